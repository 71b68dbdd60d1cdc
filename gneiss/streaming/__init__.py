"""Keyed folds over streams (an extension: the batch semantics of reduce_by_key, run incrementally)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.folds import fold


def running_reduce_by_key(stream: DataFrame, key: Column, value: Column, how: str) -> DataFrame:
    """reduce_by_key of all rows seen so far; write it in update or complete mode. Named monoids only."""
    if not isinstance(how, str):
        raise TypeError("streams fold by a monoid's name")
    return stream.groupBy(key.alias("key")).agg(fold(how, value).alias("value"))


def windowed_reduce_by_key(stream: DataFrame, time: str, window: str, late: str, key: Column, value: Column, how: str) -> DataFrame:
    """reduce_by_key for each tumbling window; a window's state goes once it is older than ``late``."""
    bucket = F.window(F.col(time), window)
    return stream.withWatermark(time, late).groupBy(bucket, key.alias("key")).agg(fold(how, value).alias("value"))
