"""Training rows for the classifiers: a bounded sample of labelled documents, in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; of a null id, that of the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 == 1


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: Sequence[str] = ()) -> DataFrame:
    """(text, y and the columns) of up to per_class labelled documents of each class that aren't held out.

    The sample is bounded by 2 * per_class ids, so it may be broadcast. Null labels are left out;
    of contradicting labels the larger holds.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = one.filter("y = 1").orderBy(*order).limit(per_class).union(one.filter("y = 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__m{i}") for i, c in enumerate(columns)]).filter(F.col("text").isNotNull())
    return rows.join(F.broadcast(picked), "doc_id").select("text", "y", *[f"__m{i}" for i in range(len(columns))])
