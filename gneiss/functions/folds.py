"""Folds: named monoids and Column lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that the first stage of a general fold gathers at most.
CHUNK = 4096

#: Each has a partial aggregate, so that rows are combined before the shuffle.
MONOIDS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "product": F.product,
    "and": F.bool_and,
    "or": F.bool_or,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
}


def collected(value: Column) -> Column:
    """All values of a group, NULLs too (collect_list alone drops them)."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])


def fold(how: str | Callable[[Column, Column], Column], value: Column) -> Column:
    """An aggregate expression from a monoid's name or an associative, commutative Column lambda.

    The lambda form gathers the group's values first: folded() bounds how many. Prefer a name where one fits.
    NULL values are skipped by the named monoids and seen by the lambda.
    """
    if isinstance(how, str):
        if how not in MONOIDS:
            raise ValueError(f"unknown monoid {how!r}; known: {', '.join(sorted(MONOIDS))}")
        return MONOIDS[how](value)
    if not callable(how):
        raise TypeError("a fold is a monoid's name or a function of two Columns")
    a = collected(value)
    return F.when(F.size(a) > 0, F.reduce(F.slice(a, F.lit(2), F.size(a)), F.element_at(a, 1), how))


def folded(df: DataFrame, keys: list[Column], value: Column, how: str | Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, value): the fold of each group's values (of all values, without keys).

    A lambda is folded in two stages, of at most CHUNK values of a key in a stretch of a partition and then of these
    partial results, so that a hot key is spread over tasks and the list for its last fold is CHUNK times shorter.
    """
    if isinstance(how, str):
        return df.groupBy(*keys).agg(fold(how, value).alias("value"))
    names = [f"__k{i}" for i in range(len(keys))]
    parts = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], value.alias("__v"), F.floor(F.monotonically_increasing_id() / CHUNK).alias("__chunk"))
    some = parts.groupBy(*names, "__chunk").agg(fold(how, F.col("__v")).alias("__v"))
    out = some.groupBy(*names).agg(fold(how, F.col("__v")).alias("value"))
    titles = df.select(*keys).columns
    return out.select(*[F.col(n).alias(t) for n, t in zip(names, titles, strict=True)], "value")
