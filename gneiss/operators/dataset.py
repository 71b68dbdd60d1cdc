"""Dataset: an immutable, lazy, unordered multiset over a DataFrame.

Scalars lie in a column ``value``, pairs in ``key`` and ``value``. Methods take Column
expressions or functions of Columns, so that Catalyst sees every step. Methods ending in ``_py``
run opaque Python callables and are the only ones that leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.folds import collected, folded


def _callable(f) -> None:
    if not callable(f):
        raise TypeError("a function is needed")


class Dataset:
    """A distributed multiset. Every transformation returns a new Dataset."""

    def __init__(self, df: DataFrame):
        if not isinstance(df, DataFrame):
            raise TypeError("a DataFrame is needed")
        self.df = df

    # -- columns ------------------------------------------------------------

    def _element(self) -> Column:
        cols = self.df.columns
        return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)

    def _args(self) -> list[Column]:
        return [self.df[c] for c in self.df.columns]

    def _apply(self, f) -> Column:
        if isinstance(f, Column):
            return f
        if isinstance(f, str):
            return F.expr(f)
        _callable(f)
        out = f(*self._args())
        return out if isinstance(out, Column) else F.lit(out)

    def _pairs(self) -> None:
        if len(self.df.columns) != 2:
            raise TypeError(f"pairs are needed, found columns {self.df.columns}")

    def _key_value(self) -> tuple[Column, Column]:
        self._pairs()
        return self._args()[0].alias("key"), self._args()[1]

    # -- per element --------------------------------------------------------

    def map(self, *fs) -> Dataset:
        """One output element for each input element. One expression gives ``value``, two give pairs;
        an alias is kept."""
        names = ["value"] if len(fs) == 1 else ["key", "value"]
        cols = [self._apply(f) for f in fs]
        if len(cols) > 2:
            return Dataset(self.df.select(*cols))
        return Dataset(self.df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)]))

    def select(self, *cols) -> Dataset:
        """A projection that keeps the given names."""
        return Dataset(self.df.select(*cols))

    def filter(self, p) -> Dataset:
        """Keep elements whose condition is true; NULL counts as false."""
        return Dataset(self.df.filter(self._apply(p)))

    def flat_map(self, f) -> Dataset:
        """One output element for each entry of an array expression; none for empty or NULL arrays."""
        return Dataset(self.df.select(F.explode(self._apply(f)).alias("value")))

    def map_partition_py(self, f: Callable[[list], list], returns: str | T.DataType) -> Dataset:
        """Call f once with the list of a partition's elements; its list becomes ONE element.

        Empty partitions call f too. returns: the type of an entry of f's list.
        """
        _callable(f)
        entry = returns if isinstance(returns, T.DataType) else T._parse_datatype_string(returns)
        rows = self._partition_lists(f)
        return Dataset(rows.map(lambda x: (x,)).toDF(T.StructType([T.StructField("value", T.ArrayType(entry))])))

    def flat_map_partition_py(self, f: Callable[[list], list], returns: str | T.DataType) -> Dataset:
        """As map_partition_py, with the entries of the lists as elements."""
        out = self.map_partition_py(f, returns)
        return Dataset(out.df.select(F.explode("value").alias("value")))

    def _partition_lists(self, f):
        scalar = len(self.df.columns) == 1

        def run(rows: Iterator[Row]):
            out = f([r[0] if scalar else tuple(r) for r in rows])
            if not isinstance(out, list):
                raise TypeError("the partition function must return a list")
            yield out

        return self.df.rdd.mapPartitions(run)

    def map_batches_py(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Dataset:
        """Arrow batches of a partition, one after the other: memory stays bounded."""
        _callable(f)
        return Dataset(self.df.mapInPandas(lambda batches: (f(b) for b in batches), schema))

    def map_py(self, f: Callable, returns: str | T.DataType) -> Dataset:
        """map() with a Python callable of the element (Arrow batches)."""
        _callable(f)
        udf = F.udf(f, returns, useArrow=True)
        return Dataset(self.df.select(udf(*self._args()).alias("value")))

    def filter_py(self, p: Callable) -> Dataset:
        """filter() with a Python callable; any truthy result keeps the element."""
        _callable(p)
        return Dataset(self.df.filter(F.udf(lambda *x: bool(p(*x)), "boolean", useArrow=True)(*self._args())))

    def flat_map_py(self, f: Callable, returns: str) -> Dataset:
        """flat_map() with a Python callable that returns an iterable. returns: an entry's type."""
        _callable(f)
        udf = F.udf(lambda *x: list(f(*x)), f"array<{returns}>", useArrow=True)
        return Dataset(self.df.select(F.explode(udf(*self._args())).alias("value")))

    # -- by key -------------------------------------------------------------

    def reduce_by_key(self, how) -> Dataset:
        """Fold the values of each key: a monoid's name (combined before the shuffle) or a Column lambda."""
        key, value = self._key_value()
        return Dataset(folded(self.df, [key], value, how))

    def reduce_by_key_py(self, f: Callable, value_type: str | None = None) -> Dataset:
        """Fold with an opaque associative, commutative callable, combined before the shuffle."""
        _callable(f)
        self._pairs()
        key, value = self.df.schema.fields
        kind = T._parse_datatype_string(value_type) if value_type else value.dataType
        schema = T.StructType([T.StructField("key", key.dataType), T.StructField("value", kind)])
        return Dataset(self.df.rdd.map(tuple).reduceByKey(f).toDF(schema))

    def group_by_key(self) -> Dataset:
        """All values of each key in one array, NULLs kept, order undefined."""
        key, value = self._key_value()
        return Dataset(self.df.groupBy(key).agg(collected(value).alias("value")))

    def count_by_key(self) -> Dataset:
        """The number of elements of each key, as a lazy Dataset."""
        key, _ = self._key_value()
        return Dataset(self.df.groupBy(key).agg(F.count("*").alias("value")))

    # -- multisets ----------------------------------------------------------

    def concat(self, other: Dataset) -> Dataset:
        """Union that keeps duplicates."""
        return Dataset(self.df.unionByName(self._other(other)))

    def distinct(self) -> Dataset:
        """Duplicates removed; NULLs are equal to each other."""
        return Dataset(self.df.distinct())

    def difference(self, other: Dataset) -> Dataset:
        """The distinct elements of self that other doesn't hold (EXCEPT DISTINCT)."""
        return Dataset(self.df.subtract(self._other(other)))

    def _other(self, other: Dataset) -> DataFrame:
        if not isinstance(other, Dataset):
            raise TypeError("a Dataset is needed")
        return other.df

    # -- actions ------------------------------------------------------------

    def collect(self) -> list:
        """All elements, in any order: scalars, or tuples if there are several columns."""
        rows = self.df.collect()
        return [r[0] for r in rows] if len(self.df.columns) == 1 else [tuple(r) for r in rows]

    def count(self) -> int:
        return self.df.count()

    def reduce(self, how):
        """Fold of all elements of a scalar Dataset; None if there are none."""
        return folded(self.df, [], self._element(), how).first()[0]

    def reduce_py(self, f: Callable):
        """Fold with an opaque callable, by a tree of partial results; None if there are no elements."""
        _callable(f)
        scalar = len(self.df.columns) == 1
        some = lambda a, b: b if a is None else a if b is None else (f(a[0], b[0]),)
        out = self.df.rdd.map(lambda r: (r[0] if scalar else tuple(r),)).treeAggregate(None, some, some)
        return None if out is None else out[0]

    def empty(self) -> bool:
        """Whether there is no element; reads one row at most."""
        return self.df.isEmpty()

    def output(self) -> None:
        print(self.collect())

    def topk_dataset(self, k: int, key=None, reverse: bool = False, ties=()) -> Dataset:
        """topk() as a lazy Dataset. ties: further columns that settle equal keys."""
        if k < 0:
            raise ValueError("k must not be negative")
        by = [self._element() if key is None else self._apply(key), *(F.col(c) for c in ties)]
        return Dataset(self.df.orderBy(*[c.desc() if reverse else c.asc() for c in by]).limit(k))

    def topk(self, k: int, key=None, reverse: bool = False, ties=()) -> list:
        """The k smallest elements in ascending order; with reverse the k largest, descending."""
        return self.topk_dataset(k, key, reverse, ties).collect()

    def foreach_py(self, f: Callable) -> None:
        """Call f on each element on the executors, for its side effects."""
        _callable(f)
        scalar = len(self.df.columns) == 1
        self.df.foreach(lambda r: f(r[0] if scalar else tuple(r)))

    def write_text(self, url: str, text=None) -> None:
        """One line for each element: its cast to string, or the given string expression.

        Several columns without an expression are written as JSON. NULL gives an empty line.
        """
        if text is not None:
            line = self._apply(text)
        else:
            line = self._element().cast("string") if len(self.df.columns) == 1 else F.to_json(F.struct(*self.df.columns))
        self.df.select(F.coalesce(line, F.lit("")).alias("value")).write.text(url)

    def cache(self) -> Dataset:
        """Compute now and keep in memory and on disk; does nothing if already kept. Returns self."""
        if not self.df.is_cached:
            self.df.persist(StorageLevel.MEMORY_AND_DISK)
            self.df.count()
        return self

    def uncache(self) -> None:
        """Drop what cache() keeps; later uses compute from the sources again."""
        if self.df.is_cached:
            self.df.unpersist(blocking=True)
