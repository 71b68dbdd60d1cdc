"""Sessions and sources. Every source gives a Dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.dataset import Dataset

_own: list[SparkSession] = []


def start(master: str | None = None, conf: dict[str, str] | None = None, quiet: bool = False) -> SparkSession:
    """The active session, or a new one, which stop() then ends."""
    if active := SparkSession.getActiveSession():
        return active
    builder = SparkSession.builder.config(map={"spark.sql.session.timeZone": "UTC", **(conf or {})})
    spark = (builder.master(master) if master else builder).getOrCreate()
    if quiet:
        spark.sparkContext.setLogLevel("ERROR")
    _own.append(spark)
    return spark


def stop() -> None:
    """End the session that start() made; a session of the caller's own is left alone."""
    while _own:
        _own.pop().stop()


def _kind(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {int, float}:
        raise TypeError("integers and floats in one list: convert them first")
    if len(kinds) > 1:
        raise TypeError(f"one element type is needed, found {sorted(k.__name__ for k in kinds)}")
    return T._infer_type(next(v for v in values if v is not None))


def from_list(spark: SparkSession, data: list, schema: str | T.StructType | None = None) -> Dataset:
    """A Dataset of a list: scalars in ``value``, 2-tuples or 2-lists in ``key`` and ``value``.

    The types come from the values (of an empty list: string) unless a schema is given.
    """
    if not isinstance(data, list):
        raise TypeError("a list is needed")
    pairs = bool(data) and all(isinstance(x, tuple | list) and len(x) == 2 for x in data)
    rows = [tuple(x) for x in data] if pairs else [(x,) for x in data]
    if schema is None:
        names = ["key", "value"] if pairs else ["value"]
        columns = list(zip(*rows, strict=True)) if rows else [()]
        schema = T.StructType([T.StructField(n, _kind(list(c))) for n, c in zip(names, columns, strict=True)])
    return Dataset(spark.createDataFrame(rows, schema))


def load(spark: SparkSession, path: str) -> Dataset:
    """Lines of text files, one element each. ``nfs:`` paths are local mounts; other schemes as Spark reads them."""
    if not isinstance(path, str) or not path:
        raise ValueError("a path is needed")
    where = "file://" + path[4:].replace("//", "/", 1) if path.startswith("nfs:") else path
    return Dataset(spark.read.text(where))


class hdfs:
    """hdfs(spark, host, port).load(path): lines of files on that name node."""

    def __init__(self, spark: SparkSession, host: str, port: int | str):
        self.spark, self.root = spark, f"hdfs://{host}:{port}"

    def url(self, path: str) -> str:
        return path if "://" in path else f"{self.root}/{path.lstrip('/')}"

    def load(self, path: str) -> Dataset:
        return load(self.spark, self.url(path))


class mongodb:
    """mongodb(spark, host, port).auth(user, password).load(database, collection): a JSON string for each document.

    Needs the MongoDB Spark connector on the class path.
    """

    def __init__(self, spark: SparkSession, host: str, port: int | str):
        self.spark, self.host, self.port, self.login = spark, host, port, ""

    def auth(self, user: str, password: str) -> mongodb:
        from urllib.parse import quote_plus

        self.login = f"{quote_plus(user)}:{quote_plus(password)}@"
        return self

    def options(self, database: str, collection: str) -> dict[str, str]:
        return {"connection.uri": f"mongodb://{self.login}{self.host}:{self.port}/", "database": database, "collection": collection}

    def load(self, database: str, collection: str) -> Dataset:
        try:
            df = self.spark.read.format("mongodb").options(**self.options(database, collection)).load()
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
                raise RuntimeError("the MongoDB Spark connector is not on the class path") from e
            raise
        return Dataset(df.select(F.to_json(F.struct("*")).alias("value")))


def parquet(spark: SparkSession, path: str, *columns: str) -> Dataset:
    """Columns of Parquet files (all, if none is named)."""
    df: DataFrame = spark.read.parquet(path)
    return Dataset(df.select(*columns) if columns else df)
