"""Intermediate tables in the shared folder, which cut lineage and outlive executors.

A written table is columnar and compressed and is computed once. It lies under
spark.checkpoint.dir; only where that is unset and the master is local (tests, a laptop) is a folder of our own used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", found)
        with contextlib.suppress(Exception):
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/gneiss-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here. codec: of the files, else as configured."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, on whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def size_of(df: DataFrame) -> int:
    """Bytes of a table made by written()."""
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._gneiss_path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later step reads."""
    for df in tables:
        if path := getattr(df, "_gneiss_path", None):
            with contextlib.suppress(Exception):
                remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
