"""Linear models by full-batch gradient descent: each step is one aggregation of the gradient.

Features are scaled to mean 0 and deviation 1 for training (but for the SVM); the parameters are given back in the
scale of the input, so that predict() takes plain features. Rows with a NULL feature array or
label are left out; shorter arrays count as filled with zeros.

Sparse rows are arrays of (i, v) with indices from 0. They are never filled: tasks get the weights as one array and send
sums for the indices they met. Shifting would fill them, so they are scaled by their root mean square alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.dataset import Dataset

#: Wider features are summed through one row for each (row, feature) instead of one column for each.
WIDE = 256


def dot(features: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """X·w + b. Elements are added in order of their index."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    terms = F.zip_with(features, w, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.lit(float(intercept))


def read_tsv(spark: SparkSession, url: str) -> DataFrame:
    """Whitespace separated numbers, the last of which is the label."""
    f = F.transform(F.split(F.trim(F.col("value")), "\\s+"), lambda x: x.cast("double"))
    return spark.read.text(url).filter(F.trim("value") != "").select(F.slice(f, F.lit(1), F.size(f) - 1).alias("features"), F.element_at(f, -1).alias("label"))


SPARSE = "array<struct<i:int,v:double>>"


def read_libsvm_sparse(spark: SparkSession, url: str) -> DataFrame:
    """libsvm lines (label index:value ..., indices from 1) as arrays of (i, v), indices from 0."""
    fields = F.split(F.trim(F.col("value")), "\\s+")
    pairs = F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda x: F.struct((F.split(x, ":")[0].cast("int") - 1).alias("i"), F.split(x, ":")[1].cast("double").alias("v")))
    return spark.read.text(url).filter(F.trim("value") != "").select(pairs.cast(SPARSE).alias("features"), F.element_at(fields, 1).cast("double").alias("label"))


def read_libsvm(spark: SparkSession, url: str) -> DataFrame:
    """libsvm lines (label index:value ..., indices from 1) as dense arrays."""
    fields = F.split(F.trim(F.col("value")), "\\s+")
    rows = spark.read.text(url).filter(F.trim("value") != "").select(
        F.element_at(fields, 1).cast("double").alias("label"),
        F.map_from_entries(F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double")))).alias("m"),
    )
    width = rows.select(F.max(F.array_max(F.map_keys("m")))).first()[0] or 0
    dense = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))) if width else F.array().cast("array<double>")
    return rows.select(dense.alias("features"), "label")


class LinearModel:
    """Shared by the three models: loading, scaling, descent and parameters."""

    #: Labels below this become 0 when read from a file.
    floor_labels = False

    def __init__(self, n_feature: int = -1):
        self.n_feature, self.data, self.weights, self.intercept = n_feature, None, None, None

    def load_text(self, spark: SparkSession, url: str, is_sparse: int = 0, fmat: str = "tsv") -> LinearModel:
        df = read_tsv(spark, url) if fmat == "tsv" else (read_libsvm_sparse if is_sparse else read_libsvm)(spark, url)
        return self.load_frame(df.withColumn("label", F.when(F.col("label") < 0, 0.0).otherwise(F.col("label"))) if self.floor_labels else df)

    def load_dataset(self, data: Dataset, is_sparse: int = 0) -> LinearModel:
        """Pairs (features, label)."""
        if len(data.df.columns) != 2:
            raise TypeError("pairs of features and label are needed")
        return self.load_frame(data.df.toDF("features", "label"))

    def load_frame(self, df: DataFrame) -> LinearModel:
        self.sparse = "struct" in df.schema["features"].dataType.simpleString()
        self.data = df.select(F.col("features").cast(SPARSE if self.sparse else "array<double>").alias("features"), F.col("label").cast("double").alias("label")).dropna()
        return self

    sparse = False

    def load_train_set(self, source, is_sparse: int = 1, format: str = "libsvm", spark: SparkSession | None = None) -> LinearModel:
        """A URL, a list of (features, label) or a Dataset."""
        if isinstance(source, str):
            return self.load_text(spark or SparkSession.getActiveSession(), source, is_sparse, format)
        if isinstance(source, Dataset):
            return self.load_dataset(source, is_sparse)
        if isinstance(source, list):
            spark = spark or SparkSession.getActiveSession()
            return self.load_frame(spark.createDataFrame([([float(v) for v in x], float(y)) for x, y in source], "features array<double>, label double"))
        raise TypeError("a URL, a list or a Dataset is needed")

    def slope(self, margin: Column, label: Column) -> Column:
        """The derivative of a row's loss by its margin."""
        raise NotImplementedError

    @staticmethod
    def slopes(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
        """slope() of whole arrays."""
        raise NotImplementedError

    def _sparse_sums(self, df: DataFrame, weights: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """The sums of slope * feature by index, and of slope, in one pass over sparse rows."""
        slopes, width = type(self).slopes, len(weights)

        def run(batches):
            for batch in batches:
                rows = batch.column(0)
                at = np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy())
                flat = rows.flatten()
                i, v = flat.field("i").to_numpy(), flat.field("v").to_numpy(zero_copy_only=False)
                g = slopes(np.bincount(at, weights[i] * v, minlength=batch.num_rows) + intercept, batch.column(1).to_numpy())
                met, where = np.unique(i, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(met, width), pa.int32()), pa.array(np.append(np.bincount(where, v * g[at], minlength=len(met)), g.sum()))], names=["i", "s"])

        got = df.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        sums = np.zeros(width + 1)
        sums[got.column("i").to_numpy()] = got.column("s").to_numpy()
        return sums[:-1], float(sums[-1])

    def _train_sparse(self, n_iter: int, alpha: float) -> LinearModel:
        df = self.data.persist()
        try:
            each = df.select(F.explode("features").alias("f")).select("f.i", "f.v")
            n = df.count()
            got = each.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s")).toArrow()
            at = got.column("i").to_numpy()
            width = max(int(at.max(initial=-1)) + 1, self.n_feature)
            if not n or not width:
                raise ValueError("the training data are empty")
            scale = np.ones(width)
            scale[at] = np.sqrt(got.column("s").to_numpy() / n)
            scale[scale == 0] = 1.0
            w, b = np.zeros(width), 0.0
            for _ in range(n_iter):
                g, g0 = self._sparse_sums(df, w / scale, b)
                w, b = w - alpha * g / scale / n, b - alpha * g0 / n
        finally:
            df.unpersist()
        self.weights, self.intercept = (w / scale).tolist(), b
        return self

    def _sums(self, df: DataFrame, parts: list[Column], width: int) -> list[list[float]]:
        """For each array expression, the sums of its elements by index, in one pass."""
        if width <= WIDE:
            row = df.agg(*[F.sum(p[j]).alias(f"s{i}_{j}") for i, p in enumerate(parts) for j in range(width)]).first()
            return [[float(row[f"s{i}_{j}"] or 0.0) for j in range(width)] for i in range(len(parts))]
        out = []
        for p in parts:
            got = dict(df.select(F.posexplode(p)).groupBy("pos").agg(F.sum("col")).collect())
            out.append([float(got.get(j) or 0.0) for j in range(width)])
        return out

    def train(self, n_iter: int = 10, alpha: float = 0.1, is_sparse: int = 1) -> LinearModel:
        """n_iter steps of size alpha."""
        if self.data is None:
            raise RuntimeError("no training data are loaded")
        if self.sparse:
            return self._train_sparse(n_iter, alpha)
        n, width = self.data.agg(F.count("*"), F.max(F.size("features"))).first()
        if not n or not width:
            raise ValueError("the training data are empty")
        width = max(width, self.n_feature)
        filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("features", i), F.lit(0.0)))
        df = self.data.select(filled.alias("x"), "label").persist()
        try:
            one, two = self._sums(df, [F.col("x"), F.transform("x", lambda v: v * v)], width)
            mean = [a / n for a in one]
            dev = [math.sqrt(max(b / n - m * m, 0.0)) or 1.0 for b, m in zip(two, mean, strict=True)]
            w, b = [0.0] * width, 0.0
            for step in range(n_iter):
                plain, at = self._unscaled(w, b, mean, dev)
                slope = self.slope(dot(F.col("x"), plain, at), F.col("label"))
                row = df.select("x", slope.alias("g"))
                moved = F.concat(F.transform("x", lambda v: v * F.col("g")), F.array("g"))
                sums = self._sums(row, [moved], width + 1)[0]
                g = [(s - m * sums[-1]) / d / n for s, m, d in zip(sums[:-1], mean, dev, strict=True)]
                w = [x - alpha * y for x, y in zip(w, g, strict=True)]
                b -= alpha * sums[-1] / n
        finally:
            df.unpersist()
        self.weights, self.intercept = self._unscaled(w, b, mean, dev)
        return self

    @staticmethod
    def _unscaled(w, b, mean, dev) -> tuple[list[float], float]:
        plain = [x / d for x, d in zip(w, dev, strict=True)]
        return plain, b - sum(x * m for x, m in zip(plain, mean, strict=True))

    def _trained(self) -> None:
        if self.weights is None:
            raise RuntimeError("train() has not been called")

    def get_param(self) -> list[float]:
        self._trained()
        return list(self.weights)

    def get_intercept(self) -> float:
        self._trained()
        return self.intercept

    def predict(self, x: Sequence[float]) -> float:
        """The raw margin X·w + b."""
        self._trained()
        return sum(a * b for a, b in zip(x, self.weights, strict=False)) + self.intercept

    def predict_column(self, features: Column) -> Column:
        """The margin as a Column expression."""
        self._trained()
        return dot(features, self.weights, self.intercept)


class LinearRegressionModel(LinearModel):
    """Squared loss."""

    def slope(self, margin: Column, label: Column) -> Column:
        return margin - label

    @staticmethod
    def slopes(margin, label):
        return margin - label


class LogisticRegressionModel(LinearModel):
    """Logistic loss on labels 0 and 1. predict() gives the margin, probability() its sigmoid."""

    floor_labels = True

    def slope(self, margin: Column, label: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-margin)) - label

    @staticmethod
    def slopes(margin, label):
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))) - label

    def probability(self, x: Sequence[float]) -> float:
        return 1.0 / (1.0 + math.exp(-self.predict(x)))


class SVMModel(LinearModel):
    """Hinge loss with an L2 penalty, by projected subgradient steps; labels above 0 are one class, the others the other.

    Step i (from 0) brings the weights into the ball of radius 1 / sqrt(penalty), then goes by eta = 1 / (i + 1) along the rows
    inside the margin. Features are taken as they are, and steps have no size of the caller's.
    """

    def __init__(self, n_feature: int = -1, penalty: float = 0.01):
        super().__init__(n_feature)
        self.penalty = penalty

    def slope(self, margin: Column, label: Column) -> Column:
        y = F.when(label > 0, 1.0).otherwise(-1.0)
        return F.when(y * margin < 1.0, -y).otherwise(0.0)

    @staticmethod
    def slopes(margin, label):
        y = np.where(label > 0, 1.0, -1.0)
        return np.where(y * margin < 1.0, -y, 0.0)

    def train(self, n_iter: int = 10, alpha: float | None = None, is_sparse: int = 1) -> LinearModel:
        """n_iter steps; alpha is ignored."""
        if self.data is None:
            raise RuntimeError("no training data are loaded")
        top = F.array_max(F.transform("features", lambda x: x["i"])) + 1 if self.sparse else F.size("features")
        n, width = self.data.agg(F.count("*"), F.max(top)).first()
        if not n or not width:
            raise ValueError("the training data are empty")
        width = max(width, self.n_feature)
        filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("features", i), F.lit(0.0)))
        df = (self.data if self.sparse else self.data.select(filled.alias("x"), "label")).persist()
        w, b = np.zeros(width), 0.0
        try:
            for step in range(n_iter):
                norm = float(w @ w)
                near = min(1.0, 1.0 / math.sqrt(norm * self.penalty)) if norm else 1.0
                w, eta = w * near, 1.0 / (step + 1)
                if self.sparse:
                    g, g0 = self._sparse_sums(df, w, b * near)
                else:
                    row = df.select("x", self.slope(dot(F.col("x"), w.tolist(), b * near), F.col("label")).alias("g"))
                    sums = self._sums(row, [F.concat(F.transform("x", lambda v: v * F.col("g")), F.array("g"))], width + 1)[0]
                    g, g0 = np.array(sums[:-1]), sums[-1]
                w, b = (1 - eta) * w - eta / (n * self.penalty) * g, b - eta / n * g0
        finally:
            df.unpersist()
        self.weights, self.intercept = w.tolist(), b
        return self
