"""Word counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.dataset import Dataset


class WordCount:
    """Counts of words. Load once, then wordcount(), then read the pairs.

    from_dataset takes each element as one word; from_text splits lines on spaces and tabs and
    drops empty words. NULL elements are skipped.
    """

    def __init__(self):
        self.words: DataFrame | None = None
        self.counts: DataFrame | None = None

    def _load(self, words: DataFrame) -> WordCount:
        if self.words is not None:
            raise RuntimeError("words are already loaded")
        self.words = words.filter(F.col("word").isNotNull())
        return self

    def from_dataset(self, data: Dataset) -> WordCount:
        return self._load(data.df.select(data._element().cast("string").alias("word")))

    def from_text(self, spark: SparkSession, url: str) -> WordCount:
        return self.from_lines(spark.read.text(url), "value")

    def from_lines(self, df: DataFrame, column: str, separators: str = "[ \\t]+") -> WordCount:
        return self._load(split_words(df, column, separators))

    def wordcount(self) -> WordCount:
        if self.words is None:
            raise RuntimeError("no words are loaded")
        self.counts = self.words.groupBy("word").agg(F.count("*").alias("cnt"))
        return self

    def _counts(self) -> DataFrame:
        if self.counts is None:
            raise RuntimeError("wordcount() has not been called")
        return self.counts

    def print_all(self) -> list[tuple[str, int]]:
        """All (word, count) pairs."""
        return [tuple(r) for r in self._counts().collect()]

    def topk_frame(self, k: int) -> DataFrame:
        return self._counts().orderBy(F.desc("cnt"), F.desc("word")).limit(k)

    def topk(self, k: int) -> list[tuple[str, int]]:
        """The k words with the largest (count, word), in ascending order."""
        rows = self.topk_frame(k).collect()
        return sorted(((r["word"], r["cnt"]) for r in rows), key=lambda x: (x[1], x[0]))


def split_words(df: DataFrame, column: str, separators: str = "[ \\t]+") -> DataFrame:
    """One row for each non-empty word. Classes of spaces, tabs and line ends are split at without a regular expression."""
    text = F.col(column)
    if re.fullmatch(r"\[( |\\[tnr])* ( |\\[tnr])*\]\+", separators):
        for code, c in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            if code in separators:
                text = F.replace(text, F.lit(c), F.lit(" "))
        separators = " "
    return df.select(F.explode(F.split(text, separators)).alias("word")).filter(F.col("word") != "")
