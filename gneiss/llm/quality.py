"""Quality scores of documents by a factorisation machine.

Features are hashed words, binned structure statistics of the text and hashed values of metadata columns (METADATA, where
the documents have them; numbers by their order of magnitude). Labels, lang, source and doc_id are never among them. The score is w0 + sum w x + half the sum over factors of ((sum v x)^2 - sum v^2 x^2),
linear in the number of features, through a sigmoid. The model is trained on a bounded sample
of labelled documents (PER_CLASS for each label); every document is scored from its whole text.

Rows: null texts count as empty and get a score too. A null doc_id is allowed. If no labelled
training row exists, every score is 0.5. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.labelled import held_out, training_texts
from gneiss.llm.words import bounded_batches, chunks_with_bytes, column_bytes, list_array, mix

#: Labelled documents of each class that training reads at most.
PER_CLASS = 3000
BUCKETS, FACTORS, BINS = 1 << 15, 8, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 128, 0.08, 1e-5, 7
#: Statistics, each scaled to 0..1 and binned.
STATISTICS = 12
#: Columns of the documents that are features of their own and in pairs with all others.
METADATA = ("n_chars",)
WIDTH = STATISTICS * BINS + BUCKETS

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[65:91] = 1  # capitals
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[44, 46, 59, 58, 39, 45, 63]] = 4  # ordinary punctuation
_CLASS[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = 5  # symbols
_CLASS[128:] = 2
_CLASS[10] = 6


def _share(a, b):
    return a / np.maximum(b, 1)


def features(column: pa.Array, metadata: Sequence[pa.Array] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges (from, to): row offsets, feature indices and values."""
    for lo, hi, hashes, offsets, raw, starts, stops in chunks_with_bytes(column, lower=False):
        n, rows = np.diff(offsets), hi - lo
        row = np.repeat(np.arange(rows), n)
        kinds = _CLASS[raw]
        # Bytes belong to rows: each row ends with the line feed that was put after it.
        row_of_byte = _rows_of_bytes(column, lo, hi, len(raw))
        count = lambda k: np.bincount(row_of_byte[kinds == k], minlength=rows)
        capitals, small, digits, points, symbols, lines = (count(k) for k in (1, 2, 3, 4, 5, 6))
        letters = capitals + small
        size = np.bincount(row, (stops - starts), minlength=rows)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
        pair, counts = np.unique(row * np.int64(BUCKETS) + bucket, return_counts=True)
        at, word = pair // BUCKETS, pair % BUCKETS
        distinct = np.bincount(at, minlength=rows)
        most = np.zeros(rows)
        np.maximum.at(most, at, counts)
        odd = np.bincount(row[(stops - starts) == 1], minlength=rows)
        stats = np.stack([
            np.log1p(n) / 12, _share(size, n) / 16, _share(capitals, letters), _share(digits, size), _share(points, n), _share(symbols, n) / 2,
            _share(distinct, n), _share(most, n), _share(np.bincount(row[again], minlength=rows), n), _share(lines, n), _share(odd, n), np.log1p(_share(size, lines)) / 12,
        ], axis=1)
        bins = np.clip((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), 0, BINS - 1) + np.arange(STATISTICS) * BINS
        extra = [_metadata_bucket(c.slice(lo, rows), k) for k, c in enumerate(metadata)]
        idx = np.concatenate([bins.ravel(), word + STATISTICS * BINS, *extra])
        val = np.concatenate([np.full(bins.size, 0.5), np.sqrt(counts / np.maximum(n[at], 1)), *[np.full(rows, 0.5) for _ in extra]])
        own = np.concatenate([np.repeat(np.arange(rows), STATISTICS), at, *[np.arange(rows) for _ in extra]])
        order = np.argsort(own, kind="stable")
        yield lo, hi, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]), idx[order], val[order]


def _rows_of_bytes(column: pa.Array, lo: int, hi: int, size: int) -> np.ndarray:
    _, at = column_bytes(column)
    return np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]) + 1)


def _metadata_bucket(values: pa.Array, k: int) -> np.ndarray:
    plain = lambda v: round(4 * math.log2(1 + abs(v))) if isinstance(v, int | float) and math.isfinite(v) else v
    text = [f"{k}={plain(v)}" for v in values.to_pylist()]
    h = mix(np.array([zlib.crc32(t.encode()) for t in text], dtype=np.uint64))
    return (h % np.uint64(BUCKETS)).astype(np.int64) + STATISTICS * BINS


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def _sums(self, idx, val, offsets):
        vx = self.v[idx] * val[:, None]
        at = offsets[:-1]
        return vx, np.add.reduceat(vx, at, axis=0), np.add.reduceat(vx * vx, at, axis=0), np.add.reduceat(self.w[idx] * val, at)

    def margin(self, offsets: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Of rows that each have a feature at least."""
        _, s, q, linear = self._sums(idx, val, offsets)
        return self.w0 + linear + 0.5 * (s * s - q).sum(axis=1)

    def score(self, offsets: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(offsets, idx, val), -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
    """Adaptive-rate gradient descent on the logistic loss, over (indices, values) of each row."""
    rng = np.random.default_rng(SEED)
    m = FactorisationMachine(0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    if not len(rows) or len(set(y.tolist())) < 2:
        return FactorisationMachine(0.0, m.w, np.zeros_like(m.v))
    gw, gv, g0 = np.full(WIDTH, 1e-3), np.full((WIDTH, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in part])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            vx, s, q, linear = m._sums(idx, val, offsets)
            margin = m.w0 + linear + 0.5 * (s * s - q).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[part]) / len(part)
            ge = np.repeat(g, sizes)
            seen, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, ge * val) + DECAY * m.w[seen]
            dv = np.zeros((len(seen), FACTORS))
            np.add.at(dv, inverse, (ge * val)[:, None] * (np.repeat(s, sizes, axis=0) - vx))
            dv += DECAY * m.v[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            m.w[seen] -= RATE * dw / np.sqrt(gw[seen])
            m.v[seen] -= RATE * dv / np.sqrt(gv[seen])
            g0 += g.sum() ** 2
            m.w0 -= RATE * g.sum() / np.sqrt(g0)
    return m


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta = [batch.column(i) for i in range(2, batch.num_columns)]
        for lo, hi, offsets, idx, val in features(batch.column(0), meta):
            cut = list(zip(offsets[:-1], offsets[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), list_array([idx[a:b] for a, b in cut], pa.int32()), list_array([val[a:b] for a, b in cut], pa.float32())], names=["y", "idx", "val"])


def _metadata(docs: DataFrame, metadata: Sequence[str]) -> list[str]:
    """Those that the documents have and that may be features."""
    return [c for c in metadata if c in docs.columns and c not in ("text", "doc_id", "lang", "source")]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, metadata: Sequence[str] = METADATA) -> FactorisationMachine:
    """Train on at most 2 * per_class labelled documents outside the held-out ids."""
    bounded_batches(docs.sparkSession)
    got = training_texts(docs, labels, label, per_class, _metadata(docs, metadata)).mapInArrow(_training_features, "y int, idx array<int>, val array<float>").toArrow()
    columns = [got.column(c).combine_chunks() for c in ("idx", "val")]
    cut = np.concatenate([[0], np.cumsum(columns[0].value_lengths().to_numpy())]) if len(got) else np.zeros(1, int)
    idx, val = (c.flatten().to_numpy() for c in columns)
    rows = [(idx[a:b], val[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    y = got.column("y").to_numpy().astype(float)
    # Rows arrive in any order: training must not depend on it.
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i][0]), rows[i][0].tobytes(), rows[i][1].tobytes()))
    return train([rows[i] for i in order], y[order] if len(order) else y)


def _scores(model: FactorisationMachine, metadata: int):
    """Batches of (text, metadata columns, others) with a last column for the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, idx, val in features(batch.column(0), [batch.column(1 + i) for i in range(metadata)]):
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(1 + metadata, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(offsets, idx, val))], names=[*batch.schema.names[1 + metadata :], SCORE])

    return run


#: A name that no column of the documents has.
SCORE = "__gneiss_quality"


def _with_scores(docs: DataFrame, model: FactorisationMachine, columns: list[Column], metadata: Sequence[str]) -> DataFrame:
    """columns of docs, and SCORE."""
    bounded_batches(docs.sparkSession)
    used = _metadata(docs, metadata)
    rows = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(c).alias(f"__m{i}") for i, c in enumerate(used)], *columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1 + len(used) :])
    return rows.mapInArrow(_scores(model, len(used)), f"{fields}, {SCORE} double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.5, metadata: Sequence[str] = METADATA) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, label, per_class, metadata)
    out = _with_scores(docs, model, [F.col("doc_id").cast("bigint").alias("doc_id")], metadata)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5, metadata: Sequence[str] = METADATA) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    out = _with_scores(docs, fit(docs, labels, "quality", per_class, metadata), [F.col(f"`{c}`") for c in docs.columns], metadata)
    return out.filter(F.col(SCORE) >= threshold).drop(SCORE)
