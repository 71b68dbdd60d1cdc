"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read through memory maps.

Texts become runs of about RUN tokens (words with A-Z lower-cased, then one end): one row each, with the run's distinct
words as hashes and its tokens as places among them. An n-gram is a hash of its words; a document begins after
order - 1 starts, so that each token ends an n-gram of the full order.

From the full order down to single words, every run sends its distinct n-grams, sorted by hash, to hash ranges. A range's task
merges what the runs know of an n-gram, and answers every run in the order of its own n-grams: so no key travels back.
Of the full order runs send counts; an answer also tells one run that it owns the n-gram. Owners alone then count: for the
order below, distinct n-grams by their endings (the lower order's counts), and sums and numbers of counts by their
contexts. An answer is stored as arrays in the order of the run's sorted hashes, which the worker that scores the run maps into memory.

So a worker holds one run and one range at a time, never the model, whatever the corpus. Hashes spread n-grams over ranges,
and a frequent one is one entry of each run, so no range is hot. Runs and ranges grow with the square root of the
corpus (run_tokens()), so that there are not more blocks between them than n-grams. Arrays lie in the shared folder; where
that isn't a mounted file system, a worker copies those of its run.

Hashes of n-grams keep so many bits (key_bits()) that about one in 200,000 meets another; those of words keep 64.

Rows: null texts count as empty: their only token is the end. Rows that repeat count each time. A null
doc_id has the crc32 of the empty text. An empty table gives an empty result; without training rows
every probability is 1. Extra columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, new_path, written
from gneiss.llm.labelled import crc_of_id
from gneiss.llm.words import bounded_batches, chunks, mix

ORDER = 3
#: Tokens of a run, and n-grams of a range, in a small corpus.
RUN = 1 << 20

_END, _START = np.uint64(0x5EED0FE4D0FD0C05), np.uint64(0xB0F0B0F0C0FFEE11)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What is known of an n-gram: its count (in the lower orders: of n-grams that end in it); of those that begin with it the
#: sum of counts, and how many have count 1, 2, more; of a word its occurrences. Nearly all are nothing or as these.
_USUAL = np.array([1, 1, 1, 0, 0, 1])


def run_tokens(tokens: int) -> int:
    return max(RUN, 8 * math.isqrt(tokens))


def key_bits(tokens: int) -> int:
    return min(64, 18 + max(1, tokens).bit_length())


# -- arrays on their way and in files -------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes by significance: those that are all alike shrink to nothing when rows are compressed."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Store arrays as .npy files; a repeated task writes the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    for key, a in arrays.items():
        buf, temp = io.BytesIO(), f"{path}/.{name}.{key}.{uuid.uuid4().hex}"
        np.save(buf, a)
        with fs.open_output_stream(temp) as out:
            out.write(buf.getbuffer())
        fs.move(temp, f"{path}/{name}.{key}.npy")


def _load(folder: str, name: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with fs.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def _width(n: int, order: int) -> int:
    """The number of fields of an n-gram."""
    return 1 if n == order else 5 if n > 1 else 6


def _kinds(fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns are all zero, and which are the usual ones."""
    return ~fields.any(axis=0), (fields == _USUAL[: len(fields), None]).all(axis=0)


def _spread(zero: np.ndarray, usual: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rest), len(zero)), np.int64)
    out[:, usual] = _USUAL[: len(rest), None]
    out[:, ~(zero | usual)] = rest
    return out


def _packed(fields: np.ndarray) -> bytes:
    """Columns of fields as bytes: two bits for each, and those that are neither zero nor usual."""
    zero, usual = _kinds(fields)
    rest = fields[:, ~(zero | usual)]
    kind = np.uint32 if rest.max(initial=0) < 2**32 else np.uint64
    return b"".join([bytes([np.dtype(kind).itemsize]), np.packbits(zero).tobytes(), np.packbits(usual).tobytes(), *[_planes(f.astype(kind)) for f in rest]])


def _unpacked(raw: bytes, width: int, size: int) -> np.ndarray:
    kind, bits = np.uint32 if raw[0] == 4 else np.uint64, (size + 7) // 8
    zero, usual = (np.unpackbits(np.frombuffer(raw, np.uint8, bits, 1 + i * bits), count=size).astype(bool) for i in range(2))
    m = size - int((zero | usual).sum())
    at = 1 + 2 * bits
    rest = [_unplaned(raw[at + i * m * raw[0] : at + (i + 1) * m * raw[0]], kind).astype(np.int64) for i in range(width)]
    return _spread(zero, usual, np.stack(rest))


def _known(folder: str, n: int, run: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The answer to a run: the fields of its n-grams in the order of their hashes, and whether it owns them. One byte each is stored, and larger values apart."""
    zero, usual, own = (np.unpackbits(x, count=size).astype(bool) for x in _load(folder, f"{n}-{run}.bits"))
    rest, large = _load(folder, f"{n}-{run}.small").astype(np.int64), _load(folder, f"{n}-{run}.large")
    rest[large[0], large[1]] = large[2]
    return _spread(zero, usual, rest), own


# -- runs -------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row for each run: its number, documents (id, whether it trains, tokens), words and tokens. Rows: doc_id, trains, text."""
    held, n, turn = [], 0, 0
    part = TaskContext.get().partitionId()

    def send():
        ids = pa.concat_arrays([h[0] for h in held])
        trains, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        words, at, often = np.unique(np.concatenate([*[h[3] for h in held], np.array([_START])]), return_inverse=True, return_counts=True)
        # Frequent words have small numbers, which take little room.
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        words, at = words[order], number[at]
        values = [(part << 32) + turn, ids.to_pylist(), trains.astype(np.uint8).tobytes(), sizes.astype(np.int64).tobytes(), _planes(words), _planes(at[:-1])]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["run", "ids", "trains", "sizes", "words", "tokens"])

    for batch in batches:
        for lo, hi, hashes, offsets in chunks(batch.column(2)):
            tokens = np.insert(hashes, offsets[1:], _END)
            held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False), np.diff(offsets) + 1, tokens))
            n += len(tokens)
            if n >= size:
                yield send()
                held, n, turn = [], 0, turn + 1
    if held:
        yield send()


_RUNS = "run bigint, ids array<bigint>, trains binary, sizes binary, words binary, tokens binary"


class Run:
    """The n-grams of a run's tokens."""

    def __init__(self, row: dict, bits: int):
        self.run, self.ids, self.bits = row["run"], row["ids"], bits
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.hashes = _unplaned(row["words"], np.uint64)[_unplaned(row["tokens"], np.uint32)]
        self.trains = np.repeat(np.frombuffer(row["trains"], np.uint8).astype(bool), self.sizes)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.place = np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)

    def _keys(self, n: int) -> tuple[np.ndarray, np.uint64]:
        """The hash of the n-gram that ends at each token, and that of n starts."""
        key, start = self.hashes, np.array([_START])
        for k in range(1, n):
            before = np.full(len(key), _START)
            inside = self.place >= k
            before[inside] = self.hashes[np.flatnonzero(inside) - k]
            key, start = mix(key * _STEP + mix(before + np.uint64(k))), mix(start * _STEP + mix(np.array([_START]) + np.uint64(k)))
        if n > 1:
            cut = np.uint64(64 - self.bits)
            key, start = key >> cut << cut, start >> cut << cut
        return key, start[0]

    def grams(self, n: int, with_start: bool = True, ends: bool = False) -> tuple[np.ndarray, ...]:
        """The sorted distinct n-grams, the place among them of that which ends at each token (and last, of n starts), and, if asked for, a token that ends each."""
        key, start = self._keys(n)
        found, *first, at = np.unique(np.append(key, start) if with_start else key, return_index=ends, return_inverse=True)
        return found, at, *first

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Of each token, the place of the n-gram before it, from places as of grams()."""
        out = np.empty(len(self.hashes), at.dtype)
        out[1:] = at[: len(self.hashes) - 1]
        out[self.starts] = at[-1]
        return out


def _each_run(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[Run]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Run({c: batch.column(c)[i].as_py() for c in batch.schema.names}, bits)


# -- counting ---------------------------------------------------------------------


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges in the order of the hashes."""
    return ((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _requests(n: int, order: int, folder: str, ranges: int, bits: int):
    """What each run knows of its n-grams, for each range: the hashes as differences, and the fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each_run(batches, bits):
            keys, at = r.grams(n, n < order)
            count = lambda places, weights=None: np.bincount(places, weights, minlength=len(keys)).astype(np.int64)
            tokens = at[: len(r.hashes)]
            fields = [count(tokens[r.trains])] if n in (1, order) else []
            if n < order:
                longer, _, first = r.grams(n + 1, n + 1 < order, ends=True)
                known, own = _known(folder, n + 1, r.run, len(longer))
                counts, first = known[0, own], first[own]
                begins = r.contexts(at)[first]
                fields = [count(tokens[first]), count(begins, counts), *[count(begins[x]) for x in (counts == 1, counts == 2, counts >= 3)], *fields]
            fields = np.stack(fields)
            range_ = _range_of(keys, ranges)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(range_)) + 1, [len(keys)]])
            parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            sent = [_packed(fields[:, a:b]) for a, b in parts]
            arrays = [pa.array([int(range_[a]) for a, _ in parts], pa.int64()), pa.array([r.run] * len(parts), pa.int64()), pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()), pa.array(sent, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["range", "run", "keys", "fields"])

    return run


#: Sums over a range: numbers of n-grams with counts 1 to 4 and more, counts in all, and of words those that occur and their occurrences.
_SUMS = ["k1", "k2", "k3", "k4", "k5", "counts", "words", "tokens"]


def _answers(n: int, order: int):
    """For each run, the fields of its n-grams over all runs, and whether it owns them; and a row without run for the sums."""

    def run(key, table):
        table = table.sort_by("run")
        keys = [np.cumsum(_unplaned(b.as_py(), np.uint64), dtype=np.uint64) for b in table.column("keys")]
        sizes = [len(k) for k in keys]
        width = _width(n, order)
        each = np.concatenate([_unpacked(b.as_py(), width, s) for b, s in zip(table.column("fields"), sizes, strict=True)], axis=1)
        flat = np.concatenate(keys)
        order_ = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], np.diff(flat[order_]) != 0])
        at = np.empty(len(flat), np.int64)
        at[order_] = np.cumsum(new) - 1
        fields = np.stack([np.bincount(at, f) for f in each]).astype(np.int64)
        # The first run that counted an n-gram owns it.
        some = np.flatnonzero(each[0])
        own = np.zeros(len(flat), bool)
        own[some[np.unique(at[some], return_index=True)[1]]] = True
        cuts = np.cumsum([0, *sizes]).tolist()
        out = [np.packbits(own[a:b]).tobytes() + _packed(fields[:, at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        k = np.bincount(np.minimum(fields[0], 5), minlength=6)[1:]
        sums = [*k.tolist(), int(fields[0].sum()), int((fields[-1] > 0).sum()), int(fields[-1].sum())]  # the last two: of words
        rows = len(sizes)
        return pa.table({
            "run": pa.array([*table.column("run").to_pylist(), None], pa.int64()), "range": pa.array([key[0].as_py()] * (rows + 1), pa.int64()),
            "size": pa.array([*sizes, 0], pa.int64()), "fields": pa.array([*out, b""], pa.binary()),
            **{c: pa.array([0] * rows + [v], pa.int64()) for c, v in zip(_SUMS, sums, strict=True)},
        })

    return run


_ANSWERS = f"run bigint, range bigint, size bigint, fields binary, {', '.join(f'{c} bigint' for c in _SUMS)}"


def _store(n: int, order: int, folder: str):
    """Stores the answers to a run, range after range."""

    def run(key, table):
        rows = table.sort_by("range").select(["size", "fields"]).to_pylist()
        bits = [(r["size"] + 7) // 8 for r in rows]
        own = np.concatenate([np.unpackbits(np.frombuffer(r["fields"], np.uint8, b), count=r["size"]) for r, b in zip(rows, bits, strict=True)])
        known = np.concatenate([_unpacked(r["fields"][b:], _width(n, order), r["size"]) for r, b in zip(rows, bits, strict=True)], axis=1)
        zero, usual = _kinds(known)
        rest = known[:, ~(zero | usual)]
        field, place = np.nonzero(rest > 255)
        _save(folder, f"{n}-{key[0].as_py()}", small=np.minimum(rest, 255).astype(np.uint8), large=np.stack([field, place, rest[field, place]]), bits=np.stack([np.packbits(x) for x in (zero, usual, own)]))
        return pa.table({"run": pa.array([key[0].as_py()], pa.int64())})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4; 0.5, 1, 1.5 where they are undefined."""
    if min(n[:3]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05 * k), k * 0.99) for k, x in enumerate(d, 1))


def fit(rows: DataFrame, order: int = ORDER) -> tuple[DataFrame, str, int, list[dict]]:
    """The runs of rows (doc_id, trains, text), the folder of the answers to them, the bits of hashes, and the sums of each order from 1 on."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = rows.sparkSession
    bounded_batches(spark)
    # About a token for five bytes; it only sets sizes.
    tokens = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    size, bits = run_tokens(tokens), key_bits(tokens)
    runs = written(rows.mapInArrow(lambda batches: _runs(batches, size), _RUNS), "runs", "zstd")
    folder, sums = new_path(spark, "ngrams"), []
    for n in range(order, 0, -1):
        # A run has about a tenth as many distinct words as tokens.
        ranges = max(1, -(-tokens // size) // (1 if n > 1 else 10))
        asked = runs.mapInArrow(_requests(n, order, folder, ranges, bits), "range bigint, run bigint, keys binary, fields binary")
        answers = written(asked.groupBy("range").applyInArrow(_answers(n, order), _ANSWERS), "answers", "zstd")
        sums.append({k: v or 0 for k, v in answers.agg(*[F.sum(c).alias(c) for c in _SUMS]).first().asDict().items()})
        answers.filter("run is not null").groupBy("run").applyInArrow(_store(n, order, folder), "run bigint").write.format("noop").mode("overwrite").save()
        drop(answers)
    return runs, folder, bits, sums[::-1]


# -- scoring ----------------------------------------------------------------------


def probabilities(r: Run, folder: str, sums: list[dict]) -> np.ndarray:
    """Of each token, the model's probability after the tokens before it."""
    order, tokens = len(sums), len(r.hashes)
    d = [(0.0, *discounts([s[f"k{k}"] for k in range(1, 5)])) for s in sums]
    weight = lambda n, counts: np.array(d[n - 1])[np.minimum(counts, 3)]
    s = sums[0]
    if not s["counts"]:
        return np.ones(tokens)
    keys, at = r.grams(1)
    known, _ = _known(folder, 1, r.run, len(keys))
    counts = known[0]
    rest = (d[0][1] * s["k1"] + d[0][2] * s["k2"] + d[0][3] * (s["k3"] + s["k4"] + s["k5"])) / s["counts"]
    p = (np.maximum(counts - weight(1, counts), 0) / s["counts"] + rest / (s["words"] + 1))[at[:tokens]]
    for n in range(2, order + 1):
        total, n1, n2, n3 = known[1:5]
        left = (d[n - 1][1] * n1 + d[n - 1][2] * n2 + d[n - 1][3] * n3) / np.maximum(total, 1)
        before = r.contexts(at)
        keys, at = r.grams(n, n < order)
        known, _ = _known(folder, n, r.run, len(keys))
        c = known[0][at[:tokens]]
        after = total[before]
        p = np.where(after > 0, np.maximum(c - weight(n, c), 0) / np.maximum(after, 1) + left[before] * p, p)
    return p


def _scores(folder: str, bits: int, sums: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each_run(batches, bits):
            words, at = r.grams(1)
            counts = _known(folder, 1, r.run, len(words))[0][5][at[: len(r.hashes)]]
            base = np.log10((counts + 0.1) / (sums[0]["tokens"] + 0.1 * (sums[0]["words"] + 1)))
            of = lambda x: np.add.reduceat(x, r.starts)
            arrays = [pa.array(r.ids, pa.int64()), pa.array(r.sizes), pa.array(of((counts > 0).astype(np.int64))), pa.array(of(base)), pa.array(of(np.log10(probabilities(r, folder, sums))))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, held_out_of: int = 10, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document.

    Learns from the documents whose crc32 of the id isn't divisible by held_out_of.
    """
    out_of = crc_of_id(F.col("doc_id")) % held_out_of == 0
    runs, folder, bits, sums = fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (~out_of).alias("trains"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), order)
    scored = runs.mapInArrow(_scores(folder, bits, sums), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(sums[0]["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
