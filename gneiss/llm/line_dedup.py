"""Line dedup: of lines that are equal or within the edit bound, the earliest in the corpus stays.

A line's words are the symbols; the edit bound is one word inserted, deleted or replaced, for lines of
at least NEAR_WORDS words (so that at least nine tenths agree). Shorter lines must be equal; blank lines
are left alone. Every line emits its deletion
neighbourhood as hashed keys: the line itself, and each variant with one word deleted, keyed with
the place of the deletion. Two lines share a variant at one place exactly if one word is replaced; so the
lines of a key with a place all lie within the bound of each other, and each meets the earliest. A line goes if any earlier
line is within the bound of it, whether that one stays or goes. A variant
equals the other line exactly if one word is inserted; so a key without a place is that of one line
and of all that are one word longer, which may be two edits from each other: each longer line meets
the shorter one, and the shorter one the earliest longer one. All are plain minima, combined before
the shuffle, however many lines share the key. Each line is then held against the lines it met, word
by word, before it goes.

Only lines that share their first or last half (by word count) with a different line can be within the
bound, so that the others emit no variants. Earliest: by doc_id, then line number.

Rows: null and empty texts are kept as they are. A null doc_id sorts first; rows that share a doc_id
are told apart by their text's hash, and repeats of a whole row are told apart by nothing: they count
as one and stay together. A document that loses all its lines goes. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.words import bounded_batches, chunks_with_bytes, column_bytes, list_array, mix, signed

LEAST_WORDS, NEAR_WORDS = 1, 10
#: Lines whose variants a worker holds at once.
VARIANT_LINES = 256

_P = np.uint64(0x9E3779B97F4A7C15)


def _lines(raw: np.ndarray, starts: np.ndarray, rows: int, ends: np.ndarray):
    """For all lines of a chunk: row, number in the row, word range from and to. ends: where each row's bytes end, with its line feed."""
    feeds = np.flatnonzero(raw == 10)
    to = np.searchsorted(starts, feeds)
    row = np.searchsorted(ends, feeds, side="right")
    first = np.searchsorted(row, np.arange(rows))
    return row, np.arange(len(feeds)) - first[row], np.concatenate([[0], to[:-1]]), to


def _sequence(h: np.ndarray) -> np.ndarray:
    """Prefix sums of word * P^place, for hashes of whole ranges."""
    steps = np.full(len(h) + 1, _P, dtype=np.uint64)
    steps[0] = 1
    power, sums = np.cumprod(steps, dtype=np.uint64), np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[:-1], dtype=np.uint64, out=sums[1:])
    return sums, power


def line_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines from words a to b: the hash, and the keys of the first and last halves, for a partner
    of the same length and one a word shorter or longer (a row each; for odd lengths the last two repeat)."""
    s, _ = _sequence(hashes)
    steps = np.full(len(hashes) + 1, np.uint64(pow(int(_P), -1, 1 << 64)), dtype=np.uint64)
    steps[0] = 1
    inverse = np.cumprod(steps, dtype=np.uint64)
    of = lambda x, y: (s[y] - s[x]) * inverse[x]
    n = b - a
    keys = []
    for k in (n // 2, (n - 1) // 2):
        keys.append(mix(of(a, a + k) + mix((2 * k + 1).astype(np.uint64))))
        keys.append(mix(of(b - k, b) + mix((2 * k + 2).astype(np.uint64))))
    return mix(of(a, b) + n.astype(np.uint64)), np.stack(keys, axis=1)


def variants(h: np.ndarray) -> np.ndarray:
    """The deletion neighbourhood: for each place, the key of (line without it, place) and of the line without it;
    then the key of the line itself as a variant of a longer one."""
    n, (s, power) = len(h), _sequence(h)
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    without = s[:-1] + (s[-1] - s[1:]) * inverse
    plain = mix(without + np.uint64(n - 1))
    return np.concatenate([mix(plain ^ (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _P), np.unique(plain), mix(s[-1:] + np.uint64(n))])


def _chunk_lines(column: pa.Array):
    """For row ranges: their first row, the words' hashes, and the lines as of _lines()."""
    _, at = column_bytes(column)
    for lo, hi, hashes, _, raw, starts, _ in chunks_with_bytes(column):
        yield lo, hashes, *_lines(raw, starts, hi - lo, np.cumsum(np.diff(at[lo : hi + 1]) + 1))


def _line_table(least: int, near: int):
    """(doc, text hash, line, words, hash, halves) of every line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hashes, row, line, a, b in _chunk_lines(batch.column(2)):
                long = np.flatnonzero(b - a >= least)
                row, line, a, b = row[long], line[long], a[long], b[long]
                key, half = line_hashes(hashes, a, b)
                n = b - a
                kept = np.zeros(half.shape, bool)
                kept[n >= near - 1] = True
                kept[n % 2 == 1, 2:] = False
                offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(signed(key)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(half[kept])))],
                    names=["doc_id", "row", "line", "words", "hash", "halves"],
                )

    return run


def _wanted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One output row for each wanted line: its place and the hashes of its words."""
    for batch in batches:
        wanted = batch.column(3).to_pylist()
        for lo, hashes, row, _, a, b in _chunk_lines(batch.column(2)):
            at, line, got = [], [], []
            first = np.searchsorted(row, np.arange(int(row[-1]) + 2 if len(row) else 1))
            for i in range(len(first) - 1):
                for k in wanted[lo + i]:
                    j = first[i] + k
                    at.append(lo + i)
                    line.append(k)
                    got.append(signed(hashes[a[j] : b[j]]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), list_array(got, pa.int64())], names=["doc_id", "row", "line", "got"])


def _variant_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each line with each key of its deletion neighbourhood, VARIANT_LINES lines at a time.
    kind: 0 for a key with a place, 1 for one without, 2 for the line's own."""
    for whole in batches:
        for lo in range(0, whole.num_rows, VARIANT_LINES):
            batch = whole.slice(lo, VARIANT_LINES)
            lines = batch.column(3)
            keys = [variants(np.asarray(lines[i].values).view(np.uint64)) for i in range(len(lines))]
            sizes = np.array([len(k) for k in keys])
            take = pa.array(np.repeat(np.arange(len(keys)), sizes), pa.int64())
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kind = (place >= np.repeat([len(lines[i]) for i in range(len(lines))], sizes)).astype(np.int8)
            kind[np.cumsum(sizes) - 1] = 2
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(signed(np.concatenate(keys))), pa.array(kind)], names=["doc_id", "row", "line", "key", "kind"])


def _within_one(x, y):
    """Whether two arrays of words differ by one inserted, deleted or replaced word at most, as a Column."""
    n = F.least(F.size(x), F.size(y))
    same = lambda u, v: F.size(F.filter(F.arrays_zip(u.alias("u"), v.alias("v")), lambda p: ~p["u"].eqNullSafe(p["v"])))
    head = lambda z: F.slice(z, F.lit(1), n)
    # The longer one without the word at the first difference must be the shorter one.
    first = F.array_position(F.zip_with(head(x), head(y), lambda u, v: u != v), F.lit(True))
    cut = F.when(first == 0, n + 1).otherwise(first).cast("int")
    without = lambda z: F.concat(F.slice(z, F.lit(1), cut - 1), F.slice(z, cut + 1, F.greatest(F.size(z) - cut, F.lit(0))))
    return F.when(F.size(x) == F.size(y), same(x, y) <= 1).when(F.size(x) == F.size(y) + 1, without(x) == y).when(F.size(y) == F.size(x) + 1, without(y) == x).otherwise(F.lit(False))


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, row, line) of every line that goes; row is the hash of the document's text."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    place = F.struct("doc_id", "row", "line")
    lines = written(plain.mapInArrow(_line_table(least, near), "doc_id bigint, row bigint, line int, words int, hash bigint, halves array<bigint>"), "lines")
    firsts = written(lines.groupBy("hash").agg(F.min(F.struct("doc_id", "row", "line", "words", "halves")).alias("f")).select("hash", "f.*"), "firsts")
    # A line equal to another may go, and only the first of equal lines can be near to another.
    half = firsts.filter(F.size("halves") > 0).select("hash", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("hash").alias("h1"), F.max("hash").alias("h2")).filter(F.col("h1") < F.col("h2")).select("half")
    able = half.join(shared, "half", "left_semi").select("hash").distinct()
    able = written(firsts.join(able, "hash", "left_semi").select("hash", "doc_id", "row", "line", "words"), "able")
    wanted = able.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))  # bounded by a document's lines
    texts = plain.join(wanted.withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("doc_id", "row", "text", "lines")
    # The texts are dealt out once: both the variants and the check below come from these words.
    words = written(texts.mapInArrow(_wanted_words, "doc_id bigint, row bigint, line int, got array<bigint>"), "words")
    keys = written(words.mapInArrow(_variant_keys, "doc_id bigint, row bigint, line int, key bigint, kind tinyint").select(place.alias("at"), "key", "kind"), "keys")
    # own: the line that a key without a place is the key of; first: the earliest of the others.
    best = keys.groupBy("key").agg(F.min(F.when(F.col("kind") < 2, F.col("at"))).alias("first"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("own"), F.max("at").alias("far"), F.min("kind").alias("least"))
    best = best.filter(F.when(F.col("least") == 0, F.col("first") < F.col("far")).otherwise(F.col("first").isNotNull() & F.col("own").isNotNull())).select("key", "first", "own")
    met = keys.join(best, "key").select("at", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("first")).alias("to"))
    met = written(met.filter(F.col("to") < F.col("at")).distinct(), "met")
    drop(able, keys)  # as soon as nothing reads them: they are the largest tables here
    gone = _verified(words, met, near)
    # Both a line equal to one that goes and a repeat of a kept one go; the first of a class stays only if nothing earlier is near.
    mark = firsts.select("hash", F.struct("doc_id", "row", "line").alias("first")).join(gone.select(F.col("at").alias("first"), F.lit(True).alias("near")), "first", "left")
    out = lines.select("hash", place.alias("at")).join(mark, "hash").filter(F.coalesce("near", F.lit(False)) | (F.col("at") != F.col("first"))).select("at.doc_id", "at.row", "at.line")
    out = written(out, "gone")
    drop(lines, firsts, words, met)
    return out


def _verified(words: DataFrame, met: DataFrame, near: int) -> DataFrame:
    """The pairs of met that really are within the bound, checked on their words."""
    ends = met.select(F.col("at").alias("p")).union(met.select("to")).distinct()
    # Written, so that the joins are of plain tables, in which the engine splits a line that many others meet.
    words = written(words.select(F.struct("doc_id", "row", "line").alias("p"), "got").join(ends, "p", "left_semi").distinct(), "ends")
    pairs = met.join(words.select(F.col("p").alias("at"), F.col("got").alias("x")), "at").join(words.select(F.col("p").alias("to"), F.col("got").alias("y")), "to")
    longest = F.greatest(F.size("x"), F.size("y"))
    out = written(pairs.filter((longest >= near) & _within_one(F.col("x"), F.col("y"))).select("at").distinct(), "verified")
    drop(words)
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """The documents without their repeated lines; n_chars, if there, is that of the new text."""
    names = docs.columns
    gone = repeated_lines(docs, least, near).groupBy("doc_id", "row").agg(F.collect_set("line").alias("__gone")).toDF("__d", "__r", "__gone")
    rows = docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__r")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    rows = rows.withColumn("__text", text).filter(F.col("__gone").isNull() | (F.trim(F.regexp_replace("__text", "\\s+", " ")) != ""))
    new = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names]
    return rows.select(*new)


def line_counts(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without its repeated lines; empty if all go) of every document."""
    gone = repeated_lines(docs, least, near).groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")).toDF("d", "r", "gone")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return rows.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"), left.alias("text"))
