"""Packing tokenised documents into sequences of a fixed length by the sum-of-squares rule.

Documents become token ids with an end id after each; those longer than a sequence are cut into
full pieces and a last, shorter one. Pieces are dealt to shards by a hash, so that a shard holds a
bounded number of pieces whatever the corpus, and each shard is packed on its own: a piece goes
where the sum over gaps of the squared number of open sequences with that gap becomes smallest
(an exact fit counts as none). Sequences that a shard leaves far from full are dissolved and
packed again in fewer shards, round after round, so that sharding costs few sequences. In the last round a shard
also dissolves its loosest sequences TRIES times and places their pieces by the same rule in other orders,
and keeps what takes no more sequences.

Rows: null texts count as empty; an empty text is the end id alone. Rows that repeat or share a
doc_id are packed each on its own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.words import bounded_batches

LENGTH = 2048
#: Pieces that one shard packs, on average.
SHARD_PIECES = 1000
#: A shard's sequences with a larger gap than this are packed again.
LOOSE = 8
ROUNDS = 2
TRIES, SEED = 24, 5
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

# Characters for which the splitting below is the tokenizer's own: for these, composition (NFC) and
# lower-casing act on each character alone and white space is ASCII. Other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t-\\r -~¡-įı-ſ]*")
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
# Fixed value: the vocabulary file's pre-tokenizer pattern, with the classes above.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


class WordIds:
    """The ids of texts as little-endian unsigned 32-bit bytes, remembering the ids of words.

    A word here is what lies between white space; the tokenizer's own parts never cross it. Words
    seen lately are kept in two generations, so that memory is bounded and frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[ends] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Put the ids of words that aren't known yet into self.words."""
        older, missing = self.older, []
        if len(self.words) + len(words) > REMEMBERED:
            self.older, self.words = self.words, {}
            older = self.older
        for w in words:
            if (ids := older.get(w)) is None:
                missing.append(w)
            else:
                self.words[w] = ids
        split = [(w, _PARTS.findall(w)) for w in missing]
        new = list({x for _, parts in split for x in parts if x not in self.words and x not in older})
        if new:
            # One call for all: each part ends with a token that ends words.
            ids = self._whole(" ".join(new))
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data, at = ids.tobytes(), 0
            for x, to in zip(new, stops, strict=True):
                self.words[x] = data[at:to]
                at = to
        for w, parts in split:
            if len(parts) != 1:
                self.words[w] = b"".join(self.words.get(x) or older[x] for x in parts)
            elif parts[0] not in self.words:
                self.words[w] = older[w]

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return self._whole(text).tobytes()
        parts = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, parts))
        except KeyError:
            self._learn(list(set(parts).difference(self.words)))
        if len(self.words) < REMEMBERED // 4:  # a new generation has begun
            self._learn(list(set(parts).difference(self.words)))
        return b"".join(map(self.words.__getitem__, parts))


def _pieces(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, 4 bytes each) of every piece of every document."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pieces(path, length, with_ids), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, placed in the given order."""
    counts = np.zeros(length + 1, dtype=np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = (2 * counts[length - s] + 1 if s < length else 0), length
        if s < length:
            from_, to = counts[s:length], counts[: length - s]
            change = np.where(from_ > 0, 2 * (to - from_) + 2, np.iinfo(np.int64).max)
            if from_[0]:
                change[0] = 1 - 2 * from_[0]
            k = int(change.argmin())
            if change[k] <= best:
                gap = s + k
        if gap == length:
            at, n = n, n + 1
        else:
            at = open_[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = at, length - gap
        if gap > s:
            open_[gap - s].append(at)
            counts[gap - s] += 1
    return sequence, offset


def tightened(sizes: np.ndarray, sequence: np.ndarray, length: int = LENGTH, tries: int = TRIES) -> np.ndarray:
    """The sequences of pieces after dissolving the loosest again and again; never more of them than before."""
    rng, n = np.random.default_rng(SEED), int(sequence.max()) + 1 if len(sequence) else 0
    for _ in range(tries):
        if n <= -(-int(sizes.sum()) // length):
            break
        gaps = length - np.bincount(sequence, sizes, minlength=n)
        some = max(2, int((0.1 + 0.4 * rng.random()) * n))
        loose = np.zeros(n, bool)
        loose[np.argsort(-gaps, kind="stable")[:some]] = True
        freed = np.flatnonzero(loose[sequence])
        order = np.argsort(-sizes[freed] * (1 + 0.3 * rng.random(len(freed))), kind="stable")
        again, _ = sum_of_squares(sizes[freed][order], length)
        if again.max() + 1 <= loose.sum():
            kept = int(n - loose.sum())
            sequence = (np.cumsum(~loose) - 1)[sequence]
            sequence[freed[order]] = kept + again
            n = kept + int(again.max()) + 1
    return sequence


def _pack_shard(length: int, loose: int, tries: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        sizes = rows["length"].to_numpy()
        sequence = tightened(sizes, sum_of_squares(sizes, length)[0], length, tries)
        # Pieces of a sequence follow each other in the order of the rows.
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.searchsorted(sequence[order], sequence[order])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - (ends - sizes[order])[first]
        filled = np.bincount(sequence, sizes) if len(rows) else np.empty(0)
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + sequence, offset=offset, loose=(length - filled[sequence]) > loose)

    return run


def pack(pieces: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES, loose: int = LOOSE, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset: which sequence holds each, and where, gapless from 0."""
    base = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    row = F.xxhash64("doc_id", "piece", "ids_crc32") if "ids_crc32" in base else F.xxhash64("doc_id", "piece")
    rest, done, size = written(pieces, "pieces"), [], shard_pieces
    for turn in range(rounds + 1):
        n = rest.count()
        shards = max(1, round(n / size))
        dealt = rest.withColumn("row", row).withColumn("shard", F.pmod("row", F.lit(shards)) + F.lit(turn << 24))
        last = turn == rounds or shards == 1
        packed = written(dealt.groupBy("shard").applyInPandas(_pack_shard(length, loose, TRIES if last else 0), f"{schema}, row bigint, shard bigint, sequence_id bigint, offset bigint, loose boolean"), "packed")
        drop(rest)
        done.append((packed if last else packed.filter(~F.col("loose"))).select(*base, "sequence_id", "offset"))
        if last:
            break
        # Few pieces are left by now, so a shard of them may hold more.
        rest, size = written(packed.filter("loose").select(*base), "loose"), size * 4
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def packed_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, length), length)
