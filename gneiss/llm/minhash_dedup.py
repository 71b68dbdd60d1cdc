"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds the hashes of its distinct word shingles (of fewer words: of the whole
sequence). Each element draws a random permutation of the signature's places and one random
fraction for each step; a place keeps the least step-plus-fraction that reaches it. The ranks of
one element are thus correlated (each place gets another step), which lowers the variance, and
an element stops early once no later step can lower any place.

Equal sets are one class from the start. Classes that share a band of the signature are compared:
small buckets pair by pair; in a large bucket a central pivot is compared with all members, and
those that it doesn't reach elect the next. Most of a group is then one component, and no pair inside it is
looked at again. Members that are still apart, and can be linked to anything (enough of their
shingles are in other candidates too), are held against all members of the buckets that hang together,
in tiles: a task gets a block of those apart and a block of members, multiplies their incidence matrices and
emits one link for each component that a member reaches. So no link between components is lost, and what is
emitted grows with the members, not with their pairs.

Rows: null, empty or blank texts have an empty set, n_shingles 0, and link with nothing. Rows that
share a doc_id count as one document. A null doc_id is kept with a null component. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.components import components
from gneiss.llm.words import bounded_batches, chunks, list_array, mix, signed

PLACES, ROWS = 160, 5
#: Buckets of up to so many classes are compared pair by pair; larger ones by pivots.
SMALL_BUCKET = 16
#: Rounds of pivots in a large bucket before the rest is compared in tiles.
PIVOTS = 3
#: Sets on a side of a tile: TILE for groups of up to TILE * TILES, then more, up to TILE_MAX. Columns that a task multiplies at once.
TILE, TILES, TILE_MAX, COLUMNS = 1024, 8, 4096, 2048

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.cumsum(np.full(4096, _STEP, dtype=np.uint64), dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
#: Elements handled together; bounds the permutation table of one very long document.
_BLOCK = 1 << 14


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
        for k in range(words):
            rolled = mix(rolled * _STEP + hashes[k : k + len(rolled)])
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        n = hi - lo
        if n >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif n:
            x = np.full(1, n, dtype=np.uint64)
            for k in range(n):
                x = mix(x * _STEP + hashes[lo + k])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature: for each place the least (step << 32 | fraction) over all elements."""
    best = np.full(places, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(elements), _BLOCK):
        h = elements[at : at + _BLOCK]
        rows = np.arange(len(h))
        perm = np.tile(np.arange(places, dtype=np.int16), (len(h), 1))
        for j in range(places):
            x = mix(h + _STEPS[j])
            k = j + (((x & _LOW) * np.uint64(places - j)) >> _32).astype(np.int64)
            place = perm[rows, k]
            perm[rows, k] = perm[:, j]
            np.minimum.at(best, place, (np.uint64(j) << _32) | (x >> _32))
            if best.max() < np.uint64(j + 1) << _32:
                break
    return best


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of the signature; the band's number is part of it."""
    bands = signature[: len(signature) // rows * rows].reshape(-1, rows)
    x = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        x = mix(x * _STEP + bands[:, k])
    return x


def _set_key(s: np.ndarray) -> tuple[int, int]:
    salt = np.uint64(0xD1B54A32D192ED03)
    return int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0]), int(signed(np.array([mix(s ^ salt).sum(dtype=np.uint64)]))[0])


def _signatures(words: int, places: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, hashes, offsets in chunks(column):
                sets = shingle_sets(hashes, offsets, words)
                keys = [_set_key(s) for s in sets]
                bands = [signed(band_keys(super_minhash(s, places), rows)) if len(s) else np.empty(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), list_array(bands, pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, offsets in chunks(batch.column(1)):
                sets = [signed(s) for s in shingle_sets(hashes, offsets, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), list_array(sets, pa.int64())], names=["id", "elements"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with inter and total, the sizes of intersection and union of their full sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", inter.alias("inter"), (F.size("x") + F.size("y") - inter).alias("total"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _similar(n: str, m: str, percent: int):
    """Sets of sizes too different can't be linked."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _bucket_links(reps: DataFrame, sets_of, percent: int, kept) -> list[DataFrame]:
    """Tables of verified links (a, b) between class representatives. kept: written(), for tables that the caller drops."""
    entries = written(reps.select("id", "n", F.explode("bands").alias("key")), "bands")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).filter(F.col("first") < F.col("last"))
    members = kept(entries.join(sizes.select("key", "size"), "key"), "buckets")
    drop(entries)
    small, large = members.filter(F.col("size") <= SMALL_BUCKET), members.filter(F.col("size") > SMALL_BUCKET).select("key", "id", "n")
    sets = sets_of(members.select("id").distinct())

    def links_of(pairs: DataFrame) -> DataFrame:
        return kept(_verified(pairs, sets), "verified")

    other = small.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"))
    pairs = small.join(other, "key").filter((F.col("id") < F.col("id2")) & _similar("n", "n2", percent))
    found = links_of(pairs.select(*_pair("id", "id2")).distinct())
    out = [found.filter(_linked(percent)).select("a", "b")]
    if large.isEmpty():
        return out
    # Shingles that no other candidate has can't be shared: m is what an intersection can hold at most.
    # A member with the smallest share of them is near the middle of its group and reaches most others at once.
    elements = sets.select("id", F.explode("elements").alias("e"))
    alone = elements.groupBy("e").agg(F.min("id").alias("id"), F.count("*").alias("c")).filter("c = 1")
    lone = alone.groupBy("id").agg(F.count("*").alias("lone"))
    m = F.col("n") - F.coalesce("lone", F.lit(0))
    large = kept(large.join(lone, "id", "left").select("key", "id", "n", m.alias("m"), F.floor(m * 1_000_000 / F.col("n")).alias("weight")), "large")
    left = large
    for _ in range(PIVOTS):
        best = F.struct("weight", F.xxhash64("id"), "id")
        pivots = left.groupBy("key").agg(F.max_by(F.struct("id", "n", "weight"), best).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.weight").alias("pw"))
        pivots = kept(pivots, "pivots")  # one row a large bucket; the join below is of plain tables, so that buckets are split
        near = large.join(pivots, "key").filter((F.col("id") != F.col("pivot")) & _similar("n", "pn", percent))
        # One pivot a member and round, the most central of its buckets': what this leaves apart is compared in tiles.
        chosen = near.groupBy("id").agg(F.max(F.struct("pw", F.xxhash64("pivot").alias("h"), "pivot")).alias("c")).select("id", F.col("c.pivot").alias("pivot"))
        ball = links_of(chosen.select(*_pair("id", "pivot")).distinct()).filter(_linked(percent)).select("a", "b")
        out.append(ball)
        reached = ball.select(F.col("a").alias("id")).union(ball.select("b")).distinct()
        rest = left.join(reached, "id", "left_anti")
        left = kept(rest.select("key", "id", "n", "weight"), "outside")
        if left.isEmpty():
            break
    return [*out, _across(large, sets, out, percent, kept)]


def _linked(percent: int):
    return F.col("inter") * 100 >= F.col("total") * percent


def _tile_links(percent: int):
    """(a, b): for each set of a tile's left side, one linked set of each other component of the right side. Rows come sorted by tile."""

    def links(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        tile = pa.Table.from_batches(rows)
        side, ids, roots, sizes = (tile.column(c).to_numpy() for c in range(3, 7))
        elements = tile.column(7).combine_chunks()
        flat, at = elements.flatten().to_numpy(), np.repeat(np.arange(len(ids)), elements.value_lengths().to_numpy())
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        # Elements of one set alone are in no intersection; the others are columns 0, 1, ...
        number = np.cumsum(often > 1) - 1
        some = often[column] > 1
        at, column = at[some], number[column[some]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.empty(len(ids), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        inter = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            part, c = at[a:b], column[a:b] - lo
            x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            own = side[part] == 0
            x[place[part[own]], c[own]], y[place[part[~own]], c[~own]] = 1, 1
            inter += x @ y.T
        total = sizes[left][:, None] + sizes[right][None, :] - inter
        i, j = np.nonzero((inter * 100 >= total * percent) & (roots[left][:, None] != roots[right][None, :]))
        if not len(i):
            return i, j
        # One link for each component reached.
        _, first = np.unique(np.stack([i, roots[right][j]]), axis=1, return_index=True)
        return ids[left][i[first]], ids[right][j[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(tile, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                this = tuple(tile[:, lo].tolist())
                if held and this != key:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], names=["a", "b"])
                    held = []
                key = this
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], names=["a", "b"])

    return run


def _across(large: DataFrame, sets: DataFrame, links: list[DataFrame], percent: int, kept) -> DataFrame:
    """Links between members of large buckets that hang together and are still in different components."""
    union = links[0]
    for x in links[1:]:
        union = union.union(x)
    roots = components(union)
    # Only those that can be linked to anything as large as they need stay.
    able = large.filter(F.col("m") * 100 >= F.col("n") * percent)
    state = written(able.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")), "able")
    drop(roots)
    mixed = state.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("id").alias("first")).filter(F.col("r1") < F.col("r2")).select("key", "first")
    open_ = written(state.join(mixed, "key"), "open")
    drop(state)
    # Buckets that share a member are one group; its largest component need not be compared with itself.
    groups = components(open_.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    member = open_.select("id", "n", "root").distinct().join(groups.select(F.col("node").alias("id"), F.col("root").alias("found")), "id", "left").withColumn("group", F.coalesce("found", "id")).drop("found")
    member = written(member, "members")
    drop(open_, groups)
    main = member.groupBy("group", "root").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"))
    side = lambda n: F.greatest(F.least(F.ceil(n / TILE), F.lit(TILES)), F.ceil(n / TILE_MAX)).cast("int")
    apart = member.join(main, "group").withColumn("apart", F.col("root") != F.col("main"))
    blocks = apart.groupBy("group").agg(F.greatest(side(F.count_if("apart")), F.lit(1)).alias("xs"), side(F.count("*")).alias("ys"))
    dealt = apart.join(blocks, "group").withColumn("h", F.xxhash64("id"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = dealt.filter("apart").select("group", F.pmod("h", "xs").cast("int").alias("i"), F.explode(span("ys")).alias("j"), F.lit(0).alias("side"), "id", "root", "n")
    right = dealt.select("group", F.explode(span("xs")).alias("i"), F.pmod("h", "ys").cast("int").alias("j"), F.lit(1).alias("side"), "id", "root", "n")
    rows = left.union(right).join(sets, "id").select("group", "i", "j", "side", "id", "root", "n", "elements")
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rows.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    out = kept(tiles.mapInArrow(_tile_links(percent), "a bigint, b bigint").select(*_pair("a", "b")).distinct(), "across")
    drop(member)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Links: 100 * intersection >= percent * union of the sets of word shingles. Candidates come from
    places / rows bands: with the defaults a pair of exactly 0.8 is missed with a chance of 3e-6.
    """
    bounded_batches(docs.sparkSession)
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = written(plain.mapInArrow(_signatures(words, places, rows), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"), "signatures")
    some = signed_docs.filter("n_shingles > 0")
    # Written, so that the join below is of two plain tables, in which the engine splits a class of many copies.
    classes = written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")).filter(F.col("rep").isNotNull()), "classes")
    member = written(some.join(classes, ["s1", "s2"]).select("doc_id", "rep", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    drop(classes)
    reps = member.filter(F.col("doc_id") == F.col("rep")).groupBy("doc_id", "n").agg(F.first("bands").alias("bands")).select(F.col("doc_id").alias("id"), "n", "bands")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = plain.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return kept(wanted.mapInArrow(_sets(words), "id bigint, elements array<bigint>"), "sets")

    # Links are between class representatives; copies follow theirs. A doc_id of several texts links their classes.
    several = member.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter(F.col("a") < F.col("z")).select("doc_id", "a")
    union = member.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    for x in _bucket_links(reps, sets_of, percent, kept):
        union = union.union(x)
    roots = components(union)
    drop(*made)
    of_doc = member.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root")).filter(F.col("doc_id").isNotNull()).distinct()
    out = signed_docs.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
