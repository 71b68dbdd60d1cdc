"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. In each pass the classes are put in the lexicographic order of BITS
concatenated random sign hashes and every class is compared with its WINDOW neighbours on either
side; the order is global, and the ends of the parts it is dealt in are compared with each other.
Cosines are in double precision. Verified pairs of all passes are united. A table of more classes gets more
passes (passes_for()), so that an isolated pair at the threshold is missed with a chance of about MISS,
reckoned for classes that spread evenly over the hashes.

Windows cannot hold all links of a large group. So all classes of a component are then compared with
each other exactly, in tiles of at most TILE_MAX classes a side; only counts leave a tile. Direct links
inside a component are therefore complete, at a cost of the square of its classes.

n_links counts the other vectors linked directly, those in linked classes each. Rows: vectors that
are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
of different lengths. Rows that share a vec_id count as one vector; a null vec_id keeps a null
component. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.components import components

PASSES, WINDOW, BITS, SEED = 24, 64, 63, 11
THRESHOLD = 0.9
#: Chance that the passes miss an isolated pair whose cosine is the threshold.
MISS = 1e-4
#: Classes on a side of a tile: TILE for components of up to TILE * TILES, then more, up to TILE_MAX.
TILE, TILES, TILE_MAX = 512, 64, 16384

_OUT = "a bigint, b bigint, edge bigint, side int, pos int, pass int, vec array<float>"


def _matrix(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _keys(passes: int, bits: int):
    """A row for each class and pass, with the pass's hash."""
    planes: dict[tuple[int, int], np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = np.stack([vectors[i] for i in rows]).astype(np.float64)
                part = batch.take(pa.array(rows))
                for k in range(passes):
                    if (k, size) not in planes:
                        planes[k, size] = np.random.default_rng([SEED, k, size]).normal(size=(size, bits))
                    signs = (x @ planes[k, size] > 0).astype(np.int64)
                    key = signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(key), part.column(0), part.column(1)], names=["pass", "dim", "key", "id", "vec"])

    return run


def _near(ids: np.ndarray, x: np.ndarray, old: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most window apart whose later row isn't among the first old rows."""
    a, b = [], []
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for o in range(1, min(window, len(ids) - 1) + 1):
        lo = max(0, old - o)
        hit = np.flatnonzero(np.einsum("ij,ij->i", unit[lo : len(ids) - o], unit[lo + o :]) >= threshold) + lo
        a.append(ids[hit])
        b.append(ids[hit + o])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _batch_out(a, b, edge=None, side=None, pos=None, pass_=None, vec=None) -> pa.RecordBatch:
    n = len(a)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
    values = [a, b, edge, side, pos, pass_, vec]
    arrays = [pa.nulls(n, k) if v is None else v.cast(k) if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "edge", "side", "pos", "pass", "vec"])


def _windows(window: int, threshold: float):
    """Pairs inside a sorted part, and the part's first and last rows, for the comparison across parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept: dict = {}
        head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy() * np.int64(1 << 32) + batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            if head < window:
                n = min(window - head, batch.num_rows)
                first = batch.slice(0, n)
                yield _batch_out(first.column(3), pa.nulls(n, pa.int64()), np.full(n, part - 1), np.ones(n, np.int32), np.arange(head, head + n), first.column(0), first.column(4))
                head += n
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = batch.slice(lo, hi - lo)
                ids, x = own.column(3).to_numpy(), np.stack(_matrix(own.column(4))).astype(np.float64)
                old = 0
                if kept.get("group") == group[lo]:
                    old = len(kept["ids"])
                    ids, x = np.concatenate([kept["ids"], ids]), np.concatenate([kept["x"], x])
                a, b = _near(ids, x, old, window, threshold)
                yield _batch_out(np.minimum(a, b), np.maximum(a, b))
                kept = {"group": group[lo], "pass": int(batch.column(0)[lo].as_py()), "ids": ids[-window:], "x": x[-window:]}
        if kept:
            n = len(kept["ids"])
            yield _batch_out(kept["ids"], pa.nulls(n, pa.int64()), np.full(n, part), np.zeros(n, np.int32), np.arange(n), np.full(n, kept["pass"], np.int32), pa.array([v.astype(np.float32) for v in kept["x"]], pa.list_(pa.float32())))

    return run


def _across(window: int, threshold: float):
    """Pairs between the last rows of a part (side 0) and the first of the next (side 1)."""

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("side", "pos", "a", "pass")), _matrix(table.column("vec")), strict=True), key=lambda r: r[:2])
        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        a, b = [], []
        for i, x in enumerate(left):
            for y in right[: max(0, window - (len(left) - 1 - i))]:
                if x[3] == y[3] and len(x[4]) == len(y[4]) and x[2] != y[2]:
                    u, v = x[4].astype(np.float64), y[4].astype(np.float64)
                    if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                        a.append(min(x[2], y[2]))
                        b.append(max(x[2], y[2]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes for n classes: a pass finds a pair that agrees in the bits which leave about a window of classes."""
    found = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return max(PASSES, math.ceil(math.log(MISS) / math.log1p(-found))) if found < 1 else PASSES


def _tile_counts(threshold: float):
    """(rep, others): how many rows the classes linked with each class of a tile stand for. Rows come sorted by tile."""

    def counted(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        tile = pa.Table.from_batches(rows)
        i, j, own, ids, copies = (tile.column(c).to_numpy() for c in range(1, 6))
        x = np.stack(_matrix(tile.column(6))).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        left = np.flatnonzero(own == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(own == j[0])
        others = np.zeros(len(ids), np.int64)
        y, weight = x[right].T, copies[right]
        for lo in range(0, len(left), TILE):
            at = left[lo : lo + TILE]
            near = x[at] @ y >= threshold
            if i[0] == j[0]:
                near[np.arange(len(at)), np.arange(lo, lo + len(at))] = False
            else:
                others[right] += copies[at] @ near
            others[at] += near @ weight
        return ids, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done]), pa.int64()) for k in (0, 1)], names=["rep", "others"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(tile, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            done = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                this = tuple(tile[:, lo].tolist())
                if held and this != key:
                    done.append(counted(held))
                    held = []
                key = this
                held.append(batch.slice(lo, hi - lo))
            if done:
                yield out(done)
        if held:
            yield out([counted(held)])

    return run


def _links_inside(reps: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rep, others) of every class in a component, from exact comparison with all classes of the component."""
    inside = roots.select(F.col("node").alias("vec_id"), "root").union(roots.select("root", "root").distinct())
    sizes = inside.groupBy("root").agg(F.count("*").alias("n")).select("root", F.greatest(F.least(F.ceil(F.col("n") / TILE), F.lit(TILES)), F.ceil(F.col("n") / TILE_MAX)).cast("int").alias("chunks"))
    own = inside.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    rows = reps.select("vec_id", "copies", "vec").join(own, "vec_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "copies", "vec")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(_tile_counts(threshold), "rep bigint, others bigint").groupBy("rep").agg(F.sum("others").alias("others"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable over links, itself included), kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vec", lambda v: v != 0.0)
    keyed = written(rows.select("vec_id", F.when(some & ~odd & F.col("vec_id").isNotNull(), F.col("vec")).alias("vec")).withColumn("k", F.when(F.col("vec").isNotNull(), F.struct(F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")))), "vectors")
    classes = keyed.filter("vec is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    member = written(keyed.join(classes, "k", "left").select("vec_id", "rep", "copies", F.when(F.col("vec_id") == F.col("rep"), F.col("vec")).alias("vec")), "members")
    drop(keyed)
    reps = member.filter("vec is not null").dropDuplicates(["vec_id"])
    if passes is None:
        passes = passes_for(reps.count(), threshold, window)
    hashed = reps.select(F.col("vec_id").alias("id"), "vec").mapInArrow(_keys(passes, bits), "pass int, dim int, key bigint, id bigint, vec array<float>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = hashed.repartitionByRange(parts, "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
    found = written(ordered.mapInArrow(_windows(window, threshold), _OUT), "windows")
    ends = found.filter("edge is not null").groupBy("edge").applyInArrow(_across(window, threshold), "a bigint, b bigint")
    links = written(found.filter("edge is null").select("a", "b").union(ends).distinct(), "pairs")
    drop(found)
    roots = components(links)
    counts = _links_inside(reps, roots, threshold)
    out = member.select("vec_id", "rep", "copies").join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep", "vec_id")
    n = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("bigint")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
