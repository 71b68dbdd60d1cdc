"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents are laid end to end in the order of a hash of their rows and cut into blocks of
BLOCK words. The mix is a row of slots, SHARD of them in an output shard. A pseudorandom permutation
of all slots gives each slot a stratified uniform number, and the inverse distribution of the
targets gives its source: the counts of sources in a shard are multinomial, given that every
source's total is its target. The slot's rank among those of its source, mapped through that source's
own pseudorandom permutation of its blocks (one for each pass over the source), gives the block,
and documents join their slots by block index. The permutations are swap-or-not shuffles: they are
bijections of any range, computed for each index alone, so nothing is sorted or collected.

A source is taken at most ceil(target / size) <= 3 times, so that no document exceeds 3 times its size.
Nothing depends on the partitioning: reruns agree.

Rows: null texts have size 0 and are never taken; a null source is a source of its own, the last. A
source whose texts are all null or empty has target 0 and no slots. Rows that repeat are laid out and taken each on its own. Extra columns are ignored (mixed_documents
keeps them). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.lineage import drop, written

BLOCK, SHARD, ROUNDS, SEED = 64, 1024, 12, 20240229
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def _swap_or_not(df: DataFrame, index: str, size: Column, key: list[Column], backwards: bool = False) -> DataFrame:
    """df with index mapped through a pseudorandom permutation of 0..size-1."""
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        shift = F.pmod(F.xxhash64(F.lit(SEED), F.lit(r), *key), size)
        df = df.withColumn("__other", F.pmod(shift - F.col(index), size))
        flip = F.xxhash64(F.lit(SEED + 1), F.lit(r), F.greatest(index, "__other"), *key).bitwiseAND(1) == 1
        df = df.withColumn(index, F.when(flip, F.col("__other")).otherwise(F.col(index)))
    return df.drop("__other")


def _hashable(docs: DataFrame, names: list[str]) -> list[Column]:
    """Columns that can be hashed; maps and variants count as their JSON."""
    plain = lambda kind: not any(x in kind.simpleString() for x in ("map<", "variant"))
    return [F.col(f"`{c}`") if plain(docs.schema[c].dataType) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in names]


def _row_key(columns: list[Column]) -> list[Column]:
    """Two independent hashes of a row, never NULL: joins on them are plain equalities."""
    return [F.xxhash64(F.lit(SEED + 2), *columns).alias("__k1"), F.xxhash64(F.lit(SEED + 3), *columns).alias("__k2")]


def _running(t: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """t (dealt to ranges p of order) with the sum of value over all rows before each. One row a range is summed in one task."""
    inside = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("p").agg(F.sum(value).alias("__sum"))
    before = sums.select(F.col("p").alias("__p"), F.coalesce(F.sum("__sum").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    summed = t.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, F.col("p") == F.col("__p"))
    return summed.withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__p", "__before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row for each source: s (its place), source, source_size, target, blocks, slots, first_slot and all_slots.

    Targets share all words by weight; a target above most times its source's size stops there and
    its excess goes to the others by weight: min(cap, level * weight) with the level that uses all.
    Sources are dealt to ranges of their names, so that no task holds all, however many there are.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    dealt = written(by_source.repartitionByRange(parts, "unnamed", "source").withColumn("p", F.spark_partition_id()), "sources")
    t = _running(dealt, F.lit(1), ["unnamed", "source"], "s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    t = written(t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "weighted")
    drop(dealt)
    # The level rises until no further source stops at its cap; whole numbers are summed, so that reruns agree.
    everything, capped, level = t.agg(F.sum("source_size")).first()[0] or 0, -1, 0.0
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        n, stopped, free = t.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (everything - (stopped or 0)) / free
    t = t.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block))
    # A source without words has no slots.
    share = F.round(F.col("target") * F.col("blocks") / F.nullif("source_size", F.lit(0))).cast("bigint")
    t = t.withColumn("slots", F.coalesce(F.least(share, F.col("blocks") * most), F.lit(0).cast("bigint")))
    t = _running(t, F.col("slots"), ["unnamed", "source"], "first_slot")
    total = t.agg(F.sum("slots")).first()[0] or 0
    return t.select("s", "source", "source_size", "target", "blocks", "slots", "first_slot", F.lit(total).cast("bigint").alias("all_slots"))


def _laid_out(rows: DataFrame, targets: DataFrame, parts: int) -> DataFrame:
    """rows with s and start, the number of words of the source that lie before the document."""
    # The table of sources is broadcast if it is small; otherwise hot sources are split by the skew-join handling.
    sized = rows.join(targets.select("s", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # The order is that of the rows' keys; ranges of it, cut finer the more partitions there are, never change it.
    sized = sized.withColumn("part", F.floor(F.col("__k1").cast("double") / (2.0**63) * parts + parts).cast("bigint"))
    inside = Window.partitionBy("s", "part").orderBy("__k1", "__k2").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("s", "part").agg(F.sum("size").alias("n"))
    before = sums.select("s", "part", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(before, ["s", "part"]).withColumn("start", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def slots(targets: DataFrame, spark) -> DataFrame:
    """Every slot of the mix: shard, slot, s, pass and block."""
    total = targets.agg(F.first("all_slots")).first()[0] or 0
    numbers = spark.range(total).select(F.col("id").alias("slot"), F.col("id").alias("u"))
    # Written before and after each permutation: the planner's constraints on such a chain of columns would grow without end.
    drawn = written(_swap_or_not(numbers, "u", F.lit(total), [F.lit(-1)]) if total else numbers, "drawn")
    # Inverse distribution: u lies in the run of slots of one source. Runs are few, and cut in cells so that the join is by equality.
    cell = max(1, total // 4096)
    t = targets.filter("slots > 0").select("s", "blocks", "slots", "first_slot")
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_slot") / cell), F.floor((F.col("first_slot") + F.col("slots") - 1) / cell))))
    of = drawn.withColumn("cell", F.floor(F.col("u") / cell)).join(cells, "cell").filter((F.col("u") >= F.col("first_slot")) & (F.col("u") < F.col("first_slot") + F.col("slots")))
    ranked = of.select("slot", "s", "blocks", (F.col("u") - F.col("first_slot")).alias("rank"))
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    ranked = written(ranked.drop("rank"), "ranked")
    drop(drawn)
    mapped = _swap_or_not(ranked, "block", F.col("blocks"), [F.col("s"), F.col("pass")])
    out = written(mapped.select(F.floor(F.col("slot") / SHARD).alias("shard"), "slot", "s", "pass", "block"), "slots")
    drop(ranked)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _placed(docs: DataFrame, key: list[str], weights, most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Every row's place in its source (s, start, size and the hashes of the key's columns), and the sources."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), *_row_key(_hashable(docs, key))), "sizes")
    targets = written(source_targets(rows.select("source", "size"), weights, most, block), "targets")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(_laid_out(rows, targets, parts).select("doc_id", "__k1", "__k2", "s", "start", "size"), "placed")
    drop(rows)
    return placed, targets


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document has words in: words, from which word of the document."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    from_ = F.greatest(F.col("start"), F.col("block") * block)
    to = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.withColumn("words", to - from_).withColumn("at", from_ - F.col("start"))


def mix_words(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    placed, targets = _placed(docs, ["doc_id", "source", "text"], weights, most, block)
    mix = slots(targets, docs.sparkSession)
    times = mix.groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = _pieces(placed, block).join(times, ["s", "block"]).groupBy("s", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = placed.join(taken.withColumnRenamed("s", "ts").withColumnRenamed("start", "tstart"), (F.col("s") == F.col("ts")) & (F.col("start") == F.col("tstart")) & (F.col("size") > 0), "left")
    out = out.join(targets.select("s", "source_size", "target"), "s")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix as documents: for each pass over its source, a document with the words taken in it.

    A pass that takes a whole document keeps its text as it is; otherwise the runs of taken words follow
    each other, each word with the white space after it, so that lines stay lines. All columns are kept;
    n_chars, if there, is that of the new text. Rows that are equal in all columns are one row with as many places.
    """
    names = docs.columns
    placed, targets = _placed(docs, names, weights, most, block)
    mix = slots(targets, docs.sparkSession).select("s", "block", "pass")
    got = _pieces(placed, block).join(mix, ["s", "block"]).groupBy("__k1", "__k2", "s", "start", "size", "pass").agg(F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("runs"))
    got = got.select(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2"), F.when(F.col("n") < F.col("size"), F.col("runs")).alias("__runs"))
    # Texts are dealt out once, by the two hashes alone; equal rows meet on the way, so that a group of them is one row here.
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *_row_key(_hashable(docs, names)))
    rows = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))).filter("__nth = 1")
    one = rows.join(got, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    parts = F.flatten(F.transform("__runs", lambda r: F.slice(words, (r["at"] + 1).cast("int"), r["words"].cast("int"))))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.regexp_replace(F.array_join(parts, ""), "[\\x20\\x09-\\x0D]+$", ""))
    rows = one.withColumn("__text", text)
    new = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return rows.select(*new)
