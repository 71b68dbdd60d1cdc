"""Document fingerprints by spot signatures, with DataFrame operations only.

An anchor is a common word; its signature is the hash of the anchor and the CHAIN content words (words
that aren't anchors) that follow it. A document's fingerprint is the sorted set of its signatures.
Content words before the j-th anchor number (its place - j), so that all chains are slices of the
list of content words and a document costs one pass. A text without any complete signature uses runs
of CHAIN + 1 words instead, and a shorter one its words as a whole; a text without words has an empty
fingerprint.

likeness() is the Jaccard similarity of two fingerprints (1 for two empty ones). similar_pairs() finds
all pairs above a threshold: sets are partitioned by their length, a pair meets only in the same or the next
partition, on one of its rarest signatures, and is compared only if its lengths allow the
threshold.

Rows: null texts count as empty. Rows that repeat are neighbours of each other. A null doc_id sorts
first. Extra columns are ignored. An empty table gives an empty result; a single document is its own next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.lineage import written

CHAIN = 2

# Common function words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from he in is it of on or that the this to was were with
au aux avec ce dans de des du elle en est et il la le les ne par pas plus pour que qui se sur un une
als auch auf aus das dem den der des die ein eine er es für ist mit nicht sich sie und von wie zu
al como con de del el en es la las lo los no para pero por que se su una y
""".split()


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as 32-bit integers."""
    anchors = sorted(set(ANCHORS))
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    marks = lambda w: w.isin(*anchors)

    def of(s: Column) -> Column:
        places, content = s["places"], s["content"]
        n = F.size(content)
        chains = F.transform(places, lambda p, j: F.when(p["at"] - j + chain <= n, F.hash(p["w"], F.slice(content, p["at"] - j + 1, F.lit(chain)))))
        spots = F.filter(chains, lambda x: x.isNotNull())
        all_ = s["words"]
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_) - chain, F.lit(1))), lambda i: F.hash(F.lit(1), F.slice(all_, i, F.lit(chain + 1))))
        return F.when(F.size(spots) > 0, spots).when(F.size(all_) > 0, runs).otherwise(F.array().cast("array<int>"))

    # Let-bindings: a one-element array, so that each part is computed once.
    split = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda p: marks(p["w"])).alias("places"), F.filter(w, lambda x: ~marks(x)).alias("content")))
    return F.array_sort(F.array_distinct(F.transform(split, of)[0]))


def fingerprint(signs: Column) -> Column:
    """Eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct signatures."""
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below value, by halving; NULL is in bucket 0."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    step = lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(known, acc + s - 1) <= value), acc + s).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """docs (doc_id, columns and those derived from them) with next_<column>: the columns of the next document by ascending doc_id, after the last the first.

    Documents are dealt to ranges of ids by quantiles. The first document of each range is
    sent to the end of the range before, so that no order crosses ranges and no task sees all rows.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = sorted(set(quantiles))
    sized = docs.withColumn("__r", _bucket(F.col("doc_id"), bounds))
    order = F.struct("doc_id", *columns)
    # The smallest id of each range: one value each, a table as small as the number of ranges.
    least = written(docs.select("doc_id").withColumn("__r", _bucket(F.col("doc_id"), bounds)).groupBy("__r").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")).select("__r", F.col("m.doc_id").alias("__first")), "firsts")
    ranges = [r["__r"] for r in least.select("__r").orderBy("__r").collect()]
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}
    heads = sized.join(F.broadcast(least.withColumnRenamed("__r", "__f")), (F.col("__r") == F.col("__f")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    heads = heads.groupBy("__r").agg(F.min(order).alias("o")).select("__r", "o.*")
    moved = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    heads = heads.select("doc_id", *columns, moved[F.col("__r")].alias("__r"), F.lit(1).alias("__extra"))
    # Derived only now: above, they would be computed for every row to find the few heads.
    derived = derived or {}
    rows = sized.select("doc_id", *columns, "__r", F.lit(0).alias("__extra")).withColumns(derived).unionByName(heads.withColumns(derived))
    w = Window.partitionBy("__r").orderBy("__extra", F.col("doc_id").asc_nulls_first(), *columns)
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in [*columns, *derived]])
    return out.filter("__extra = 0").drop("__r", "__extra")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_part: the
    partition of set lengths in which similar_pairs() compares the fingerprint at its default threshold."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(rows, ["text"], {"signs": signatures(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    out = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), "signs", "next_signs", F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"))
    out = out.select("doc_id", "n_chars", "signs", "next_signs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_signs"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("signs")).alias("fingerprint"), fingerprint(F.col("edited_signs")).alias("edited_fingerprint"), likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"), length_part(F.size("signs")).alias("length_part"))


def length_part(n: Column, threshold: float = 0.8) -> Column:
    """The partition of sets of n signatures: lengths of one differ by the threshold at most, so that partners lie in this or the next."""
    return F.when(n > 0, F.floor(F.log(n) / -math.log(threshold) + 1e-9)).cast("int")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of class representatives with a likeness of threshold at least, a < b.

    Documents with equal fingerprints are one class, named by its smallest doc_id.
    """
    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")).groupBy("signs").agg(F.min("doc_id").alias("id")).filter(F.size("signs") > 0)
    sets = written(sets.withColumn("n", F.size("signs")), "signature-sets")
    sets = sets.withColumn("part", length_part(F.col("n"), threshold))
    each = sets.select("id", "n", "part", F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count("*").alias("often"))
    ranked = each.join(often, "sign").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "sign")))
    # Of sets that similar, one of the rarest signatures must be shared.
    rare = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "n", "part", "sign")
    other = rare.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sign", F.col("part").alias("part2"))
    met = rare.join(other, ["sign", "part"]).filter((F.col("id") != F.col("id2")) & ((F.col("part2") != F.col("part")) | (F.col("id") < F.col("id2"))) & (F.least("n", "n2") >= F.greatest("n", "n2") * threshold))
    pairs = met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    got = pairs.join(sets.select(F.col("id").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("signs").alias("y")), "b")
    return got.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).filter(F.col("likeness") >= threshold)
