"""Queries over the collection operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.lineage import new_path, written
from gneiss.operators.dataset import Dataset
from gneiss.operators.graph import Graph, adjacency_edges, in_degree_histogram, pagerank
from gneiss.operators.models import LinearRegressionModel, LogisticRegressionModel, SVMModel, dot
from gneiss.operators.words import WordCount
from gneiss.sources.readers import from_list, load, parquet

SPACES = "[ \\t\\n\\r]+"
SQL_WORDS = r"SELECT unnest(string_split_regex(text, '[ \t\n\r]+')) AS word FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Dataset:
    return parquet(spark, f"{sf_dir}/{name}.parquet", *columns)


def _words(spark: SparkSession, sf_dir: str) -> WordCount:
    return WordCount().from_lines(table(spark, sf_dir, "documents", "text").df, "text", SPACES).wordcount()


# -- sources ----------------------------------------------------------------


@query("SELECT * FROM (VALUES ('quartz'), ('mica'), ('quartz'), ('slate')) t(value)")
def parallelize_words(spark, sf_dir):
    return from_list(spark, ["quartz", "mica", "quartz", "slate"]).df


@query("SELECT CAST(doc_id AS VARCHAR) AS value FROM documents")
def text_round_trip(spark, sf_dir):
    path = new_path(spark, "text")
    table(spark, sf_dir, "documents", "doc_id").write_text(path)
    return load(spark, path).df


@query("SELECT * FROM (VALUES (1, 2), (1, 3), (2, 3)) t(src, dst)")
def adjacency_load(spark, sf_dir):
    path = new_path(spark, "adjacency")
    from_list(spark, ["1 2 2 3", "2\t1\t3", "3 0", ""]).write_text(path)
    return adjacency_edges(load(spark, path).df)


# -- per element ------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS p FROM lineitem")
def map_disc_price(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p")).df


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_qty(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").filter(F.col("l_quantity") > 45).df


@query(f"SELECT word FROM ({SQL_WORDS}) WHERE word <> ''")
def flat_map_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents", "text").flat_map(lambda t: F.filter(F.split(t, SPACES), lambda w: w != ""))
    return words.df.select(F.col("value").alias("word"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def map_partition_top(spark, sf_dir):
    d = table(spark, sf_dir, "events", "event_id", "value")
    tops = d.map_partition_py(lambda rows: sorted(rows, key=lambda r: (-r[1], r[0]))[:10], "struct<event_id:bigint,value:double>")
    rows = tops.df.select(F.inline("value"))
    return rows.orderBy(F.desc("value"), "event_id").limit(10)


@query("SELECT o_orderkey * 2 + 1 AS value FROM orders")
def map_callable(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").map_py(lambda k: k * 2 + 1, "bigint").df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def filter_callable(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").filter_py(lambda k: k % 7 == 3).df


@query(r"SELECT unnest(string_split(p_type, ' ')) AS value FROM part")
def flat_map_callable(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_type").flat_map_py(lambda s: s.split(" "), "string").df


# -- by key -----------------------------------------------------------------


@query(f"SELECT word, count(*) AS cnt FROM ({SQL_WORDS}) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return _words(spark, sf_dir).counts


@query(f"SELECT word, count(*) AS cnt FROM ({SQL_WORDS}) WHERE word <> '' GROUP BY word ORDER BY cnt DESC, word DESC LIMIT 10")
def word_topk(spark, sf_dir):
    return _words(spark, sf_dir).topk_frame(10)


@query("SELECT l_partkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY l_partkey")
def reduce_by_key_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").map(F.col("l_partkey"), F.col("l_quantity").cast("bigint")).reduce_by_key("sum").df


@query("SELECT l_suppkey AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey")
def reduce_by_key_money(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").map(F.col("l_suppkey"), F.col("l_extendedprice").cast("decimal(18,2)")).reduce_by_key("sum")
    return out.df.select("key", F.col("value").cast("double").alias("value"))


@query("SELECT l_partkey AS key, max(l_shipdate) AS value FROM lineitem GROUP BY l_partkey")
def reduce_by_key_max(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").map(F.col("l_partkey"), F.col("l_shipdate")).reduce_by_key("max").df


@query("SELECT o_custkey AS key, CAST(bit_xor(o_orderkey) AS BIGINT) AS value FROM orders GROUP BY o_custkey")
def reduce_by_key_lambda(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").reduce_by_key(lambda x, y: x.bitwiseXOR(y)).df


@query("SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY o_custkey")
def reduce_by_key_callable(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").reduce_by_key_py(max).df


@query("SELECT o_custkey AS key, list_sort(list(o_orderkey)) AS value FROM orders GROUP BY o_custkey")
def group_by_key(spark, sf_dir):
    out = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key().df
    return out.select("key", F.array_sort("value").alias("value"))


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
def count_by_key(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type", "value").count_by_key().df


# -- multisets --------------------------------------------------------------


@query("SELECT c_nationkey AS value FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat(spark, sf_dir):
    left, right = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return left.map(F.col("c_nationkey")).concat(right.map(F.col("s_nationkey"))).df


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").distinct().df


@query("SELECT l_partkey AS value FROM lineitem WHERE l_quantity <= 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def difference(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    some = lambda cond: d.filter(cond).map(F.col("l_partkey"))
    return some(F.col("l_quantity") <= 45).difference(some(F.col("l_quantity") > 45)).df


# -- actions ----------------------------------------------------------------


@query("SELECT count(*) AS value FROM orders")
def count_all(spark, sf_dir):
    return spark.createDataFrame([(table(spark, sf_dir, "orders", "o_orderkey").count(),)], "value bigint")


@query("SELECT count(*) = 0 AS value FROM orders")
def is_empty(spark, sf_dir):
    return spark.createDataFrame([(table(spark, sf_dir, "orders", "o_orderkey").empty(),)], "value boolean")


@query("SELECT max(o_totalprice) AS value FROM orders")
def reduce_max(spark, sf_dir):
    return spark.createDataFrame([(table(spark, sf_dir, "orders", "o_totalprice").reduce("max"),)], "value double")


@query("SELECT CAST(bit_xor(o_orderkey) AS BIGINT) AS value FROM orders")
def reduce_lambda(spark, sf_dir):
    found = table(spark, sf_dir, "orders", "o_orderkey").reduce(lambda x, y: x.bitwiseXOR(y))
    return spark.createDataFrame([(found,)], "value bigint")


@query("SELECT count(*) AS value, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def foreach_sum(spark, sf_dir):
    """What foreach_py() leaves behind: sums in accumulators."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(k):
        n.add(1)
        total.add(k)

    table(spark, sf_dir, "orders", "o_orderkey").foreach_py(add)
    return spark.createDataFrame([(n.value, total.value)], "value bigint, total bigint")


@query("SELECT p_type AS word, count(*) AS cnt FROM part GROUP BY p_type")
def word_count_elements(spark, sf_dir):
    """Elements of a Dataset counted as words, as print_all() gives them."""
    pairs = WordCount().from_dataset(table(spark, sf_dir, "part", "p_type")).wordcount().print_all()
    return spark.createDataFrame(pairs, "word string, cnt bigint")


@query("SELECT max(o_orderkey) AS value FROM orders")
def reduce_callable(spark, sf_dir):
    found = table(spark, sf_dir, "orders", "o_orderkey").reduce_py(max)
    return spark.createDataFrame([(found,)], "value bigint")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def topk_smallest(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").topk_dataset(10, F.col("o_totalprice"), ties=["o_orderkey"]).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def topk_largest(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").topk_dataset(10, F.col("o_totalprice"), reverse=True, ties=["o_orderkey"]).df


@query("SELECT o_orderpriority AS key, count(*) AS value FROM orders GROUP BY o_orderpriority")
def cache_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey")
    d.cache()
    try:
        counts = written(d.count_by_key().df, "counts")  # computed from what is kept
    finally:
        d.uncache()
    return counts


# -- graphs -----------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").df
    return d.select((F.col("l_partkey") % 1000).alias("src"), F.col("l_suppkey").alias("dst"))


@query("SELECT indegree, count(*) AS n FROM (SELECT l_suppkey, count(*) AS indegree FROM lineitem GROUP BY l_suppkey) GROUP BY indegree")
def indegree_histogram(spark, sf_dir):
    return in_degree_histogram(_edges(spark, sf_dir))


@query("SELECT count(DISTINCT indegree) AS value FROM (SELECT count(*) AS indegree FROM lineitem GROUP BY l_suppkey)")
def indegree_values(spark, sf_dir):
    return in_degree_histogram(_edges(spark, sf_dir)).agg(F.count("*").alias("value"))


def pagerank_sql(iterations: int) -> str:
    parts = [
        "e AS (SELECT l_partkey % 1000 AS src, l_suppkey AS dst FROM lineitem)",
        "d AS (SELECT src, count(*) AS deg FROM e GROUP BY src)",
        "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)",
        "p0 AS (SELECT id, 0.15::DOUBLE AS pr FROM v)",
    ]
    for i in range(1, iterations):
        parts.append(f"p{i} AS (SELECT v.id, 0.85 * coalesce(s.t, 0) + 0.15 AS pr FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.pr / d.deg) AS t FROM e JOIN p{i - 1} p ON p.id = e.src JOIN d ON d.src = e.src GROUP BY e.dst) s ON s.id = v.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(pr, 6) AS pr FROM p{iterations - 1}"


@query(pagerank_sql(10))
def pagerank_ten(spark, sf_dir):
    return pagerank(_edges(spark, sf_dir), 10).select("id", F.round("pr", 6).alias("pr"))


@query(f"SELECT id, pr FROM ({pagerank_sql(3)}) ORDER BY pr DESC, id DESC LIMIT 20")
def pagerank_topk(spark, sf_dir):
    top = Graph().from_edges(Dataset(_edges(spark, sf_dir))).compute_pagerank(3).topk_pagerank(20, digits=6)
    return spark.createDataFrame(top, "id bigint, pr double")


# -- models -----------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (i / 64.0::DOUBLE))) + 0.5, 9) AS y FROM embeddings")
def linear_predict(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings", "vec_id", "embedding").df
    return d.select("vec_id", F.round(dot(F.col("embedding"), [i / 64 for i in range(1, 65)], 0.5), 9).alias("y"))


def _trained(model, spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings", "embedding", "label").df
    model.load_frame(d.select(F.col("embedding").alias("features"), (F.col("label") < 5).cast("double").alias("label")))
    model.train(n_iter=STEPS, alpha=0.5)
    rows = [(j, w) for j, w in enumerate([*model.get_param(), model.get_intercept()])]
    return spark.createDataFrame(rows, "position int, weight double").select("position", F.round("weight", 6).alias("weight"))


STEPS = 5

#: Rows in long form: id, y and one row for each feature j.
_LONG = """x AS (SELECT row_number() OVER () AS id, embedding, (label < 5)::INT::DOUBLE AS y FROM embeddings),
l AS (SELECT id, y, j - 1 AS j, embedding[j]::DOUBLE AS v FROM x, range(1, 65) t(j)),
n AS (SELECT count(*)::DOUBLE AS n FROM x)"""


def descent_sql(slope: str, steps: int = STEPS, alpha: float = 0.5) -> str:
    """Gradient steps on scaled features; slope: the derivative of the loss by the margin m, with label y."""
    parts = [
        _LONG,
        "s AS (SELECT j, avg(v) AS mean, CASE WHEN avg(v * v) - avg(v) * avg(v) > 0 THEN sqrt(avg(v * v) - avg(v) * avg(v)) ELSE 1 END AS dev FROM l GROUP BY j)",
        "z AS (SELECT id, y, l.j, (v - mean) / dev AS v FROM l JOIN s ON s.j = l.j)",
        "w0 AS (SELECT j, 0::DOUBLE AS w FROM s)",
        "b0 AS (SELECT 0::DOUBLE AS b)",
    ]
    for k in range(steps):
        parts += [
            f"g{k} AS (SELECT id, {slope} AS g FROM (SELECT id, y, sum(v * w) + any_value(b) AS m FROM z JOIN w{k} ON w{k}.j = z.j, b{k} GROUP BY id, y))",
            f"w{k + 1} AS (SELECT j, any_value(w) - {alpha} * sum(g * v) / any_value(n) AS w FROM (SELECT z.j, z.v, g, w FROM z JOIN g{k} ON g{k}.id = z.id JOIN w{k} ON w{k}.j = z.j), n GROUP BY j)",
            f"b{k + 1} AS (SELECT any_value(b) - {alpha} * sum(g) / any_value(n) AS b FROM g{k}, b{k}, n)",
        ]
    return f"WITH {', '.join(parts)} SELECT j::INT AS position, round(w / dev, 6) AS weight FROM w{steps} JOIN s USING (j) UNION ALL SELECT 64, round(any_value(b) - sum(w / dev * mean), 6) FROM w{steps} JOIN s USING (j), b{steps}"


def svm_sql(steps: int = STEPS, penalty: float = 0.01) -> str:
    """Projected subgradient steps on plain features; r: the projection's factor."""
    parts = [_LONG, "w0 AS (SELECT DISTINCT j, 0::DOUBLE AS w FROM l)", "b0 AS (SELECT 0::DOUBLE AS b)"]
    for k in range(steps):
        parts += [
            f"r{k} AS (SELECT CASE WHEN sum(w * w) > 0 THEN least(1, 1 / sqrt(sum(w * w) * {penalty})) ELSE 1 END AS r FROM w{k})",
            f"m{k} AS (SELECT id, 2 * y - 1 AS y, (2 * y - 1) * (sum(v * w) * any_value(r) + any_value(b) * any_value(r)) AS m FROM l JOIN w{k} ON w{k}.j = l.j, b{k}, r{k} GROUP BY id, y)",
            f"w{k + 1} AS (SELECT j, (1 - 1.0::DOUBLE / {k + 1}) * any_value(w) * any_value(r) + 1.0::DOUBLE / {k + 1} / (any_value(n) * {penalty}) * sum(CASE WHEN m < 1 THEN y * v ELSE 0 END) AS w FROM (SELECT l.j, l.v, m, m{k}.y, w FROM l JOIN m{k} ON m{k}.id = l.id JOIN w{k} ON w{k}.j = l.j), r{k}, n GROUP BY j)",
            f"b{k + 1} AS (SELECT any_value(b) + 1.0::DOUBLE / {k + 1} / any_value(n) * sum(CASE WHEN m < 1 THEN y ELSE 0 END) AS b FROM m{k}, b{k}, n)",
        ]
    return f"WITH {', '.join(parts)} SELECT j::INT AS position, round(w, 6) AS weight FROM w{steps} UNION ALL SELECT 64, round(b, 6) FROM b{steps}"


@query(descent_sql("m - y"))
def linear_train(spark, sf_dir):
    return _trained(LinearRegressionModel(), spark, sf_dir)


@query(descent_sql("1 / (1 + exp(-m)) - y"))
def logistic_train(spark, sf_dir):
    return _trained(LogisticRegressionModel(), spark, sf_dir)


@query(svm_sql())
def svm_train(spark, sf_dir):
    return _trained(SVMModel(), spark, sf_dir)
