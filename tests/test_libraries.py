import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import from_list
from gneiss.operators import graph
from gneiss.operators.graph import Graph, adjacency_edges, pagerank
from gneiss.operators.models import LinearRegressionModel, LogisticRegressionModel, SVMModel, dot
from gneiss.operators.words import WordCount
from gneiss.streaming import running_reduce_by_key, windowed_reduce_by_key

EDGES = [(10, 20), (20, 30), (30, 10), (30, 40), (10, 40), (40, 50), (50, 20), (50, 20)]


def ranks_of(edges, iterations):
    """The same recurrence by plain loops."""
    ranks = {v: 0.15 for e in edges for v in e}
    for _ in range(iterations - 1):
        given = dict.fromkeys(ranks, 0.0)
        for a, b in edges:
            given[b] += ranks[a] / sum(x == a for x, _ in edges)
        ranks = {v: 0.85 * g + 0.15 for v, g in given.items()}
    return ranks


def test_words(spark, tmp_path):
    w = WordCount().from_dataset(from_list(spark, ["b", "a", "b", "c", "a", None]))
    with pytest.raises(RuntimeError):
        w.print_all()
    assert sorted(w.wordcount().print_all()) == [("a", 2), ("b", 2), ("c", 1)]
    assert w.topk(2) == [("a", 2), ("b", 2)] and w.topk(0) == []
    with pytest.raises(RuntimeError):
        w.from_dataset(from_list(spark, ["x"]))
    (tmp_path / "t.txt").write_text("x  y\tx\n\n")
    assert WordCount().from_text(spark, f"file://{tmp_path}/t.txt").wordcount().topk(9) == [("y", 1), ("x", 2)]


def test_pagerank_golden(spark, monkeypatch):
    edges = from_list(spark, EDGES)
    g = Graph().from_edges(edges).compute_pagerank(10)
    want = ranks_of(EDGES, 10)
    assert [i for i, _ in g.topk_pagerank(2)] == sorted(want, key=want.get)[-2:]
    assert g.topk_pagerank(1, digits=3)[0][1] == round(max(want.values()), 3)
    got = dict(g.ranks.select("id", "pr").collect())
    assert got == pytest.approx(want, abs=1e-9)
    df = edges.df.toDF("src", "dst")
    monkeypatch.setattr(graph, "SMALL", 0)  # edges dealt and kept
    for n in (1, 2, 5):
        assert dict(pagerank(df, n).collect()) == pytest.approx(ranks_of(EDGES, n))
    with pytest.raises(ValueError):
        pagerank(df, 0)


def test_pagerank_edges_count_each_time_and_sinks_appear(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 3)], "src int, dst int")
    got = dict(pagerank(df, 2).collect())
    assert got == pytest.approx({1: 0.15, 2: 0.15 + 0.85 * 0.15 * 2 / 3, 3: 0.15 + 0.85 * 0.15 / 3})


def test_adjacency(spark):
    df = spark.createDataFrame([("7 2 8 9",), ("8 0",), ("",), (" 9\t1\t7 ",)], "value string")
    assert sorted(map(tuple, adjacency_edges(df).collect())) == [(7, 8), (7, 9), (9, 7)]


def points(spark, n=200):
    df = spark.range(n).select(F.array((F.col("id") % 17) / 3.0, (F.col("id") % 5) * 1.0).alias("features"))
    return df.withColumn("label", 2.0 * F.col("features")[0] - F.col("features")[1] + 4.0)


def test_linear(spark):
    m = LinearRegressionModel().load_frame(points(spark)).train(n_iter=60, alpha=0.5)
    assert m.get_param() == pytest.approx([2.0, -1.0], abs=1e-3) and m.get_intercept() == pytest.approx(4.0, abs=1e-2)
    assert m.predict([1.0, 1.0]) == pytest.approx(5.0, abs=1e-2)
    with pytest.raises(RuntimeError):
        LinearRegressionModel().train()
    with pytest.raises(RuntimeError):
        LinearRegressionModel().get_param()


@pytest.mark.parametrize("kind", [LogisticRegressionModel, SVMModel])
def test_classifiers_separate(spark, kind):
    df = points(spark).select(F.array(F.col("features")[0] - 2.5, F.col("features")[1] - 2.0).alias("features"))
    df = df.withColumn("label", (F.col("features")[0] > 0).cast("double"))
    m = kind().load_frame(df).train(n_iter=40, alpha=1.0)
    wrong = df.filter((m.predict_column(F.col("features")) > 0).cast("double") != F.col("label")).count()
    assert wrong <= 20
    assert m.predict([-2.5, 0.0]) < 0 < m.predict([2.5, 0.0])


@pytest.mark.parametrize("kind", [LinearRegressionModel, LogisticRegressionModel, SVMModel])
def test_sparse_rows(spark, kind):
    """Sparse training against the same steps by numpy; a feature number of a million isn't filled."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 8)) < 0.4, rng.normal(size=(60, 8)), 0.0)
    y = (x[:, 0] - x[:, 3] > 0).astype(float)
    place = [0, 3, 7, 100, 5000, 70_000, 500_000, 999_999]
    rows = [([(place[j], float(v)) for j, v in enumerate(r) if v], float(t)) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, ([], 1.0)], "features array<struct<i:int,v:double>>, label double")
    x, y = np.vstack([x, np.zeros(8)]), np.append(y, 1.0)
    m = kind().load_frame(df).train(n_iter=6, alpha=0.3)
    w, b, n = np.zeros(8), 0.0, len(x)
    scale = np.sqrt((x * x).mean(axis=0))
    for k in range(6):
        if kind is SVMModel:
            near = min(1.0, 1 / np.sqrt(w @ w * 0.01)) if w.any() else 1.0
            sign = 2 * y - 1
            hit = sign * (x @ (w * near) + b * near) < 1
            w, b = (1 - 1 / (k + 1)) * w * near + (sign * hit) @ x / (k + 1) / n / 0.01, b + (sign * hit).sum() / (k + 1) / n
        else:
            at = x @ w + b
            g = (1 / (1 + np.exp(-at)) if kind is LogisticRegressionModel else at) - y
            w, b = w - 0.3 * (g @ x) / n / scale**2, b - 0.3 * g.mean()
    assert len(m.get_param()) == 1_000_000
    assert [m.get_param()[p] for p in place] == pytest.approx(w.tolist()) and m.get_intercept() == pytest.approx(b)
    assert np.count_nonzero(m.get_param()) <= 8


def test_model_files(spark, tmp_path):
    (tmp_path / "a.svm").write_text("-1 1:0.5 3:2\n1 2:1\n")
    (tmp_path / "a.tsv").write_text("1\t2\t3\n4 5 6\n")
    m = LogisticRegressionModel().load_train_set(f"file://{tmp_path}/a.svm", spark=spark)
    assert sorted(map(tuple, m.data.select("label", F.to_json("features")).collect())) == [(0.0, '[{"i":0,"v":0.5},{"i":2,"v":2.0}]'), (1.0, '[{"i":1,"v":1.0}]')]
    m = LogisticRegressionModel().load_train_set(f"file://{tmp_path}/a.svm", is_sparse=0, spark=spark)
    assert sorted(map(tuple, m.data.select("label", F.to_json("features")).collect())) == [(0.0, "[0.5,0.0,2.0]"), (1.0, "[0.0,1.0,0.0]")]
    m = LinearRegressionModel().load_text(spark, f"file://{tmp_path}/a.tsv")
    assert sorted(r["label"] for r in m.data.collect()) == [3.0, 6.0]
    m = LogisticRegressionModel().load_train_set([([1, 2], 1), ([0], 0)], spark=spark).train(2)
    assert len(m.get_param()) == 2


def test_wide_features(spark):
    df = spark.range(30).select(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: (F.col("id") * i % 7).cast("double")).alias("features"), F.col("id").cast("double").alias("label"))
    assert len(LinearRegressionModel().load_frame(df).train(2, 0.01).get_param()) == 300


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(dot(F.col("x"), [1, 10], 5)).collect()] == [26.0, 6.0, None]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:01"), ("a", 4, "2024-01-01 00:00:02"), ("b", 2, "2024-01-01 00:01:00")], "k string, v int, t string")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(f"{tmp_path}/in")
    for name, make, want in (
        ("s1", lambda s: running_reduce_by_key(s, F.col("k"), F.col("v"), "sum"), {("a", 5), ("b", 2)}),
        ("s2", lambda s: windowed_reduce_by_key(s, "t", "1 minute", "5 minutes", F.col("k"), F.col("v"), "max"), {("a", 4), ("b", 2)}),
    ):
        stream = spark.readStream.schema("k string, v int, t timestamp").parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(name).select("key", "value").collect()} == want
