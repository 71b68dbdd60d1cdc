import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gneiss import Dataset, from_list, load, mongodb, start, stop
from gneiss.functions import folds, lineage
from gneiss.sources.readers import hdfs


def test_word_count_golden(spark):
    words = from_list(spark, ["quartz", "mica", "quartz", "slate"])
    got = words.map(lambda v: v, lambda v: 1).reduce_by_key("sum").collect()
    assert sorted(got) == [("mica", 1), ("quartz", 2), ("slate", 1)]


def test_readme_example(spark, capsys):
    text = (Path(__file__).parent.parent / "README.md").read_text()
    code = "\n".join(line[4:] for line in text.split("\n") if line.startswith("    "))
    names = {}
    exec(code, names)
    assert sorted(names["counts"]) == [("mica", 1), ("quartz", 2)]


def test_output_and_foreach(spark, capsys):
    d = from_list(spark, [3, 1, 2]).filter(F.col("value") > 1)
    d.output()
    assert sorted(eval(capsys.readouterr().out)) == [2, 3]
    seen = spark.sparkContext.accumulator(0)
    d.foreach_py(lambda x: seen.add(x))
    assert seen.value == 5
    pairs = spark.sparkContext.accumulator(0)
    from_list(spark, [("a", 1), ("b", 2)]).foreach_py(lambda p: pairs.add(p[1]))
    assert pairs.value == 3


def test_general_fold_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(folds, "CHUNK", 8)
    df = spark.range(0, 1000, 1, 5).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(F.lit(7)).alias("k"), F.col("id"))
    want = defaultdict(int)
    for i in range(1000):
        want[i % 3 if i % 10 == 0 else 7] += i
    assert dict(Dataset(df).reduce_by_key(lambda x, y: x + y).collect()) == dict(want)
    assert Dataset(df.select("id")).reduce(lambda x, y: F.greatest(x, y)) == 999
    assert from_list(spark, [], "value int").reduce(lambda x, y: x + y) is None


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_topk_is_smallest_by_default(spark):
    d = from_list(spark, [5, 3, 9, 1])
    assert d.topk(2) == [1, 3]
    assert d.topk(2, reverse=True) == [9, 5]
    assert d.topk(2, key=lambda v: -v) == [9, 5]
    assert d.topk(0) == []


def test_difference_is_distinct_and_null_safe(spark):
    a, b = from_list(spark, [1, 1, 2, None, 3]), from_list(spark, [3])
    assert Counter(a.difference(b).collect()) == Counter([1, 2, None])
    assert a.difference(a).empty()


def test_concat_keeps_duplicates_and_reduces(spark):
    a = from_list(spark, [("x", 1), ("y", 2)])
    assert sorted(a.concat(a).reduce_by_key("sum").collect()) == [("x", 2), ("y", 4)]
    assert a.concat(a).distinct().count() == 2


def test_group_by_key_keeps_nulls(spark):
    d = from_list(spark, [("a", 1), ("a", None), ("b", None)])
    got = {k: Counter(v) for k, v in d.group_by_key().collect()}
    assert got == {"a": Counter([1, None]), "b": Counter([None])}
    assert sorted(d.count_by_key().collect()) == [("a", 2), ("b", 1)]


def test_map_partition_is_one_element_each(spark):
    d = Dataset(spark.range(6).toDF("value").repartition(3))
    assert sorted(len(x) for x in d.map_partition_py(lambda xs: xs, "bigint").collect()) == sorted(len(x) for x in d.df.rdd.glom().collect())
    empty = Dataset(spark.range(1).toDF("value").repartition(4))
    assert len(empty.map_partition_py(lambda xs: [len(xs)], "int").collect()) == 4
    assert sorted(d.flat_map_partition_py(lambda xs: xs, "bigint").collect()) == list(range(6))


def test_callables(spark):
    d = from_list(spark, [1, 2, 3])
    assert sorted(d.map_py(lambda x: x * 2, "bigint").collect()) == [2, 4, 6]
    assert sorted(d.filter_py(lambda x: x % 2).collect()) == [1, 3]
    assert sorted(d.flat_map_py(lambda x: [x] * x, "bigint").collect()) == [1, 2, 2, 3, 3, 3]
    assert d.reduce_py(lambda a, b: a + b) == 6
    assert from_list(spark, []).reduce_py(lambda a, b: a + b) is None
    assert d.reduce("max") == 3 and d.reduce(lambda a, b: a * b) == 6
    with pytest.raises(TypeError):
        d.map_py(3, "bigint")
    with pytest.raises(TypeError):
        d.reduce_by_key("sum")
    with pytest.raises(ValueError):
        from_list(spark, [(1, 1)]).reduce_by_key("mean")


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_against_model(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("abcd"), rng.randrange(100)) for _ in range(40)]
    d = Dataset(from_list(spark, rows).df.repartition(parts))
    model = defaultdict(list)
    for k, v in rows:
        model[k].append(v)
    assert dict(d.reduce_by_key("max").collect()) == {k: max(v) for k, v in model.items()}
    assert dict(d.reduce_by_key(lambda x, y: x + y).collect()) == {k: sum(v) for k, v in model.items()}
    assert dict(d.reduce_by_key_py(min).collect()) == {k: min(v) for k, v in model.items()}
    assert Counter(d.collect()) == Counter(rows) and d.count() == 40


def test_cache_uncache_cache(spark):
    d = from_list(spark, [1, 2])
    assert d.cache() is d and d.count() == 2
    d.uncache()
    assert d.cache().count() == 2
    d.uncache()


def test_text_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    from_list(spark, ["a b", "", None]).write_text(path)
    assert sorted(load(spark, path).collect()) == ["", "", "a b"]
    assert sorted(load(spark, f"nfs:{tmp_path}/out").flat_map(lambda v: F.split(v, "")).collect())[-2:] == ["a", "b"]


def test_sources_reject(spark):
    with pytest.raises(TypeError):
        from_list(spark, "ab")
    with pytest.raises(TypeError):
        from_list(spark, [1, "a"])
    assert from_list(spark, []).empty()
    assert hdfs(spark, "h", 9).url("/x/y") == "hdfs://h:9/x/y"
    m = mongodb(spark, "h", 1).auth("u", "p@")
    assert m.options("d", "c")["connection.uri"] == "mongodb://u:p%40@h:1/"
    with pytest.raises(RuntimeError):
        m.load("d", "c")


def test_sessions(spark):
    assert start() is not None
    stop()
    assert spark.range(1).count() == 1


def test_plans_stay_in_the_engine(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(f"{tmp_path}/t")
    d = Dataset(spark.read.parquet(f"{tmp_path}/t"))
    plan = lambda x: x.df._jdf.queryExecution().toString()
    top = plan(d.topk_dataset(3, F.col("v")))
    assert "TakeOrderedAndProject" in top
    summed = plan(d.filter(F.col("v") > 2).map(F.col("v"), F.col("id")).reduce_by_key("sum"))
    assert "partial_sum" in summed and "PushedFilters: [IsNotNull(v), GreaterThan(v,2)]" in summed
    assert "Python" not in summed
