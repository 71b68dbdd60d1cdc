"""The pipeline over a small table: every stage against brute force on its own input, odd rows through every stage, and run() as a whole."""

import itertools
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gneiss.functions.lineage import written
from gneiss.llm.quality import quality_scores
from gneiss.llm.registry import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], DATA), "stage"))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.filter("text is null or n_chars <> length(text)").isEmpty()


def test_quality(spark, stages):
    scores = quality_scores(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    assert texts(stages[1]).keys() == want and 0 < len(want) < stages[0].count()
    assert stages[1].exceptAll(stages[0]).isEmpty()


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_lines(stages):
    before, by_size, seen, want = texts(stages[1]), defaultdict(list), set(), {}
    for i in sorted(before):
        kept, gone = [], False
        for line in before[i].split("\n"):
            w = words(line)
            if w and (tuple(w) in seen or (len(w) >= 9 and any(max(len(w), n) >= 10 and near(w, x) for n in (len(w) - 1, len(w), len(w) + 1) for x in by_size[n]))):
                gone = True
            else:
                kept.append(line)
            if w:
                seen.add(tuple(w))
                by_size[len(w)].append(w)
        text = "\n".join(kept)
        if not gone or text.strip():
            want[i] = text
    assert texts(stages[2]) == want and want != before


def test_near_duplicates(stages):
    before = texts(stages[2])
    sets = {}
    for i, t in before.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert texts(stages[3]) == {i: t for i, t in before.items() if find(i) == i}


def test_mixing(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, free = {}, set(size)
    while free:
        left = sum(size.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    taken = Counter()
    whole = {r["doc_id"]: r for r in before}
    per_doc = Counter()
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
        per_doc[r["doc_id"]] += len(words(r["text"]))
        it = iter(words(whole[r["doc_id"]]["text"]))
        assert all(w in it for w in words(r["text"]))  # its words, in their order
    assert all(abs(taken[s] - target[s]) <= 128 for s in size)
    assert all(n <= 3 * len(words(whole[i]["text"])) for i, n in per_doc.items())


def test_packing_and_run(spark, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    total = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == total
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(filled) <= 1.005 * -(-total // 2048) + 1
    key = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    again = corpus_pipeline.run(spark, DATA)
    assert Counter(map(tuple, again.select(*key).collect())) == Counter(map(tuple, stages[5].select(*key).collect()))


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, line, "s"), (2, None, "s"), (3, "", None), (4, " \t\n", "s"), (5, line, None), (7, line.replace("five", "5"), "s"), (7, line.replace("five", "5"), "s"), (None, "A b C d e f", "t"), (8, "short", "t"), (9, "w " * 9000, "t")]
    schema = "doc_id long, text string, source string, lang string, n_chars int, score double, y int, row string, hash string, s int, p int, host string"
    odd = spark.createDataFrame([(i, t, s, "en", len(t or ""), 1.0, 2, "x", "y", 3, 4, "z") for i, t, s in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, DATA), stage(spark, odd.limit(0), DATA)
        assert none.count() == 0
        if name == "best-fit packing":
            assert Counter(r["doc_id"] for r in got.filter("piece = 0").collect()) == Counter(i for i, _, _ in rows)
            continue
        assert got.columns == odd.columns
        found = got.collect()
        kept = Counter(r["doc_id"] for r in found)
        if name == "line dedup":
            assert kept == Counter([1, 2, 3, 4, None, 8, 9])  # what is equal to an earlier line or one word off goes
        elif name == "MinHash near-dedup":
            assert kept == Counter([1, 2, 3, 4, 7, 7, None, 8, 9])
        elif name == "mixing sources":
            assert not {2, 3, 4} & kept.keys()
        else:
            assert set(kept) <= {i for i, _, _ in rows}


def test_every_operator_is_registered():
    assert sorted(QUERIES) == sorted([*(n for n in QUERIES if n.startswith("op")), "pipeline"])
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 11))


def test_columns_of_operators(spark, stages):
    """What each query must return at least."""
    need = {
        1: "doc_id size source_size target taken", 2: "doc_id n_shingles component_id kept", 3: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        5: "doc_id held_out score predicted", 6: "doc_id held_out score predicted", 9: "doc_id held_out n_tokens n_known train_tokens base_score score", 10: "page_id url text n_chars",
    }
    for name, query in QUERIES.items():
        n = int(name[2:].split("_")[0]) if name.startswith("op") else 0
        if n in (5, 6, 10):
            df = query(spark, DATA)
            assert set(need[n].split()) <= set(df.columns)
            assert df.count() == spark.read.parquet(f"{DATA}/{'pages' if n == 10 else 'documents'}.parquet").count()
            assert df.select(F.count_if(F.col(df.columns[0]).isNull())).first()[0] == 0
