"""Operators against brute force on small inputs, and on the odd rows: nulls, empty and long texts, repeats, clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.functions.lineage import written
from gneiss.llm import words as words_
from gneiss.llm import embedding_dedup, fingerprints, html_extract, minhash_dedup, mixing, ngram_lm, packing, quality, toxicity
from gneiss.llm.components import components
from gneiss.llm.embedding_dedup import near_vectors
from gneiss.llm.line_dedup import dedup_lines, line_counts
from gneiss.llm.registry import vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, row string, hash string, id int, shard int, b string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null texts, ids and sources, an empty, a blank and a long text, repeated rows; columns with names that the operators use."""
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, line), (2, None), (3, ""), (4, " \t\n"), (5, line), (6, "word " * 30000), (7, line.replace("five", "5")), (7, line.replace("five", "5")), (None, "A b C d e f"), (8, "short")]
    return spark.createDataFrame([(i, t, None if i == 5 else "s", "en", len(t or ""), "x", "y", 1, 2, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(text):
    return (text or "").encode().lower().split()


def test_words_of_long_texts():
    rng = np.random.default_rng(1)
    text = "\n ".join("x" * int(n) for n in rng.integers(1, 30, 400_000)).encode() + b"y" * (3 << 20) + b" Z"
    raw = np.frombuffer(text, np.uint8)
    assert len(raw) > 5 << 20
    h, starts, ends = words_.hash_words(raw)
    want = words_._hash_slice(raw, True)
    assert all((x == y).all() for x, y in zip((h, starts, ends), want, strict=True)) and len(h) == len(text.split())


def test_very_long_texts(spark):
    """Texts of more than 5 MB, one of them twice, through every operator on documents."""
    long = "\n".join(" ".join(f"w{(i * 31 + j * j) % 9973}" for j in range(40)) for i in range(24_000))
    assert len(long) > 5 << 20
    rows = [(1, long, "a", "en", 1), (2, "short text of few words", "b", "en", 1), (3, long, "a", "en", 1), (4, long[: len(long) // 10], "b", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(2)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    n = len(words(long))
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_words(df, block=4096).collect()} == {1: n, 2: 5, 3: n, 4: len(words(rows[3][1]))}
    assert {r["doc_id"]: r["n_tokens"] for r in ngram_lm.lm_scores(df).collect()}[3] == n + 1
    assert {r["doc_id"]: r["text"] for r in line_counts(df).collect()}[3] == ""
    assert packing.packed_documents(df, vocabulary()).filter("doc_id = 1").agg(F.sum("length")).first()[0] > n
    for make in (quality.quality_scores, toxicity.toxicity):
        assert make(df, labels).filter("score between 0 and 1").count() == 4
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert got[1]["n_chars"] == len(long) and got[1]["fingerprint"] == got[3]["fingerprint"]


# -- 2 -----------------------------------------------------------------------


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_minhash_components(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = brute_components(sets, 80)
    got = minhash_dedup.near_duplicates(docs, words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_large_bucket(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 5), replace=False):
            w[j] = f"x{rng.integers(10**9)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, words=4).collect()}
    assert got == brute_components({i: shingles(t, 4) for i, t in texts.items()}, 80)


@pytest.mark.parametrize("pivots", [0, 1, 3])
def test_minhash_tiles(spark, monkeypatch, pivots):
    """Near-copies of a text, some of them in no link, and a chain of copies; compared in several tiles and column blocks."""
    for name, value in (("PIVOTS", pivots), ("SMALL_BUCKET", 2), ("TILE", 16), ("TILES", 4), ("COLUMNS", 50)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = np.random.default_rng(7)
    texts, w = {}, [f"w{i}" for i in range(120)]
    for i in range(90):
        x = list(w)
        for j in rng.choice(120, rng.integers(0, 12), replace=False):
            x[j] = f"x{rng.integers(10**9)}"
        texts[i] = " ".join(x)
    for i in range(40):  # each one a few words further on
        w = w[2:] + [f"z{2 * i}", f"z{2 * i + 1}"]
        texts[200 + i] = " ".join(w)
    want = brute_components({i: shingles(t, 4) for i, t in texts.items()}, 80)
    assert 5 < len(set(want.values())) < 60
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, words=4).collect()} == want


def test_minhash_ids_of_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(5, a), (9, a), (9, b), (7, b), (11, c), (None, b), (None, c)], "doc_id long, text string")
    got = rows_of(minhash_dedup.near_duplicates(df, words=4), "doc_id", "component_id")
    assert got == sorted([(5, 5), (7, 5), (9, 5), (9, 5), (11, 11), (None, None), (None, None)], key=repr)


def test_minhash_odd(odd, nothing):
    got = rows_of(minhash_dedup.near_duplicates(odd, words=4), "doc_id", "component_id", "kept", "n_shingles")
    assert (5, 1, False, 8) in got and (2, 2, True, 0) in got and (3, 3, True, 0) in got and len(got) == 10
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_super_minhash_early_stop_changes_nothing():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 40).astype(np.uint64)
    whole = minhash_dedup.super_minhash(e, 32)
    parts = np.minimum(minhash_dedup.super_minhash(e[:13], 32), minhash_dedup.super_minhash(e[13:], 32))
    assert (whole == parts).all()
    assert len(set((minhash_dedup.super_minhash(e[:1], 32) >> np.uint64(32)).tolist())) == 32  # one element: every step once


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (5, 5), (9, 8), (8, 7), (7, 6), (3, 1), (None, 1)]
    got = rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "root")
    assert got == [(2, 1), (3, 1), (5, 4), (7, 6), (8, 6), (9, 6)]


# -- 8 -----------------------------------------------------------------------


def test_lines(spark, odd, nothing):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [
        (1, f"{a}\nshort line\nunique words that nobody else in here has written down"),
        (2, f"{a.upper()}\nshort line"),
        (3, f"{a.replace('eta theta', 'eta new theta')}\nfirst of its kind and quite alone"),
        (4, f"{a.replace('kappa', 'KAPA')}\n\nother words follow now for sure and stay"),
        (5, f"{a.replace('kappa', 'x').replace('beta', 'y')}"),
    ]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]  # the earliest stays
    assert 2 not in got and got[3] == "first of its kind and quite alone" and got[4] == "\nother words follow now for sure and stay"
    assert 5 in got  # two words differ
    out = dedup_lines(odd)
    assert out.columns == odd.columns
    assert rows_of(out.filter("doc_id in (2, 3, 4)"), "doc_id", "text") == [(2, None), (3, ""), (4, " \t\n")]
    assert rows_of(line_counts(odd).filter("doc_id = 5"), "n_lines", "n_dropped", "text") == [(1, 1, "")]
    assert dedup_lines(nothing).count() == 0


def within_one_word(x, y):
    if len(x) == len(y):
        return sum(u != v for u, v in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_near_lines_against_brute_force(spark):
    z = [f"w{i}" for i in range(12)]
    lines = [[*z[:3], "a", *z[3:]], z, [*z[:9], "b", *z[9:]]]  # the third is two edits from the first, one from the second
    rng = np.random.default_rng(8)
    for _ in range(150):
        x = list(lines[rng.integers(len(lines))])
        for _ in range(rng.integers(1, 3)):
            k, new = rng.integers(len(x)), [f"v{rng.integers(4)}"]
            x[k : k + rng.integers(2)] = new if rng.random() < 0.6 or len(x) < 11 else []
        lines.append(x)
    want = [i for i, x in enumerate(lines) if any(x == y or (max(len(x), len(y)) >= 10 and within_one_word(x, y)) for y in lines[:i])]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in line_counts(df).filter("n_dropped > 0").collect())
    assert {1, 2} <= set(want) and len(want) < len(lines) - 3 and got == want


# -- 1 -----------------------------------------------------------------------


def test_mix(docs, odd, nothing):
    got = mixing.mix_words(docs).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (got["size"] == [len(words(t)) for t in got.text]).all() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(n=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert abs(by.target.sum() - by.n.sum()) < 1e-6
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(by))], float)
    want, free = np.zeros(len(by)), np.ones(len(by), bool)
    while True:
        left = by.n.sum() - (3 * by.n.to_numpy()[~free]).sum()
        want[free] = weight[free] * left / weight[free].sum()
        over = free & (want > 3 * by.n.to_numpy())
        if not over.any():
            break
        want[over], free = 3 * by.n.to_numpy()[over], free & ~over
    assert by.target.to_numpy() == pytest.approx(want)
    assert (abs(by.taken - by.target) <= 2 * mixing.BLOCK).all()
    again = mixing.mix_words(docs.repartition(7)).toPandas().sort_values("doc_id")
    assert (again.taken.to_numpy() == got.sort_values("doc_id").taken.to_numpy()).all()
    out = mixing.mix_words(odd).collect()
    assert len(out) == 10 and sum(r["size"] for r in out) == 30000 + 44 + 6 + 1 and mixing.mix_words(nothing).count() == 0
    texts = mixing.mixed_documents(odd)
    assert texts.columns == odd.columns and mixing.mixed_documents(nothing).count() == 0
    assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in out)


def test_mix_of_sources_without_words(spark):
    rows = [(1, "a b c " * 40, "x"), (2, "", "empty"), (3, None, "empty"), (4, None, None), (5, "d\n e" * 50, "y"), (5, "d\n e" * 50, "y"), (None, "f g", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_words(df).collect()
    assert len(got) == 7 and {(r["doc_id"], r["source_size"], r["target"], r["taken"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(2, 0, 0.0, 0), (3, 0, 0.0, 0), (4, 0, 0.0, 0)}
    assert all(r["taken"] <= 3 * r["size"] for r in got) and sum(r["target"] for r in got if r["doc_id"] in (1, None)) == sum(r["size"] for r in got)
    texts = mixing.mixed_documents(df, block=4)
    assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in mixing.mix_words(df, block=4).collect())
    whole = {i: words(t) for i, t, _ in rows}
    assert all(set(words(r["text"])) <= set(whole[r["doc_id"]]) and "\n" in r["text"] for r in texts.filter("doc_id = 5").collect())


def test_mix_deals_texts_out_once(docs):
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    # One exchange holds the texts: that of the window on the two hashes, which the join uses as it is. The other is that of the runs.
    exchanges = re.findall(r"Exchange hashpartitioning\(((?:__k1|__g1)[^)]*)\)", plan)
    assert sorted(len(x.split(", ")) for x in exchanges if "pass" not in x) == [3] and "Cartesian" not in plan


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:03}": (i * 37 % 90) ** 2 for i in range(300)}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).orderBy("source").collect()
    weight, cap = np.array([(5, 2, 1)[i % 3] for i in range(300)], float), 3.0 * np.array(list(sizes.values()))
    lo, hi = 0.0, float(cap.max())
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(cap, mid * weight).sum() < sum(sizes.values()) else (lo, mid)
    assert [r["s"] for r in got] == list(range(300)) and [r["target"] for r in got] == pytest.approx(np.minimum(cap, lo * weight).tolist(), abs=1e-3)
    assert [r["first_slot"] for r in got] == [sum(r["slots"] for r in got[:i]) for i in range(300)]


def test_swap_or_not_is_a_permutation(spark):
    for n in (1, 2, 97):
        df = spark.range(n).select("id", F.col("id").alias("u"))
        # Written each time: the planner's constraints on such a chain grow without end.
        there = written(mixing._swap_or_not(df, "u", F.lit(n), [F.lit(5)]))
        back = written(mixing._swap_or_not(there, "u", F.lit(n), [F.lit(5)], backwards=True))
        assert sorted(r["u"] for r in there.collect()) == list(range(n)) and back.filter("id <> u").isEmpty()


# -- 3 -----------------------------------------------------------------------


def brute_signatures(text):
    import re

    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    stop = set(fingerprints.ANCHORS)
    out = set()
    for i, x in enumerate(w):
        if x in stop and len(c := [y for y in w[i:] if y not in stop][:2]) == 2:
            out.add((x, *c))
    if not out and w:
        out = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    return out


def test_fingerprints(docs, odd, nothing):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = fingerprints.edited_fingerprints(docs).orderBy("doc_id").collect()
    sets = [brute_signatures(t) for t in texts]
    for i, (t, r) in enumerate(zip(texts, got, strict=True)):
        k = len(t) // 2
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        for x, y in ((r["near_edited"], brute_signatures(edited)), (r["near_next"], sets[(i + 1) % len(texts)])):
            assert x == pytest.approx(len(sets[i] & y) / max(1, len(sets[i] | y)) if sets[i] | y else 1.0, abs=0.02)
        assert len(r["fingerprint"]) == 8 * len(sets[i])
    out = fingerprints.edited_fingerprints(odd).collect()
    assert len(out) == 10 and all(0 <= r["near_edited"] <= 1 for r in out) and fingerprints.edited_fingerprints(nothing).count() == 0
    reps = {}
    for r, s in zip(got, sets, strict=True):
        reps.setdefault(frozenset(s), r["doc_id"])
    want = {tuple(sorted((a, b))) for (x, a), (y, b) in itertools.combinations(reps.items(), 2) if x and y and len(x & y) >= 0.8 * len(x | y)}
    assert {(r["a"], r["b"]) for r in fingerprints.similar_pairs(docs, 0.8).collect()} == want


# -- 4 -----------------------------------------------------------------------


def test_packing(docs, odd, nothing):
    from tokenizers import Tokenizer

    path = vocabulary()
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        got = packing.pack(packing.token_pieces(df, path, with_ids=True)).collect()
        texts = collections.Counter((r["doc_id"], r["text"] or "") for r in df.collect())
        ids = {k: np.asarray([*tok.encode(k[1], add_special_tokens=False).ids, 0], "<u4").tobytes() for k in texts}
        assert sum(r["length"] for r in got) == sum(n * len(ids[k]) // 4 for k, n in texts.items())
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
        if df is docs:
            by = collections.defaultdict(dict)
            for r in got:
                by[r["doc_id"]][r["start"]] = bytes(r["ids"])
            assert {k: b"".join(v for _, v in sorted(p.items())) for k, p in by.items()} == {k[0]: v for k, v in ids.items()}
        seqs = collections.defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in seqs.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(seqs) <= 1.005 * -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed_documents(nothing, path).count() == 0


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    ids, tok = packing.WordIds(vocabulary()), Tokenizer.from_file(vocabulary())
    for t in ["I'll don't <|endoftext|> x", "naïve ½ ²x İstanbul ẞ ǅ ́e é 日本語   a b", "ŉ'S 'LL µ ª\x1cz ſ &'s", "", "ÉCOLE\tÉcole 12,5!"]:
        assert ids(t) == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_tightened_keeps_pieces_whole():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1200, 300)
    first, _ = packing.sum_of_squares(sizes)
    got = packing.tightened(sizes, first, tries=30)
    assert np.bincount(got, sizes).max() <= 2048 and sorted(set(got.tolist())) == list(range(got.max() + 1)) and got.max() <= first.max()


def test_sum_of_squares_rule():
    seq, off = packing.sum_of_squares(np.array([6, 4, 5, 5, 10]), 10)
    assert seq.tolist() == [0, 0, 1, 1, 2] and off.tolist() == [0, 6, 0, 5, 0]


# -- 5 and 6 -------------------------------------------------------------------


def test_classifiers(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for make, label, least in ((quality.quality_scores, "quality", 0.95), (toxicity.toxicity, "toxic", 0.85)):
        got = make(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
        held = got[got.held_out]
        assert len(held) > 80 and (held.predicted == held[label]).mean() >= least
        assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
        out = make(odd, labels).collect()
        assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out) and make(nothing, labels).count() == 0
        assert all(0 <= r["score"] <= 1 for r in make(odd, labels.limit(0)).collect())
    assert quality.good_documents(odd, labels).columns == odd.columns
    clash = odd.withColumnRenamed("row", "score").withColumnRenamed("hash", "y").withColumnRenamed("b", "predicted").drop("n_chars")
    assert quality.good_documents(clash, labels).columns == clash.columns and quality.good_documents(clash.limit(0), labels).count() == 0
    again = [rows_of(quality.quality_scores(odd.repartition(k), labels), "doc_id", "score") for k in (1, 5)]
    assert again[0] == again[1]


def test_toxic_tokens_at_every_sample_size():
    # Documents with each key: toxic in 9 and clean in none; in 4 of both; a word of all; one of three toxic documents.
    for k in (1, 10):
        got, odds = toxicity.admitted(np.array([9.0 * k, 4 * k, 400 * k, 3]), np.array([0.0, 4 * k, 1600 * k, 0]), 400 * 60.0 * k, 1600 * 60.0 * k, 5000, 0.1, math.log(5))
        assert got.tolist() == [True, False, False, False] and odds[0] > odds[1] > odds[2]


def test_first_of_copies():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2**40, (2, 64))
    near = a.copy()
    near[:8] = 1
    far = a.copy()
    far[:30] = 2
    assert toxicity.first_of_copies([a, b, near, a, far, b]).tolist() == [0, 1, 0, 0, 4, 1]


def test_segments_against_all_ranges():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.integers(-3, 4, 12).astype(float)
        found, taken = toxicity.segments(s), []

        def best(lo, hi, s=s, taken=taken):
            top = max(((s[a:b].sum(), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), key=lambda x: (x[0], x[1] - x[2], -x[1]), default=(0,))
            if top[0] > 0:
                taken.append(top[0])
                best(lo, top[1])
                best(top[2], hi)

        best(0, 12)
        assert max((x[2] for x in found), default=0) == pytest.approx(max(taken, default=0))
        assert all(s[a:b].sum() == pytest.approx(v) and v > 0 for a, b, v in found)


def test_machine_identity():
    rng = np.random.default_rng(2)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    idx, val = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.v[a] @ m.v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(idx, val, strict=True), 2))
    assert m.margin(np.array([0, 3]), idx, val)[0] == pytest.approx(0.3 + m.w[idx] @ val + pairs)


# -- 7 -----------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rng.normal(size=(10, 16)), base[:3]]).astype(np.float32)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, pass int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert all(got[i]["component_id"] == min(np.flatnonzero(near[i])) for i in range(30))
    assert all(got[100 + i]["n_links"] == 0 and got[100 + i]["kept"] for i in range(len(bad)))
    assert near_vectors(df.limit(0)).count() == 0


def test_links_of_a_group_larger_than_the_windows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 50)  # several tiles
    rng = np.random.default_rng(6)
    x = (rng.normal(size=16) + 0.25 * rng.normal(size=(400, 16))).astype(np.float32)
    x = np.concatenate([x, x[:2]])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, passes=8, window=8).collect()}
    assert want.max() > 8 * 16 and [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("parts", [8, 60])
def test_dense_group_and_scattered_pairs(spark, parts):
    """2,000 near vectors (more than windows reach), copies, and isolated pairs just above and below the threshold."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = unit(rng.normal(size=32) + 0.3 * rng.normal(size=(2000, 32)))
    a, b = unit(rng.normal(size=(300, 32))), unit(rng.normal(size=(300, 32)))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    c = np.where(np.arange(300) % 3, 0.905, 0.895)[:, None]
    x = np.concatenate([group, a, c * a + np.sqrt(1 - c * c) * b, group[:5], a[:5]]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(parts)
    y = unit(x.astype(float))
    links = y @ y.T >= 0.9
    root = np.arange(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(links[i])
        root[np.isin(root, root[near])] = root[near].min()
    want = {i: (int(links[i].sum()) - 1, int(root[i])) for i in range(len(x))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want[0][0] > 2 * embedding_dedup.WINDOW and got == want


def test_passes_grow_with_the_table():
    assert embedding_dedup.passes_for(0) == embedding_dedup.passes_for(1000) == 24
    assert 24 < embedding_dedup.passes_for(50_000) < embedding_dedup.passes_for(500_000) < embedding_dedup.passes_for(50_000_000)


# -- 9 -----------------------------------------------------------------------


def kneser_ney(train, order):
    """p(context, word) of the interpolated modified model by plain dictionaries, and the counts of each order."""
    grams = lambda t, n: [tuple((["start"] * (n - 1) + t)[i : i + n]) for i in range(len(t))]
    count = {order: collections.Counter(g for t in train for g in grams(t, order))}
    for n in range(order - 1, 0, -1):
        count[n] = collections.Counter(g[1:] for g in count[n + 1])
    d = {n: (0, *ngram_lm.discounts([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)])) for n, c in count.items()}
    total, cut = collections.Counter(), collections.Counter()
    for n, c in count.items():
        for g, k in c.items():
            total[n, g[:-1]] += k
            cut[n, g[:-1]] += d[n][min(k, 3)]
    v = len(count[1])

    def p(context, word):
        n = len(context) + 1
        low = 1 / (v + 1) if n == 1 else p(context[1:], word)
        if not total[n, context]:
            return low
        k = count[n][*context, word]
        return max(k - d[n][min(k, 3)], 0) / total[n, context] + cut[n, context] / total[n, context] * low

    return p, v


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, odd, nothing, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "run_tokens", lambda tokens: 5000)
    monkeypatch.setattr(ngram_lm, "key_bits", lambda tokens: 60)  # no n-gram meets another
    texts = {r["doc_id"]: [*words(r["text"]), "end"] for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    p, v = kneser_ney(train, order)
    one = collections.Counter(w for t in train for w in t)
    n = sum(one.values())
    got = ngram_lm.lm_scores(docs.repartition(3), order=order).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        padded = ["start"] * (order - 1) + t
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(t)), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in one for w in t), n)
    context = (b"the",) * (order - 1)
    assert sum(p(context, w) for w in one) + p(context, "never seen") == pytest.approx(1.0)


def test_language_model_odd(odd, nothing):
    assert ngram_lm.lm_scores(odd).count() == 10 and ngram_lm.lm_scores(nothing).count() == 0
    held = odd.withColumn("doc_id", F.lit(None).cast("long"))  # the empty text's crc32 is 0: no row trains
    got = ngram_lm.lm_scores(held).collect()
    assert len(got) == 10 and all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_arrays_on_their_way():
    rng = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64):
        a = rng.integers(0, np.iinfo(kind).max, 77, dtype=kind)
        assert (ngram_lm._unplaned(ngram_lm._planes(a), kind) == a).all() and len(ngram_lm._unplaned(b"", kind)) == 0
    for width, top in itertools.product((1, 5, 6), (2, 300, 2**33)):
        fields = np.where(rng.random((width, 90)) < 0.5, rng.integers(0, top, (width, 90)), 0)
        fields[:, 5], fields[:, 6] = ngram_lm._USUAL[:width], 0
        for f in (fields, fields[:, :0]):
            assert (ngram_lm._unpacked(ngram_lm._packed(f), width, f.shape[1]) == f).all()


# -- 10 ----------------------------------------------------------------------


def test_pages(spark):
    page = lambda i: f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div class="ad-box">Buy</div><article><h1>Title {i}</h1><p>First &amp; best\n text {i}<b>bold<p>Second<br>line {i}
    <p>Printed by the same firm</p><p>Edition of the week</p></article><section id="comments"><p>Me too</p></section><form>Name</form><script>x="</p>"</script><footer>&copy; us</footer></body></html>"""  # noqa: E731
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(10)]
    rows += [(20, "https://b.example/x", "<body><p>Only this &lt;here&gt;"), (21, None, None), (22, "", ""), (23, "u", "plain text"), (24, "c.example", "<div><a href=x>All of this is links</a></div><div>Real text stays</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit("x"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for i in range(10):
        assert got[i]["text"] == f"Title {i}\n\nFirst & best text {i}bold\n\nSecond line {i}"  # the firm and the edition are the host's template
    assert got[20]["text"] == "Only this <here>" and got[23]["text"] == "plain text" and got[24]["text"] == "Real text stays"
    assert got[21]["text"] == got[22]["text"] == "" and got[21]["n_chars"] == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_names_on_wrappers_of_the_article():
    text = "<h1 class='entry-header'>Title</h1><p>The text of this page is here and it goes on for a while</p>"
    want = "Title\n\nThe text of this page is here and it goes on for a while"
    side = "<div class='sidebar'><p>Read this too</p></div>"
    for page in (f"<body class='has-sidebar'>{text}{side}", f"<body class='no-sidebar'><div class='main with-menu'>{text}</div>{side}", f"<div class='share'><article>{text}</article>{side}</div>", f"<div class='search-result'>{text}</div>{side}", f"<form class='login'><div class='banner'>{text}{side}</div></form>"):
        assert html_extract.main_text(page) == want, page
    assert html_extract.main_text(f"<article>{text}</article><div class='related'><article>Teaser</article></div>") == want


def neutral_page(i, n=0):
    """Names and tags that say nothing; menu, teaser and notice vary from page to page."""
    return f"""<div class=x1><div class=x2><p><a href=/{i}>Go to {i}</a></p><p><a href=/>Home {i}</a></p></div><div class=x3><h1>Title {i}</h1><div class=x4><p>First words of page {i}, which
    go on for a good while {n}</p><p>And the second paragraph of number {i}, as long as the first</p></div></div><div class=x5><p>See also {i}</p></div><div class=x6><p>All rights are with us</p><p>Since 1999</p></div></div>"""


def test_only_the_template_tells_content(spark):
    rows = [(i, f"https://a.example/{i}", neutral_page(i)) for i in range(12)]
    rows += [(20 + i, "https://b.example/", neutral_page(i % 2)) for i in range(6)]  # two distinct pages: no template
    rows += [(40 + i, f"https://c.example/{i}", neutral_page(3, i)) for i in range(12)]  # near-copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = lambda i, n=0: f"Title {i}\n\nFirst words of page {i}, which go on for a good while {n}\n\nAnd the second paragraph of number {i}, as long as the first"
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    off = {r["page_id"]: r["text"] for r in html_extract.extract(df, least=10**6).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == want(i) and got[40 + i] == want(3, i)
        assert off[i] != got[i] and "See also" in off[i] and "Since 1999" in off[i]
    assert got[20] == off[20]


def article_text(source):
    """The text of a page's article by plain replacements, for pages whose articles hold headings, paragraphs, bold text and breaks."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    assert {x.lower() for x in re.findall(r"</?([a-zA-Z0-9]+)", inner)} <= {"h1", "p", "b", "br"}
    blocks = re.split(r"</?(?:p|h1)[^>]*>", inner, flags=re.I)
    plain = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br\s*/?>", " ", b, flags=re.I), flags=re.I)).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_pages_against_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_extract.extract(pages).collect()
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_content_slot():
    tag = lambda *path: html_extract._tag("/" + "/".join(path))
    row = lambda *path, chars=0, links=0: {tag(*path): (tag(*path[:-1]) if path[:-1] else 0, html_extract._flags("/" + "/".join(path)), chars, links)}
    shell = row("body", chars=1000) | row("body", "div.a", chars=700) | row("body", "div.b", chars=300, links=290)
    assert html_extract.content_slot(shell | row("body", "div.a", "p", chars=700), {}) == (tag("body", "div.a"), [])
    assert html_extract.content_slot(shell, {7: (tag("body", "div.a"), 700, 0)}) == (0, [])  # all of it is constant
    inner = row("body", "div.a", "ul", chars=100, links=95) | row("body", "div.a", "p", chars=600)
    assert html_extract.content_slot(shell | inner, {}) == (tag("body", "div.a"), [tag("body", "div.a", "ul")])
    beside = row("body", "h1", chars=20)
    assert html_extract.content_slot(shell | beside, {}) == (tag("body", "div.a"), [-tag("body", "h1")])
    assert html_extract.content_slot(row("body", chars=100) | row("body", "p", chars=100), {}) == (0, [])
    assert html_extract.content_slot({}, {}) == (0, [])


def test_copies_of_a_page_are_no_template(spark):
    page = lambda i: f"<nav>Home</nav><article><h1>Title {i}</h1><p>First line {i}</p><p>Second line {i}</p></article>"
    rows = [(i, f"https://a.example/{i}", page(max(0, i - 6))) for i in range(10)]  # seven copies
    rows += [(100 + i, f"https://b.example/{i}", page(max(0, i - 14))) for i in range(24)]  # fifteen copies, ten pages
    rows += [(200 + i, f"https://c.example/{i}", page(0).replace("<nav>", f"<nav>{i} ")) for i in range(9)]  # nothing else on any page
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, n in [*((i, max(0, i - 6)) for i in range(10)), *((100 + i, max(0, i - 14)) for i in range(24)), *((200 + i, 0) for i in range(9))]:
        assert got[i] == f"Title {n}\n\nFirst line {n}\n\nSecond line {n}", i
