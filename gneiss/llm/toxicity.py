"""Toxic passages by maximum-scoring segments over token log-odds.

A token's score is its log-odds between toxic and other documents under a Dirichlet prior that
follows the overall frequencies. Tokens without significant evidence cost DRIFT each. One linear scan finds
every maximal segment. A segment of score S among n tokens has the value lambda S - ln(K n): minus the logarithm of how many
segments as good clean text of that length is expected to show, so that the best one's value follows a Gumbel law (lambda
solves E[exp(lambda s)] = 1, K comes from the number of segments in clean training documents). The values of a
document's significant segments add up, and a logistic curve turns the sum into the score.

Learning uses training rows alone. Their documents are dealt to FOLDS, near-copies together. Which tokens
count is set by the false discovery rate q of the signed root of the likelihood ratio, the least log-odds, and whether a word
without evidence of its own takes that of its beginning (6, 5, then 4 bytes). fit() tries each of SETTINGS: every fold is
scored by a model of the other folds, lambda and K come from the fold's clean documents, and the setting whose
logistic curve explains the labels of all folds best is taken, with that curve. So no row that scores are judged on, and
no document that a token was counted in, takes part in a choice.

Tokens are counted in Spark, near-copies once. The driver gets, of the bounded sample, SKETCH hashes and one number
per setting of each document, and of the tokens those that a setting could admit.

Training reads at most PER_CLASS labelled documents of each class. Rows: null texts count as empty;
texts without tokens get the score of no evidence. Without training rows of both classes every
score is 0. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.labelled import held_out, training_texts
from gneiss.llm.words import _pow, bounded_batches, chunks_with_bytes, list_array, mix, signed

#: Labelled documents of each class that training reads at most.
PER_CLASS = 4000
PREFIXES = (6, 5, 4)
DRIFT, PRIOR = 0.4, 200.0
#: A token must occur in so many toxic documents that aren't near-copies of each other, whatever the sample's size.
AT_LEAST = 4
#: What learning chooses from: false discovery rate, least log-odds, whether beginnings of words count.
SETTINGS = tuple(product((0.03, 0.3), (math.log(5), math.log(20)), (False, True)))
FOLDS = 4
#: Minima that a document's set of words is sketched by; documents that share COPY of them are near-copies: the first counts.
SKETCH, COPY = 64, 0.8
#: A segment counts if clean text of this length shows one as good with at most this chance.
SIGNIFICANT = 0.01


def token_parts(hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """The words' hashes, then those of their beginnings (0 for shorter words). Closing punctuation is cut off."""
    sizes = stops - starts
    while len(stops):
        last = raw[np.maximum(stops - 1, 0)]
        cut = (sizes > 1) & np.isin(last, np.frombuffer(b".,;:!?", dtype=np.uint8))
        if not cut.any():
            break
        stops, sizes = stops - cut, sizes - cut
    out, sums, k = {}, np.zeros(len(starts), np.uint64), 0
    power = _pow(int(sizes.max(initial=1)) + 1)
    longest = int(sizes.max(initial=0))
    while k < longest and k < max(PREFIXES):
        inside = sizes > k
        sums[inside] += (raw[starts[inside] + k].astype(np.uint64) + np.uint64(1)) * power[k]
        k += 1
        if k in PREFIXES:
            out[k] = np.where(sizes >= k, mix(sums + np.uint64(k << 40)), np.uint64(0))
    none = np.zeros(len(starts), np.uint64)
    whole = sums.copy()
    long = np.flatnonzero(sizes > k)
    if len(long):
        rest = sizes[long] - k
        at = np.cumsum(rest) - rest
        place = np.arange(int(rest.sum())) - np.repeat(at, rest)
        letters = (raw[np.repeat(starts[long] + k, rest) + place].astype(np.uint64) + np.uint64(1)) * power[place + k]
        whole[long] += np.add.reduceat(letters, at)
    return [mix(whole + sizes.astype(np.uint64)), *[out.get(p, none) for p in PREFIXES]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in one linear scan (each joins earlier ones at most once)."""
    found: list[list[float]] = []  # from, to, sum before, sum after
    total = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= right:
                found.append([start, i + 1, left, right, j])
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in found]


@dataclass
class ToxicModel:
    keys: np.ndarray
    odds: np.ndarray
    beginnings: bool = True
    lam: float = 1.0
    ln_k: float = 0.0
    slope: float = 0.0
    offset: float = -40.0

    def __post_init__(self):
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys & np.uint64((1 << 16) - 1)).astype(np.int64)] = True

    def _look(self, h: np.ndarray, into: np.ndarray, open_: np.ndarray) -> None:
        at = np.flatnonzero(self.filter[(h & np.uint64((1 << 16) - 1)).astype(np.int64)] & open_)
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[k] == h[at]
            into[at[hit]] = self.odds[k[hit]]
            open_[at[hit]] = False

    def token_scores(self, parts: list[np.ndarray]) -> np.ndarray:
        out, open_ = np.full(len(parts[0]), -DRIFT), np.ones(len(parts[0]), bool)
        for h in parts if self.beginnings else parts[:1]:
            self._look(h, out, open_)
        return out

    def value(self, score: float, n: int) -> float:
        return self.lam * score - self.ln_k - math.log(max(n, 1))

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """The summed values of the significant passages, and the passages; without any, the best value (0 at least)."""
        found = [(a, b, self.value(s, len(scores))) for a, b, s in segments(scores)]
        sure = [x for x in found if -math.expm1(-math.exp(-max(x[2], -30.0))) <= SIGNIFICANT]
        if sure:
            return sum(x[2] for x in sure), sure
        return max([0.0, *(x[2] for x in found)]), []

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * math.asinh(evidence) + self.offset))))


def _training_parts(batch: pa.RecordBatch):
    """(row, y, the token's hash and those of its beginnings) of each document of a batch of (row, y, text)."""
    rows, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for lo, hi, hashes, offsets, raw, starts, stops in chunks_with_bytes(batch.column(2)):
        parts = token_parts(hashes, raw, starts, stops)
        for i in range(lo, hi):
            a, b = offsets[i - lo], offsets[i - lo + 1]
            yield rows[i], y[i], [p[a:b] for p in parts]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sketch): the minima of SKETCH hashes of the document's words; none for a document without words."""
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for batch in batches:
        found = [(row, np.unique(parts[0])) for row, _, parts in _training_parts(batch)]
        minima = [np.array([mix(s ^ seed).min() for seed in seeds]) if len(s) else np.empty(0, np.uint64) for _, s in found]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), list_array([signed(m) for m in minima], pa.int64())], names=["row", "sketch"])


def first_of_copies(sketches: list[np.ndarray]) -> np.ndarray:
    """Of each sketch, the place of the first whose near-copy it is (its own, if of none). Candidates share a pair of minima."""
    seen: dict[tuple, int] = {}
    out = np.arange(len(sketches))
    for i, s in enumerate(sketches):
        bands = [(k, *x) for k, x in enumerate(s.reshape(-1, 2).tolist())]
        for j in sorted({seen[b] for b in bands if b in seen}):
            if (sketches[j] == s).mean() >= COPY:
                out[i] = j
                break
        else:
            for b in bands:
                seen.setdefault(b, i)
    return out


def _token_counts(kept: dict[int, int]):
    """(key, and the number of documents of each fold and class that have it) of a batch's documents. kept: the folds of rows that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for row, y, parts in _training_parts(batch):
                if row in kept:
                    keys.append(np.unique(np.concatenate(parts)))
                    cells.append(np.full(len(keys[-1]), 2 * kept[row] + y))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(at * 2 * FOLDS + np.concatenate(cells), minlength=len(key) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
            some = key != 0
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[some])), *[pa.array(np.ascontiguousarray(counts[some, c])) for c in range(2 * FOLDS)]], names=["key", *_CELLS])

    return run


_CELLS = [f"c{k}" for k in range(2 * FOLDS)]


def admitted(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, tests: int, q: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of some keys a setting admits, and the log-odds of all. toxic, clean: documents with the key; n_toxic, n_clean:
    sums over all keys; tests: keys that could be admitted. Keys left out of toxic and clean must have smaller odds than least."""
    both = max(n_toxic + n_clean, 1.0)
    prior = PRIOR * (toxic + clean) / both + 0.1
    total = PRIOR + 0.1 * max(tests, 1)
    delta = np.log((toxic + prior) / (n_toxic + total - toxic - prior)) - np.log((clean + prior) / (n_clean + total - clean - prior))
    # The signed root of the likelihood ratio; a deviation from the posterior's variance would be blind to words that clean text never has.
    part = lambda y, n: y * np.log(np.maximum(y, 1e-9) / np.maximum((toxic + clean) * n / both, 1e-9))
    z = np.sign(delta) * np.sqrt(np.maximum(2 * (part(toxic, n_toxic) + part(clean, n_clean)), 0))
    chance = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
    able = np.flatnonzero((toxic >= AT_LEAST) & (delta >= least))
    order = able[np.argsort(chance[able], kind="stable")]
    good = np.flatnonzero(chance[order] <= q * np.arange(1, len(order) + 1) / max(tests, 1))
    out = np.zeros(len(toxic), bool)
    out[order[: good[-1] + 1 if len(good) else 0]] = True
    return out, delta


def _scored(models: dict[tuple[int, int], ToxicModel], folds: dict[int, int]):
    """Of the clean documents of a batch under each setting, by the models of their folds: (setting, fold, score, tokens of
    that score), and (setting, -1 - fold, score, segments of that score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int, float], int] = Counter()
            for row, y, parts in _training_parts(batch):
                fold = folds.get(row)
                if y or fold is None or not len(parts[0]):
                    continue
                for k in range(len(SETTINGS)):
                    scores = models[k, fold].token_scores(parts)
                    for v, n in zip(*(x.tolist() for x in np.unique(scores, return_counts=True)), strict=True):
                        sums[k, fold, v] += n
                    sums.update((k, -1 - fold, round(s, 6)) for _, _, s in segments(scores))
            rows = [(*key, n) for key, n in sums.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["setting", "fold", "value", "n"])

    return run


def _evidences(models: dict[tuple[int, int], ToxicModel], folds: dict[int, int]):
    """(row, y, evidence under each setting by the model of the document's fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, y, [models[k, folds[row]].evidence(models[k, folds[row]].token_scores(parts))[0] for k in range(len(SETTINGS))]) for row, y, parts in _training_parts(batch) if row in folds]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], names=["row", "y", "evidence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicModel:
    bounded_batches(docs.sparkSession)
    none = ToxicModel(np.empty(0, np.uint64), np.empty(0))
    # The bounded sample; rows with the same text and label are one.
    texts = training_texts(docs, labels, label, per_class).select(F.xxhash64("text", "y").alias("row"), "y", "text").dropDuplicates(["row"])
    train = written(texts, "toxic-sample")
    got = sorted(train.mapInArrow(_sketches, "row bigint, sketch array<bigint>").toArrow().to_pylist(), key=lambda r: r["row"])
    got = [r for r in got if r["sketch"]]
    first = first_of_copies([np.array(r["sketch"], np.int64) for r in got])
    rows = [r["row"] for r in got]
    folds = {row: int(mix(np.array([rows[k]], np.int64).view(np.uint64))[0] >> np.uint64(11)) % FOLDS for row, k in zip(rows, first.tolist(), strict=True)}
    kept = {row: folds[row] for i, row in enumerate(rows) if first[i] == i}
    counts = train.mapInArrow(_token_counts(kept), f"key bigint, {', '.join(f'{c} bigint' for c in _CELLS)}").groupBy("key").agg(*[F.sum(c).alias(c) for c in _CELLS])
    counts = written(counts, "token-counts")
    toxic, clean = (sum((F.col(c) for c in _CELLS[k::2]), F.lit(0)) for k in (1, 0))
    sums = counts.agg(F.count_if(toxic + clean >= AT_LEAST), *[F.sum(c) for c in _CELLS]).first()
    tests, n = sums[0], np.array([x or 0 for x in sums[1:]], float)
    if not n[1::2].sum() or not n[0::2].sum():
        drop(train, counts)
        return none
    # Keys that are no more frequent in toxic documents, and those of few, can't be admitted by any setting.
    able = counts.filter((toxic >= AT_LEAST) & (toxic * float(n[0::2].sum()) > 2 * clean * float(n[1::2].sum()))).toArrow()
    drop(counts)
    keys = able.column("key").to_numpy().view(np.uint64)
    c = np.stack([able.column(x).to_numpy() for x in _CELLS], axis=1).astype(float)
    order = np.argsort(keys)
    keys, c = keys[order], c[order]

    def model(setting: tuple, without: int | None) -> ToxicModel:
        use = [f for f in range(FOLDS) if f != without]
        t, o = (c[:, [2 * f + k for f in use]].sum(axis=1) for k in (1, 0))
        sure, odds = admitted(t, o, n[[2 * f + 1 for f in use]].sum(), n[[2 * f for f in use]].sum(), tests, *setting[:2])
        return ToxicModel(keys[sure], odds[sure], setting[2])

    models = {(k, f): model(setting, f) for k, setting in enumerate(SETTINGS) for f in range(FOLDS)}
    seen = written(train.mapInArrow(_scored(models, folds), "setting int, fold int, value double, n bigint"), "token-scores")
    # One row for each distinct score, and one for the least score of a segment.
    tokens = seen.filter("fold >= 0").groupBy("setting", "fold", "value").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    best = {(r["setting"], -1 - r["fold"]): r for r in seen.filter("fold < 0").groupBy("setting", "fold").agg(F.sum("n").alias("n"), F.min("value").alias("least")).collect()}
    drop(seen)
    for (k, f), m in models.items():
        x = tokens[(tokens.setting == k) & (tokens.fold == f)].sort_values("value")
        m.lam = _lambda(x.value.to_numpy(), x.n.to_numpy().astype(float))
        found = best.get((k, f))
        # Of segments that score s at least, K n exp(-lambda s) are expected; one more is counted, so that K is never 0.
        m.ln_k = math.log((1 + found["n"] if found else 1) / max(1.0, x.n.sum())) + (m.lam * found["least"] if found else 0.0)
    evidence = sorted(train.mapInArrow(_evidences(models, folds), "row bigint, y int, evidence array<double>").toArrow().to_pylist(), key=lambda r: r["row"])
    drop(train)
    y, x = np.array([r["y"] for r in evidence], float), np.arcsinh(np.array([r["evidence"] for r in evidence]))
    curves = [_logistic(x[:, k], y) for k in range(len(SETTINGS))]
    k = min(range(len(SETTINGS)), key=lambda k: (round(_loss(x[:, k], y, *curves[k]), 9), k))
    out = model(SETTINGS[k], None)
    out.lam, out.ln_k = (math.fsum(getattr(models[k, f], a) for f in range(FOLDS)) / FOLDS for a in ("lam", "ln_k"))
    out.slope, out.offset = curves[k]
    return out


def _lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over sorted scores; 1 if no clean token scores above zero."""
    if not len(values) or values[-1] <= 0 or (values * counts).sum() >= 0:
        return 1.0
    lo, hi, share = 1e-6, 4.0, counts / counts.sum()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return lo


def _loss(x: np.ndarray, y: np.ndarray, slope: float, offset: float) -> float:
    """The mean logistic loss."""
    return float(np.logaddexp(0, np.where(y > 0, -1, 1) * np.clip(slope * x + offset, -40, 40)).mean())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, lightly regularised."""
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - y) + 1e-2 * w)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _score(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, offsets, raw, starts, stops in chunks_with_bytes(batch.column(1)):
                tokens = model.token_scores(token_parts(hashes, raw, starts, stops))
                scores, passages = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    evidence, found = model.evidence(tokens[a:b])
                    scores.append(model.score(evidence))
                    passages.append([{"from": i, "to": j, "value": v} for i, j, v in found])
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("value", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (word ranges and values of the significant ones)."""
    model = fit(docs, labels, label, per_class)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id bigint, score double, passages array<struct<`from`:bigint,`to`:bigint,value:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
