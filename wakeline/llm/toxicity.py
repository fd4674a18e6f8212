"""Toxic passages as maximum-scoring segments over token log-odds.

Terms (words, and beginnings of words) get log-odds between toxic and clean training documents under an
informative Dirichlet prior, the term's own overall frequency; they are shrunk by their standard error,
so what little is known of a term says little. Terms of either label count. A document is then a sequence
of scores; one linear scan finds every maximal segment, an extreme-value law turns a segment's score into
the number of such segments that clean text of that length gives by chance, and the significant ones add
up to the document's evidence. The law and the final curve are fitted by two halves of the training documents,
either of which is scored with the terms of the other; the terms of both are then used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

#: The model is fitted on at most so many labelled rows, chosen by a hash of doc_id.
SAMPLE_ROWS = 40_000
#: Pseudo-counts of the prior; the standard errors by which log-odds are shrunk towards 0.
PRIOR, SHRINK = 2.0, 3.0
#: Lengths of the beginnings of words that are terms, too.
PREFIXES, THRESHOLD = (5, 6, 7, 8), 0.3
#: Words whose scores a task remembers.
KEPT_WORDS = 500_000
#: A segment counts as significant if clean text of this length has at most so many by chance.
EXPECTED = 0.05
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _of(word: str) -> list[str]:
    """The terms of a word: its beginnings, marked, and itself."""
    return [*("^" + word[:n] for n in PREFIXES if len(word) > n), word]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by the linear scan of Ruzzo and Tompa.

    Only runs of positive scores are visited; what lies between two of them is one sum.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list] = []  # begin, end, sum before, sum after
    for i in up.tolist():
        seg = [i, i + 1, float(total[i]), float(total[i + 1])]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(a, b, y - x) for a, b, x, y in out]


class Model:
    """Term scores, the score of any other token, the law's two constants, and the final curve."""

    def __init__(self, weights: dict[str, float], other: float) -> None:
        self.weights, self.other = weights, other
        self.rate, self.log_k, self.curve = 1.0, 0.0, (0.0, 1.0)
        self._met: dict[str, float] = {}

    def scores(self, words: list[str]) -> np.ndarray:
        """A token's score is that of its strongest term."""
        if len(self._met) > KEPT_WORDS:
            self._met.clear()
        get, known = self.weights.get, self._met
        for w in set(words).difference(known):
            found = [x for t in _of(w) if (x := get(t)) is not None]
            known[w] = max(found, key=abs) if found else math.nan
        scores = np.fromiter(map(known.__getitem__, words), float, len(words))
        return np.where(np.isnan(scores), self.other, scores)

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Each maximal segment with its score and the log of its expected number in clean text."""
        base = self.log_k + math.log(max(1, len(words)))
        return [(a, b, s, base - self.rate * s) for a, b, s in segments(self.scores(words))]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        """Nats of surprise of all significant passages; else that of the best one, which is less."""
        if not found:
            return -8.0
        significant = [-e for *_, e in found if e <= math.log(EXPECTED)]
        return sum(significant) if significant else max(-8.0, max(-e for *_, e in found))

    def score(self, x: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often either label's documents of either half have each term; in one document by the times' logarithm."""
    for b in batches:
        seen: list[dict[str, float]] = [{}, {}, {}, {}]
        for text, y, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
            own: Counter = Counter()
            for w, n in Counter(terms(text)).items():
                for t in _of(w):
                    own[t] += n
            into = seen[2 * half + y]
            for t, n in own.items():
                into[t] = into.get(t, 0.0) + math.log2(1 + n)
        every = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([s.get(t, 0.0) for t in every], pa.float64()) for s in seen)], ["term", *_COUNTS])


_COUNTS = ["a0", "a1", "b0", "b1"]


def _lexicon(counts: DataFrame, halves: str) -> dict[str, float]:
    """Shrunk log-odds of the terms whose log-odds are more than SHRINK standard errors from 0."""
    n1, n0 = (sum((F.col(h + y) for h in halves), F.lit(0.0)) for y in "10")
    sums = counts.where(~F.col("term").startswith("^")).agg(F.sum(n1), F.sum(n0)).first()
    t1, t0 = float(sums[0] or 0), float(sums[1] or 0)
    if not t1 or not t0:
        return {}
    # a label's share of the prior is in proportion to its size, so the mix of labels doesn't bound the log-odds
    m1, m0 = n1 + PRIOR * t1 / (t1 + t0), n0 + PRIOR * t0 / (t1 + t0)
    odds, error = F.log(m1 / t1) - F.log(m0 / t0), F.sqrt(1 / m1 + 1 / m0)
    best = counts.where(n1 + n0 > 0).select("term", (F.signum(odds) * F.greatest(F.abs(odds) - SHRINK * error, F.lit(0.0))).alias("score")).where("score <> 0")
    return {r["term"]: r["score"] for r in best.toLocalIterator()}


def _rates(models: list[Model]):
    """Tokens and those with a score of their own by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = [0, 0], [0, 0]
            for text, y, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                s = models[half].scores(terms(text))
                n[y] += len(s)
                k[y] += int((s != 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), pa.array(k)], ["toxic", "n", "k"])

    return run


def _measure(models: list[Model]):
    """For training documents: tokens, number and score of their segments, and the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, total, x = [], [], [], []
            for text, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True):
                words = terms(text)
                found = models[half].passages(words)
                n.append(len(words))
                k.append(len(found))
                total.append(sum(s for *_, s, _ in found))
                x.append(models[half].evidence(found))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(total, pa.float64()), pa.array(x, pa.float64())], ["toxic", "n", "k", "total", "x"])

    return run


def _fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression on (evidence, clean, toxic) counts, with a small ridge, by Newton steps."""
    x = np.array([p[0] for p in points] or [0.0])
    n0, n1 = (np.array([p[i] for p in points] or [1], float) for i in (1, 2))
    design, w = np.stack([np.ones(len(x)), x / 10], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n1 - (n0 + n1) * p) - 0.01 * w
        hess = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1] / 10))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    At most sample_rows label rows are used (those with the least hash of doc_id), which bounds what
    is broadcast. Null labels don't count; of repeated labels of a doc_id the largest holds. Without
    labels of both kinds the model knows no term and gives every text the share of label 1.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    sample = own.where(seen).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    train = cut(train.select("text", "toxic", half.alias("half")), "train")
    counts = map_batches(train, _counts, "term string, " + ", ".join(f"{c} double" for c in _COUNTS)).groupBy("term").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    counts = cut(counts, "terms")
    halves = [Model(_lexicon(counts, h), 0.0) for h in "ba"]  # the first half is scored with the terms of the second
    rate = {r["toxic"]: (r["n"], r["k"]) for r in map_batches(train, _rates(halves), "toxic long, n long, k long").groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}
    q1, q0 = ((rate.get(y, (0, 0))[1] + 0.5) / (rate.get(y, (0, 0))[0] + 1000.0) for y in (1, 0))
    model = Model(_lexicon(counts, "ab"), min(math.log((1 - min(0.9, q1)) / (1 - min(0.9, q0))), -1e-4))
    kind = "toxic int, n long, k long, total double, x double"
    for m in halves:
        m.other = model.other
    # segments of clean text have exponential tails: their mean score gives the rate, their number the constant
    n, k, total = (float(x or 0) for x in map_batches(train, _measure(halves), kind).where("toxic = 0").agg(F.sum("n"), F.sum("k"), F.sum("total")).first())
    for m in (model, *halves):
        m.rate, m.log_k = (k + 1) / (total + 1), math.log((k + 0.5) / (n + 1000))
    bins = map_batches(train, _measure(halves), kind).groupBy(F.round("x", 1).alias("x")).agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).collect()
    model.curve = _fit_curve(sorted((r["x"], r["n0"], r["n1"]) for r in bins))
    return model


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            score, spans = [], []
            for text in b.column("_text").to_pylist():
                found = model.passages(terms(text))
                score.append(model.score(model.evidence(found)))
                significant = [f for f in found if f[3] <= math.log(EXPECTED)]
                at = [m.span() for m in _WORD.finditer((text or "").lower())] if significant else []
                spans.append([{"start": at[a][0], "end": at[e - 1][1], "score": s} for a, e, s, _ in significant])
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(score, pa.float64()), pa.array(spans, kind), *map(b.column, keep)], ["doc_id", "score", "passages", *keep])

    return run


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> (doc_id, score, passages, *keep), a row for each input row.

    score is the probability of label 1; passages are the significant ones, with code-point offsets in
    the text (as lower-cased) and their scores. A null or empty text, or one without words, has the
    score of no evidence. doc_id, lang and source are never looked at; repeated rows score alike. keep names
    input columns to carry along as they are; other columns are ignored.
    """
    carried = [c for c in keep if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"), *carried)
    schema = ", ".join(["doc_id long, score double, passages array<struct<start:int,end:int,score:double>>", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)])
    return map_batches(rows, _score(model, carried), schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = toxicity(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
