"""Stupid-backoff language-model scores, computed relationally.

Documents are encoded in runs of about RUN_TOKENS tokens. Order by order, a run's distinct n-grams go to shards of hashes in
blocks, each once with its count in the run, so a frequent n-gram is no hot key. A shard adds up the counts and answers
each block in its own order with what other runs have; those answers go back to the run. Longer n-grams are asked for only where
other documents have their shorter parts, which leaves out none that counts. At last the scores of a run's tokens are summed by document.

A document's own occurrences are no evidence for it: its counts are those of the rest of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches, shuffles_dropped

#: Order of the model and discount per backoff step.
ORDER, DISCOUNT = 5, 0.4
#: Tokens of a run, and at most of a shard on average; one task holds either.
RUN_TOKENS, SHARD_TOKENS = 500_000, 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "run long, doc_ids array<long>, lengths array<int>, tokens binary, words binary"
_ANSWERS = "run long, k int, shard int, outside binary"


def _squeezed(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, by byte planes, compressed."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _expanded(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _encode(batches: Iterator[pa.RecordBatch], run_tokens: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents: token numbers, and the hash of each number's word."""
    part, count = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    lengths: list[int] = []
    tokens: list[np.ndarray] = []
    number: dict[bytes, int] = {}
    size = 0

    def row() -> pa.RecordBatch:
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        cols = [pa.array([part | count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([_squeezed(flat)], pa.binary()), pa.array([words.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["run", "doc_ids", "lengths", "tokens", "words"])

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            put = number.setdefault
            tokens.append(np.array([put(w, len(number)) for w in found], np.uint32))
            ids.append(doc)
            lengths.append(len(found))
            size += len(found)
            if size >= run_tokens or len(ids) >= 100_000:
                yield row()
                ids, lengths, tokens, number, size, count = [], [], [], {}, 0, count + 1
    if ids:
        yield row()


class _Order:
    """A run's candidates of one order: where they end, which distinct one each is, their rising hashes and counts in the run."""

    def __init__(self, at: np.ndarray, which: np.ndarray, seen: np.ndarray, n: np.ndarray, tokens: int) -> None:
        self.at, self.which, self.seen, self.n = at, which, seen, n.astype(np.int64)
        self.code = np.full(tokens, -1)
        self.code[at] = which


class _Run:
    """One run's n-grams, order by order, with what is known of them from the rest of the corpus.

    An n-gram that another document has has both of its shorter parts there, too. So from the second order on only those places
    are candidates where the words up to the one before and the words from the second on may be in other documents.
    """

    def __init__(self, lengths, tokens: bytes, words: bytes) -> None:
        self.lengths = np.asarray(lengths, np.int64)
        self.t, self.h = _expanded(tokens).astype(np.int64), np.frombuffer(words, np.uint64)
        self.place = np.arange(len(self.t)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.may, self.orders = np.ones(len(self.t), bool), []

    def ask(self) -> _Order:
        """The next order's candidates."""
        k = len(self.orders)
        if not k:
            by = np.argsort(self.h)
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            found = _Order(np.arange(len(self.t)), rank[self.t], self.h[by], np.bincount(self.t, minlength=len(by))[by], len(self.t))
        else:
            may = self.may & (self.place >= k)
            may[1:] &= self.may[:-1]
            self.may, at, before = may, np.flatnonzero(may), self.orders[-1]
            seen = (before.seen[before.code[at - 1]] * _MIX + np.uint64(k)) ^ self.h[self.t[at]]
            seen = (seen ^ (seen >> np.uint64(29))) * _MIX
            seen, which, n = np.unique(seen, return_inverse=True, return_counts=True)
            found = _Order(at, which, seen, n, len(self.t))
        self.orders.append(found)
        return found

    def told(self, of: _Order, outside: np.ndarray) -> None:
        """Takes how often each of these stands in other runs; rest is then by place how often in other documents."""
        of.every = of.n + outside
        mine = np.ones(len(of.at), np.int64)
        often = np.flatnonzero(of.n[of.which] > 1)
        _, one, n = np.unique(self.doc[of.at[often]] * max(1, len(of.n)) + of.which[often], return_inverse=True, return_counts=True)
        mine[often] = n[one]
        of.rest = np.zeros(len(self.t), np.int64)
        of.rest[of.at] = of.every[of.which] - mine
        self.may = of.rest > 0


def _steps(order: int) -> list[list[int]]:
    """Orders (from 0) that are asked for at once: each step reads the runs again, so an order waits for answers only where they leave out much."""
    return [s for s in ([k for k in ks if k < order] for ks in ([0, 1], [2], *([k, k + 1] for k in range(3, order, 2)))) if s]


def _replayed(runs: pd.DataFrame, answers: pd.DataFrame, steps: list[list[int]]) -> _Run:
    """The run with the answers to these steps."""
    r = runs.iloc[0]
    own, answers = _Run(r["lengths"], r["tokens"], r["words"]), answers.sort_values("shard")
    for step in steps:
        for of in [own.ask() for _ in step]:
            parts = [_expanded(x) for x in answers["outside"][answers["k"] == own.orders.index(of)]]
            own.told(of, np.concatenate(parts).astype(np.int64) if parts else np.zeros(len(of.n), np.int64))
    return own


def _asked(before: list[list[int]], step: list[int], bits: int):
    """A run and the answers of the steps before -> blocks (run, k, shard, grams, n) of the step's candidates."""

    def run(_, runs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, rows = _replayed(runs, answers, before), []
        for k in step:
            of = own.ask()
            shards, first = np.unique((of.seen >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
            for s, g, n in zip(shards, np.split(of.seen, first[1:]), np.split(of.n, first[1:]), strict=False):
                rows.append((runs["run"].iloc[0], k, s, _squeezed(np.diff(g, prepend=np.uint64(int(s) << (64 - bits)))), _squeezed(n - 1)))
        return pd.DataFrame(rows, columns=["run", "k", "shard", "grams", "n"])

    return run


def _answered(bits: int):
    """A shard's blocks of all runs -> (run, k, shard, outside): how often other runs have each n-gram of a block."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(key[1]) << (64 - bits))
        grams = [base + np.cumsum(_expanded(x), dtype=np.uint64) for x in blocks["grams"]]
        counts = [_expanded(x).astype(np.int64) + 1 for x in blocks["n"]]
        every, of = np.unique(np.concatenate(grams), return_inverse=True)
        n = np.concatenate(counts)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, of, n)
        outside = np.split(total[of] - n, np.cumsum([len(x) for x in counts])[:-1])
        return pd.DataFrame({"run": blocks["run"], "k": key[0], "shard": key[1], "outside": [_squeezed(x) for x in outside]})

    return run


def _summed(order: int, size: int, discount: float):
    """A run and all answers -> the scores of its documents."""

    def run(_, runs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, r = _replayed(runs, answers, _steps(order)), runs.iloc[0]
        first = own.orders[0]
        score, before = np.log10(first.every[first.which] / max(1, size)), first.rest
        for k, of in enumerate(own.orders[1:], 1):
            kept = of.at[of.rest[of.at] > 0]
            score[own.place >= k] += np.log10(discount)
            score[kept] = np.log10(of.rest[kept] / before[kept - 1])
            before = of.rest
        ends = np.cumsum(own.lengths)
        summed = np.concatenate([[0.0], np.cumsum(score)])
        return pd.DataFrame({"doc_id": pd.array(list(r["doc_ids"]), "Int64"), "n_words": own.lengths, "log10_score": summed[ends] - summed[ends - own.lengths]})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """documents -> (doc_id, n_words, log10_score), a row for each input row.

    Words are what stands between ASCII blanks, with A-Z in lower case. A word's score is
    count(n-gram) / count(its context) for the longest n-gram, up to `order`, that the rest of the corpus
    has, times discount for each step down; counts leave the document itself out. The last step is the
    word's count in all documents, this one too, by the words of the corpus. Repeated rows are documents of
    their own. log10_score is the sum over the document, 0 for a null or empty text. N-grams are told apart
    by 64-bit hashes. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # in buckets, so that the runs stay where they are when answers come to them
    runs = cut(map_batches(rows, lambda batches: _encode(batches, run_tokens), _RUNS), "runs", bucket="run")
    size = runs.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(3, (size // SHARD_TOKENS).bit_length())
    answers = spark.createDataFrame([], _ANSWERS)
    steps = _steps(order)
    for i, step in enumerate(steps):
        blocks = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(_asked(steps[:i], step, bits), "run long, k int, shard int, grams binary, n binary")
        with shuffles_dropped(spark):
            known = cut(blocks.groupBy("k", "shard").applyInPandas(_answered(bits), _ANSWERS), f"answers-{i + 1}")
        answers = answers.unionByName(known)
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(_summed(order, size, discount), "doc_id long, n_words long, log10_score double")


def op7_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    found = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"))


OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT rid, i, k, array_to_string(w[i - k + 1 : i], ' ') AS g FROM i, range(1, 6) AS o(k) WHERE i >= k),
own AS (SELECT rid, k, g, count(*) AS n FROM g GROUP BY ALL),
every AS (SELECT k, g, sum(n) AS n FROM own GROUP BY ALL),
r AS (SELECT g.rid, g.i, g.k, every.n, every.n - own.n AS rest FROM g JOIN own USING (rid, k, g) JOIN every USING (k, g)),
s AS (
  SELECT r.rid, CASE WHEN r.k = 1 THEN log10(r.n / (SELECT count(*) FROM i)) ELSE log10(r.rest / c.rest) END + (least(5, r.i) - r.k) * log10(0.4::DOUBLE) AS lp
  FROM r LEFT JOIN r AS c ON c.rid = r.rid AND c.i = r.i - 1 AND c.k = r.k - 1 AND r.k > 1
  WHERE r.k = 1 OR r.rest > 0 QUALIFY row_number() OVER (PARTITION BY r.rid, r.i ORDER BY r.k DESC) = 1
), d AS (SELECT rid, sum(lp) AS lp FROM s GROUP BY 1)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, round(coalesce(d.lp, 0), 4) AS log10_score FROM t LEFT JOIN d USING (rid)
"""
