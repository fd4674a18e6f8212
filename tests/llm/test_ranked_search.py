"""Ranked search against plain Python: ties, many shards, many chunks of queries."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import documents, table

from wakeline.llm import ranked_search


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, queries, top=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x for _, _, x in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c, size in counts:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(str(item), rank, str(d), -score) for rank, (score, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "W1", "x9"]
    make = lambda: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "!"]) for _ in range(rng.choice([1, 3, 8, 60])))
    texts = [None, "", " .,!", *(make() for _ in range(120))]
    texts += texts[3:40] * 3
    queries = [("a", make()), ("b", make() + " unknown"), ("b", make()), (None, make()), ("none", None), ("empty", "?!"), ("never", "unheard of"), ("same", "w1 w1 W1"), ("ü", "Ünï 日本")]
    return list(enumerate(texts)), queries


@pytest.mark.parametrize(("shard", "chunk"), [(ranked_search.SHARD_TERMS, ranked_search.CHUNK_TERMS), (40, 20), (1, 1)])
def test_ranks(spark, shard, chunk):
    """Copies tie everywhere, also at the tenth place and across shards."""
    docs, queries = corpus()
    index = ranked_search.index(table(spark, docs, "doc_id long, text string").repartition(6), shard)
    got = ranked_search.search(table(spark, queries, "item_id string, text string"), index, chunk_terms=chunk)
    assert rows_of(got) == plain(docs, queries)
    assert sum(r["n_docs"] for r in index.shards.select(F.size("ids").alias("n_docs")).collect()) == len(docs)


def test_nulls_repeats_and_no_rows(spark):
    docs = [(None, "a b"), (None, "a"), (1, "a b"), (1, "a b"), (2, None), (3, "c")]
    queries = [("q", "A c"), ("q", "A c")]
    found = ranked_search.index(table(spark, docs, "doc_id long, text string"))
    ask = lambda q, f: ranked_search.search(table(spark, q, "item_id string, text string"), f)
    assert rows_of(ask(queries, found)) == plain(docs, queries)
    assert ask([], found).count() == 0
    empty = ranked_search.index(documents(spark, []))
    assert ask(queries, empty).count() == 0 and empty.n_docs == 0


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, top = rng.integers(0, 30), int(rng.integers(1, 8))
        score, ids = rng.integers(-2, 4, n), rng.integers(0, 12, n)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s > 0)[:top]
        assert sorted((-score[k], ids[k]) for k in ranked_search.best(score, ids, top)) == want


def test_very_long_text(spark):
    rng = random.Random(2)
    docs = [(0, " ".join(f"t{rng.randrange(5000)}" for _ in range(500_000))), *((i, f"t{i} t{i + 1} t{i}") for i in range(1, 40))]
    queries = [("q", "t5 t6 t7")]
    assert rows_of(ranked_search.search(table(spark, queries, "item_id string, text string"), ranked_search.index(documents(spark, [t for _, t in docs])))) == plain(docs, queries)
