"""Ranked lexical search: an index of document shards with integer impacts, scored a term at a time.

A shard is a run of documents: its terms, and for each of them the documents that hold it with their impacts, as
compressed sparse rows. Impacts hold all of the score but a term's weight, so they are worked out once, when the index
is written; weights need the document frequencies of all shards, which are a table of the index. A search takes the
queries' terms with their weights in chunks of bounded size to every shard, adds up weight by impact in one
dense array for each query, takes the best by argpartition without losing ties, and merges the bests of
all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.decontamination import words_of
from wakeline.llm.lm import _expanded, _squeezed
from wakeline.llm.shared import cut, map_batches

TOP = 10
#: Terms of a shard, which one task holds, and its documents at most.
SHARD_TERMS, SHARD_DOCS = 400_000, 100_000
#: Terms of the queries that go to the tasks at once; more are searched chunk by chunk.
CHUNK_TERMS = 200_000
_SHARD = "ids array<long>, terms binary, starts binary, docs binary, {} binary"
_SHORT = ("terms", "starts", "docs")


def _shards(batches: Iterator[pa.RecordBatch], shard_terms: int) -> Iterator[pa.RecordBatch]:
    """Documents -> shards with counts: ids, lengths, sorted terms, where each one's postings begin, postings and counts."""
    ids: list = []
    texts: list[np.ndarray] = []
    number: dict[bytes, int] = {}
    size = 0

    def row() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        order = sorted(number)
        place = np.empty(len(order), np.int64)
        place[[number[t] for t in order]] = np.arange(len(order))
        flat = place[np.concatenate(texts)] if size else np.zeros(0, np.int64)
        # by term, then by document
        code, count = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
        starts = np.searchsorted(code, np.arange(len(order) + 1) * len(texts))
        raw = [b" ".join(order), *map(_squeezed, (np.diff(starts), code % len(texts), count, lengths))]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], ["ids", "terms", "starts", "docs", "counts", "lengths"])

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = words_of(text)
            put = number.setdefault
            texts.append(np.array([put(w, len(number)) for w in found], np.int64))
            ids.append(doc)
            size += len(found)
            if size >= shard_terms or len(ids) >= SHARD_DOCS:
                yield row()
                ids, texts, number, size = [], [], {}, 0
    if ids:
        yield row()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and all terms, of the shards."""
    docs = terms = 0
    for b in batches:
        for raw in b.column("lengths").to_pylist():
            n = _expanded(raw)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each shard."""
    for b in batches:
        for terms, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms.split(b" "), pa.binary()), pa.array(_expanded(starts).astype(np.int64))], ["term", "df"])


def _impacts(n_docs: int, n_terms: int):
    """Shards with counts -> shards with impacts, (10^9 tf) div (1000 tf + 8 m) with m of the document's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for docs, counts, lengths in zip(*(b.column(c).to_pylist() for c in ("docs", "counts", "lengths")), strict=True):
                m = 10 + 90 * _expanded(lengths).astype(np.int64) * n_docs // max(1, n_terms)
                tf = _expanded(counts).astype(np.int64)
                out.append(_squeezed(1_000_000_000 * tf // (1000 * tf + 8 * m[_expanded(docs).astype(np.int64)])))
            yield pa.RecordBatch.from_arrays([*map(b.column, ("ids", *_SHORT)), pa.array(out, pa.binary())], ["ids", *_SHORT, "impacts"])

    return run


class Index:
    """Shards and document frequencies as written tables, and the corpus's size."""

    def __init__(self, shards: DataFrame, terms: DataFrame, n_docs: int) -> None:
        self.shards, self.terms, self.n_docs = shards, terms, n_docs


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> Index:
    """documents (doc_id, text) -> their index, in the shared folder.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case. A null or
    empty text has none and isn't counted among the documents. doc_id may be null or repeat: each row is a
    document. A shard ends with the document that brings it to shard_terms terms or SHARD_DOCS documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(map_batches(rows, lambda batches: _shards(batches, shard_terms), _SHARD.format("counts") + ", lengths binary"), "counts")
    sizes = counted.select("lengths").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (x or 0 for x in sizes)
    terms = counted.select("terms", "starts").mapInArrow(_frequencies, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(cut(counted.mapInArrow(_impacts(n_docs, n_terms), _SHARD.format("impacts")), "shards"), cut(terms, "terms"), n_docs)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries -> (query, term), each term once."""
    for b in batches:
        for query, text in zip(b.column("_query").to_pylist(), b.column("_text").to_pylist(), strict=True):
            if found := sorted(set(words_of(text))):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(found), pa.int64()), pa.array(found, pa.binary())], ["query", "term"])


def best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the highest scores above 0, equal ones by the least id; unsorted, at most top of them."""
    at = np.flatnonzero(score > 0)
    if len(at) <= top:
        return at
    # all that reach the top-th score stay, so that a tie at the edge is settled by id
    edge = -np.partition(-score[at], top - 1)[top - 1]
    above, level = at[score[at] > edge], at[score[at] == edge]
    need = top - len(above)
    if len(level) > need:
        level = level[np.argpartition(ids[level], need - 1)[:need]] if need else level[:0]
    return np.concatenate([above, level])


#: In the order of ids, none comes last.
_LAST = np.iinfo(np.int64).max


def _searched(queries: list[tuple[int, list[tuple[bytes, int]]]], top: int):
    """Shards -> (query, doc_id, score): each query's best of all shards of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {term for _, terms in queries for term, _ in terms}
        kept = {query: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for query, _ in queries}
        for b in batches:
            for r in range(len(b)):
                ids, terms, starts, docs, impacts = (b.column(c)[r].as_py() for c in ("ids", *_SHORT, "impacts"))
                ends = np.cumsum(_expanded(starts).astype(np.int64))
                docs, impacts = _expanded(docs).astype(np.int64), _expanded(impacts).astype(np.int64)
                place = {t: k for k, t in enumerate(terms.split(b" ")) if t in wanted} if terms else {}
                none = np.array([i is None for i in ids], bool)
                ids = np.array([_LAST if i is None else i for i in ids], np.int64)
                for query, weighted in queries:
                    total = None
                    for term, weight in weighted:
                        k = place.get(term)
                        if k is not None and weight:
                            total = np.zeros(len(ids), np.int64) if total is None else total
                            span = slice(ends[k - 1] if k else 0, ends[k])
                            # a document stands once in a term's postings
                            total[docs[span]] += weight * impacts[span]
                    if total is not None:
                        at = best(total, ids, top)
                        score, doc, no = (np.concatenate([x, y]) for x, y in zip(kept[query], (total[at], ids[at], none[at]), strict=True))
                        at = best(score, doc, top)
                        kept[query] = score[at], doc[at], no[at]
        query = np.repeat([q for q in kept], [len(x[0]) for x in kept.values()]).astype(np.int64)
        score, doc, none = (np.concatenate([x[i] for x in kept.values()] or [np.zeros(0, np.int64)]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def search(queries: DataFrame, found: Index, keep: tuple[str, ...] = ("item_id",), top: int = TOP, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """queries (text, *keep) -> (*keep, rank, doc_id, score): each row's `top` best documents with a score above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over N documents with terms; a score adds up weight by
    impact over the query's distinct terms that the corpus has. Equal scores go by ascending doc_id, null last. Each row
    is a query of its own, so repeated ones are answered each; one without terms, or whose terms no document has, has
    no rows. The terms of the queries, at most chunk_terms (and one query's more) at a time, go by way of the driver to
    the tasks; each chunk reads the index once.
    """
    spark = queries.sparkSession
    text = F.col("text").cast("string")
    rows = cut(queries.select(F.monotonically_increasing_id().alias("_query"), text.alias("_text"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept")), "queries")
    terms = rows.select("_query", "_text").mapInArrow(_split, "query long, term binary").join(found.terms, "term")
    weight = F.floor(1000 * F.log((2 * F.lit(found.n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = cut(terms.select("query", "term", weight.alias("weight")), "weights")
    n = max(1, -(-terms.count() // chunk_terms))
    out = None
    for k in range(n):
        part = terms if n == 1 else terms.where(F.pmod(F.xxhash64("query"), F.lit(n)) == k)
        asked: dict[int, list[tuple[bytes, int]]] = {}
        for r in part.toLocalIterator():
            asked.setdefault(r["query"], []).append((bytes(r["term"]), r["weight"]))
        if asked:
            hits = cut(found.shards.mapInArrow(_searched(sorted(asked.items()), top), "query long, doc_id long, score long"), "hits")
            out = hits if out is None else out.unionByName(hits)
    out = spark.createDataFrame([], "query long, doc_id long, score long") if out is None else out
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(rows.select(F.col("_query").alias("query"), "_kept"), "query").select(*(F.col(f"_kept.{c}").alias(c) for c in keep), "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Each item of benchmark against the index of all documents; edge cases are those of index and search."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(bench, index(docs))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
len AS (SELECT rid, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
size AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM len),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY ALL),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT qid, item_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT qid, item_id, unnest(t) AS term FROM q) JOIN df USING (term), size),
s AS (SELECT qid, item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::BIGINT AS score FROM w JOIN tf USING (term) JOIN len USING (rid), size GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
