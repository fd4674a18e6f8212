"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

SCALE, EVERY, TOP = 256, 50, 5
#: Vectors of a block, which one task holds, and queries that one task lets pass by a block.
BLOCK, CHUNK = 16_384, 100_000
#: Rows of a block that are bounded together, and rotated components of the partial sum.
STEP, HEAD = 512, 16
#: How many times as many blocks each round takes as all rounds before it.
GROWTH = 4


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as whole numbers; those that are null or hold null or non-finite parts take no part."""
    for b in batches:
        ids, vecs, norms = [], [], []
        for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
            if i is None or x is None or None in x:
                continue
            v = np.asarray(x, float)
            if np.isfinite(v).all():
                ids.append(i)
                vecs.append(np.floor(SCALE * v).astype(np.int64))
                norms.append(float(np.sqrt((vecs[-1].astype(float) ** 2).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.int64())), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])


def _stack(vecs: pa.Array, d: int) -> np.ndarray:
    """Rows of d components; a shorter vector ends in zeros."""
    size = vecs.value_lengths().to_numpy()
    out = np.zeros((len(vecs), d), np.int64)
    out[np.arange(d) < size[:, None]] = vecs.flatten().to_numpy()
    return out


def _gram(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _stack(b.column("v"), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(total.ravel())], ["i", "g"])

    return run


class _Block:
    """Vectors by descending length, rotated, with the lengths of what the partial sums leave out."""

    def __init__(self, rows: pa.Table, turn: np.ndarray) -> None:
        rows = rows.sort_by([("norm", "descending"), ("vec_id", "ascending")]).combine_chunks()
        self.turn, self.x = turn, _stack(rows.column("v").combine_chunks(), len(turn))
        self.ids, self.row, self.norm = (rows.column(c).to_numpy() for c in ("vec_id", "row", "norm"))
        self.rotated = self.x @ turn
        self.rest = _rest(self.rotated)

    def best(self, queries: pa.RecordBatch, top: int) -> pa.RecordBatch:
        """Each query's best of the block. Bounds prune; what they leave gets the whole integer product."""
        q = _stack(queries.column("v"), len(self.turn))
        own, length = queries.column("row").to_numpy(), queries.column("norm").to_numpy()
        least = queries.column("least").to_numpy(zero_copy_only=False).astype(float)
        least = np.where(np.isnan(least), -np.inf, least)
        turned = q @ self.turn
        rest = _rest(turned)
        held_q, held_i, held_s = (np.zeros(0, np.int64) for _ in range(3))
        for a in range(0, len(self.x), STEP):
            part = slice(a, a + STEP)
            slack = 1 + 1e-9 * length * self.norm[a]
            live = np.flatnonzero(length * self.norm[a] + slack >= least)
            if not len(live):
                break
            bound = turned[live, :HEAD] @ self.rotated[part, :HEAD].T + np.outer(rest[live], self.rest[part])
            i, j = np.nonzero((bound + slack[live, None] >= least[live, None]) & (own[live, None] != self.row[part]))
            i, j = live[i], a + j
            score = np.concatenate([(q[i[k : k + 100_000]] * self.x[j[k : k + 100_000]]).sum(1) for k in range(0, len(i), 100_000)]) if len(i) else np.zeros(0, np.int64)
            held_q, held_i, held_s = np.concatenate([held_q, i]), np.concatenate([held_i, j]), np.concatenate([held_s, score])
            o = np.lexsort([self.row[held_i], self.ids[held_i], -held_s, held_q])
            held_q, held_i, held_s = held_q[o], held_i[o], held_s[o]
            rank = np.arange(len(held_q)) - np.searchsorted(held_q, held_q)
            keep = rank < top
            held_q, held_i, held_s, rank = held_q[keep], held_i[keep], held_s[keep], rank[keep]
            full = rank == top - 1
            least[held_q[full]] = np.maximum(least[held_q[full]], held_s[full])
        cols = queries.column("vec_id").to_numpy()[held_q], own[held_q], self.ids[held_i], self.row[held_i], held_s
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "query", "vec_id", "row", "score"])


def _rest(rotated: np.ndarray) -> np.ndarray:
    return np.sqrt((rotated[:, HEAD:] ** 2).sum(1))


def _met(turn: np.ndarray, top: int):
    """Rows sorted by block and chunk, vectors before queries: one block is held, queries pass by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("block", "chunk", "asks")], 1)
            edge = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(b)]
            for x, y in zip(edge, edge[1:], strict=False):
                if x == y:
                    continue
                part, now = b.slice(x, y - x), tuple(keys[x, :2])
                if now != key:
                    key, held, block = now, [], None
                if not keys[x, 2]:
                    held.append(part)
                elif held or block:
                    block, held = block or _Block(pa.Table.from_batches(held), turn), []
                    yield block.best(part, top)

    return run


_HITS = "query_id long, query long, vec_id long, row long, score long"


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """embeddings -> (query_id, rank, vec_id, score): each query row's highest inner products.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but the query's own,
    so of repeated rows each one is a query and a candidate. Ties go to the smaller vec_id. A null vec_id
    or vector, and one that holds null or non-finite components, takes no part. Of vectors of different
    dimension the shorter ends in zeros; products must fit 64 bits. Other columns are ignored. No rows
    give no rows.

    Vectors are dealt into blocks of falling length (ties by vec_id and row, so equal vectors spread).
    Queries meet the longest block first, which sets what they must beat; then, in rounds of more and more
    blocks, only those blocks whose longest vector can still beat what they have by then. Queries travel,
    blocks stay: a block is copied only where more than `chunk` queries meet it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = cut(map_batches(rows, _whole, "vec_id long, v array<long>, norm double").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, d, nq = whole.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return _flat(whole, every, top)
    gram = np.zeros(d * d)
    for r in map_batches(whole.select("v"), _gram(d), "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toLocalIterator():
        gram[r["i"]] = r["g"]
    turn = np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1].copy()
    blocks = cut(whole.repartitionByRange(-(-n // block), F.desc("norm"), "vec_id", "row").withColumn("block", F.spark_partition_id()), "blocks")
    sizes = cut(blocks.groupBy("block").agg(F.max("norm").alias("longest")), "sizes")
    first, last = sizes.agg(F.min("block"), F.max("block")).first()
    queries = whole.where(F.col("vec_id") % every == 0)
    held, begin, size = None, first, 1
    while begin <= last:
        end = min(last, begin + size - 1)
        held = cut(_round(queries, blocks, sizes, held, begin, end, turn, top, chunk), "held")
        begin, size = end + 1, GROWTH * (end + 1 - first)
    return held.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _round(queries: DataFrame, blocks: DataFrame, sizes: DataFrame, held: DataFrame | None, begin: int, end: int, turn: np.ndarray, top: int, chunk: int) -> DataFrame:
    """What queries hold after the blocks from begin to end."""
    if held is None:
        asks = queries.withColumn("least", F.lit(None).cast("double"))
    else:
        full = held.groupBy("query").agg(F.when(F.count("*") >= top, F.min("score")).cast("double").alias("least"))
        asks = queries.join(full, F.col("row") == F.col("query"), "left").drop("query")
    here = sizes.where(F.col("block").between(begin, end))
    longest = here.agg(F.max("longest")).first()[0] or 0.0
    reach = lambda x: (F.col("norm") * x) * (1 + 1e-9) + 1e-6 >= F.col("least")
    asks = cut(asks.where(F.col("least").isNull() | reach(F.lit(longest))), "asks")
    k = max(1, -(-asks.count() // chunk))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(begin), F.lit(end)))).join(here, "block").where(F.col("least").isNull() | reach(F.col("longest")))
    cols = ["block", "chunk", "asks", "vec_id", "v", "norm", "row", "least"]
    passing = asks.withColumns({"chunk": F.pmod(F.xxhash64("row"), F.lit(k)).cast("int"), "asks": F.lit(1)}).select(cols)
    staying = blocks.where(F.col("block").between(begin, end)).withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(k - 1))), "asks": F.lit(0), "least": F.lit(None).cast("double")}).select(cols)
    both = staying.unionByName(passing).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks")
    found = map_batches(both, _met(turn, top), _HITS)
    return _ranked(found if held is None else found.unionByName(held.drop("rank")), top)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _flat(whole: DataFrame, every: int, top: int) -> DataFrame:
    """All vectors are empty, so all products are zero: the least vec_ids but the query's own row."""
    least = whole.select("vec_id", "row").orderBy("vec_id", "row").limit(top + 1)
    queries = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query"))
    found = queries.join(F.broadcast(least), F.col("query") != F.col("row")).withColumn("score", F.lit(0).cast("long"))
    return _ranked(found, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_norm_sorted_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
