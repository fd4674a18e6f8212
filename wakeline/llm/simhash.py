"""Near-duplicate documents by SimHash, with candidates found by pigeonring chains.

A fingerprint of 64 bits is cut into 5 segments on a ring. If two fingerprints differ in at most 4
bits, some segment begins a chain whose cumulative differences stay within the proportional budgets
0, 1, 2, 3, 4 (lengths 1 to 5: floor(4 * length / 5)). The first two budgets become a join key: the
first segment is equal and the second differs in at most one bit. Longer chains prune what shares a
key, and only the rest gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.components import components
from wakeline.llm.shared import cut, map_batches

BITS, SEGMENTS, DISTANCE, WORDS, SEED = 64, 5, 4, 4, 42
#: Members of a key up to which one task compares them; larger keys are dealt out in slices.
SLICE = 8192
_CUTS = [round(BITS * i / SEGMENTS) for i in range(SEGMENTS + 1)]
_BUDGET = [DISTANCE * n // SEGMENTS for n in range(SEGMENTS + 1)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash over word shingles, as an unsigned number; 0 for no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return run


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(_CUTS[i])) & np.uint64((1 << (_CUTS[i + 1] - _CUTS[i])) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) for each chain start: the exact second segment, and each of its zero bits set.

    Two second segments that differ in one bit meet where the one with the zero sets it.
    """
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        keys, who = [], []
        for i in range(SEGMENTS):
            nxt = (i + 1) % SEGMENTS
            first, second = _segment(fp, i), _segment(fp, nxt)
            base = np.uint64(i << 26) | (first << np.uint64(13))
            keys.append(base | second)
            who.append(fp)
            for j in range(_CUTS[nxt + 1] - _CUTS[nxt]):
                zero = (second >> np.uint64(j)) & np.uint64(1) == 0
                keys.append((base | second | np.uint64(1 << j))[zero])
                who.append(fp[zero])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, who)], ["key", "fp"])


def _mask(start: int, length: int) -> np.uint64:
    out = 0
    for i in range(start, start + length):
        i %= SEGMENTS
        out |= ((1 << (_CUTS[i + 1] - _CUTS[i])) - 1) << _CUTS[i]
    return np.uint64(out)


_CHAINS = np.array([[_mask(i, n) for n in range(SEGMENTS + 1)] for i in range(SEGMENTS)], np.uint64)


def linked(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """For differences x of pairs that share a key of chain start: whether the pair is linked.

    The chains prune first; the full Hamming check is made on what they leave.
    """
    ok = np.ones(len(x), bool)
    for n in range(3, SEGMENTS):
        ok &= np.bitwise_count(x & _CHAINS[start, n]) <= _BUDGET[n]
    ok[ok] = np.bitwise_count(x[ok]) <= DISTANCE
    return ok


class _Forest:
    """Union-find over the fingerprints one task has linked; keeps only edges that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = a = up[b]
        return a

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _link_small(key: np.ndarray, fp: np.ndarray, forest: _Forest) -> None:
    """All pairs at each distance in the sorted run; keys here have few members."""
    start, d = (key >> 26).astype(np.int64), 1
    at = np.arange(len(key))
    while True:
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        ok = at[linked(fp[at] ^ fp[at + d], start[at])]
        for a, b in zip(fp[ok].tolist(), fp[ok + d].tolist(), strict=True):
            forest.link(a, b)
        d += 1


def _link_large(key: int, fp: np.ndarray, forest: _Forest) -> None:
    """A search from member to member, so each one that is reached leaves the rest to look at."""
    rest, start = np.unique(fp), int(key) >> 26
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            ok = linked(rest ^ a, start)
            for b in rest[ok]:
                forest.link(int(a), int(b))
                queue.append(b)
            rest = rest[~ok]


def _edges(limit: int | None):
    """Sorted (key, fp) rows -> spanning edges (key null), and the rows of keys over limit as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key, u, v):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["key", "u", "v"])

        forest, held, over = _Forest(), [np.zeros(0, np.int64), np.zeros(0, np.uint64)], None

        def done(key: np.ndarray, fp: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(key)) + 1
            first, size = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(key)]]))
            small = np.repeat((size > 1) & (size <= 64), size)
            _link_small(key[small], fp[small], forest)
            for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
                _link_large(key[a], fp[a : a + n], forest)

        for b in batches:
            key = np.concatenate([held[0], b.column("key").to_numpy()])
            fp = np.concatenate([held[1], b.column("fp").to_numpy().view(np.uint64)])
            last = np.searchsorted(key, key[-1])
            if last:
                whole = slice(0, last)
                if over is not None:
                    n = np.searchsorted(key, over, "right")
                    if n:
                        yield rows(key[:n], fp[:n].view(np.int64), np.zeros(n, np.int64))
                    whole, over = slice(n, last), None
                if len(key[whole]):
                    done(key[whole], fp[whole])
            key, fp = key[last:], fp[last:]
            if limit and (over is not None or len(key) > limit):
                over = key[-1]
                yield rows(key, fp.view(np.int64), np.zeros(len(key), np.int64))
                key, fp = key[:0], fp[:0]
            held = [key, fp]
            if len(forest.edges) > 50_000:
                u, v = np.array(forest.edges, np.uint64).view(np.int64).T
                forest.edges.clear()
                yield rows([None] * len(u), u, v)
        if len(held[0]):
            done(*held)
        if forest.edges:
            u, v = np.array(forest.edges, np.uint64).view(np.int64).T
            yield rows([None] * len(u), u, v)

    return run


def link_edges(prints: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all that are linked.

    Each key gives a spanning forest of its links, never all its pairs. A key with more than
    slice_rows members is cut into slices by hash, and each pair of slices is one task's group.
    """
    keyed = map_batches(prints.select("fp"), _keys, "key long, fp long")
    found = cut(map_batches(keyed.repartition("key").sortWithinPartitions("key"), _edges(slice_rows), "key long, u long, v long"), "links")
    edges = found.where("key IS NULL").select("u", "v")
    hot = found.where("key IS NOT NULL").select("key", F.col("u").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    sliced = hot.join(sizes, "key").withColumn("s", mine).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = sliced.select(F.col("key").alias("of"), "fp", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    # the chain start stays in the upper bits; the rest of the key only tells groups apart
    grouped = pairs.select(F.expr("(of & ~67108863L) | (xxhash64(of, a, b) & 67108863L)").alias("key"), "fp", "of", "a", "b")
    more = map_batches(grouped.repartition("of", "a", "b").sortWithinPartitions("key", "of", "a", "b").select("key", "fp"), _edges(None), "key long, u long, v long")
    return edges.unionByName(more.select("u", "v"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """documents -> (doc_id, fp long, component_id long), a row for each input row.

    Fingerprints are over shingles of `words` words. docs needs doc_id and text; other columns are ignored. Null and empty texts have fingerprint 0
    and are linked like any other. Equal fingerprints share a component. component_id is the least
    doc_id reached by links of at most 4 differing bits; a null doc_id is kept and never chosen
    (component_id is null if there is no other). No rows give no rows.
    """
    return of_prints(cut(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _prints(words), "doc_id long, fp long"), "prints"))


def of_prints(prints: DataFrame) -> DataFrame:
    """A written table (doc_id, fp) -> the same rows with their component_id."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_edges(least))
    classes = cut(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: fingerprint as 16 lower-case hex digits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
