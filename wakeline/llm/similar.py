"""Groups of documents whose sets of word shingles are similar, with every link checked on the sets.

Candidates are the members of a SimHash component: fingerprints of the same shingles, linked within 4 bits by
pigeonring. At a Jaccard similarity of 0.8 two fingerprints differ in about 10 of 64 bits, so few of such
pairs are within 4; candidates are therefore also those that share a band of MinHash values: at 0.8 all 16
bands of 4 values differ for about 2 pairs in 10,000. Equal token streams are one candidate.

First each member meets the least one of its component or band, a pair that several bands propose but once.
Where all of a group are similar to its least member, that connects it, and what is connected over other
groups is so in this one. Only groups that are still in several parts are searched, from one member to the
next, so that each part that is reached leaves the rest to look at; large ones are dealt out in pairs of
slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm import simhash
from wakeline.llm.components import components
from wakeline.llm.shared import cut, drop, map_batches

WORDS, LEAST, SEED = 5, 0.8, 42
BANDS, VALUES = 16, 4
#: Members of a band that one task compares at once; larger bands are cut into slices of about that size.
SLICE = 1024
#: Token streams whose signatures a task remembers.
REMEMBERED = 4096
_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 1 << 64, (BANDS * VALUES, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words are the empty one."""
    tokens = _tokens(text)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens] or [0]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), np.maximum(ends[-n:], 0).tolist(), strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def bands(found: np.ndarray) -> list[int]:
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        least = np.minimum(least, ((found[None, i : i + 4096] ^ _XOR) * _TIMES).min(1))
    return [xxhash.xxh64_intdigest(least[i * VALUES : (i + 1) * VALUES].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def _signed(words: int):
    """(id, text) -> (id, stream, bands, fp), all that is asked of a text before sets are compared, in one pass.

    What a task has worked out for a token stream is remembered for the next copies of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[list[int], int]] = {}
        for b in batches:
            streams, found = [], []
            for text in b.column("text").to_pylist():
                stream = xxhash.xxh3_128_digest(b" ".join(_tokens(text)))
                if stream not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    fp = simhash.fingerprint(text, words)
                    known[stream] = bands(shingles(text, words)), fp - (1 << 64) if fp >> 63 else fp
                streams.append(stream)
                found.append(known[stream])
            cols = [pa.array(streams, pa.binary()), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "stream", "bands", "fp"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t, words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "members"])

    return run


def links(ids: list[int], sets: list[np.ndarray], least: float, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect what similar pairs connect, by a search from member to member.

    Members of one class are connected already, so they are reached together and never compared.
    """
    classes = classes or list(range(len(ids)))
    of: dict[int, list[int]] = {}
    for i, c in enumerate(classes):
        of.setdefault(c, []).append(i)
    out: list[tuple[int, int]] = []
    while len(of) > 1:
        queue = of.pop(next(iter(of)))
        while queue and of:
            a = queue.pop()
            n, reached = len(sets[a]), []
            for c, members in of.items():
                for b in members:
                    m = len(sets[b])
                    if min(n, m) >= least * max(n, m) and similarity(sets[a], sets[b]) >= least:
                        out.append((ids[a], ids[b]))
                        reached.append(c)
                        break
            for c in reached:
                queue += of.pop(c)
    return out


def _linked(least: float):
    """Rows sorted by group -> edges; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, classes = None, [], [], []

        def edges() -> pa.RecordBatch:
            found = links(ids, sets, least, classes)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("key", "a", "b")), strict=True)
            for key, one, of, raw in zip(keys, b.column("id").to_pylist(), b.column("of").to_pylist(), b.column("members").to_pylist(), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield edges()
                    now, ids, sets, classes = key, [], [], []
                ids.append(one)
                classes.append(of)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(ids) > 1:
            yield edges()

    return run


def _stars(stars: DataFrame, sets: DataFrame, slice_rows: int) -> DataFrame:
    """(u, part, v, members), the middle's own row first: a middle with many members has a copy in each part."""
    sizes = stars.groupBy("least").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("k"))
    own = sizes.select("least", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("least").alias("id"))
    dealt = stars.join(sizes, "least").select("least", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("part"), "id")
    whole = own.unionByName(dealt).join(sets, "id").select(F.col("least").alias("u"), "part", F.col("id").alias("v"), "members")
    return whole.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v") != F.col("u"))


def _met(least: float):
    """Rows of _stars -> each member with its middle, and whether their sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, middle = None, None
        for b in batches:
            us, vs, ok = [], [], []
            for u, v, raw in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("members").to_pylist(), strict=True):
                found = np.frombuffer(raw, np.uint64)
                if u == v:
                    now, middle = u, found
                    continue
                if u != now:
                    raise ValueError("a middle's own row comes first")
                n, m = len(middle), len(found)
                us.append(u)
                vs.append(v)
                ok.append(min(n, m) >= least * max(n, m) and similarity(middle, found) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ok, pa.bool_())], ["u", "v", "similar"])

    return run


def once(docs: DataFrame) -> DataFrame:
    """One row for each id; of rows that share one, those of a task meet before they are shuffled."""
    return docs.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("id"))).where("_nth = 1").drop("_nth")


def groups(docs: DataFrame, words: int = WORDS, least: float = LEAST, slice_rows: int = SLICE) -> DataFrame:
    """(id, text) -> (id, num, root), a row for each input row; num is its place in the input.

    id is of any type with an order, not null, and follows from the row, as docs is read twice; rows with the
    same id have the same text. root is the least id reached by links between documents whose sets of word
    shingles have a Jaccard similarity of at least `least`. Null and empty texts are alike; a text of fewer
    words is one shingle. No rows give no rows.

    Texts are read once for their signatures and moved once, to the sets of the candidates; all else that is
    joined is numbers. Tables that nothing needs any more are dropped.
    """
    rows = docs.select("id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = map_batches(rows, _signed(words), f"id {kind}, stream binary, bands array<long>, fp long")
    signed = cut(signed.withColumn("num", F.monotonically_increasing_id()), "signed")
    # a number for each token stream; its bands and fingerprint are those of any of its rows
    per_stream = signed.groupBy("stream").agg(F.min("num").alias("num"), F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    first = cut(per_stream, "first")
    banded = first.select("num", F.explode("bands").alias("key"))
    close = simhash.of_prints(first.select(F.col("num").alias("doc_id"), "fp"))
    near = close.select(F.col("doc_id").alias("num"), F.xxhash64(F.lit("simhash"), "component_id").alias("key"))
    banded = cut(banded.unionByName(near).withColumnRenamed("num", "id"), "bands")
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    # groups with the same members are compared once
    keys = cut(sizes.groupBy("n", "sum").agg(F.min("key").alias("key"), F.min("least").alias("least")), "keys")
    members = cut(banded.join(keys.select("key", "least", "n"), "key"), "members")
    drop(banded, keys)
    wanted = members.select(F.col("id").alias("num")).distinct().join(first.select("num", "id"), "num")
    texts = once(rows).join(wanted, "id").select(F.col("num").alias("id"), "text")
    sets = cut(map_batches(texts, _sets(words), "id long, members binary"), "sets")
    stars = members.where("id <> least").select("least", "id").distinct()
    met = cut(map_batches(_stars(stars, sets, slice_rows), _met(least), "u long, v long, similar boolean"), "met")
    known = met.where("similar").select("u", "v")
    # groups of three or more that their least member doesn't connect, nor the others' least members do
    apart = members.where("id <> least AND n > 2").join(met.where("NOT similar"), (F.col("least") == F.col("u")) & (F.col("id") == F.col("v"))).select("key").distinct()
    classes = components(known).select(F.col("node").alias("id"), F.col("root").alias("of"))
    still = members.join(apart, "key").join(classes, "id", "left").select("key", "id", "n", F.coalesce("of", "id").alias("of"))
    still = cut(still, "apart")
    open_keys = still.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.first("n").alias("n")).where("low <> high").select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("k"))
    sliced = still.drop("n").join(open_keys, "key").withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = sliced.select("key", "id", "of", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).join(sets, "id")
    dealt = pairs.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    more = map_batches(dealt.select("key", "a", "b", "id", "of", "members"), _linked(least), "u long, v long")
    edges = cut(known.unionByName(more).distinct(), "edges")
    drop(sets, met, members, still)
    roots = components(edges).withColumnRenamed("node", "num")
    classes = cut(first.select("num", "stream", "id").join(roots, "num", "left").select("stream", "id", F.coalesce("root", "num").alias("of")), "roots")
    least_ids = classes.groupBy("of").agg(F.min("id").alias("root"))
    return signed.select("id", "num", "stream").join(classes.join(least_ids, "of").select("stream", "root"), "stream").select("id", "num", "root")
