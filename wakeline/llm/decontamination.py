"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

WINDOW = 13
#: UTF-8 bytes of benchmark text that one automaton holds. A larger benchmark is scanned in shards.
SHARD_BYTES = 16_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z in lower case, blanks for the other ASCII bytes that aren't word characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8: A-Z in lower case, cut at all ASCII but letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each window of words with the items it stands in. A shorter item is one window; no words, none."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).update([item] if item is not None else [])
    return {k: sorted(v) for k, v in out.items()}


class Automaton:
    """Finds windows in word lists; only runs of words that the benchmark has are walked."""

    def __init__(self, found: dict[tuple[bytes, ...], list[str]]) -> None:
        self.words: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.least = min(map(len, found), default=0)
        for window, items in found.items():
            self.trie.add_word(tuple(self.words.setdefault(w, len(self.words) + 1) for w in window), (len(window), items))
        if found:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside a window, and the items hit."""
        if not self.least or len(words) < self.least:
            return np.zeros(len(words), bool), set()
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        hit, items = None, set()
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a < self.least:
                continue
            for end, (n, found) in self.trie.iter(tuple(ids[a:b].tolist())):
                hit = np.zeros(len(words), bool) if hit is None else hit
                hit[a + end + 1 - n : a + end + 1] = True
                items.update(found)
        return np.zeros(len(words), bool) if hit is None else hit, items


_built: dict[str, Automaton] = {}


_SCHEMA = "row long, doc_id long, n_words long, runs array<struct<a:int,b:int,start:int,end:int>>, items array<string>"
_RUN = pa.struct([(n, pa.int32()) for n in ("a", "b", "start", "end")])
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])


def _runs(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words, by words and by offsets in the original text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    return [{"a": a, "b": b, "start": at[a][0], "end": at[b - 1][1]} for a, b in edge.reshape(-1, 2).tolist()]


def _scan(items: list[tuple[str | None, str]], size: int, keep: list[str]):
    """Rows -> hits of these items' windows, and the columns to keep. A worker builds their automaton once and keeps one."""
    name = hashlib.sha1(repr((size, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(windows(items, size))
        automaton = _built[name]
        for b in batches:
            out = []
            for row, doc, text in zip(b.column("_row").to_pylist(), b.column("_doc").to_pylist(), b.column("_text").to_pylist(), strict=True):
                words = words_of(text)
                hit, found = automaton.scan(words)
                out.append({"row": row, "doc_id": doc, "n_words": len(words), "runs": _runs(text, hit) if hit.any() else [], "items": sorted(found)})
            found = pa.RecordBatch.from_pylist(out, _ARROW)
            yield pa.RecordBatch.from_arrays([*found.columns, *map(b.column, keep)], [*found.schema.names, *keep])

    return run


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's distinct items, a shard of bounded text at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = cut(items, "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=str)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> (doc_id, n_words, n_hit, items, spans, contaminated, *keep), a row for each input row.

    items are the item_ids (as strings, sorted) with an occurring window; spans are the runs of hit
    words as code-point offsets in the original text. A document is contaminated if a twentieth of
    its words or more is hit. Null and empty texts have no words and aren't contaminated. Items with a null
    text or without words have no windows; those with a null item_id hit words but aren't listed; repeated
    items count once. keep names input columns to carry along as they are; other columns are ignored; no rows
    give no rows. Texts of at most shard_bytes (and one item more) go to the tasks, which build the automaton;
    a larger benchmark is scanned in shards, one after the other, whose hits are written and joined by row.
    """
    carried = [c for c in keep if c != "doc_id"]
    rows = docs.select(F.lit(None).cast("long").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"), *carried)
    schema = ", ".join([_SCHEMA, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)])
    shards = _shards(benchmark, shard_bytes)
    first, second = next(shards), next(shards, None)
    if second is None:
        return _judged(map_batches(rows, _scan(first, size, carried), schema), carried)
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    asked = rows.select("_row", "_doc", "_text")
    found = cut(map_batches(asked, _scan(first, size, []), _SCHEMA), "hits")
    while second is not None:
        found = found.unionByName(cut(map_batches(asked, _scan(second, size, []), _SCHEMA).where(F.size("runs") > 0), "hits"))
        second = next(shards, None)
    flat = lambda c: F.flatten(F.collect_list(c))
    every = found.groupBy("row", "doc_id", "n_words").agg(F.array_sort(flat("runs")).alias("runs"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    every = every.withColumn("runs", _united(F.col("runs")))
    if carried:
        every = every.withColumnRenamed("row", "_row").join(rows.select("_row", *carried), "_row")
    return _judged(every, carried)


def _united(runs: Column) -> Column:
    """Sorted runs with those that overlap or touch made one."""

    def put(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        more = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (r["a"] <= last["b"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(runs, F.filter(runs, lambda _: F.lit(False)), put)


def _judged(found: DataFrame, keep: list[str]) -> DataFrame:
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["b"] - r["a"]))
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans")
    return found.select("doc_id", "n_words", n.alias("n_hit"), "items", spans, ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"), *keep)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH w AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (SELECT places.rid, places.i, sizes.n, win.item FROM places JOIN sizes ON places.i + sizes.n - 1 <= len(places.w) JOIN win ON win.n = sizes.n AND win.g = array_to_string(places.w[places.i : places.i + sizes.n - 1], ' ')),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
