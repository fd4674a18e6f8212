"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only the lengths matter to the plan, and there are at most `capacity` of them, so the plan is made on
a histogram: a bin pattern is repeated while the lengths it uses last. Pieces then look up their place
by (length, number within the length), which Spark counts without a hot group.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

CAPACITY, END_ID = 4096, 1
#: Words and units whose ids one worker keeps at most.
KEPT_UNITS = 1_500_000
#: Parts into which the pieces of one length are dealt to be numbered.
PARTS = 512
_END = "</w>"
#: Characters whose lower case, composition and class are beyond doubt; of these, letters and digits; and
#: the units into which the vocabulary cuts text.
_PLAIN = re.compile("[\t\n\r\x20-\x3b\x3d-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u01c3\u01f4-\u024f\u2010-\u2027]*").fullmatch
_LETTERS, _DIGITS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_UNIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+").findall


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """counts[length] -> (times, lengths of the bin), in the order in which bins are filled.

    A bin takes the longest document that fits its gap until none fits. Then its shortest document
    is put back if two others fit the widened gap more tightly; of such pairs the fullest is taken.
    """
    left = counts.astype(np.int64).copy()
    lengths = np.flatnonzero(left).tolist()
    plan = []
    while lengths:
        used: dict[int, int] = {}
        order, gap, top = [], capacity, len(lengths)
        while gap and (i := bisect.bisect_right(lengths, gap, 0, top) - 1) >= 0:
            n = lengths[i]
            take = min(gap // n, int(left[n]) - used.get(n, 0))
            if take > 0:
                used[n] = used.get(n, 0) + take
                order += [n] * take
                gap -= n * take
            top = i if take <= 0 or used[n] == left[n] else top
        if gap and len(order) > 1:
            small = order[-1]
            room = gap + small
            used[small] -= 1
            a = np.array(lengths)
            rest = left[a] - np.array([used.get(n, 0) for n in lengths])
            a, rest = a[rest > 0], rest[rest > 0]
            j = np.searchsorted(a, room - a, "right") - 1
            j = np.minimum(j, np.arange(len(a)))
            j = np.where((j == np.arange(len(a))) & (rest < 2), j - 1, j)
            total = np.where(j >= 0, a + a[j], 0)
            best = int(total.argmax()) if len(a) else -1
            if best >= 0 and small < total[best] <= room:
                pair = [int(a[best]), int(a[j[best]])]
                order = order[:-1] + pair
                for n in pair:
                    used[n] = used.get(n, 0) + 1
            else:
                used[small] += 1
        used = {n: m for n, m in used.items() if m}
        times = min(int(left[n]) // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= times * m
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        plan.append((times, order))
    return plan


class _Units:
    """Token ids of text, word by word: letters, a digit, or other marks never share tokens.

    Words between white space recur, and so do the units in a new word; each unit's last token carries
    the vocabulary's mark of an end. Words with other than plain characters are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _add(self, words: list[str]) -> None:
        cut = {}
        for w in words:
            if w[0] != " ":
                cut[w] = _UNIT(w)
            elif _PLAIN(w):
                cut[w] = _UNIT(w.lower())
            else:
                self.known[w] = self._encode(w[1:]).tobytes()
        units = list({u for found in cut.values() for u in found if u not in self.units})
        for i in range(0, len(units), 5000):
            part = units[i : i + 5000]
            ids = self._encode(" ".join(part))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("this vocabulary doesn't end each unit with a token of its own")
            raw, at = ids.tobytes(), 0
            for u, e in zip(part, (4 * cuts).tolist(), strict=True):
                self.units[u] = raw[at:e]
                at = e
        get = self.units.__getitem__
        for w, found in cut.items():
            self.known[w] = get(found[0]) if len(found) == 1 else b"".join(map(get, found))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(_words_of(text))
            size += len(held[-1])
            if size >= 200_000:
                yield from self._all(held)
                held, size = [], 0
        yield from self._all(held)

    def _all(self, lists: list[list[str]]) -> Iterator[bytes]:
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(self.units) + len(new) > KEPT_UNITS:
            self.known.clear()
            self.units.clear()
            new = set().union(*lists)
        if len(new) <= KEPT_UNITS:
            self._add(list(new))
            yield from map(self._joined, lists)
            return
        for words in lists:  # a text of very many different words goes part by part
            parts = []
            for i in range(0, len(words), KEPT_UNITS):
                self.known.clear()
                self.units.clear()
                self._add(list(set(words[i : i + KEPT_UNITS])))
                parts.append(self._joined(words[i : i + KEPT_UNITS]))
            yield b"".join(parts)

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def _words_of(text: str) -> list[str]:
    """The text's words, in lower case; those of a text with other characters as they are, after a blank."""
    if _PLAIN(text):
        return text.lower().split()
    return [" " + w for w in text.replace("\n", " ").split(" ") if w]


_loaded: dict[str, _Units] = {}


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.setdefault(tokenizer, None) or _Units(tokenizer)
        _loaded[tokenizer] = words
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, raw in zip(b.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """documents -> a row per piece: (doc_id, piece, start, length, ids_crc32). A null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _places(plan: list[tuple[int, list[int]]]) -> list[np.ndarray]:
    """For each run of pieces of one length: length, first number, pieces in a bin, first bin, place."""
    seen: dict[int, int] = {}
    rows, bins = [], 0
    for times, order in plan:
        at = 0
        for n in dict.fromkeys(order):
            m = order.count(n)
            rows.append((n, seen.get(n, 0), m, bins, at))
            seen[n] = seen.get(n, 0) + times * m
            at += n * m
        bins += times
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 5


def _assign(places: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, inside, base, place = places
        code = (length << 45) | first
        for b in batches:
            n, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            i = np.searchsorted(code, (n << 45) | number, "right") - 1
            k = number - first[i]
            sequence, offset = base[i] + k // inside[i], place[i] + k % inside[i] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """documents -> a row per piece with its sequence_id and offset.

    docs needs doc_id and text; other columns are ignored. A null or empty text is one piece that
    holds only end_id. Texts of more than capacity ids are cut into pieces of capacity; the last may
    be shorter. Repeated rows are packed each for itself; ties in length go by doc_id and piece. Only
    the histogram of lengths (at most capacity rows) comes to the driver. No rows give no rows.
    """
    pieces = cut(tokenised(docs, tokenizer, capacity, end_id), "pieces").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    numbered = pieces.withColumn("rn", F.row_number().over(own)).join(bases.select("length", "part", "base"), ["length", "part"])
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rn") - 1).alias("number"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    places = _places(best_two_fit(counts, capacity))
    return map_batches(rows, _assign(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_two_fit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
