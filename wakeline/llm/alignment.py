"""Cross-tokenizer alignment by byte-owner arrays.

A text's tokens of both tokenizers are laid over its bytes: the number of the owning token is repeated for each of
its bytes. Where either owner changes, an overlap of two tokens ends; where both change, a group ends, and the two
tokens that end there are linked. Texts are cut before blanks that follow something else than white space, where tokens of
both always end; what stands between such blanks recurs, so each task encodes and aligns a piece once and remembers
it, and a document's alignment is that of its pieces put together. How often two ids are linked is counted in Spark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a task remembers before it begins anew, and the longest that it remembers.
REMEMBERED, LONGEST = 250_000, 100
#: Documents aligned at once, and their characters.
DOCS, CHARS = 200, 2_000_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_CUT = re.compile(r"(?<=\S)(?= )")
_BLANK = re.compile(r"[^\S ] |  | $|^ ")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level letters: printable Latin-1 stands for itself, the other bytes for the letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers and the bytes of their tokens. Encodes and aligns pieces that begin with a blank."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_alphabet()
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        self.known: dict[str, tuple | None] = {}
        self.passing: list[str] = []

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    def encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each piece, which is given without the blank that it begins with."""
        a = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        # the empty text has no tokens in B, but a blank at the end of a longer one is a token
        b = [ids if p else [self.blank] for p, ids in zip(pieces, self.b.encode(pieces, num_threads=1), strict=True)]
        return a, b

    def aligned(self, pieces: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, overlaps, links, groups as text) of each piece; None where bytes differ."""
        ids_a, ids_b = self.encoded(pieces)
        raw = [(" " + p).encode("utf-8", "surrogatepass") for p in pieces]
        whole = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        good = [i for i, w in enumerate(whole) if w]
        out: list[tuple | None] = [None] * len(pieces)
        if not good:
            return out
        a = np.fromiter(chain.from_iterable(ids_a[i] for i in good), np.int64)
        b = np.fromiter(chain.from_iterable(ids_b[i] for i in good), np.int64)
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.len_a[a]), np.repeat(np.arange(len(b)), self.len_b[b])
        last = np.array([True])
        change_a, change_b = (np.concatenate([np.diff(o) != 0, last]) for o in (owner_a, owner_b))
        # a piece ends with tokens of both, so its end is a change of both owners
        overlap, both = np.flatnonzero(change_a | change_b), np.flatnonzero(change_a & change_b)
        end_a, end_b = owner_a[both] + 1, owner_b[both] + 1
        link = (a[end_a - 1] * len(self.bytes_b) + b[end_b - 1]).tolist()
        ends = np.cumsum([len(raw[i]) for i in good])
        cuts, overs = np.searchsorted(both, ends).tolist(), np.searchsorted(overlap, ends).tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        end_a, end_b = end_a.tolist(), end_b.tolist()
        at_a = at_b = c0 = o0 = 0
        for i, c, o in zip(good, cuts, overs, strict=True):
            from_a, from_b, groups = at_a, at_b, []
            for k in range(c0, c):
                groups.append(",".join(text_a[at_a : end_a[k]]) + "|" + ",".join(text_b[at_b : end_b[k]]))
                at_a, at_b = end_a[k], end_b[k]
            out[i] = (at_a - from_a, at_b - from_b, c - c0, o - o0, tuple(link[c0:c]), ";".join(groups))
            c0, o0 = c, o
        return out

    def remembered(self, texts: list[list[str]]) -> dict[str, tuple | None]:
        """The alignments of all pieces of these texts; long ones are forgotten at the next call."""
        for p in self.passing:
            del self.known[p]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        if new:
            self.known.update(zip(new, self.aligned(new), strict=True))
        self.passing = [p for p in new if len(p) > LONGEST]
        return self.known


def pieces_of(text: str) -> list[str]:
    """The pieces of blank + text, each without its first blank."""
    if _BLANK.search(text) is None:
        return text.split(" ")
    return [p[1:] for p in _CUT.split(" " + text)]


_pairs: dict[tuple[str, str], Pair] = {}
_NONE = (0, 0, 0, 0, (), "")


def pair_of(path_a: str, path_b: str) -> Pair:
    """A worker loads two tokenizers once."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups string, links array<long>, times array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_overlaps")), ("groups", pa.string()), ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _align(path_a: str, path_b: str):
    def chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list[list[str]]]]:
        ids, texts, size = [], [], 0
        for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
            text = text.as_py()
            ids.append(doc.as_py())
            texts.append(pieces_of(text) if text else [])
            size += len(text or "")
            if len(ids) >= DOCS or size >= CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for b in batches:
            for ids, texts in chunks(b):
                known = pair.remembered(texts)
                sums, groups, links, times = [], [], [], []
                for pieces in texts:
                    found = list(map(known.__getitem__, pieces))
                    if not found or None in found:
                        found = [_NONE]
                    n_a, n_b, n_groups, n_overlaps, link, text = zip(*found, strict=True)
                    code, n = np.unique(np.fromiter(chain.from_iterable(link), np.int64), return_counts=True)
                    sums.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_overlaps)))
                    groups.append(";".join(text))
                    links.append(code)
                    times.append(n.astype(np.int32))
                cols = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)]
                lists = [pa.array(x, t) for x, t in ((links, pa.list_(pa.int64())), (times, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols, pa.array(groups, pa.string()), *lists], schema=_ARROW)

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """documents -> (doc_id, n_a, n_b, n_groups, n_overlaps, groups, links, times), a row for each input row.

    A's tokens are those of blank + text, B (which adds the blank) takes the text; no special tokens, and their names
    inside a text are plain text. groups has the ids of both between two places where tokens of both end, as
    `a1,a2|b1;a3|b2,b3`; n_overlaps counts pairs of tokens that share bytes. links are the distinct pairs of ids
    that end together, as a * (size of B) + b, and times how often each stands in the document. Null and empty texts, and those
    whose bytes either tokenizer doesn't give back, have no tokens: zeros, '' and empty arrays. Texts may be of any
    length; repeated rows are aligned each, doc_id may be null, other columns are ignored, no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _align(path_a, path_b), _SCHEMA)


def linked(found: DataFrame, size_b: int, keep: tuple[str, ...]) -> DataFrame:
    """Alignments -> (*keep, n_links, n_best, count_sum), a row for each input row.

    A pair's count is how often all rows link its ids; n_best counts the links whose pair has the highest count of
    its id of B, ties included; count_sum adds up the counts of all links. The counts, a row for each distinct pair, meet the
    rows' pairs in a join that Spark broadcasts where they are small and shuffles where they aren't.
    """
    rows = cut(found.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), "links", "times"), "links")
    each = rows.select("_row", F.explode(F.arrays_zip("links", "times")).alias("z")).select("_row", F.col("z.links").alias("link"), F.col("z.times").alias("n"))
    counts = each.groupBy("link").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("link") % size_b)))
    counts = cut(counts, "counts")
    n, best = F.col("n").cast("long"), F.when(F.col("best"), F.col("n")).otherwise(0)
    sums = each.join(counts, "link").groupBy("_row").agg(F.sum(n).alias("n_links"), F.sum(best).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))
    out = rows.select("_row", "_kept").join(sums, "_row", "left")
    return out.select(*(F.col(f"_kept.{c}").alias(c) for c in keep), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")))


def op12_byte_owner_alignment(spark, sf_dir: str) -> DataFrame:
    """Each document of the table; edge cases are those of alignments."""
    path_a, path_b = public_tokenizers.path(A), public_tokenizers.path(B)
    found = alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_a, path_b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = found.select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", digest.alias("groups_sha256"), "links", "times")
    out = linked(found, pair_of(path_a, path_b).b.get_piece_size(), ("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
