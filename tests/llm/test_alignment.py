"""Alignments against both tokenizers over whole texts."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import SF, documents, table
from tokenizers import Tokenizer

from wakeline.llm import alignment

PATHS = public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B)


def unescaped():
    """Byte-level letters and their bytes, as GPT-2's published table has them."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    more = [b for b in range(256) if b not in own]
    return dict(zip(map(chr, own), own, strict=True)) | {chr(256 + n): b for n, b in enumerate(more)}


class Whole:
    """Encodes whole texts at once and aligns by the ends of tokens."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        self.letters = unescaped()

    def groups(self, text):
        """[(ids of A, ids of B)], and the pairs of tokens that share bytes."""
        if not text:
            return [], 0
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        whole = (" " + text).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            return [], 0
        ends = []
        for raw in (raw_a, raw_b):
            at, e = 0, []
            for r in raw:
                at += len(r)
                e.append(at)
            ends.append(e)
        out, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            out.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        return out, len(set(ends[0]) | set(ends[1]))


def expected(texts):
    whole = Whole()
    groups = [whole.groups(t) for t in texts]
    links = [[(x[-1], y[-1]) for x, y in g] for g, _ in groups]
    count = collections.Counter(p for each in links for p in each)
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (g, n_overlaps), link in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(link), sum(count[p] == best[p[1]] for p in link), sum(count[p] for p in link), sha, n_overlaps))
    return out


def hard_texts():
    rng = random.Random(8)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "the", "Hello", "it's", "don't", ",", "...", "1234", "é", "日本語", "😀", "▁", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "ﬁ", "\x00", "ß", "á"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    return [None, "", " ", "  ", "\n", " a", "a ", "a  ", " \n", "a \n", "a\n ", "a\n b", "▁", "a▁b", "<|endoftext|> <s>", *made, *made[:30], "日本語" * 500, "x" * 3000]


@pytest.mark.parametrize("remembered", [20, alignment.REMEMBERED])
def test_pieces_align_as_whole_texts(monkeypatch, remembered):
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    pair, texts = alignment.Pair(*PATHS), [t for t in hard_texts() if t]
    whole = Whole()
    for k in range(0, len(texts), 50):
        part = [alignment.pieces_of(t) for t in texts[k : k + 50]]
        known = pair.remembered(part)
        for t, pieces in zip(texts[k : k + 50], part, strict=True):
            assert "".join(" " + p for p in pieces) == " " + t
            found = [known[p] for p in pieces]
            groups, n = whole.groups(t)
            want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert (";".join(f[5] for f in found) if None not in found else "") == want, repr(t)
            assert None in found or sum(f[3] for f in found) == n


def run(docs):
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("sha")
    names = ("doc_id", "n_a", "n_b", "n_groups", "sha", "n_overlaps")
    found = alignment.alignments(docs, *PATHS).select("*", digest)
    return alignment.linked(found, alignment.pair_of(*PATHS).b.get_piece_size(), names).collect()


def test_counts_over_the_corpus(spark):
    texts = hard_texts()
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["sha"], r["n_overlaps"]) for r in run(documents(spark, texts).repartition(5))}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], expected([r["text"] for r in docs]), strict=True))
    got = alignment.op12_byte_owner_alignment(spark, SF).collect()
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["n_overlaps"]) for r in got} == want
    assert len(got) == len(docs)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "")]
    got = run(table(spark, rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == [("1", 2, 6), ("1", 2, 6), ("2", 0, 0), ("None", 0, 0), ("None", 2, 6)]
    assert run(documents(spark, [])) == []


def test_very_long_text(spark):
    text = " ".join(f"word{i % 977}, 日本{i % 31}" for i in range(100_000))
    got = run(documents(spark, [text, text]))
    assert [(r["n_a"], r["sha"]) for r in got] == [(expected([text])[0][0], expected([text])[0][6])] * 2
