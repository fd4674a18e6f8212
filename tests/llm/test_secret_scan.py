"""Secret scans against plain Python, and what a second scan reads."""

import dataclasses
import hashlib
import random
import re

import pytest
from test_llm import documents, table

from wakeline.llm import secret_scan
from wakeline.llm.secret_scan import RULES

PLAIN = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain(text):
    """The three fixed kinds as (start, order, end, kind)."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, g, least)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def texts():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "Api_Key", "apikey", "passwd", "password", "secret", "=", ":", " ", "  ", '"', "'", "\n", "é", "😀", "AKIA", "AKIAAKIA", "ABCDEFGH01234567", "deadbeef" * 3, "0123456789abcdef01234567", "abc", "abcdef", "x=y", "ſecret", "toKen"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    fixed = [None, "", "token=token:abcdef", "token=token=abcdef", "token==abcde", "token=abcde", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24, "g" + "a" * 24 + "G", 'password = "hunter22"']
    return fixed + made + made[:50] + fixed[:6]


def spans(rows, *kinds):
    return [[(s["kind"], s["start"], s["end"]) for s in r["spans"] if not kinds or s["kind"] in kinds] for r in rows]


def test_fixed_kinds(spark, tmp_path):
    rows = texts()
    got = secret_scan.scan(documents(spark, rows).repartition(4), f"file://{tmp_path}/ledger").orderBy("doc_id").collect()
    assert spans(got, *PLAIN) == [plain(t) for t in rows]
    assert [bytes(r["blob"]) for r in got] == [hashlib.sha256((t or "").encode()).digest() for t in rows]
    ledger = spark.read.parquet(f"{tmp_path}/ledger").collect()
    assert len(ledger) == len({t or "" for t in rows})


def test_added_kinds_and_digests(spark, tmp_path):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.SflKxwRJSMeKKF2QT4"
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n"
    rows = [f"é {jwt}!", f"{pem}-----END", "see postgres://me:hunter22@db/x", "ghp_" + "Z1" * 20, "eyJ" * 5000, "://a:" * 5000, "plain text"]
    got = secret_scan.scan(documents(spark, rows), f"file://{tmp_path}/ledger").orderBy("doc_id").collect()
    assert spans(got) == [[("jwt", 2, 2 + len(jwt))], [("pem", 0, len(pem))], [("url", 12, 27)], [("vendor", 0, 44)], [], [], []]
    assert got[2]["spans"][0]["digest"] == hashlib.sha256(b"hunter22").hexdigest()


@pytest.mark.parametrize("most", [0, 100])
def test_only_unseen_pairs_are_scanned(spark, tmp_path, most):
    """Known blobs aren't read again, a new version of a rule reads all of them by itself, old paths get its findings."""
    path = f"file://{tmp_path}/ledger"
    read = lambda: [(bytes(r["blob"]), sorted(r["rules"])) for r in spark.read.parquet(path).collect()]
    names = sorted(r.name for r in RULES)
    first = ["token = abcdef", "nothing", "token = abcdef"]
    secret_scan.scan(documents(spark, first), path, broadcast_blobs=most)
    assert sorted(read()) == sorted((hashlib.sha256(t.encode()).digest(), names) for t in set(first))
    more = [*first, "passwd: 'qwerty1'", None]
    got = secret_scan.scan(documents(spark, more), path, broadcast_blobs=most).orderBy("doc_id").collect()
    assert spans(got) == [[("assign", 0, 14)], [], [("assign", 0, 14)], [("assign", 0, 16)], []]
    assert len(read()) == 4
    spark.read.parquet(path).write.mode("append").parquet(f"{path}-twice")
    spark.read.parquet(path).write.mode("append").parquet(f"{path}-twice")
    assert spans(secret_scan.scan(documents(spark, more), f"{path}-twice").orderBy("doc_id").collect()) == spans(got)
    again = secret_scan.scan(documents(spark, more), path, broadcast_blobs=most)
    assert len(read()) == 4 and spans(again.orderBy("doc_id").collect()) == spans(got)
    changed = tuple(dataclasses.replace(r, pattern="noth[a-z]++", hint="", least=1, group=0, version=2) if r.kind == "assign" else r for r in RULES)
    got = secret_scan.scan(documents(spark, more), path, changed, broadcast_blobs=most).orderBy("doc_id").collect()
    assert spans(got) == [[], [("assign", 0, 7)], [], [], []]
    assert [r for _, r in read()].count(["assign@2"]) == 4


def test_paths_with_nulls_and_repeats(spark, tmp_path):
    rows = [(None, None), (None, "secret=abcdefg"), (1, "secret=abcdefg"), (1, "secret=abcdefg"), (2, "")]
    got = secret_scan.scan(table(spark, rows, "doc_id long, text string"), f"file://{tmp_path}/ledger", keep=("doc_id", "key")).collect()
    assert sorted((str(r["doc_id"]), len(r["spans"])) for r in got) == [("1", 1), ("1", 1), ("2", 0), ("None", 0), ("None", 1)]
    assert got[0].asDict().keys() == {"doc_id", "key", "blob", "spans"}


def test_long_and_hot_blobs(spark, tmp_path):
    """A text of many secrets, held by half of all paths; and no rows."""
    long = "".join(f"token = {i:032x} und " for i in range(20_000))
    rows = [long] * 40 + [f"text {i}" for i in range(40)]
    got = secret_scan.scan(documents(spark, rows).repartition(8), f"file://{tmp_path}/ledger").orderBy("doc_id").collect()
    assert spans(got[:1])[0] == plain(long) and all(len(r["spans"]) == 40_000 for r in got[:40]) and not any(r["spans"] for r in got[40:])
    assert secret_scan.scan(documents(spark, []), f"file://{tmp_path}/empty").count() == 0
    assert secret_scan.scan(documents(spark, []), f"file://{tmp_path}/empty").count() == 0
