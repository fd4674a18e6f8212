"""Secret scans with an incremental ledger of blobs. All of it is DataFrame work.

Every version of every path is addressed by its content. The ledger is a table of the blobs that were scanned, with
the rules (and the versions of these) that read them and what they found. A scan hashes all versions, reads the texts
of only those blobs that a rule's current version hasn't read yet, each once however many paths hold it, appends them
to the ledger, and joins the ledger's findings back to all paths. A ledger's row holds a blob's rules and findings
together, so what a broken scan has appended is whole, and the next scan does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, fresh_path


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is the secret itself, and its least length.

    Loops are possessive where what follows can't match what they take, which changes no match. A text that
    hasn't `hint` has no match. A changed pattern needs a new version.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ANY = lambda *words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
BASE = ("assign", "access", "hex")
#: The three fixed kinds, and keys in PEM, web tokens, passwords in addresses, and keys with a vendor's mark.
RULES = (
    Rule("assign", f"({_ANY('password', 'passwd', 'secret', 'token', 'api_?key')})[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", 2, 6, r"[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]{6}"),
    Rule("access", "AKIA[A-Z0-9]{16,}+", hint="AKIA"),
    Rule("hex", "[0-9a-f]{24,}+"),
    Rule("pem", "-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----[A-Za-z0-9+/=\\s]*+", hint="PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,300}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", hint=r"\.eyJ"),
    Rule("url", "://[A-Za-z0-9._%+-]++:([^\\s/:@\"'<>]{4,}+)@", 1, hint="://"),
    Rule("vendor", "(?:gh[opsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+)", hint="gh[opsu]_|xox[abprs]-|AIza|sk_live_"),
)
_FOUND = "array<struct<k:int,i:int,gap:int,m:string>>"
_SPANS = "array<struct<rule:string,start:int,end:int,digest:string>>"
LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"
#: Parts into which the findings of a blob, and the paths that hold it, are dealt.
SALTS = 16
#: Unseen blobs (32 bytes and some rule names each) that are broadcast; more of them meet the texts in a shuffle.
BROADCAST_BLOBS = 100_000


def blob_of(text: Column) -> Column:
    """The content's address: SHA-256 of its UTF-8 bytes, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _found(text: Column, due: Column, rules: tuple[Rule, ...]) -> Column:
    """All matches of the rules that are due, each with the code points since the match before."""
    none = F.array().cast(_FOUND)

    def of(k: int, rule: Rule) -> Column:
        both = F.struct(F.split(text, rule.pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"))
        piece = lambda z: F.transform(z["m"], lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(F.get(z["g"], i)).alias("gap"), m.alias("m")))
        wanted = F.array_contains(due, rule.name) & text.rlike(rule.hint or rule.pattern)
        return F.when(wanted, F.element_at(F.transform(F.array(both), piece), 1)).otherwise(none)

    return F.concat(*(of(k, r) for k, r in enumerate(rules)))


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of (blob, rules, text); a row for each blob, found or not."""
    each = texts.select("blob", "rules", F.explode_outer(_found(F.col("text"), F.col("rules"), rules)).alias("f")).select("blob", "rules", "f.*")
    so_far = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(so_far).cast("int"))
    pick = lambda f: F.element_at(F.array(*map(f, rules)), F.col("k") + 1)
    secret = F.when(F.col("k").isNotNull(), pick(lambda r: F.regexp_extract("m", r.pattern, r.group) if r.group else F.col("m")))
    placed = placed.withColumn("secret", secret)
    kept = F.length("secret") >= pick(lambda r: F.lit(r.least))
    span = F.struct(pick(lambda r: F.lit(r.name)).alias("rule"), (F.col("end") - F.length("m")).alias("start"), F.col("end"), F.sha2(F.col("secret").cast("binary"), 256).alias("digest"))
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(F.when(kept, span)).cast(_SPANS).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where nothing was ever scanned."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _due(blobs: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules): the rules whose current version hasn't read the blob, where there are any."""
    done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    every = F.array(*(F.lit(r.name) for r in rules))
    left = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done"))
    return blobs.join(done, "blob", "left").select("blob", left.alias("rules")).where(F.size("rules") > 0)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Versions of paths -> (*keep, blob, spans), a row for each input row; the ledger grows by what was unseen.

    spans are the findings of the rules' current versions in the row's text: (rule, kind, start, end, digest), in
    code points, end exclusive, by start and then in the order of the rules. Matches of a rule are leftmost and don't
    overlap; those whose secret is too short are dropped and not tried again from within. digest is the SHA-256
    of the secret, so that the ledger holds no secret in the clear. ledger is a folder that all executors share; it
    may be absent. keep names the columns that tell path and version; they may be null or repeat. A null text is
    empty, an empty one is a blob without findings. Other columns are ignored; no rows give no rows.
    Unseen blobs are broadcast to the texts if there are at most broadcast_blobs; more meet them in a shuffle.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(versions.select(F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), blob_of(F.col("text")).alias("blob")), "versions")
    texts = versions.select(blob_of(F.col("text")).alias("blob"), text.alias("text"))
    known = read_ledger(spark, ledger)
    if known is None:
        # nothing was scanned before: all blobs are due
        once = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", F.array(*(F.lit(r.name) for r in rules)))
    else:
        due = cut(_due(rows.select("blob").distinct(), known, rules), "due")
        if due.count() <= broadcast_blobs:
            once = texts.join(F.broadcast(due), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
        else:
            once = texts.groupBy("blob").agg(F.first("text").alias("text")).join(due, "blob")
    _scanned(once, rules).write.mode("append").parquet(ledger)
    return _to_paths(rows, read_ledger(spark, ledger), rules, keep)


def _to_paths(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...]) -> DataFrame:
    """The findings of each row's blob beside it. A blob that many paths hold is dealt into SALTS parts."""
    order = F.array(*(F.lit(r.name) for r in rules))
    current = F.filter("spans", lambda s: F.array_contains(order, s["rule"]))
    found = known.select("blob", current.alias("spans")).where(F.size("spans") > 0).repartition("blob")
    # a broken scan may have appended a blob twice: one row of each rule counts
    each = found.select("blob", "spans", F.explode(F.array_distinct(F.transform("spans", lambda s: s["rule"]))).alias("rule"))
    each = each.groupBy("blob", "rule").agg(F.first(F.expr("filter(spans, s -> s.rule = rule)")).alias("spans"))
    found = each.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    placed = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("k"), s["end"].alias("end"), s["rule"].alias("rule"), F.split_part(s["rule"], F.lit("@"), F.lit(1)).alias("kind"), s["digest"].alias("digest"))
    ordered = F.array_sort(F.transform(F.coalesce("spans", F.array().cast(_SPANS)), placed))
    return dealt.join(spread, ["blob", "salt"], "left").select(*(F.col(f"_kept.{c}").alias(c) for c in keep), "blob", ordered.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """documents as versions of paths named by doc_id, against a new ledger; edge cases are those of scan."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "ledger"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    count = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    plain = lambda p: p.replace("*+", "*").replace("++", "+").replace("}+", "}").replace("'", "''")
    one = "SELECT rid, {k} AS k, '{kind}' AS kind, i, length(g[i]) AS gap, m[i] AS m, m[i] AS secret FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m FROM d), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)"
    each = " UNION ALL ".join(one.replace("m[i] AS secret", "regexp_extract(m[i], '{p}', {g}) AS secret").format(k=k, kind=r.kind, p=plain(r.pattern), g=r.group) for k, r in enumerate(RULES))
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    text = lambda cond: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE {cond}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{b}') AS n_{b}" for b in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
each AS ({each}),
placed AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY rid, k ORDER BY i)::BIGINT AS stop FROM each),
kept AS (SELECT *, stop - length(m) AS start FROM placed WHERE length(secret) >= CASE k {least} END),
s AS (SELECT rid, {counts}, sha256({text(f"k < {len(BASE)}")}) AS base_sha256, {text("true")} AS spans FROM kept GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (rid)
"""


OP13_SQL = _sql()
