"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

All of it is DataFrame work. Seeds are the spans of the four fixed patterns, and long mixed strings that
are assigned to a name, as seeds of secrets. Every identifier-like string is an instance; the words
before it, the words after it and its shape are its patterns. A pattern is trusted as far as the known
instances it has are of one kind, an instance as far as the patterns around it are; its shape adds to
that, but a shape never seen before is no objection. What is accepted is known in the next round, so its
contexts and its shape find more, until nothing is added; at the end it is a span of its own. A seed of a secret is
evidence for others only: it becomes a span if its patterns accept it by what they hold besides it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The patterns, with possessive loops and a guard at the left: same matches, but no backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind, so the pattern isn't tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: An @ written as a word in brackets.
_AT = r"\x20?[(\[{](?i:at)[)\]}]\x20?"
#: Identifier-like strings: a quoted value after = or :, an address with a bracketed "at", groups of digits,
#: or at least six characters without a blank, four of them digits or one an @.
CANDIDATE = (
    r"(?<=[=:]\x20?[\"'])[^\s\"'<>]{6,}+(?=[\"'])"
    r"|(?<![^\s\"'(<\[=:])(?:[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9][A-Za-z0-9.-]*+"
    r"|(?:\+?[0-9]{1,4}[\x20.-]?)?\([0-9]{1,5}\)(?:[\x20.-]?[0-9]{2,8}){1,4}(?![A-Za-z0-9@])"
    r"|[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){2,4}(?![A-Za-z0-9@])"
    r"|(?=(?:[A-Za-z@._%+()/-]*+[0-9]){4}|[A-Za-z0-9._%+()/-]*+@)[A-Za-z0-9+(][A-Za-z0-9@._%+()/-]{5,}+)"
)
#: A seed of a secret: at least so long, letters and digits mixed, right after an assignment.
SECRET = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,}$"
ASSIGNED = r"[=:]\s*[\"']?$"
_SECRET = len(BASE)
#: What unknown instances weigh against a pattern (known ones of another kind weigh 1) and a constant that
#: does, too; known instances that a pattern needs.
UNKNOWN, SMOOTHING, LEAST_SEEDS = 0.25, 1.0, 5
#: An instance is accepted if its best sighting scores so much, and all its sightings on average so much. The
#: average isn't asked of what has the form of a secret, which stays one where it stands alone.
ACCEPTED, ON_AVERAGE = 0.8, 0.5
#: Characters on either side in which its words are looked for.
CONTEXT = 64
#: Parts into which a frequent pattern or value is dealt.
SALTS = 8
_W, _P = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]*"
_SPAN = "array<struct<start:int,k:int,end:int,kind:string,value:string>>"
_MASK = "array<struct<start:int,end:int,kind:string>>"
_PIECE = "array<struct<k:int,i:int,gap:int,m:string,before:string,after:string>>"


def _bound(value: Column, body) -> Column:
    """body(value), where value is worked out once: an array of one binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(text: Column, k: int, pattern: str) -> Column:
    """Each match with the number of code points since the match before, and the text on either side.

    The context ends at the neighbouring match. Every part of the text is looked at a fixed number of times.
    """
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def piece(z: Column, m: Column, i: Column) -> Column:
        before, after = F.get(z["g"], i), F.get(z["g"], i + 1)
        return F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(before).alias("gap"), m.alias("m"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    return _bound(both, lambda z: F.transform(z["m"], lambda m, i: piece(z, m, i)))


def _found(text: Column) -> Column:
    """All matches of the fixed patterns and all candidates, kind by kind."""
    none = F.array().cast(_PIECE)

    def of(k: int, kind: str) -> Column:
        hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        return F.when(hint, _pieces(text, k, PATTERNS[kind])).otherwise(none)

    some = text.rlike(rf"[0-9@]|{_AT}|[=:]\x20?[\"']")
    every = F.concat(*(of(k, kind) for k, kind in enumerate(BASE)), _pieces(text, len(BASE), CANDIDATE).cast(_PIECE))
    return F.when(some, every).otherwise(none)


def _luhn(m: Column) -> Column:
    def total(digits: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            twice = 2 * d
            return a + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)

    return _bound(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(F.length(d).between(12, 19), total(d) % 10 == 0).otherwise(False))


def _valid(k: Column, m: Column) -> Column:
    ip = F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    phone = F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.when(k == 1, ip).when(k == 2, _luhn(m)).when(k == 3, phone).otherwise(F.lit(True))


def _shape(m: Column) -> Column:
    """Digits as 9, runs of letters as a; what stands between them stays."""
    return F.regexp_replace(F.regexp_replace(m, "[0-9]", "9"), "[A-Za-z]+", "a")


def _instances(rows: DataFrame) -> DataFrame:
    """(_row, start, end, value, before, after, seed): valid matches as seeds, and candidates that overlap none."""
    each = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*").repartition("_row")
    so_far = Window.partitionBy("_row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col("gap") + F.length("m")).over(so_far) - F.length("m")
    quoted = F.col("before").rlike("[\"']$")
    value = F.when((F.col("k") < len(BASE)) | quoted, F.col("m")).otherwise(F.regexp_replace("m", r"[^A-Za-z0-9)]+$", ""))
    placed = each.select("_row", "k", at.cast("int").alias("start"), value.alias("value"), "before", "after", "m").where(_valid(F.col("k"), F.col("m")) & (F.col("value") != ""))
    placed = placed.withColumn("end", F.col("start") + F.length("value")).drop("m")
    is_base = F.col("k") < len(BASE)
    back = Window.partitionBy("_row").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"_end": F.max(F.when(is_base, F.col("end"))).over(back), "_next": F.min(F.when(is_base, F.col("start"))).over(ahead)})
    clear = is_base | (F.coalesce(F.col("_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
    secret = F.col("value").rlike(SECRET) & F.col("before").rlike(ASSIGNED)
    seed = F.when(is_base, F.col("k")).when(secret, F.lit(KINDS.index("secret")))
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    words = {"before": tidy(F.regexp_extract("before", rf"((?:{_W}{_P}){{1,2}})$", 1)), "after": tidy(F.regexp_extract("after", rf"^((?:{_P}{_W}){{1,2}})", 1))}
    return placed.where(clear).select("_row", "start", "end", "value", *(c.alias(n) for n, c in words.items()), seed.alias("seed"))


def _patterns() -> Column:
    """The patterns of a sighting: one or two words on either side with the marks between, and the shape."""
    one = F.regexp_extract("before", rf"({_W}{_P})$", 1), F.regexp_extract("after", rf"^({_P}{_W})", 1)
    two = F.col("before"), F.col("after")
    entry = lambda side, depth, c: F.struct(F.lit(side).alias("side"), F.lit(depth).alias("depth"), F.concat(F.lit(side + ":"), c).alias("pattern"))
    sides = [entry(s, d, c[j]) for j, s in enumerate("LR") for d, c in ((1, one), (2, two))]
    # two words are a pattern of their own only where there are two
    both = F.array(*sides[:1], F.when(two[0] != one[0], sides[1]), sides[2], F.when(two[1] != one[1], sides[3]), entry("S", 1, _shape(F.col("value"))))
    return F.filter(both, lambda p: p.isNotNull() & (F.length(p["pattern"]) > 2))


def _discovered(seen: DataFrame) -> DataFrame:
    """(value, kind): the values that the contexts of known ones vouch for."""
    kinds = range(len(KINDS))
    sights = seen.groupBy("value", "before", "after").agg(F.max("seed").alias("seed"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    edges = sights.select("value", F.xxhash64("before", "after").alias("sight"), "seed", F.explode(_patterns()).alias("p")).select("value", "sight", "seed", "p.*")
    edges = cut(edges, "graph")
    pairs = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    stats = pairs.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("seed") == k).alias(f"s{k}") for k in kinds)).where(F.col("n") >= LEAST_SEEDS)
    stats = cut(stats, "patterns")
    # seeds of secrets are judged too, each by what its patterns hold besides it
    asked = edges.where(F.col("seed").isNull() | (F.col("seed") == _SECRET)).select("value", "sight", "side", "depth", "pattern", F.col("seed").isNotNull().alias("own"), salt("value").alias("salt"), salt("pattern").alias("side_salt"))
    best, count = None, 0
    while True:
        if best is None:
            known = stats.withColumns({f"m{k}": F.lit(0.0) for k in kinds} | {f"c{k}": F.lit(0) for k in kinds})
        else:
            more = asked.where("NOT own").join(best.withColumn("side_salt", spread), ["value", "side_salt"]).groupBy("pattern", "value").agg(F.first("kind").alias("kind"), F.first("score").alias("score"))
            of = lambda k: F.col("kind") == k
            more = more.groupBy("pattern").agg(*(F.sum(F.when(of(k), F.col("score")).otherwise(0.0)).alias(f"m{k}") for k in kinds), *(F.count_if(of(k)).alias(f"c{k}") for k in kinds))
            known = stats.join(more, "pattern", "left").na.fill(0)
        every = reduce(add, (F.col(f"s{k}") + F.col(f"c{k}") for k in kinds))

        def trust(own: int) -> Column:
            """By kind, leaving out so many secrets."""
            against = every - own + UNKNOWN * F.greatest(F.col("n") - every, F.lit(0)) + SMOOTHING
            held = lambda k: own if k == _SECRET else 0
            enough = lambda k: F.col(f"s{k}") + F.col(f"c{k}") - held(k) >= LEAST_SEEDS
            return F.array(*(F.when(enough(k), (F.col(f"s{k}") + F.col(f"m{k}") - held(k)) / against).otherwise(0.0) for k in kinds))  # noqa: B023

        trusted = known.select("pattern", trust(0).alias("trust"), trust(1).alias("without")).withColumn("salt", spread)
        # on either side, the longest pattern that is frequent enough to be judged
        mine = F.when(F.col("own"), F.col("without")).otherwise(F.col("trust"))
        side = lambda s: F.max_by(mine, F.when((F.col("side") == s) & F.col("trust").isNotNull(), F.col("depth"))).alias(s)  # noqa: B023, E731
        sighted = asked.join(trusted, ["pattern", "salt"], "left").groupBy("value", "sight", "own").agg(*map(side, "LRS"))
        t = lambda s, k: F.coalesce(F.get(s, F.lit(k)), F.lit(0.0))
        context = lambda k: 1 - (1 - t("L", k)) * (1 - t("R", k))
        scored = sighted.select("value", "own", *((context(k) + (1 - context(k)) * context(k) * t("S", k)).alias(f"x{k}") for k in kinds))
        scored = scored.groupBy("value").agg(F.max("own").alias("own"), F.array(*(F.struct(F.avg(f"x{k}").alias("mean"), F.max(f"x{k}").alias("score"), F.lit(k).alias("kind")) for k in kinds)).alias("a"))
        # by the best sighting where the form is that of a secret, else by the mean of all
        top = scored.select("value", F.when(F.col("own"), F.get("a", F.lit(_SECRET))).otherwise(F.array_max("a")).alias("a"), "own").where((F.col("a.score") >= ACCEPTED) & (F.col("own") | (F.col("a.mean") >= ON_AVERAGE)))
        found = top.select("value", "a.kind", "a.score")
        if best is not None:
            # what was accepted stays, so the rounds end
            found = found.unionByName(best).groupBy("value").agg(F.max_by("kind", "score").alias("kind"), F.max("score").alias("score"))
        best = cut(found, "accepted")
        before, count = count, best.count()
        if count == before:
            break
    return best.select("value", "kind")


def _spans(seen: DataFrame) -> DataFrame:
    """(_row, base, spans, masks) of the rows that have any."""
    fixed = F.coalesce(F.col("seed") < len(BASE), F.lit(False))
    seeds = seen.where(fixed).select("_row", "start", "end", "value", F.col("seed").alias("kind"))
    known = _discovered(seen).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = seen.where(~fixed).withColumn("salt", F.pmod(F.xxhash64("_row", "start"), F.lit(SALTS)).cast("int")).join(known, ["value", "salt"]).select("_row", "start", "end", "value", "kind")
    base = F.col("kind") < len(BASE)
    every = seeds.withColumn("base", base).unionByName(hits.withColumn("base", F.lit(False))).repartition("_row")
    back = Window.partitionBy("_row").orderBy("start", "kind", "end")
    new = F.coalesce(F.max("end").over(back.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    island = every.withColumn("new", new).withColumn("island", F.sum(F.col("new").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("k"), "end", name.alias("kind"), "value", "base")
    groups = island.groupBy("_row", "island").agg(F.collect_list(span).alias("spans"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(name, F.struct("start", "kind", "end")).alias("kind"))
    whole = groups.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).cast(_MASK).alias("masks"))
    plain = lambda c: F.transform(c, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "k", "end", "kind", "value")))).cast(_SPAN)
    return whole.select("_row", plain(F.filter("all", lambda s: s["base"])).alias("base"), plain(F.col("all")).alias("spans"), "masks")


def detect(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> (doc_id, base, spans, masks, *keep), a row for each input row.

    base and spans are arrays of (start, k, end, kind, value): code points, end exclusive, by start and
    kind. spans adds to base what bootstrapping accepts outside base spans; masks are the
    spans with overlapping ones united under the first one's kind. A null text is empty and has none.
    Repeated rows are found alike, each for itself; doc_id may be null. keep names input columns to carry
    along (text is then the whole text, null as empty); other columns are ignored. No rows give no rows.
    A value is one instance however often it occurs: it is accepted or not by all its contexts, of
    which those that differ count once. Frequent words and values are dealt into SALTS parts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carried = [(text if c == "text" else F.col(c)).alias(c) for c in keep]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"), F.struct(F.lit(0).alias("_"), *carried).alias("_kept"))
    rows = cut(rows.select("_row", "_doc", "_kept", _found(F.col("_text")).alias("found")), "matches")
    spans = _spans(cut(_instances(rows.where(F.size("found") > 0)), "instances"))
    joined = rows.select("_row", "_doc", "_kept").join(spans, "_row", "left")
    out = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("base", _SPAN), ("spans", _SPAN), ("masks", _MASK))]
    return joined.select(F.col("_doc").alias("doc_id"), *out, *(F.col(f"_kept.{c}").alias(c) for c in keep if c != "doc_id"))


def redact(text: Column, masks: Column) -> Column:
    """The text with each mask replaced by its kind in brackets. Pieces are taken from blocks, not from the text's begin."""
    size = 512

    def put(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            around = F.slice(blocks, first + 1, F.floor(b / size).cast("int") - first + 1)
            return F.substring(F.array_join(around, ""), a - first * size + 1, b - a)

        end = lambda i: F.when(i > 0, F.get(masks, i - 1)["end"]).otherwise(0)
        marked = F.transform(masks, lambda s, i: F.concat(between(end(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(marked, ""), between(F.element_at(masks, -1)["end"], F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.size(masks) > 0, _bound(blocks, put)).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii_bootstrapped(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
