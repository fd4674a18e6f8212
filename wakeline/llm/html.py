"""Main text of web pages by the container paths that pages of a host agree on.

A page is read in one linear scan into containers and text blocks. Each page scores its containers (names,
links, sentences, headline), picks the container of its article and judges those around and inside it.
These are votes for generalised tag-class paths; Spark counts them by host; every page is then extracted
again with its host's article paths, and paths that the host agrees on are kept or dropped as agreed.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

#: Pages from which a host's vote on a path counts, the share of them that must agree, and the share of the
#: leading article path's votes with which another one is an article path of the host, too.
PAGES, AGREED, WIN = 3, 0.8, 0.1
#: A container is chrome from this score on. See _judge.
CHROME = 2.0
#: Parts into which a host's pages are dealt where its choices aren't broadcast.
SALTS = 8

# fixed values: what HTML calls its elements
_CONTAINERS = frozenset("html body div article section main aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure blockquote details fieldset center menu dialog noscript template search".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary address hr legend option button label select textarea".split())
_GONE = frozenset("nav aside footer menu dialog noscript template search".split())
_GONE_BLOCKS = frozenset("button label legend option select".split())
_RAW = frozenset("script style textarea iframe title noembed noframes xmp".split())
_CELLS = frozenset("tbody thead tfoot tr td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# fixed values: words of class names
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended recommendations comment comments disqus replies respond widget widgets pager pagination login signup toolbar copyright disclaimer".split()
)
_FILLERS = frozenset(
    "list area box slot wrapper wrap container bar section block inner outer site page global left right top bottom primary secondary buttons button links link items item "
    "posts articles stories form panel unit group row col column content thread div region main text message".split()
)
_STATES = frozenset("has have no not with without is are open opened closed enabled disabled active inactive visible theme layout style fixed sticky responsive".split())
_STORY = frozenset("article post entry story content body text page main hentry title".split())

_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?")
_VARIES = re.compile(r"\d+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*(?:\s|$)|,\s|、|，")


def generalised(tag: str, classes: str) -> str:
    """A path step: the tag with its classes in order, digits made alike."""
    return ".".join([tag, *sorted({_VARIES.sub("#", c) for c in classes.lower().split()})])


def named(marks: list[str]) -> float:
    """How far class names, ids and roles tell chrome: 2 for a whole name of chrome, 1 for a part of a name.

    The head word of a name counts, so an entry-header is none; words of state (has-sidebar) tell nothing.
    """
    return max(map(_named, marks), default=0.0)


@lru_cache(100_000)
def _named(mark: str) -> float:
    words = [_plain(w.lower()) for w in _PARTS.findall(mark)]
    if not _STATES.isdisjoint(words) or _NAMES.isdisjoint(words):
        return 0.0
    core = [w for w in words if w not in _FILLERS] or words
    if not _STORY.isdisjoint(words) and core[-1] in ("header", "banner", "masthead"):
        return 0.0
    return 2.0 if core[-1] in _NAMES else 1.0


def _plain(word: str) -> str:
    """relatedposts is related, as posts only fills the name."""
    return next((n for n in _NAMES if len(n) > 3 and word.startswith(n) and word[len(n) :] in _FILLERS), word)


class Page:
    """Containers (each with its parent's number) and text blocks of a page, in order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.step, self.path, self.name, self.gone = [-1], ["#"], ["#"], [0], [0.0], [False]
        #: (container, text, characters in links, tag)
        self.blocks: list[tuple[int, str, int, str]] = []
        self._scan(source)
        self._judge()

    def _open(self, tag: str, attrs: str, inside: int, story: bool) -> int:
        got = {}
        for k, a, b, c in _ATTR.findall(attrs) if attrs.strip() else ():
            got.setdefault(k.lower(), a or b or c)
        classes, role = got.get("class", ""), got.get("role", "").lower()
        gone = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        gone = gone or tag in _GONE or (tag == "header" and not story) or role in _ROLES
        self.parent.append(inside)
        self.tag.append(tag)
        step = generalised(tag, classes)
        self.step.append(step)
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[inside]:x}>{step}"))
        self.name.append(0.0 if tag in ("html", "body") else named([*classes.split(), got.get("id", "")]))
        self.gone.append(gone or self.gone[inside])
        return len(self.parent) - 1

    def _scan(self, s: str) -> None:
        """One pass; what an unclosed tag, quote or comment may cost is paid once."""
        stack, tags, count = [0], ["#"], {}
        text: list[str] = []
        links, link_at, skip, block = 0, -1, False, ""
        at, n = 0, len(s)
        lost: dict[str, bool] = {}

        def find(what: str, since: int) -> int:
            if lost.get(what):
                return -1
            i = s.find(what, since)
            if i < 0:
                lost[what] = True
            return i

        def flush() -> None:
            nonlocal links
            if text:
                line = " ".join("".join(text).split())
                if line and not self.gone[stack[-1]]:
                    self.blocks.append((stack[-1], line, min(links, len(line)), block))
                text.clear()
            links = 0

        def put(piece: str) -> None:
            nonlocal links
            if not skip and piece:
                piece = _html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if link_at >= 0:
                    links += len(piece.strip())

        while at < n:
            i = s.find("<", at)
            if i < 0:
                put(s[at:])
                break
            if i > at:
                put(s[at:i])
            nxt = s[i + 1 : i + 2]
            if nxt in ("!", "?"):
                if s.startswith("<!--", i):
                    end = i + 4 if s.startswith((">", "->"), i + 4) else find("-->", i + 4)
                    at = n if end < 0 else s.index(">", end) + 1
                else:
                    end = find(">", i)
                    at = n if end < 0 else end + 1
                continue
            m = _NAME.match(s, i + 1)
            if not m:
                put("<")
                at = i + 1
                continue
            # the tag's end: a quoted value after = counts only if its end looks like one
            j, end = m.end(), -1
            while True:
                q = _QUOTE.search(s, j) if not lost.get(">") else None
                if q is None:
                    lost[">"] = lost.get(">") or find(">", j) < 0
                    break
                if q[0] == ">":
                    end = q.start()
                    break
                close = find(q[1], q.end())
                if close >= 0 and (close + 1 >= n or s[close + 1] in " \t\r\n\f/>"):
                    j = close + 1
                    continue
                end = find(">", q.end())
                break
            if end < 0:  # a tag that never ends
                break
            name, attrs, at = m[0].lower(), s[m.end() : end], end + 1
            closing, tag = name[0] == "/", name.lstrip("/")
            if tag in _RAW and not closing:
                if tag in ("textarea", "iframe"):
                    flush()
                found = _CLOSE[tag].search(s, at) if not lost.get(tag) else None
                if found is None:
                    lost[tag] = True
                    if tag in ("script", "style", "iframe", "xmp"):
                        break
                    continue
                end = find(">", found.end())
                at = n if end < 0 else end + 1
            elif tag in _CONTAINERS:
                flush()
                skip, block = False, ""
                if closing:
                    if count.get(tag):
                        while True:
                            top = tags.pop()
                            stack.pop()
                            count[top] -= 1
                            if top == tag:
                                break
                elif not attrs.endswith("/"):
                    if tag == "main":
                        while tags[-1] in ("nav", "header", "footer"):
                            count[tags.pop()] -= 1
                            stack.pop()
                    story = bool(count.get("article") or count.get("main"))
                    stack.append(self._open(tag, attrs, stack[-1], story))
                    tags.append(tag)
                    count[tag] = count.get(tag, 0) + 1
                if link_at > len(stack):
                    link_at = -1
            elif tag in _BLOCKS:
                flush()
                skip, block = tag in _GONE_BLOCKS and not closing, "" if closing else tag
            elif tag == "a":
                link_at = -1 if closing else len(stack)
            elif tag == "br":
                text.append(" ")
        flush()

    def _judge(self) -> None:
        """Scores the containers: chars, link characters, sentences and headlines below each; then the article's."""
        k = len(self.parent)
        self.chars, self.links, self.sentences, self.bars = [0] * k, [0] * k, [0] * k, [0] * k
        head, first = [False] * k, [len(self.blocks)] * k
        story = next((b for b, x in enumerate(self.blocks) if x[3] == "h1" and x[2] < len(x[1])), None)
        self.body = [2 * link <= len(line) for _, line, link, _ in self.blocks]
        for b, (c, line, link, tag) in enumerate(self.blocks):
            self.chars[c] += len(line)
            self.links[c] += link
            self.bars[c] += link > 0
            self.sentences[c] += len(line) if self.body[b] and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and _SENTENCE.search(line) else 0
            head[c] |= b == story
            first[c] = min(first[c], b)
        for c in range(k - 1, 0, -1):
            p = self.parent[c]
            for x in (self.chars, self.links, self.sentences, self.bars):
                x[p] += x[c]
            head[p] |= head[c]
            first[p] = min(first[p], first[c])
        self.head = head
        begin = min((b for b, x in enumerate(self.blocks) if b == story or (self.body[b] and _SENTENCE.search(x[1]))), default=0)
        self.score = [0.0] * k
        for c in range(1, k):
            n, tag = self.chars[c], self.tag[c]
            if not n or tag in ("html", "body") or tag in _CELLS:
                continue
            x = self.name[c] - 2.0 * head[c] - 2.0 * (tag in ("article", "main"))
            if 2 * self.links[c] > n:
                before = first[c] < begin
                x += 2.0 if before or (tag in ("div", "section") and self.bars[c] > 1 and 5 * self.links[c] > 4 * n) else 1.0
            elif not self.sentences[c]:
                x += 0.5
            if tag in ("form", "fieldset"):
                x += 2.0 if 2 * self.sentences[c] <= self.sentences[0] else 0.0
            self.score[c] = x
        self._root()

    def chrome(self, agreed: dict[int, bool] | None = None) -> list[bool]:
        """Whether each container is chrome or in chrome: as agreed for its path, or else by its own score."""
        out = [False] * len(self.parent)
        for c in range(1, len(out)):
            said = agreed.get(self.path[c]) if agreed else None
            out[c] = out[self.parent[c]] or (self.score[c] >= CHROME if said is None else said)
        return out

    def _root(self) -> None:
        """The article's container by this page alone. What no other text is left beside isn't chrome."""
        bad = self.chrome()
        kept = sum(len(x[1]) for b, x in enumerate(self.blocks) if not bad[x[0]] and self.body[b])
        if not kept and self.blocks:
            self.score = [min(x, CHROME - 0.5) for x in self.score]
        elif 5 * kept < self.sentences[0] and not any(self.head[c] and not bad[c] for c in range(1, len(bad))):
            top = max((c for c in range(1, len(bad)) if bad[c] and not bad[self.parent[c]]), key=lambda c: self.sentences[c])
            if 2 * self.sentences[top] > self.sentences[0]:
                c = top
                while c > 0:
                    self.score[c] = min(self.score[c], CHROME - 0.5)
                    c = self.parent[c]
        self.root = self._deepest(self.chrome())

    def _deepest(self, bad: list[bool]) -> int | None:
        """The deepest container of all body blocks that aren't chrome; an article element goes before it."""
        body = [x for b, x in enumerate(self.blocks) if self.body[b] and not bad[x[0]]] or [x for x in self.blocks if not bad[x[0]] and x[2] < len(x[1])]
        if not body:
            return None
        own, total = [0] * len(bad), 0
        for c, line, link, _ in body:
            own[c] += len(line) - link
            total += len(line) - link
        for c in range(len(bad) - 1, 0, -1):
            own[self.parent[c]] += own[c]
        stories = [c for c in range(1, len(bad)) if self.tag[c] in ("article", "main") and not bad[c] and own[c]]
        best = max(stories, key=lambda c: (own[c], c), default=None)
        if best is not None and 2 * own[best] >= total:
            return best
        at = body[0][0]
        while own[at] < total:
            at = self.parent[at]
        return at

    def roots(self, winners: frozenset[int] | None) -> int | None:
        """The article's container: the fullest one on a path that the host has chosen, or else the page's own."""
        own = [c for c in range(len(self.parent)) if self.path[c] in winners and self.chars[c] > self.links[c]] if winners else []
        return max(own, key=lambda c: (self.sentences[c], self.chars[c] - self.links[c], c), default=self.root)

    def kept(self, root: int | None, bad: list[bool]) -> list[str]:
        """The blocks below root that aren't chrome, and the headline where it stands before it."""
        if root is None:
            return []
        below = [False] * len(self.parent)
        below[root] = True
        for c in range(root + 1, len(below)):
            below[c] = below[self.parent[c]]
        lines, seen, heads = [], False, any(x[3] == "h1" and below[x[0]] and not bad[x[0]] for x in self.blocks)
        for c, line, link, tag in self.blocks:
            inside = below[c] and not bad[c]
            seen |= inside
            if inside or (tag == "h1" and not seen and not heads and not bad[c] and 2 * link <= len(line)):
                lines.append(line)
        return lines

    def votes(self) -> Iterator[tuple[int, bool, bool, int]]:
        """(path, whether for the article, whether chrome, hash of the text), each path once."""
        if self.root is None:
            return
        hashes = [0] * len(self.parent)
        for c, line, *_ in self.blocks:
            hashes[c] = crc32(line.encode("utf-8", "surrogatepass"), hashes[c])
        for c in range(len(hashes) - 1, 0, -1):
            hashes[self.parent[c]] = (hashes[self.parent[c]] * 1000003 + hashes[c]) & 0xFFFFFFFF
        yield self.path[self.root], True, False, hashes[self.root]
        bad, told = self.chrome(), {}
        above, c = set(), self.root
        while c >= 0:
            above.add(c)
            c = self.parent[c]
        for c in range(1, len(hashes)):
            if self.chars[c] and c not in above and self.tag[c] not in _CELLS and not bad[self.parent[c]]:
                told.setdefault(self.path[c], (bad[c], hashes[c]))
        for path, (is_bad, text) in told.items():
            yield path, False, is_bad, text


def extract(html: str | None, winners: list[int] | None = None, dropped: list[int] | None = None, kept: list[int] | None = None) -> str:
    """The main text with the host's article paths and the paths that it agrees to drop or keep.

    If agreement leaves nothing of a page, the page decides alone.
    """
    page = Page(html or "")
    agreed = dict.fromkeys(kept or [], False) | dict.fromkeys(dropped or [], True)
    root = page.roots(frozenset(winners or ()))
    lines = page.kept(root, page.chrome(agreed)) if winners or agreed else []
    return "\n".join(lines or page.kept(page.root, page.chrome()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(h, _signed(p), r, bad, t) for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) for p, r, bad, t in Page(page or "").votes()]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "path", "article", "chrome", "text"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("html", "winners", "dropped", "kept")]
        texts = [extract(h, *([x & (1 << 64) - 1 for x in p or []] for p in paths)) for h, *paths in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_choices(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, winners, dropped, kept): the paths, as hashes, on which pages of a host agree.

    winners are article paths with at least WIN of the votes of the leading one. A path is dropped or kept
    if at least PAGES pages have it and AGREED of them say so; also dropped is one whose text is the same on
    so many pages, if the host's articles aren't all alike. Hosts with fewer pages choose nothing.
    """
    votes = map_batches(pages.select("host", "html"), _votes, "host string, path long, article boolean, chrome boolean, text long")
    alike = votes.groupBy("host", "path", "article", "text").agg(F.count("*").alias("n"), F.count_if("chrome").alias("bad"))
    paths = cut(alike.groupBy("host", "path", "article").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("n").alias("same")).where(F.col("n") >= PAGES), "votes")
    lead = paths.where("article").groupBy("host").agg(F.max("n").alias("lead"), (F.sum("same") < AGREED * F.sum("n")).alias("vary"))
    repeated = F.col("vary") & (F.col("same") >= AGREED * F.col("n"))
    said = F.when(F.col("article"), F.when(F.col("n") >= WIN * F.col("lead"), 0)).when((F.col("bad") >= AGREED * F.col("n")) | repeated, 1).when(F.col("n") - F.col("bad") >= AGREED * F.col("n"), 2)
    chosen = paths.join(lead, "host").select("host", "path", said.alias("said")).where("said IS NOT NULL")
    return chosen.groupBy("host").agg(*(F.collect_list(F.when(F.col("said") == i, F.col("path"))).alias(c) for i, c in enumerate(("winners", "dropped", "kept"))))


def main_text(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text), a row for each input row.

    A null html is empty and gives an empty text; a null url belongs to the host ''. Blocks follow page
    order, white space inside one is one space, and none is dropped or cut but for page chrome. Of
    a host's article paths the one with most sentences on a page holds, then the later one. An h1 before the
    article's container is its headline. Repeated rows give repeated rows; other columns are ignored; no
    rows give no rows. The choices are read back as a table, so Spark knows their size and broadcasts them
    only if they are small.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    choices = cut(host_choices(rows), "choices").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return map_batches(rows.join(choices, ["host", "salt"], "left").select("page_id", "url", "html", "winners", "dropped", "kept"), _texts, "page_id long, url string, text string")


def op6_consensus_paths(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
