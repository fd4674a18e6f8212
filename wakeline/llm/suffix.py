"""Removal of long repeated byte strings, by suffix arrays built through Lyndon-prefix grouping.

A string of LENGTH bytes contains LENGTH - GRAM + 1 grams of GRAM bytes; the one with the least hash is
its anchor, so equal strings have equal anchors. Texts choose their anchors by themselves. Anchors whose
gram occurs once can't lie in a repeated string. The others are grouped by gram: where a whole context
occurs twice, all of it is repeated; contexts that differ are cut into cells, a suffix array over the
cells of many groups puts each next to its closest relatives, and those tell how far it is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, map_batches

LENGTH, GRAM = 400, 256
#: Bytes on either side of a gram that a string with that anchor may cover.
SIDE = LENGTH - GRAM
CELL = 16
_CELLS = SIDE // CELL
#: Contexts of a group up to which one task compares them; larger groups are split by what they share.
GROUP = 8192
#: Contexts of one suffix array, parts into which the begins of strings are cut to find hopeful contexts,
#: and texts of which a task remembers how often it has met them.
BATCH, PARTS, TEXTS = 3000, 36, 200_000
#: Contexts of which a task remembers whether it has handed them on twice.
ASKED = 1_000_000
#: Contexts of a larger group that all its others are compared with before it is split.
SOME = 64
#: Documents looked at for frequent grams, and the share of them that has one. This only decides how rows are
#: dealt, not what is found.
LOOKED, FREQUENT = 2000, 0.01
#: Begins of strings of a frequent gram that are compared together from the start.
STRIDE = 29
_BASE, _MIX = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of whole numbers >= 0, in linear time once the distinct numbers are in order.

    First every suffix is put into the group of its longest Lyndon prefix. Groups are visited in
    descending order; the previous smaller suffix of each member gets the group's prefix appended, as
    often as members point to it, and so moves up. Then the order inside the groups is emitted: a
    suffix that is placed lets those that end their Lyndon prefix where it begins take the next free
    places of their groups.
    """
    n = len(text)
    if not n:
        return []
    by_char: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_char.setdefault(c, []).append(i)
    group, previous = [0] * n, [-1] * n
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    begin_of = [0] * (n + 1)
    at = 0
    for c in sorted(by_char):
        own = by_char[c]
        for i in own:
            group[i] = at
        members[at], size[at] = own, len(own)
        begin_of[at + len(own)] = at
        at += len(own)
    end = n
    while end:
        g = begin_of[end]
        end = g
        times: dict[int, int] = {}
        for i in members.pop(g):
            if group[i] != g:
                continue
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # dealt by count, then by group: counting, as the counts add up to the members
        by_count: list[list[int]] = [[] for _ in range(max(times.values(), default=0) + 1)]
        for p, k in times.items():
            by_count[k].append(p)
        moved: dict[int, list[list[int]]] = {}
        for own in by_count:
            new: dict[int, list[int]] = {}
            for p in own:
                new.setdefault(group[p], []).append(p)
            for h, list_ in new.items():
                moved.setdefault(h, []).append(list_)
        for h, lists in moved.items():
            a = h + size[h] - sum(map(len, lists))
            size[h] = a - h
            if a > h:
                begin_of[a] = h
            for new_group in lists:
                for p in new_group:
                    group[p] = a
                members[a], size[a] = new_group, len(new_group)
                begin_of[a + len(new_group)] = a
                a += len(new_group)
    out, free, placed = [0] * n, {}, bytearray(n)
    i = n - 1
    for k in range(-1, n):
        if k >= 0:
            i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            at = free.get(g, g)
            out[at] = i
            free[g] = at + 1
            placed[i] = 1
            i = previous[i]
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of `gram` bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    k, power = 1, _BASE
    while k < gram:
        h = h[:-k] * np.uint64(power) + h[k:]
        power, k = power * power % (1 << 64), 2 * k
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the least of some LENGTH bytes (ties: all of them)."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    least = _extreme(h, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    most = _extreme(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def context(raw: bytes, p: int) -> tuple[bytes, bytes]:
    """Up to SIDE bytes before and after the gram at p."""
    return raw[max(0, p - SIDE) : p], raw[p + GRAM : p + LENGTH]


def _occurrences(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, around, n, text, sure, hot): each text's distinct anchors with the hash of their context.

    A third copy of a text adds nothing, so a task hands on two at most. An anchor whose context the task has
    handed on twice is surely repeated; it need not ask. hot: the gram is a frequent one.
    """
    copies: dict[bytes, int] = {}
    asked: dict[int, int] = {}
    for b in batches:
        if len(copies) > TEXTS:
            copies.clear()
        if len(asked) > ASKED:
            asked.clear()
        grams, around, texts, n, sure = [], [], [], [], []
        for text in b.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            own = hashlib.md5(raw).digest()
            copies[own] = copies.get(own, 0) + 1
            at, h = anchors(raw) if copies[own] < 3 else ([], [])
            if not len(at):
                continue
            ctx = np.array([hash_of(raw, p) for p in at.tolist()], np.uint64)
            pairs, counts = np.unique(np.stack([h, ctx], 1), axis=0, return_counts=True)
            # the context's own hash tells contexts apart, the gram's is added for other grams around it
            keys = (pairs[:, 0] * _MIX ^ pairs[:, 1]).tolist()
            before = [asked.get(k, 0) for k in keys]
            asked.update(zip(keys, (x + 1 for x in before), strict=True))
            grams.append(pairs[:, 0])
            around.append(pairs[:, 1])
            n.append(counts)
            sure.append(np.array(before) > 1)
            texts += [own] * len(pairs)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(cat(grams, np.uint64).view(np.int64)), pa.array(cat(around, np.uint64).view(np.int64)), pa.array(np.minimum(cat(n, np.int64), 2).astype(np.int32)), pa.array(texts, pa.binary()), pa.array(cat(sure, bool)), pa.array(np.isin(cat(grams, np.uint64), frequent))], ["gram", "around", "n", "text", "sure", "hot"])


def hash_of(raw: bytes, p: int) -> int:
    left, right = context(raw, p)
    return int.from_bytes(hashlib.blake2b(left + b"\xff" + right, digest_size=8).digest(), "little")


_CLASS = "text binary, gram long, around long, solid boolean, ship boolean"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram and context -> those that may be repeated; those that surely are pass as they come.

    Contexts of a hot gram are dealt to several tasks, so it counts as having others everywhere.

    solid: the context occurs at least twice, so all of it is repeated. ship: the first row of a context
    whose gram has other contexts as well; one of equal contexts is enough to compare with.
    """
    names = ["gram", "around", "n", "hot"]
    held = None  # at most two rows of the gram that may go on

    def flags(t: pa.Table) -> tuple[np.ndarray, ...]:
        gram, around, n, hot = (t.column(c).to_numpy() for c in names)
        new_gram = np.concatenate([[True], np.diff(gram) != 0])
        new = new_gram | np.concatenate([[True], np.diff(around) != 0])
        which, of = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        total, kinds = np.bincount(which, n)[which], np.bincount(of[new])[of] + hot
        return new, total, kinds, np.flatnonzero(new_gram)[-1], np.flatnonzero(new)[-1]

    def put(t: pa.Table, keep: np.ndarray, solid: np.ndarray, ship: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep &= (solid | ship) & ~t.column("told").to_numpy()
        out = t.select(["text", "gram", "around"]).append_column("solid", pa.array(solid)).append_column("ship", pa.array(ship))
        yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    for b in batches:
        told = b.filter(b.column("sure"))
        if len(told):
            flag = lambda x: pa.array(np.full(len(told), x))
            yield pa.RecordBatch.from_arrays([*(told.column(c) for c in ("text", "gram", "around")), flag(True), flag(False)], ["text", "gram", "around", "solid", "ship"])
            b = b.filter(pc.invert(b.column("sure")))
        b = b.drop_columns(["sure"])
        if not len(b):
            continue
        t = pa.Table.from_batches([b]).append_column("told", pa.array(np.zeros(len(b), bool)))
        t = pa.concat_tables([held, t]) if held is not None else t
        new, total, kinds, begin, last = flags(t)
        # of the last gram, a first context that is alone may yet ship, and a last one met once may yet be solid
        wait = begin if begin == last else last if total[last] < 2 else -1
        keep = np.arange(len(t)) != wait
        yield from put(t, keep, total >= 2, new & (kinds > 1))
        told = t.column("told").to_numpy()
        rows = [begin] if begin == last else [begin, last]
        some = t.take(pa.array(rows)).drop_columns(["n", "told"])
        some = some.append_column("n", pa.array(np.minimum(total[rows], 2).astype(np.int32))).append_column("told", pa.array([bool(told[r] or r != wait) for r in rows]))
        held = some.select(t.column_names).combine_chunks()
    if held is not None:
        new, total, kinds, *_ = flags(held)
        yield from put(held, np.ones(len(held), bool), total >= 2, new & (kinds > 1))


_FOUND = "doc_id long, text string, id binary, starts array<int>, ends array<int>, grams array<long>, at array<int>, lefts array<binary>, rights array<binary>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with what is known of their anchors -> solid stretches, and the contexts to compare."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
    schema = pa.schema(list(zip(["doc_id", "text", "id", "starts", "ends", "grams", "at", "lefts", "rights"], kinds, strict=True)))
    out, size, before = [], 0, None
    for r in _rows(batches):
        if before and before["id"] == r["id"]:  # copies follow each other; the first has told all
            out.append(before | {"doc_id": r["doc_id"], "grams": [], "at": [], "lefts": [], "rights": []})
            size += len(r["text"])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
            continue
        raw = (r["text"] or "").encode("utf-8", "surrogatepass")
        row = before = {"doc_id": r["doc_id"], "text": r["text"], "id": r["id"], "starts": [], "ends": [], "grams": [], "at": [], "lefts": [], "rights": []}
        known: dict[tuple[int, int], tuple[bool, bool]] = {}
        for k in r["known"]:  # equal texts have a row each; one of them ships
            key = k["gram"], k["around"]
            before_ = known.get(key, (False, False))
            known[key] = k["solid"] or before_[0], k["ship"] or before_[1]
        at, h = anchors(raw)
        some = np.isin(h.view(np.int64), np.array([g for g, _ in known], np.int64))
        shipped = set()
        for p, g in zip(at[some].tolist(), h[some].view(np.int64).tolist(), strict=True):
            key = (g, int(np.uint64(hash_of(raw, p)).view(np.int64)))
            solid, ship = known.get(key, (False, False))
            left, right = context(raw, p) if solid or ship else (b"", b"")
            if solid and len(left) + len(right) >= SIDE:
                row["starts"].append(p - len(left))
                row["ends"].append(p + GRAM + len(right))
            if ship and key not in shipped:
                shipped.add(key)
                row["grams"].append(g)
                row["at"].append(p)
                row["lefts"].append(left)
                row["rights"].append(right)
        out.append(row)
        size += len(raw) + 2 * SIDE * len(row["at"])
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows a few at a time, as Python values take much more room than Arrow's."""
    for b in batches:
        for i in range(0, len(b), 32):
            yield from b.slice(i, 32).to_pylist()


class _Contexts:
    """Contexts of whole groups: bytes plus one, zero where the text has ended."""

    def __init__(self, group: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> None:
        self.group, n = group, len(lefts)
        self.left, self.right = np.zeros((n, SIDE), np.uint8), np.zeros((n, SIDE), np.uint8)
        for i, (a, b) in enumerate(zip(lefts, rights, strict=True)):
            if a:
                self.left[i, SIDE - len(a) :] = np.frombuffer(a, np.uint8) + 1
            self.right[i, : len(b)] = np.frombuffer(b, np.uint8) + 1
        self.has_left, self.has_right = np.array([len(a) for a in lefts]), np.array([len(b) for b in rights])
        #: +1 and -1 where a stretch of repeated strings begins and ends; a string begins a bytes before the gram
        self.marks = np.zeros((n, SIDE + 2), np.int32)

    @property
    def repeated(self) -> np.ndarray:
        return np.cumsum(self.marks, 1)[:, :-1] > 0

    def extents(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the pairs agree before and after the gram."""
        l = (self.left[i] == self.left[j])[:, ::-1]  # noqa: E741
        r = self.right[i] == self.right[j]
        run = lambda m: np.where(m.all(1), SIDE, m.argmin(1))
        return np.minimum(run(l), np.minimum(self.has_left[i], self.has_left[j])), np.minimum(run(r), np.minimum(self.has_right[i], self.has_right[j]))

    def mark(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.extents(i, j)
        good = left + right >= SIDE
        for x in (i[good], j[good]):
            np.add.at(self.marks, (x, SIDE - right[good]), 1)
            np.add.at(self.marks, (x, left[good] + 1), -1)
        return left, right

    def _tokens(self, cell: int) -> np.ndarray:
        """Cells of each context in order, the group's own token in the middle, a separator at the end."""
        n, k = len(self.left), SIDE // cell
        cells = np.concatenate([self.left.reshape(n * k, cell), self.right.reshape(n * k, cell)])
        rank = np.unique(np.ascontiguousarray(cells).view(f"S{cell}").ravel(), return_inverse=True)[1] + 1 if cell > 1 else cells.ravel().astype(np.int64) + 1
        rank = rank.reshape(2, n, k)
        middle = int(rank.max()) + 1 + self.group
        return np.concatenate([rank[0], middle[:, None], rank[1], np.zeros((n, 1), np.int64)], 1)

    def neighbours(self, cell: int) -> np.ndarray:
        """Marks what neighbours in the suffix array share; best[i, c]: the farthest reach after the gram
        of any context that agrees with i in at least c cells before it, else -1."""
        tokens = self._tokens(cell)
        k, width = SIDE // cell, tokens.shape[1]
        order = np.array(suffix_array(tokens.ravel().tolist()), np.int64)
        row, col = order // width, order % width
        best = np.full((len(tokens), k + 1), -1, np.int64)
        pair = (self.group[row[1:]] == self.group[row[:-1]]) & (col[1:] == col[:-1]) & (col[1:] <= k) & (row[1:] != row[:-1])
        at = np.flatnonzero(pair)
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            i, j, c = row[part], row[part + 1], k - col[part]
            left, right = self.mark(i, j)
            good = left >= cell * c
            for x in (i, j):
                np.maximum.at(best, (x[good], c[good]), right[good])
        return best

    def solve(self) -> None:
        """Finds all strings around the gram that another context of the group has too."""
        keep = self._hopeful()
        if keep.all():
            self._solve()
        elif keep.any():
            part = self._part(keep)
            part._solve()
            self.marks[keep] = part.marks

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """For each number of bytes before and after the gram, a hash of those bytes."""
        weight = np.random.default_rng(0).integers(1 << 62, size=2 * SIDE, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        zero = np.zeros((len(self.left), 1), np.uint64)
        left = np.cumsum(self.left[:, ::-1] * weight[:SIDE], 1, dtype=np.uint64)
        right = np.cumsum(self.right * weight[SIDE:], 1, dtype=np.uint64)
        return np.concatenate([zero, left], 1), np.concatenate([zero, right], 1) * _MIX

    def _hopeful(self) -> np.ndarray:
        """Contexts that share the bytes which all strings of some part of the begins cover."""
        left, right = self._sums()
        own = self.group.astype(np.uint64) * _MIX
        out = np.zeros(len(self.left), bool)
        for k in range(PARTS):
            lo, hi = SIDE * k // PARTS, SIDE * (k + 1) // PARTS
            h = (left[:, lo] + own) ^ right[:, SIDE - hi]
            order = np.argsort(h, kind="stable")
            same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
            out[order[same]] = out[order[same + 1]] = True
        return out

    def _solve(self) -> None:
        best = self.neighbours(CELL)
        a = np.arange(SIDE + 1)
        open_ = (best[:, a // CELL] >= SIDE - a) & ~self.repeated & (a <= self.has_left[:, None]) & (SIDE - a <= self.has_right[:, None])
        if not open_.any():
            return
        # where a cell's edge hides a begin, contexts with equal hashes of just those bytes are compared
        left, right = self._sums()
        own = self.group.astype(np.uint64) * _MIX
        for k in np.flatnonzero(open_.any(0)).tolist():
            h = (left[:, k] + own) ^ right[:, SIDE - k]
            order = np.argsort(h, kind="stable")
            i, j = order[:-1], order[1:]
            pair = (h[i] == h[j]) & (self.group[i] == self.group[j]) & (open_[i, k] | open_[j, k])
            self.mark(i[pair], j[pair])

    def _part(self, rows) -> _Contexts:
        """Some of the contexts; for a slice, the marks are those of the whole."""
        part = _Contexts.__new__(_Contexts)
        for name in ("left", "right", "has_left", "has_right", "marks", "group"):
            setattr(part, name, getattr(self, name)[rows])
        return part


_GROUP = "gram long, lo int, hi int, sub long, id binary, at int, left binary, right binary"
_COVER = "id binary, start int, end int, " + _GROUP.replace("id binary, ", "of binary, ")


def _compare(limit: int):
    """Contexts sorted by group -> stretches (id, start, end), and the rows of larger groups as they are."""
    names = ["gram", "lo", "hi", "sub"]
    types = pa.schema([("id", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("gram", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("sub", pa.int64()), ("of", pa.binary()), ("at", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def key_of(t: pa.Table) -> tuple:
        return tuple(t.column(c)[0].as_py() for c in names)

    def stretches(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        arrays = [pa.array(c, types.field(i).type) for i, c in enumerate(cols)]
        return pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(rows), f.type) for f in list(types)[3:]], schema=types)

    def deferred(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches():
            own = [b.column(c) for c in ("gram", "lo", "hi", "sub", "id", "at", "left", "right")]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(b), types.field(i).type) for i in range(3)] + own, schema=types)

    def solved(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        group = np.repeat(np.arange(len(tables)), [len(x) for x in tables])
        found = _Contexts(group, t.column("left").to_pylist(), t.column("right").to_pylist())
        found.solve()
        yield told(t, found.repeated)

    def told(t: pa.Table, rep: np.ndarray) -> pa.RecordBatch:
        ids, at, rows = t.column("id").to_pylist(), t.column("at").to_pylist(), []
        for i in np.flatnonzero(rep.any(1)).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], rep[i], [0]])))
            rows += [(ids[i], at[i] - (b - 1), at[i] + LENGTH - a) for a, b in edge.reshape(-1, 2).tolist()]
        return stretches(rows)

    def split(t: pa.Table, found: _Contexts) -> Iterator[pa.RecordBatch]:
        """Of a larger group: what is repeated so far, and rows for the half of the begins where more may be.

        Where a string is known to be repeated, all that have it know, so only the others go on.
        """
        rep, a = found.repeated, np.arange(SIDE + 1)
        yield told(t, rep)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        maybe = ~rep & (a <= found.has_left[:, None]) & (SIDE - a <= found.has_right[:, None])
        mid = (lo + hi) // 2
        for x, y in ((lo, mid), (mid + 1, hi)):
            part = t.filter(pa.array(maybe[:, x : y + 1].any(1)))
            for name, v in (("lo", x), ("hi", y)):
                i = part.schema.get_field_index(name)
                part = part.set_column(i, name, pa.array(np.full(len(part), v, np.int32)))
            yield from deferred(part)

    class Large:
        """A group over the limit: SOME of its contexts meet all the others, part by part."""

        def __init__(self, t: pa.Table) -> None:
            pick = np.unique(np.linspace(0, len(t) - 1, SOME).astype(int))
            self.some, self.rest = t.take(pa.array(pick)), t.take(pa.array(np.setdiff1d(np.arange(len(t)), pick)))
            self.found = _Contexts(np.zeros(len(pick), int), self.some.column("left").to_pylist(), self.some.column("right").to_pylist())
            self.found.mark(*np.triu_indices(len(pick), 1))

        def meet(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
            k = len(self.some)
            both = pa.concat_tables([self.some, t])
            found = _Contexts(np.zeros(len(both), int), both.column("left").to_pylist(), both.column("right").to_pylist())
            for i in range(k):
                found.mark(np.full(len(t), i), np.arange(k, len(both)))
            self.found.marks += found.marks[:k]
            yield from split(t, found._part(slice(k, None)))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
        """Whole groups, or parts of one that is over the limit (True)."""
        held, over = None, False
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None and key_of(held) != key_of(t):
                yield held, over
                held, over = None, False
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = np.stack([t.column(c).to_numpy() for c in names], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            begin = [0, *cuts.tolist(), len(t)]
            for x, y in zip(begin[:-2], begin[1:-1], strict=True):
                yield t.slice(x, y - x), over
                over = False
            held = t.slice(begin[-2])
            if len(held) > limit:
                yield held.slice(0, len(held) - 1), True
                held, over = held.slice(len(held) - 1), True
        if held is not None:
            yield held, over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, large = [], 0, None
        for t, over in groups(batches):
            if large and key_of(large.some) != key_of(t):
                yield from split(large.some, large.found)
                large = None
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            if lo == hi:  # all of the group share the one string left
                if over or len(t) > 1:
                    yield stretches([(i, p - lo, p - lo + LENGTH) for i, p in zip(t.column("id").to_pylist(), t.column("at").to_pylist(), strict=True)])
            elif over:
                if not large:
                    large = Large(t)
                    t = large.rest
                if len(t):
                    yield from large.meet(t)
            elif len(t) > 1:
                waiting.append(t)
                n += len(t)
                if n >= BATCH:
                    yield from solved(waiting)
                    waiting, n = [], 0
        if large:
            yield from split(large.some, large.found)
        if waiting:
            yield from solved(waiting)

    return run


def _regrouped(rows: DataFrame) -> DataFrame:
    """Rows of larger groups for half the begins: all strings there share more bytes, which tell groups apart."""
    lo, rest = F.col("lo"), SIDE - F.col("hi")
    shared = F.xxhash64("gram", "sub", "lo", "hi", F.substring(F.col("left"), F.octet_length("left") - lo + 1, lo), F.substring(F.col("right"), F.lit(1), rest))
    return rows.select("gram", "lo", "hi", shared.alias("sub"), "id", "at", "left", "right")


def _covered(contexts: DataFrame, limit: int) -> DataFrame:
    """(id, start, end): stretches of the shipped contexts that other contexts have too."""
    rows = contexts
    out, key = None, ["gram", "lo", "hi", "sub"]
    while True:
        done = cut(map_batches(rows.repartition(*key).sortWithinPartitions(*key), _compare(limit), _COVER), "stretches")
        part = done.where("gram IS NULL").select("id", "start", "end")
        out = part if out is None else out.unionByName(part)
        more = done.where("gram IS NOT NULL")
        if more.isEmpty():
            return out
        rows = _regrouped(more.select("gram", "lo", "hi", "sub", F.col("of").alias("id"), "at", "left", "right"))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the union of the stretches from each text."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", span)])
    out, size, before = [], 0, (None, None)
    for r in _rows(batches):
        if before[0] != r["id"]:
            before = r["id"], _without(r)
        out.append({"doc_id": r["doc_id"]} | before[1])
        size += len(r["text"])
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _without(r: dict) -> dict:
    """What is left of one text, and its removed runs."""
    raw = (r["text"] or "").encode("utf-8", "surrogatepass")
    pairs = sorted([*zip(r["starts"], r["ends"], strict=True), *((c["start"], c["end"]) for c in r["more"] or [])])
    spans: list[list[int]] = []
    for a, e in pairs:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([a, e])
    keep, at = [], 0
    for a, e in spans:
        keep.append(raw[at:a])
        at = e
    keep.append(raw[at:])
    return {"n_bytes": len(raw), "n_removed": sum(e - a for a, e in spans), "n_spans": len(spans), "kept": b"".join(keep), "spans": [{"start": a, "end": e} for a, e in spans]}


def _frequent(rows: DataFrame, looked: int, share: float) -> list[int]:
    """Grams that stand in so many of about `looked` documents; few, as a document has few anchors."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [np.unique(anchors((t or "").encode("utf-8", "surrogatepass"))[1]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *every]).view(np.int64))], ["gram"])

    part = min(1.0, looked / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text")
    found = map_batches(few, grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, share * looked))
    return [r["gram"] for r in found.collect()]


def _begun(contexts: DataFrame, frequent: list[int]) -> DataFrame:
    """Contexts as groups to compare: all of a gram's, but those of a frequent gram by the bytes that strings share."""
    cols = ["gram", "id", "at", "left", "right"]
    spans = [(a, min(SIDE, a + STRIDE - 1)) for a in range(0, SIDE + 1, STRIDE)] if frequent else []
    hot = F.col("gram").isin(frequent) if frequent else F.lit(False)
    rare = contexts.where(~hot).select("gram", F.lit(0).alias("lo"), F.lit(SIDE).alias("hi"), F.lit(0).cast("long").alias("sub"), *cols[1:])
    if not spans:
        return rare
    part = F.explode(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in spans)))
    cut_ = contexts.where(hot).select(*cols, part.alias("p")).select(*cols, "p.*", F.lit(0).cast("long").alias("sub"))
    able = (F.octet_length("left") >= F.col("lo")) & (F.octet_length("right") >= SIDE - F.col("hi"))
    return rare.unionByName(_regrouped(cut_.where(able)))


def remove_repeats(docs: DataFrame, group: int = GROUP, looked: int = LOOKED, share: float = FREQUENT) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_removed, n_spans, kept binary, spans), a row for each input row.

    A byte goes if a string of LENGTH bytes that covers it begins anywhere else too, in this text or
    another; strings never cross texts. spans are the maximal removed runs as byte offsets. Texts are
    UTF-8, a null text is empty; equal texts of LENGTH bytes or more go whole. Repeated rows are two
    places. Other columns are ignored; no rows give no rows. Contexts are told apart by 64-bit hashes of
    their bytes, texts by MD5. A group of more than `group` contexts is never held by one task: it streams past
    some of its contexts, and what they leave open is split in halves by the bytes that strings must
    share, until it fits or one string is left, which all share.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = _frequent(rows, looked, share)
    hot = np.array(frequent, np.int64).view(np.uint64)
    places = map_batches(rows.select("text"), lambda batches: _occurrences(batches, hot), "gram long, around long, n int, text binary, sure boolean, hot boolean")
    dealt = places.repartition(F.when(F.col("sure"), F.xxhash64("text")).when(F.col("hot"), F.xxhash64("gram", "around")).otherwise(F.col("gram")))
    known = map_batches(dealt.sortWithinPartitions("gram", "around"), _classify, _CLASS)
    # tasks that met copies of one text say the same of it, so a set holds each of its anchors but once or twice
    known = known.groupBy(F.col("text").alias("id")).agg(F.collect_set(F.struct("gram", "around", "solid", "ship")).alias("known"))
    known = cut(known, "anchors")
    tagged = rows.withColumn("id", F.unhex(F.md5(F.col("text").cast("binary"))))
    some = tagged.join(known, "id")
    none = tagged.join(known.select("id"), "id", "left_anti")
    found = cut(map_batches(some.select("doc_id", "text", "id", "known"), _gather, _FOUND), "texts")
    contexts = found.select("id", F.explode(F.arrays_zip("grams", "at", "lefts", "rights")).alias("c")).select("id", F.col("c.grams").alias("gram"), F.col("c.at").alias("at"), F.col("c.lefts").alias("left"), F.col("c.rights").alias("right"))
    more = _covered(_begun(contexts, frequent), group).distinct().groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    changed = map_batches(found.join(more, "id", "left").select("doc_id", "text", "id", "starts", "ends", "more"), _kept, _RESULT)
    zero = F.lit(0).cast("long")
    same = none.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return changed.unionByName(same)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
