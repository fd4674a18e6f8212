"""Hexagons on the sphere as columns: 64-bit cell ids of an aperture-7 grid on an icosahedron.

A point goes to the nearest of twenty faces, by gnomonic projection onto that face's plane, and to the nearest point
of a hexagonal lattice there, which is finer by the root of 7 with each resolution and turned at odd ones. Going up
from it, each step gives a digit (0 the middle, 1 to 6 the neighbours), and the last point is one of 122
base cells, of which the twelve at the icosahedron's corners are pentagons. A cell that two faces see gets one id:
the digits are turned into the frame of the base cell's home face. The id holds resolution, base cell and
digits, so a parent is its child's id cut short. Only base cells' home faces and the icosahedron's place are given;
all other tables are worked out from them here.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: face centres (latitude, longitude) and the azimuth from each centre to its first corner, in radians
FACE_CENTRES = [
    (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159),
    (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943), (0.172745327415618701, 1.678146885280433686),
    (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035),
    (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203),
    (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622),
    (-0.427370518328979641, 1.252716453253507838), (-0.600191595538186799, 2.690988744120037492),
    (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139),
    (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
]
FACE_AZIMUTHS = [
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400,
    2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535,
    2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
]
# fixed values: home faces of the base cells, which are numbered from north to south
HOME_FACES = [
    1, 2, 1, 2, 0, 1, 1, 2, 0, 2, 1, 1, 3, 3, 11, 4, 0, 6, 0, 2, 7, 2, 0, 6, 10, 6, 3, 11, 4, 3, 0, 4, 5, 0, 7, 11, 7, 10, 12, 6, 7,
    4, 3, 3, 4, 6, 11, 8, 5, 14, 5, 12, 10, 4, 12, 7, 11, 10, 13, 10, 11, 9, 8, 6, 8, 9, 14, 5, 16, 8, 5, 12, 7, 12, 10, 9, 13, 16, 15, 15, 16,
    14, 13, 5, 8, 14, 9, 14, 17, 12, 16, 17, 15, 16, 9, 15, 13, 8, 13, 17, 19, 14, 19, 17, 13, 17, 16, 9, 15, 15, 18, 18, 19, 17, 19, 18, 18, 19, 19, 18, 19, 18,
]
#: Distance of neighbouring base cells on a face's plane, and the turn of the lattice at odd resolutions.
UNIT, TURN = 0.38196601125010500003, math.asin(math.sqrt(3.0 / 28.0))
#: Steps of the digits on the axes i and j (at 0 and 120 degrees), and the digits from 0 degrees on, counter-clockwise.
STEPS = [(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)]
AROUND = [4, 6, 2, 3, 1, 5]
_K, _DIGITS = 1, 15
_PARENT_OF = {True: ((3, -1), (1, 2)), False: ((2, 1), (-1, 3))}
_CENTRE_OF = {True: ((2, 1), (-1, 3)), False: ((3, -1), (1, 2))}


def _turned(a: int, b: int, times: int) -> tuple[int, int]:
    """60 degrees counter-clockwise, so often."""
    for _ in range(times % 6):
        a, b = a - b, a
    return a, b


def _digit_turned(d: int, times: int) -> int:
    return AROUND[(AROUND.index(d) + times) % 6] if d else 0


def _frame(face: int) -> tuple[list[float], list[float], list[float]]:
    """The face's normal and the directions of its plane: to the first corner, and a right angle on from it."""
    (la, lo), az = FACE_CENTRES[face], FACE_AZIMUTHS[face]
    n = [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]
    north, east = [-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)], [-math.sin(lo), math.cos(lo), 0.0]
    e = [math.cos(az) * x + math.sin(az) * y for x, y in zip(north, east, strict=True)]
    return n, e, [n[1] * e[2] - n[2] * e[1], n[2] * e[0] - n[0] * e[2], n[0] * e[1] - n[1] * e[0]]


def _on_sphere(face: int, a: int, b: int) -> list[float]:
    n, e, g = _frame(face)
    x, y = (a - b / 2) * UNIT, b * math.sqrt(3) / 2 * UNIT
    v = [p + x * q + y * r for p, q, r in zip(n, e, g, strict=True)]
    size = math.hypot(*v)
    return [c / size for c in v]


def _dot(u, v) -> float:
    return sum(x * y for x, y in zip(u, v, strict=True))


_CORNERS = ((2, 0), (0, 2), (-2, -2))
#: A face's edges by the corners at their ends; how far a point is beyond each, in halves of the lattice's unit.
_EDGES = ((0, 1), (1, 2), (2, 0))
_BEYOND = ((1, 1), (-2, 1), (1, -2))


@cache
def adjacency() -> list[list[tuple[int, int, int, int]]]:
    """For each face and edge: the face beyond, and the turn and shift that bring coordinates to its frame."""
    corner = [[_on_sphere(f, *c) for c in _CORNERS] for f in range(20)]
    out = []
    for f, edge in product(range(20), _EDGES):
        for g in range(20):
            same = [next((k for k in range(3) if _dot(corner[f][e], corner[g][k]) > 1 - 1e-9), None) for e in edge]
            if g != f and None not in same:
                there = [_CORNERS[k] for k in same]
                for m in range(6):
                    here = [_turned(*_CORNERS[e], m) for e in edge]
                    shift = {(t[0] - h[0], t[1] - h[1]) for t, h in zip(there, here, strict=True)}
                    if len(shift) == 1:
                        out.append((g, m, *shift.pop()))
    return [out[3 * f : 3 * f + 3] for f in range(20)]


def _own_face(face: int, a: int, b: int, size: int = 1) -> tuple[int, int, int, int]:
    """(face, a, b, turn) in the frame of a face that has the point; size is the lattice's fineness."""
    turn = 0
    for _ in range(3):
        beyond = [p * a + q * b - 2 * size for p, q in _BEYOND]
        if max(beyond) <= 0:
            break
        face, m, s, t = adjacency()[face][beyond.index(max(beyond))]
        (a, b), turn = _turned(a, b, m), turn + m
        a, b = a + s * size, b + t * size
    return face, a, b, turn % 6


@cache
def base_cells() -> list[tuple[int, int, int]]:
    """(home face, a, b) of each base cell, from north to south."""
    found: list[tuple[float, list[float], list[tuple[int, int, int]]]] = []
    for f, (a, b) in product(range(20), [*STEPS, *_CORNERS]):
        v = _on_sphere(f, a, b)
        same = next((x for x in found if _dot(x[1], v) > 1 - 1e-9), None)
        if same is None:
            found.append((v[2], v, [(f, a, b)]))
        else:
            same[2].append((f, a, b))
    found.sort(key=lambda x: -x[0])
    return [next(p for p in places if p[0] == home) for (_, _, places), home in zip(found, HOME_FACES, strict=True)]


@cache
def pentagons() -> dict[int, dict[int, tuple[int, int]]]:
    """Base cells at corners: for each face around, which of its corners that is, and steps counter-clockwise from home."""
    out = {}
    for base, (home, a, b) in enumerate(base_cells()):
        if (a, b) in _CORNERS:
            v = _on_sphere(home, a, b)
            corner = {f: k for f, k in product(range(20), range(3)) if _dot(_on_sphere(f, *_CORNERS[k]), v) > 1 - 1e-9}
            e = [x - _dot(_frame(home)[0], v) * y for x, y in zip(_frame(home)[0], v, strict=True)]
            g = [v[1] * e[2] - v[2] * e[1], v[2] * e[0] - v[0] * e[2], v[0] * e[1] - v[1] * e[0]]
            angle = lambda f: math.atan2(_dot(_frame(f)[0], g), _dot(_frame(f)[0], e)) % (2 * math.pi)  # noqa: B023, E731
            out[base] = {f: (corner[f], round(angle(f) / (2 * math.pi / 5)) % 5) for f in corner}
    return out


def _pentagon_turn(face: int, base: int, lead: int) -> int:
    """How far a pentagon's digits are turned, by the first that isn't 0: none of its cells may begin with K."""
    corner, steps = pentagons()[base][face]
    # the digit towards the face's middle in its own frame, and what home calls it
    local, ring = (3, 5, 6)[corner], [3, 5, 4, 6, 2]
    times, turn = (ring.index(ring[steps]) - ring.index(local)) % 5, 0
    if lead == _K:
        turn = -1 if corner == 1 else 1
    for _ in range(times):
        turn += 1
        if _digit_turned(lead, turn) == _K:
            turn += 1
    return turn % 6


@cache
def encoding() -> dict[tuple[int, int, int, int], tuple[int, list[int]]]:
    """(face, i, j, k) -> (base cell, turn of the digits by the first of them that isn't 0)."""
    number = {place: base for base, place in enumerate(base_cells())}
    out = {}
    for f, (i, j, k) in product(range(20), product(range(3), repeat=3)):
        if min(i, j, k) > 0:
            continue
        face, a, b, turn = _own_face(f, i - k, j - k)
        v = _on_sphere(face, a, b)
        base = next(n for n, place in enumerate(base_cells()) if _dot(_on_sphere(*place), v) > 1 - 1e-9)
        if base in pentagons():
            turns = [(turn + _pentagon_turn(face, base, _digit_turned(d, turn))) % 6 for d in range(7)]
        else:
            if (face, a, b) not in number:
                # on an edge, and at home beyond it
                face, a, b, m = next((g, *(x + y for x, y in zip(_turned(a, b, m), (s, t), strict=True)), m) for g, m, s, t in adjacency()[face] if g == HOME_FACES[base] and (g, *(x + y for x, y in zip(_turned(a, b, m), (s, t), strict=True))) in number)
                turn += m
            turns = [turn % 6] * 7
        out[f, i, j, k] = base, turns
    return out


@cache
def decoding() -> list[list[tuple[int, int, int, int]]]:
    """For each base cell and first digit: a face that sees those children whole, where the base cell is, turn of the digits."""
    out = []
    for base, (home, a, b) in enumerate(base_cells()):
        if base not in pentagons():
            out.append([(home, a, b, 0)] * 7)
            continue
        row = [(home, a, b, 0)]
        for lead in range(1, 7):
            ring = [3, 5, 4, 6, 2]
            steps = ring.index(lead) if lead in ring else 0
            face, corner = next((f, c) for f, (c, s) in pentagons()[base].items() if s == steps)
            local = (3, 5, 6)[corner]
            turn = _pentagon_turn(face, base, local)
            row.append((face, *_CORNERS[corner], turn))
        out.append(row)
    return out


# --- arrays: a place is (face, a, b), one array each

_FRAMES = [[x for part in _frame(f) for x in part] for f in range(20)]
_TURNED = [_digit_turned(d, t) for t in range(6) for d in range(7)]
_STEPS_TURNED = [STEPS[_digit_turned(d, t)] for t in range(6) for d in range(7)]
_RING = [(math.cos(math.radians(60 * k + 30)) / math.sqrt(3), math.sin(math.radians(60 * k + 30)) / math.sqrt(3)) for k in range(6)]
#: Corners of a cell from 30 degrees on, by 60, on the axes i and j.
_CORNER_STEPS = [(x + y / math.sqrt(3), 2 * y / math.sqrt(3)) for x, y in _RING]
Place = tuple[np.ndarray, np.ndarray, np.ndarray]


def _digit_of() -> list[int]:
    out = [0] * 9
    for d, (a, b) in enumerate(STEPS):
        out[(a + 1) * 3 + b + 1] = d
    return out


@cache
def _encode_rows() -> list[int]:
    """By face * 27 + i * 9 + j * 3 + k: base cell in 7 bits, and 3 for each turn; places that no face uses are 0."""
    rows = [0] * 540
    for (f, i, j, k), (base, turns) in encoding().items():
        rows[f * 27 + i * 9 + j * 3 + k] = base | sum(t << 7 + 3 * d for d, t in enumerate(turns))
    return rows


def encoded(place: Place, res: int) -> np.ndarray:
    """Ids of lattice points as a face that has them, or is next to one that has, sees them."""
    face, a, b = place
    code, lead = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    digits = np.array(_digit_of())
    for r in range(res, 0, -1):
        m, c = _PARENT_OF[r % 2 == 1], _CENTRE_OF[r % 2 == 1]
        up_a, up_b = (np.rint((p * a + q * b) / 7).astype(np.int64) for p, q in m)
        digit = digits[(a - c[0][0] * up_a - c[0][1] * up_b + 1) * 3 + b - c[1][0] * up_a - c[1][1] * up_b + 1]
        code, lead, a, b = code + (digit << 3 * (res - r)), np.where(digit > 0, digit, lead), up_a, up_b
    low = np.minimum(np.minimum(a, b), 0)
    row = np.array(_encode_rows())[face * 27 + (a - low) * 9 + (b - low) * 3 - low]
    turn, rest, turned = row >> 7 + 3 * lead & 7, 3 * (_DIGITS - res), np.array(_TURNED)
    out = ((1 << 59) | (res << 52) | ((1 << rest) - 1)) + ((row & 127) << 45)
    for k in range(res):
        out = out + (turned[turn * 7 + (code >> 3 * k & 7)] << rest + 3 * k)
    return out


def decoded(ids: np.ndarray, res: int) -> Place:
    """The lattice points in the frame of a face that has them."""
    digits = [ids >> 3 * (_DIGITS - r) & 7 for r in range(1, res + 1)]
    lead = np.zeros(len(ids), np.int64)
    for d in reversed(digits):
        lead = np.where(d > 0, d, lead)
    rows = np.array([(f, a, b, (-turn) % 6) for row in decoding() for f, a, b, turn in row])
    face, a, b, turn = rows[(ids >> 45 & 127) * 7 + lead].T
    steps = np.array(_STEPS_TURNED)
    for r, d in enumerate(digits, 1):
        m = _CENTRE_OF[r % 2 == 1]
        step = steps[turn * 7 + d]
        a, b = (p * a + q * b + step[:, k] for k, (p, q) in enumerate(m))
    return _own((face, a, b), res)


def _own(place: Place, res: int) -> Place:
    """Places in the frame of a face that has them; each step crosses the edge that they are farthest beyond."""
    face, a, b = place
    # where the lattice is turned, edges lie along that of the next resolution
    odd, size = res % 2 == 1, 7 ** ((res + 1) // 2)
    if odd:
        a, b = 3 * a - b, a + 2 * b
    near = np.array(adjacency()).reshape(60, 4)
    turns = np.array([(*_turned(1, 0, m), *_turned(0, 1, m)) for m in range(6)])
    for _ in range(3):
        far = np.stack([p * a + q * b for p, q in _BEYOND])
        edge = far.argmax(axis=0)
        out = far.max(axis=0) > size * (2 + 1e-9)
        if not out.any():
            break
        to, m, s, t = near[face * 3 + edge].T
        u = turns[m]
        face, a, b = np.where(out, to, face), np.where(out, u[:, 0] * a + u[:, 2] * b + s * size, a), np.where(out, u[:, 1] * a + u[:, 3] * b + t * size, b)
    if odd:
        a, b = 2 * a + b, 3 * b - a
        a, b = (a // 7, b // 7) if a.dtype.kind == "i" else (a / 7, b / 7)
    return face, a, b


def _degrees(place: Place, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of places on their faces' planes."""
    face, a, b = place
    x, y = a - b / 2, b * (math.sqrt(3) / 2)
    if res % 2:
        x, y = math.cos(TURN) * x - math.sin(TURN) * y, math.sin(TURN) * x + math.cos(TURN) * y
    scale = UNIT / math.sqrt(7) ** res
    frames = np.array(_FRAMES).reshape(20, 3, 3)[face]
    v = frames[:, 0] + (x * scale)[:, None] * frames[:, 1] + (y * scale)[:, None] * frames[:, 2]
    return np.degrees(np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1]))), np.degrees(np.arctan2(v[:, 1], v[:, 0]))


def cells_of(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """Ids of the cells of points in degrees, which must be finite."""
    la, lo = np.radians(lat), np.radians(lon)
    v = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
    frames = np.array(_FRAMES).reshape(20, 3, 3)
    dots = v @ frames[:, 0].T
    face = dots.argmax(axis=1)
    fine = math.sqrt(7) ** res / UNIT / dots.max(axis=1, initial=0.5)
    x, y = (np.einsum("ij,ij->i", v, frames[face, k]) * fine for k in (1, 2))
    if res % 2:
        x, y = math.cos(TURN) * x + math.sin(TURN) * y, math.cos(TURN) * y - math.sin(TURN) * x
    # of three coordinates that add up to 0, the one farthest off when rounded follows from the others
    three = np.stack([x - y / math.sqrt(3), y * (2 / math.sqrt(3)), -x - y / math.sqrt(3)])
    near = np.rint(three)
    worst = np.abs(near - three).argmax(axis=0)
    near[worst, np.arange(len(worst))] -= near.sum(axis=0)
    return encoded((face, (-near[2]).astype(np.int64), near[1].astype(np.int64)), res)


def neighbours_of(ids: np.ndarray, res: int) -> np.ndarray:
    """Six ids for each cell, counter-clockwise from 0 degrees on; one of a pentagon's is there twice, side by side."""
    face, a, b = decoded(ids, res)
    return np.stack([encoded(_own((face, a + STEPS[d][0], b + STEPS[d][1]), res), res) for d in AROUND], axis=1)


def sides_of(ids: np.ndarray, res: int) -> list[list[tuple[int, float, float]]]:
    """Each cell's sides, counter-clockwise: neighbour, and the corner (lat, lon) at the side's end."""
    face, a, b = decoded(ids, res)
    near = neighbours_of(ids, res)
    at = [_degrees(_own((face, a + x, b + y), res), res) for x, y in _CORNER_STEPS]
    lat, lon = (np.stack([p[k] for p in at], axis=1) for k in (0, 1))
    # of two directions with the same neighbour, the side goes on to the later one's end
    kept = near != np.roll(near, -1, axis=1)
    return [[(int(n), float(y), float(x)) for n, y, x, k in zip(*rows, strict=True) if k] for rows in zip(near, lat, lon, kept, strict=True)]


def disks_of(ids: np.ndarray, res: int, k: int) -> list[list[int]]:
    """The cells within k steps of each, itself first, by distance."""
    out = [[int(c)] for c in ids]
    ring = [[int(c)] for c in ids]
    for _ in range(k):
        flat = np.array([c for r in ring for c in r], np.int64)
        near, at = neighbours_of(flat, res).tolist() if len(flat) else [], 0
        for i, r in enumerate(ring):
            ring[i] = sorted({n for row in near[at : at + len(r)] for n in row}.difference(out[i]))
            at += len(r)
            out[i] += ring[i]
    return out


# --- columns


class HexSphere:
    """Cells of one resolution, 0 to 15. Ids are longs; null coordinates or cells give null.

    The functions work on batches of arrays: as Spark expressions, chains so long are either interpreted or compiled into
    methods too large for the virtual machine, and take 50 times as long.
    """

    def __init__(self, res: int) -> None:
        self.res = res

    def cell(self, lat: Column, lon: Column) -> Column:
        """The cell of each point, null where a coordinate is null or not finite."""
        res = self.res

        @F.pandas_udf("long")
        def cell(lat: pd.Series, lon: pd.Series) -> pd.Series:
            y, x = lat.to_numpy(float, na_value=np.nan), lon.to_numpy(float, na_value=np.nan)
            there = np.isfinite(y) & np.isfinite(x)
            return pd.Series(cells_of(np.where(there, y, 0.0), np.where(there, x, 0.0), res), dtype="Int64").where(there, pd.NA)

        return cell(lat.cast("double"), lon.cast("double"))

    def centre(self, cell: Column) -> Column:
        """struct<lat, lon>."""
        at = self._each(cell, lambda ids, res: [{"lat": y, "lon": x} for y, x in zip(*_degrees(decoded(ids, res), res), strict=True)], "array<struct<lat:double,lon:double>>", lambda x: [x])
        return F.element_at(at, 1)

    def corners(self, cell: Column) -> Column:
        """Six corners (five of a pentagon) as (lat, lon), counter-clockwise as seen from outside."""
        return F.transform(self.sides(cell), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")))

    def neighbours(self, cell: Column) -> Column:
        """Ids of the six cells around (five around a pentagon)."""
        return F.array_distinct(self._each(cell, lambda ids, res: neighbours_of(ids, res).tolist(), "array<long>"))

    def sides(self, cell: Column) -> Column:
        """Its sides, counter-clockwise: (neighbour, lat, lon), where the corner is the one at the side's end."""
        named = lambda row: [{"neighbour": n, "lat": y, "lon": x} for n, y, x in row]
        return self._each(cell, sides_of, "array<struct<neighbour:long,lat:double,lon:double>>", named)

    def disk(self, cell: Column, k: int = 1) -> Column:
        """The cells within k steps, this one first."""
        return self._each(cell, lambda ids, res: disks_of(ids, res, k), "array<long>")

    def parent(self, cell: Column, res: int) -> Column:
        """The cell of a coarser resolution that this one's digits begin with."""
        low = (1 << 3 * (_DIGITS - res)) - 1
        return cell.bitwiseAND(F.lit(~((15 << 52) | low))).bitwiseOR(F.lit((res << 52) | low))

    @staticmethod
    def name(cell: Column) -> Column:
        """The id as text, hexadecimal."""
        return F.lower(F.hex(cell))

    def _each(self, cell: Column, of, kind: str, row=None) -> Column:
        res = self.res

        # an array of one keeps a null apart from the numbers, which pandas would make fractions
        @F.pandas_udf(kind)
        def each(cells: pd.Series) -> pd.Series:
            ids = np.array([c[0] for c in cells], np.int64)
            found = of(ids, res)
            return pd.Series([row(x) for x in found] if row else list(found), dtype=object)

        return F.when(cell.isNotNull(), each(F.array(F.coalesce(cell, F.lit(self._any())))))

    def _any(self) -> int:
        """Some cell, worked on in place of null."""
        return int(cells_of(np.zeros(1), np.zeros(1), self.res)[0])
