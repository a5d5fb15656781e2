"""Geometry that has no closed form over columns: numpy inside Arrow pandas UDFs.

The overlap of two polygons fans every ring into signed triangles from one origin near the pair.
Triangles of both fans share that apex, so two of them overlap in an angular interval under the
nearer of two lines, whose area is one or two triangles: no polygon clipping library is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LINE_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
GEOMETRY_TYPE = T.ArrayType(T.ArrayType(LINE_TYPE))


def ring_array(ring) -> np.ndarray:
    """Vertices (n, 2) without a repeated closing vertex."""
    out = np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2)
    return out[:-1] if len(out) > 1 and (out[0] == out[-1]).all() else out


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def ring_area(r: np.ndarray) -> float:
    d = r - r[0] if len(r) else r
    return float(cross(d, np.roll(d, -1, axis=0)).sum() / 2)


def as_rings(geom) -> list[np.ndarray]:
    """All rings, outlines anticlockwise and holes clockwise."""
    out = []
    for polygon in geom if geom is not None else ():
        for k, ring in enumerate(polygon):
            r = ring if isinstance(ring, np.ndarray) and ring.ndim == 2 else ring_array(ring)
            if len(r) >= 3:
                out.append(r if (ring_area(r) > 0) == (k == 0) else r[::-1])
    return out


def unpacked(column: pa.Array) -> list[list[list[np.ndarray]] | None]:
    """Polygons of rings (n, 2) of every geometry of an Arrow column, cut from its flat vertices."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    polygons = column.flatten()
    rings = polygons.flatten()
    vertices = rings.flatten()
    xy = np.column_stack([vertices.field(0).to_numpy(zero_copy_only=False), vertices.field(1).to_numpy(zero_copy_only=False)]) if len(vertices) else np.zeros((0, 2))
    cuts = [np.append(0, np.cumsum([0 if n is None else n for n in pc.list_value_length(a).to_pylist()])).tolist() for a in (column, polygons, rings)]

    def open_ring(a: int, b: int) -> np.ndarray:
        r = xy[a:b]
        return r[:-1] if b - a > 1 and (r[0] == r[-1]).all() else r

    ring = [open_ring(a, b) for a, b in zip(cuts[2], cuts[2][1:], strict=False)]
    polygon = [ring[a:b] for a, b in zip(cuts[1], cuts[1][1:], strict=False)]
    return [polygon[a:b] if ok else None for a, b, ok in zip(cuts[0], cuts[0][1:], column.is_valid().to_pylist(), strict=False)]


def unpacked_lists(column: pa.Array) -> list[list]:
    """The geometries of every row of an Arrow column of arrays of geometries (null: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    geoms = unpacked(column.flatten())
    cuts = np.append(0, np.cumsum([0 if n is None else n for n in pc.list_value_length(column).to_pylist()])).tolist()
    return [geoms[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def as_arrow(rows: list, kind: T.DataType) -> pa.Array:
    """Plain Python rows as an Arrow column; rings of unlike length are no matter here."""
    return pa.array(rows, to_arrow_type(kind))


def fans(geoms: list, origins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anticlockwise triangles from each geometry's origin: both far corners, a sign, the geometry's place."""
    rings, owner, outer = [], [], []
    for i, geom in enumerate(geoms):
        for polygon in geom if geom is not None else ():
            for k, ring in enumerate(polygon):
                r = ring if isinstance(ring, np.ndarray) and ring.ndim == 2 else ring_array(ring)
                if len(r) >= 3:
                    rings.append(r)
                    owner.append(i)
                    outer.append(1.0 if k == 0 else -1.0)
    if not rings:
        return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0), np.zeros(0, np.int64)
    n = np.fromiter(map(len, rings), np.int64, len(rings))
    first, ring = np.cumsum(n) - n, np.repeat(np.arange(len(rings)), n)
    following = np.arange(len(ring)) + 1
    following[first + n - 1] = first
    place = np.array(owner)[ring]
    p = np.concatenate(rings) - origins[place]
    q = p[following]
    c = cross(p, q)
    sign = np.sign(c) * (np.sign(np.add.reduceat(c, first)) * np.array(outer))[ring]
    flip = (c < 0)[:, None]
    p, q = np.where(flip, q, p), np.where(flip, p, q)
    some = np.abs(c) > 1e-12
    return p[some], q[some], sign[some], place[some]


def overlaps(left: list, right: list, most: int = 1_000_000) -> np.ndarray:
    """Overlap areas of pairs of geometries; at most about ``most`` pairs of triangles at a time."""
    out = np.zeros(len(left))
    origins = np.array([next((np.asarray(r[0], float) if isinstance(r, np.ndarray) else ring_array(r)[0] for p in g for r in p if len(r)), np.zeros(2)) if g is not None else np.zeros(2) for g in left]).reshape(-1, 2) - np.array([0.37, 0.41])
    p, q, s, own = fans(left, origins)
    e, f, t, other = fans(right, origins)
    count = np.bincount(other, minlength=len(left))
    start = np.cumsum(count) - count
    todo = np.cumsum(count[own]) if len(own) else np.zeros(0, np.int64)
    at = 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + most, "right")))
        k = np.arange(at, end)
        times = count[own[k]]
        i = np.repeat(k, times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + start[own[i]]
        size, ok = wedge_overlap(p[i], q[i], e[j], f[j])
        i, j = i[ok], j[ok]
        out += np.bincount(own[i], weights=s[i] * t[j] * size, minlength=len(left))
        at = end
    return np.maximum(out, 0.0)


def wedge_overlap(p: np.ndarray, q: np.ndarray, e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlap of triangles (0, p, q) and (0, e, f) where their angles meet, and the mask of those."""
    inside = lambda v, a, b: (cross(a, v) >= 0) & (cross(v, b) >= 0)
    pe, qe = inside(p, e, f), inside(q, e, f)
    u, v = np.where(pe[:, None], p, e), np.where(qe[:, None], q, f)
    ok = (pe | inside(e, p, q)) & (qe | inside(f, p, q)) & (cross(u, v) > 0)
    p, q, e, f, u, v = p[ok], q[ok], e[ok], f[ok], u[ok], v[ok]
    reach = lambda ray, a, b: cross(a, b - a) / cross(ray, b - a)
    with np.errstate(divide="ignore", invalid="ignore"):
        u1, u2, v1, v2 = reach(u, p, q), reach(u, e, f), reach(v, p, q), reach(v, e, f)
        pu, pv = np.minimum(u1, u2)[:, None] * u, np.minimum(v1, v2)[:, None] * v
        d1, d2 = q - p, f - e
        meet = p + (cross(e - p, d2) / cross(d1, d2))[:, None] * d1
        bent = (cross(pu, meet) + cross(meet, pv)) / 2
    return np.nan_to_num(np.where((u1 <= u2) == (v1 <= v2), cross(pu, pv) / 2, bent)), ok


def overlap(a, b) -> float:
    """Overlap area of two geometries."""
    return float(overlaps([a], [b])[0])


def crossings(r: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The first pair of edges of a ring that properly cross, and where."""
    n = len(r)
    a, b = r, np.roll(r, -1, axis=0)
    for i in range(n - 2):
        j = np.arange(i + 2, n if i else n - 1)
        if not len(j):
            continue
        d, e = b[i] - a[i], b[j] - a[j]
        den = cross(d[None], e)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(a[j] - a[i], e) / den, cross(a[j] - a[i], d[None]) / den
        hit = np.flatnonzero((den != 0) & (t > 1e-12) & (t < 1 - 1e-12) & (u > 1e-12) & (u < 1 - 1e-12))
        if len(hit):
            k = hit[0]
            return i, int(j[k]), a[i] + t[k] * d
    return None


def untangle(r: np.ndarray) -> list[np.ndarray]:
    """Simple rings of a ring that crosses itself, cut at its crossings."""
    todo, out = [r], []
    while todo:
        r = todo.pop()
        if len(r) < 3:
            continue
        if (x := crossings(r)) is None:
            if abs(ring_area(r)) > 0:
                out.append(r)
        else:
            i, j, c = x
            todo += [np.vstack([c, r[i + 1 : j + 1]]), np.vstack([c, r[j + 1 :], r[: i + 1]])]
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) >= 2 and cross(out[-1] - out[-2], p - out[-2]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Least rotated rectangle: corners, short side, long side."""
    h = hull(points)
    if len(h) < 3:
        span = float(np.ptp(h, axis=0).max()) if len(h) else 0.0
        return h, 0.0, span
    best = None
    for d in np.roll(h, -1, axis=0) - h:
        d = d / np.hypot(*d)
        along, across = h @ d, h @ np.array([-d[1], d[0]])
        w, t = np.ptp(along), np.ptp(across)
        if best is None or w * t < best[0]:
            n = np.array([-d[1], d[0]])
            corners = np.array([along.min() * d + across.min() * n, along.max() * d + across.min() * n, along.max() * d + across.max() * n, along.min() * d + across.max() * n])
            best = (w * t, corners, min(w, t), max(w, t))
    return best[1], float(best[2]), float(best[3])


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with the end points kept."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = point_line(line[a + 1 : b], line[a], line[b])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def point_line(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to one segment."""
    d = b - a
    square = float(d @ d)
    t = np.clip((points - a) @ d / square, 0, 1) if square else np.zeros(len(points))
    return np.hypot(*(points - a - t[:, None] * d).T)


def hausdorff(a, b) -> float | None:
    """Greatest distance of a vertex of one outline to the other's edges, both ways."""
    ra, rb = as_rings(a), as_rings(b)
    if not ra or not rb:
        return None

    def one_way(x: list[np.ndarray], y: list[np.ndarray]) -> float:
        points = np.concatenate(x)
        return float(np.min([point_line(points, p, q) for r in y for p, q in zip(r, np.roll(r, -1, axis=0), strict=True)], axis=0).max())

    return max(one_way(ra, rb), one_way(rb, ra))


def half_plane(r: np.ndarray, a: np.ndarray, d: np.ndarray, side: float) -> np.ndarray:
    """The part of a ring on one side of the line through ``a`` along ``d``."""
    s = side * cross(d[None], r - a)
    out = []
    for p, q, x, y in zip(r, np.roll(r, -1, axis=0), s, np.roll(s, -1), strict=True):
        if x >= 0:
            out.append(p)
        if (x > 0 > y) or (x < 0 < y):
            out.append(p + (q - p) * (x / (x - y)))
    return np.array(out).reshape(-1, 2)


def plain(rings: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in polygon] for polygon in rings]


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(overlaps(unpacked(a), unpacked(b)), pa.float64())


@F.arrow_udf(T.BooleanType())
def is_valid(geom: pa.Array) -> pa.Array:
    """Whether every ring has three corners or more, an area, and no crossing edges."""
    ok = lambda r: len(r) >= 3 and ring_area(r) != 0 and crossings(r) is None
    return pa.array([g is not None and len(g) > 0 and all(ok(r) for p in g for r in p) for g in unpacked(geom)], pa.bool_())


@F.arrow_udf(T.BooleanType())
def meets_box(geom: pa.Array, box: pa.Array) -> pa.Array:
    """Whether a geometry and a box (another geometry) have a point in common, borders included."""
    out = []
    for g, b in zip(unpacked(geom), unpacked(box), strict=True):
        rings, frame = as_rings(g), as_rings(b)
        if not rings or not frame:
            out.append(False)
            continue
        corners = frame[0]
        low, high = corners.min(axis=0), corners.max(axis=0)
        points = np.concatenate(rings)
        found = bool(((points >= low) & (points <= high)).all(axis=1).any()) or bool(sum(within(corners[0], r) for r in rings) % 2)
        p, q = points, np.concatenate([np.roll(r, -1, axis=0) for r in rings])
        for s, t in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            if found:
                break
            turn = cross(q - p, (t - s)[None])
            with np.errstate(divide="ignore", invalid="ignore"):
                x, y = cross(s - p, (t - s)[None]) / turn, cross(s - p, q - p) / turn
            found = bool(((turn != 0) & (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)).any())
        out.append(found)
    return pa.array(out, pa.bool_())


@F.arrow_udf(GEOMETRY_TYPE)
def make_valid(geom: pa.Array) -> pa.Array:
    """Outlines cut at their crossings; holes stay with the part that holds their first corner."""

    def fix(g):
        if g is None:
            return None
        out = []
        for polygon in g:
            shells = [[s] for s in untangle(polygon[0])]
            for hole in (h for ring in polygon[1:] for h in untangle(ring)):
                for shell in shells:
                    if within(hole[0], shell[0]):
                        shell.append(hole)
                        break
            out += shells
        return plain(out)

    return as_arrow([fix(g) for g in unpacked(geom)], GEOMETRY_TYPE)


def within(p: np.ndarray, r: np.ndarray) -> bool:
    a, b = r, np.roll(r, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((((a[:, 1] > p[1]) != (b[:, 1] > p[1])) & (p[0] < x)).sum() % 2)


RECTANGLE_TYPE = T.StructType([T.StructField("rect", GEOMETRY_TYPE), *(T.StructField(c, T.DoubleType()) for c in ("short_m", "long_m", "share"))])


@F.arrow_udf(RECTANGLE_TYPE)
def rotated_rectangle(geom: pa.Array) -> pa.Array:
    """Least rotated rectangle of the outlines and the share of it that the geometry fills."""
    rows = []
    for g in unpacked(geom):
        rings = as_rings(g)
        if not rings:
            rows.append({"rect": None, "short_m": None, "long_m": None, "share": None})
            continue
        corners, short, long = rectangle(np.concatenate(rings))
        rows.append({"rect": plain([[corners]]), "short_m": short, "long_m": long, "share": sum(map(ring_area, rings)) / (short * long) if short * long else 0.0})
    return as_arrow(rows, RECTANGLE_TYPE)


#: Share of its least rectangle above which a roof is drawn as that rectangle (fixed value).
RECTANGULAR = 0.82


def squared(geom: Column, rectangle_of: Column) -> Column:
    """The geometry, or its least rotated rectangle (a struct of :func:`rotated_rectangle`) where it nearly fills it."""
    return F.when(F.round(rectangle_of["share"], 9) >= RECTANGULAR, rectangle_of["rect"]).otherwise(geom)


@F.arrow_udf(T.DoubleType())
def solidity(geom: pa.Array) -> pa.Array:
    """Area over the area of the convex hull."""
    rings = [as_rings(g) for g in unpacked(geom)]
    return pa.array([sum(map(ring_area, r)) / ring_area(hull(np.concatenate(r))) if r else None for r in rings], pa.float64())


@F.arrow_udf(T.DoubleType())
def boundary_offset(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([hausdorff(x, y) for x, y in zip(unpacked(a), unpacked(b), strict=True)], pa.float64())


@F.pandas_udf(LINE_TYPE)
def simplify_line(line: pd.Series, tolerance: pd.Series) -> pd.Series:
    as_array = lambda v: np.array([(p["x"], p["y"]) for p in v], float).reshape(-1, 2)
    return pd.Series([None if v is None else plain([[simplified(as_array(v), t)]])[0][0] if len(v) > 2 else list(v) for v, t in zip(line, tolerance, strict=True)], dtype=object)


def lengthened(line: np.ndarray, by: float) -> np.ndarray:
    """A polyline whose two ends reach farther by so much."""
    out = line.astype(float).copy()
    for end, before in ((0, 1), (-1, -2)):
        d = line[end] - line[before]
        out[end] = line[end] + d * (by / max(float(np.hypot(*d)), 1e-9))
    return out


def met(rings: list[np.ndarray], line: np.ndarray) -> tuple[list[list[tuple]], list[tuple]]:
    """Rings with their crossing points inserted, and the crossings (place along the line, point) in order."""
    found, out = {}, []
    for r in rings:
        new: list[tuple] = []
        for p, q in zip(r, np.roll(r, -1, axis=0), strict=True):
            here = [(0.0, tuple(np.round(p, 6).tolist()))]
            for i, (a, b) in enumerate(zip(line, line[1:], strict=False)):
                d, e = b - a, q - p
                turn = float(cross(d, e))
                if turn == 0:
                    continue
                s, t = float(cross(p - a, e)) / turn, float(cross(p - a, d)) / turn
                if -1e-9 <= s <= 1 + 1e-9 and -1e-9 <= t <= 1 + 1e-9:
                    point = tuple(np.round(p + t * e, 6).tolist())
                    here.append((t, point))
                    found.setdefault(point, i + s)
            new += [x for _, x in sorted(here)]
        out.append([x for x, y in zip(new, [*new[1:], new[0]], strict=True) if x != y])
    return out, sorted((s, x) for x, s in found.items())


def inner_paths(rings: list[np.ndarray], line: np.ndarray, crossings: list[tuple]) -> list[list[tuple]]:
    """The parts of the line that run inside from one crossing to the next."""
    out = []
    for (s, a), (t, b) in zip(crossings, crossings[1:], strict=False):
        path = [a, *(tuple(np.round(line[k], 6).tolist()) for k in range(int(s) + 1, int(np.ceil(t)))), b]
        path = [x for x, y in zip(path, [None, *path], strict=False) if x != y]
        if len(path) > 1:
            middle = (np.array(path[0]) + np.array(path[1])) / 2
            if sum(within(middle, r) for r in rings) % 2:
                out.append(path)
    return out


def faces(rings: list[list[tuple]], paths: list[list[tuple]]) -> list[np.ndarray]:
    """Closed walks with the inside on their left: over rings in their sense and over paths both ways."""
    after: dict[tuple, set] = {}
    for ring in rings:
        for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
            after.setdefault(p, set()).add(q)
    for path in paths:
        for p, q in zip(path, path[1:], strict=False):
            after.setdefault(p, set()).add(q)
            after.setdefault(q, set()).add(p)
    angle = lambda p, q: float(np.arctan2(q[1] - p[1], q[0] - p[0]))
    unused, out = {(p, q) for p, qs in after.items() for q in qs}, []
    while unused:
        first = step = min(unused)
        walk = []
        while step in unused:
            unused.discard(step)
            walk.append(step[0])
            p, q = step
            back = angle(q, p)
            # the next edge clockwise from the way back
            step = (q, min(after[q], key=lambda x: (back - angle(q, x)) % (2 * np.pi) or 2 * np.pi))
        if step == first:
            out.append(np.array(walk))
    return out


def cut_polygon(polygon: list[np.ndarray], line: np.ndarray) -> list[list[np.ndarray]]:
    """Pieces (outline and holes) of one polygon along a polyline; one piece if the line does not cross it."""
    rings, crossings = met(polygon, line)
    walked = faces(rings, inner_paths(polygon, line, crossings))
    outlines, holes = [w for w in walked if ring_area(w) > 1e-9], [w for w in walked if ring_area(w) < -1e-9]
    pieces = [[o] for o in outlines]
    for h in holes:
        inside = [x for x in pieces if within(h[0], x[0])]
        if inside:
            min(inside, key=lambda x: ring_area(x[0])).append(h)
    return pieces


PIECES_TYPE = T.ArrayType(T.StructType([T.StructField("geom", GEOMETRY_TYPE), T.StructField("area", T.DoubleType())]))


@F.arrow_udf(PIECES_TYPE)
def split_by_line(geom: pa.Array, line: pa.Array) -> pa.Array:
    """Pieces of a geometry along a polyline, greatest first; holes and separate sides are kept apart.

    The line reaches 5 m past both its ends.  Pieces of at most 0.5 square metres are left out; a
    line that misses, or ends inside, gives one piece.
    """
    rows = []
    for g, v in zip(unpacked(geom), line.to_pylist(), strict=True):
        if g is None or v is None or len(v) < 2:
            rows.append([])
            continue
        way = lengthened(np.array([(p["x"], p["y"]) for p in v], float), 5.0)
        pieces = [x for polygon in g if (rings := as_rings([polygon])) for x in cut_polygon(rings, way)]
        sized = sorted(((sum(map(ring_area, x)), x) for x in pieces), key=lambda x: (-x[0], tuple(x[1][0].min(axis=0))))
        rows.append([{"geom": plain([x]), "area": float(s)} for s, x in sized if s > 0.5])
    return as_arrow(rows, PIECES_TYPE)


def left_over(box: tuple[float, float, float, float], others: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float, float, float]]]:
    """The connected parts of a box outside other boxes, each as the rectangles of the grid of all sides."""
    x0, y0, x1, y1 = box
    xs = sorted({x0, x1, *(min(max(v, x0), x1) for o in others for v in (o[0], o[2]))})
    ys = sorted({y0, y1, *(min(max(v, y0), y1) for o in others for v in (o[1], o[3]))})
    free = {
        (i, j)
        for i in range(len(xs) - 1)
        for j in range(len(ys) - 1)
        if not any(o[0] <= xs[i] and xs[i + 1] <= o[2] and o[1] <= ys[j] and ys[j + 1] <= o[3] for o in others)
    }
    out = []
    while free:
        todo = [min(free)]
        free.discard(todo[0])
        part = []
        while todo:
            i, j = todo.pop()
            part.append((xs[i], ys[j], xs[i + 1], ys[j + 1]))
            for near in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if near in free:
                    free.discard(near)
                    todo.append(near)
        out.append(part)
    return out


BOXES_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("boxes", BOXES_TYPE)])))
def uncovered_parts(box: pd.DataFrame, others: pd.Series) -> pd.Series:
    """Parts of a box (struct x0, y0, x1, y1) that other boxes leave, greatest first, each as touching boxes."""
    rows = []
    for own, near in zip(box[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), others, strict=True):
        parts = left_over(own, [(o["x0"], o["y0"], o["x1"], o["y1"]) for o in near])
        sized = sorted(((sum((c - a) * (d - b) for a, b, c, d in p), p) for p in parts), key=lambda v: -v[0])
        rows.append([{"area": float(s), "boxes": [dict(zip(("x0", "y0", "x1", "y1"), q, strict=True)) for q in sorted(p)]} for s, p in sized])
    return pd.Series(rows, dtype=object)
