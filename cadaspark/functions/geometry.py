"""Closed-form geometry as column expressions over vertex arrays.

A ring is ``array<struct<x,y>>`` (closing vertex optional), a polygon an array of rings (the first
is the outline, the rest are holes) and a geometry an array of polygons.  All lengths are metres.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
LINE = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A geometry of one axis-aligned box."""
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))))


def edges(ring: Column) -> Column:
    """Edges of a ring as ``array<struct<p,q>>``, the closing one included."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_ring_area(ring: Column) -> Column:
    """Shoelace area relative to the first vertex; positive when anticlockwise."""
    o = F.element_at(ring, 1)
    cross = lambda e: (e["p"]["x"] - o["x"]) * (e["q"]["y"] - o["y"]) - (e["q"]["x"] - o["x"]) * (e["p"]["y"] - o["y"])
    return _sum(F.transform(edges(ring), cross)) / 2


def ring_length(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])))


def polygon_area(polygon: Column) -> Column:
    return F.abs(signed_ring_area(F.element_at(polygon, 1))) - _sum(F.transform(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: F.abs(signed_ring_area(r))))


def area(geom: Column) -> Column:
    return _sum(F.transform(geom, polygon_area))


def perimeter(geom: Column) -> Column:
    return _sum(F.transform(F.flatten(geom), ring_length))


def thinness(geom: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a disc, near 0 for slivers; 0 without a boundary."""
    return let(perimeter(geom), lambda p: F.when(p > 0, 4 * pi * area(geom) / (p * p)).otherwise(0.0))


def parts(geom: Column) -> Column:
    return F.size(geom)


def holes(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda a, p: a + F.size(p) - 1)


def largest_part(geom: Column) -> Column:
    """The polygon of greatest area as a geometry; ties go to the least first vertex."""
    ranked = F.transform(geom, lambda p: F.struct((-polygon_area(p)).alias("k"), F.element_at(F.element_at(p, 1), 1).alias("v"), p.alias("p")))
    return F.array(F.array_min(ranked)["p"])


def bounds(geom: Column) -> Column:
    xs = F.transform(F.flatten(F.flatten(geom)), lambda v: v["x"])
    ys = F.transform(F.flatten(F.flatten(geom)), lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(geom: Column) -> Column:
    """Area centroid of all rings (holes count against it)."""
    o = F.element_at(F.element_at(F.element_at(geom, 1), 1), 1)

    def moments(polygon: Column) -> Column:
        def of(ring: Column, i: Column) -> Column:
            turn = F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(signed_ring_area(ring))

            def edge(e: Column) -> Column:
                px, py, qx, qy = e["p"]["x"] - o["x"], e["p"]["y"] - o["y"], e["q"]["x"] - o["x"], e["q"]["y"] - o["y"]
                c = turn * (px * qy - qx * py)
                return F.struct(c.alias("a"), (c * (px + qx)).alias("x"), (c * (py + qy)).alias("y"))

            return F.transform(edges(ring), edge)

        return F.flatten(F.transform(polygon, of))

    total = F.aggregate(
        F.flatten(F.transform(geom, moments)),
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y")),
    )
    return let(total, lambda t: F.when(t["a"] != 0, point(o["x"] + t["x"] / (3 * t["a"]), o["y"] + t["y"] / (3 * t["a"]))))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Ray casting over all rings (even-odd), so holes are outside."""
    hits = lambda e: F.when(((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.when(e["q"]["y"] == e["p"]["y"], 1.0).otherwise(e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]), 1).otherwise(0)
    return F.aggregate(F.flatten(F.transform(F.flatten(geom), edges)), F.lit(0), lambda a, e: a + hits(e)) % 2 == 1


def is_box(geom: Column) -> Column:
    """Whether the geometry is one axis-aligned box: four corners that enclose all of its bounds."""
    corners = F.size(F.flatten(F.flatten(geom)))
    one = (F.size(geom) == 1) & (F.size(F.flatten(geom)) == 1) & corners.isin(4, 5)
    full = let(bounds(geom), lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.coalesce(one & (full > 0) & (area(geom) >= full * (1 - 1e-12)), F.lit(False))


def inside_point(geom: Column, share: Column) -> Column:
    """A point within the geometry: the middle of its widest span at a share of its height (ties: the first span)."""
    box = bounds(geom)
    level = lambda b: b["y0"] + share * (b["y1"] - b["y0"])

    def at(y: Column) -> Column:
        hits = F.filter(F.flatten(F.transform(F.flatten(geom), edges)), lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
        xs = F.array_sort(F.transform(hits, lambda e: e["p"]["x"] + (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"])))

        def middle(v: Column) -> Column:
            spans = F.transform(F.sequence(F.lit(1), F.size(v) - 1, F.lit(2)), lambda i: F.struct((F.element_at(v, i) - F.element_at(v, i + 1)).alias("k"), F.element_at(v, i).alias("a"), F.element_at(v, i + 1).alias("b")))
            return let(F.array_min(spans), lambda s: point((s["a"] + s["b"]) / 2, y))

        return let(xs, lambda v: F.when(F.size(v) > 1, middle(v)))

    return let(box, lambda b: let(level(b), at))


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """Distance of a point to an edge by clamped projection."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["p"]["x"]) * dx + (y - e["p"]["y"]) * dy) / F.when(square > 0, square).otherwise(1.0)))).otherwise(0.0)
    return F.hypot(x - e["p"]["x"] - t * dx, y - e["p"]["y"] - t * dy)


def boundary_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest outline."""
    return F.array_min(F.flatten(F.transform(geom, lambda p: F.transform(edges(F.element_at(p, 1)), lambda e: segment_distance(x, y, e)))))


def point_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the geometry, 0 inside."""
    rings = F.flatten(F.transform(F.flatten(geom), edges))
    return F.when(contains_point(geom, x, y), 0.0).otherwise(F.array_min(F.transform(rings, lambda e: segment_distance(x, y, e))))


# boxes -------------------------------------------------------------------------------------------


def box_overlap(a: str, b: str) -> Column:
    """Overlap area of two boxes whose columns are ``{a}x0`` .. ``{b}y1``."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_distance(a: str, b: str) -> Column:
    dx = F.greatest(F.lit(0.0), F.col(f"{b}x0") - F.col(f"{a}x1"), F.col(f"{a}x0") - F.col(f"{b}x1"))
    dy = F.greatest(F.lit(0.0), F.col(f"{b}y0") - F.col(f"{a}y1"), F.col(f"{a}y0") - F.col(f"{b}y1"))
    return F.hypot(dx, dy)


def box_area(a: str = "") -> Column:
    return (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}y1") - F.col(f"{a}y0"))


def union_area(boxes: Column) -> Column:
    """Area that an array of boxes (x0, y0, x1, y1) covers, counted once where they overlap.

    Slab by slab between neighbouring x: the lengths of the joined y intervals of the boxes there.
    """
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"]))))

    def covered(inside: Column) -> Column:
        spans = F.array_sort(F.transform(inside, lambda b: F.struct(b["y0"].alias("a"), b["y1"].alias("b"))))
        start = F.struct(F.lit(float("-inf")).alias("end"), F.lit(0.0).alias("length"))
        step = lambda s, v: F.struct(F.greatest(s["end"], v["b"]).alias("end"), (s["length"] + F.greatest(F.lit(0.0), v["b"] - F.greatest(s["end"], v["a"]))).alias("length"))
        return F.aggregate(spans, start, step, lambda s: s["length"])

    slab = lambda p, q: (q - p) * covered(F.filter(boxes, lambda b: (b["x0"] <= p) & (b["x1"] >= q)))
    slabs = lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), slab)
    return let(xs, lambda x: F.when(F.size(x) < 2, 0.0).otherwise(_sum(slabs(x))))


def box_relation(a: str, b: str) -> Column:
    """How two boxes lie: equal, within, contains, overlaps, touches (borders alone) or apart."""
    at = lambda p, c: F.col(f"{p}{c}")
    inside = lambda p, q: (at(p, "x0") >= at(q, "x0")) & (at(p, "y0") >= at(q, "y0")) & (at(p, "x1") <= at(q, "x1")) & (at(p, "y1") <= at(q, "y1"))
    w = F.least(at(a, "x1"), at(b, "x1")) - F.greatest(at(a, "x0"), at(b, "x0"))
    h = F.least(at(a, "y1"), at(b, "y1")) - F.greatest(at(a, "y0"), at(b, "y0"))
    return F.when((w < 0) | (h < 0), "apart").when((w == 0) | (h == 0), "touches").when(inside(a, b) & inside(b, a), "equal").when(inside(a, b), "within").when(inside(b, a), "contains").otherwise("overlaps")
