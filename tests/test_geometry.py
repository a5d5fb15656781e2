"""Properties of the geometry functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions import kernels as k
from cadaspark.functions import projection as p


def shape(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]


def star(rng, n, dx=0.0):
    angle, radius = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(3, 10, n)
    return shape(list(zip(radius * np.cos(angle) + dx, radius * np.sin(angle), strict=True)))


def size(geom):
    return sum(map(k.ring_area, k.as_rings(geom)))


@pytest.mark.parametrize("seed", range(12))
def test_overlap_properties(seed):
    rng = np.random.default_rng(seed)
    a, b = star(rng, 9), star(rng, 12, 4)
    inter = k.overlap(a, b)
    assert inter == pytest.approx(k.overlap(b, a), abs=1e-9)
    assert inter <= min(size(a), size(b)) + 1e-9
    assert k.overlap(a, a) == pytest.approx(size(a), rel=1e-9)
    parts = [k.half_plane(k.as_rings(a)[0], np.array([0.5, 0.0]), np.array([0.2, 1.0]), s) for s in (1.0, -1.0)]
    assert sum(k.overlap(shape(q), b) for q in parts) == pytest.approx(inter, abs=1e-7)
    turn = lambda geom: shape([(-v["y"] + 3, v["x"] - 7) for v in geom[0][0]])
    assert k.overlap(turn(a), turn(b)) == pytest.approx(inter, abs=1e-7)


def test_overlap_with_hole():
    frame = shape([(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)])
    assert k.overlap(frame, shape([(2, 2), (5, 2), (5, 5), (2, 5)])) == pytest.approx(9 - 4)
    assert k.overlap(frame, shape([(3.5, 3.5), (6, 3.5), (6, 6), (3.5, 6)])) == pytest.approx(0, abs=1e-9)
    assert k.overlap(frame, []) == 0


def test_untangle_and_rectangle():
    bow = np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)
    assert sorted(abs(k.ring_area(r)) for r in k.untangle(bow)) == pytest.approx([4, 4])
    _, short, long = k.rectangle(np.array([(0, 0), (3, 4), (-1, 7), (-4, 3)], float))
    assert (short, long) == pytest.approx((5, 5))
    assert k.rectangle(np.array([(0, 0), (1, 1)], float))[1] == 0


def test_simplify_and_hausdorff():
    line = np.array([(0, 0), (1, 0.05), (2, 0), (3, 2), (4, 0)], float)
    assert k.simplified(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    a = shape([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert k.hausdorff(a, shape([(0, 0), (3, 0), (3, 1), (0, 1)])) == pytest.approx(2)
    assert k.hausdorff(a, []) is None


def test_columns(spark):
    frame = shape([(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)])
    df = spark.createDataFrame([(frame,), (shape([(0, 0), (4, 0), (0, 3)]),)], f"geom {g.GEOMETRY}")
    c = F.col("geom")
    got = df.select(g.area(c), g.perimeter(c), g.holes(c), g.parts(c), g.thinness(c), g.centroid(c)["x"], g.contains_point(c, F.lit(5.0), F.lit(5.0)), g.point_distance(c, F.lit(5.0), F.lit(5.0)), g.boundary_distance(c, F.lit(1.0), F.lit(5.0))).collect()
    assert got[0][0] == 96 and got[0][1] == 48 and got[0][2] == 1 and got[0][3] == 1
    assert got[0][5] == pytest.approx(5) and not got[0][6] and got[0][7] == pytest.approx(1) and got[0][8] == pytest.approx(1)
    assert got[1][0] == 6 and got[1][1] == 12 and got[1][4] == pytest.approx(4 * np.pi * 6 / 144) and got[1][5] == pytest.approx(4 / 3)


def test_projections(spark):
    df = spark.createDataFrame([(78.5, 17.4), (-70.1, -33.2), (10.0, 0.0)], "lon double, lat double")
    u = p.utm_forward(F.col("lon"), F.col("lat"), p.utm_zone(F.col("lon")))
    back = df.withColumn("u", u).select("lon", "lat", "u", p.utm_inverse(F.col("u.x"), F.col("u.y"), p.utm_zone(F.col("lon")), F.col("lat") >= 0).alias("b")).collect()
    for r in back:
        assert (r.b.lon, r.b.lat) == pytest.approx((r.lon, r.lat), abs=1e-8)
    assert back[2].u.x == pytest.approx(611200, abs=200)  # one degree east of the meridian of zone 32
    e = df.select(p.local_inverse(p.local_forward(F.col("lon"), F.col("lat"), F.lit(78.0), F.lit(17.0))["x"], p.local_forward(F.col("lon"), F.col("lat"), F.lit(78.0), F.lit(17.0))["y"], F.lit(78.0), F.lit(17.0))["lon"]).first()[0]
    assert e == pytest.approx(78.5)


def pieces(polygon, *line):
    rings = k.as_rings([polygon])
    return sorted((round(sum(map(k.ring_area, p)), 6) for p in k.cut_polygon(rings, k.lengthened(np.array(line, float), 5.0))), reverse=True)


def test_cut_of_polygons():
    square = shape([(0, 0), (20, 0), (20, 20), (0, 20)])[0]
    assert pieces(square, (8, -1), (8, 21)) == [240, 160]
    assert pieces(square, (8, 1), (8, 19)) == [240, 160]  # the line reaches past its ends
    assert pieces(square, (-30, 40), (50, 41)) == [400]  # misses
    assert pieces(square, (-5, 10), (8, 10)) == [400]  # ends inside
    assert pieces(square, (-5, 8), (8, 8), (8, -5)) == [336, 64]  # a bend
    assert pieces(square, (0, 0), (20, 20)) == [200, 200]  # through corners
    comb = shape([(0, 0), (30, 0), (30, 20), (20, 20), (20, 5), (10, 5), (10, 20), (0, 20)])[0]
    assert pieces(comb, (-1, 10), (31, 10)) == [250, 100, 100]  # both teeth stay apart
    ring = shape([(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (15, 5), (15, 15), (5, 15)])[0]
    assert pieces(ring, (10, -1), (10, 21)) == [150, 150]
    assert pieces(ring, (2, -1), (2, 21)) == [260, 40]  # the hole stays with its side
    assert pieces(ring, (-1, 10), (6, 10)) == [300]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_keep_the_area(seed):
    rng = np.random.default_rng(seed)
    a = star(rng, 14)
    line = np.array([(-20, rng.uniform(-4, 4)), (rng.uniform(-3, 3), rng.uniform(-4, 4)), (20, rng.uniform(-4, 4))])
    found = k.cut_polygon(k.as_rings(a), line)
    assert len(found) >= 2
    assert sum(sum(map(k.ring_area, p)) for p in found) == pytest.approx(size(a), rel=1e-5)
    for i, p in enumerate(found):
        assert k.overlap(shape(p[0]), a) == pytest.approx(k.ring_area(p[0]), rel=1e-4, abs=1e-4)
        assert all(k.overlap(shape(p[0]), shape(q[0])) < 1e-3 for q in found[:i])
