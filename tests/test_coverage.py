"""Layers as noded edges: clipping, gaps, arcs, straight borders, repair, splits and merges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.functions import clipping, straight
from cadaspark.functions import geometry as g
from cadaspark.functions.kernels import crossings, overlaps, ring_area
from cadaspark.operators import coverage, repair, straighten, topology
from cadaspark.operators.spatial import with_bounds

GEOM = "array<array<array<struct<x:double,y:double>>>>"


def ring(points, angle=0.0):
    c, s = math.cos(angle), math.sin(angle)
    return [(c * x - s * y, s * x + c * y) for x, y in points]


def box(x0, y0, x1, y1, angle=0.0):
    return [[ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], angle)]]


def layer(spark, rows, more=""):
    real = lambda geom: [[[(float(x), float(y)) for x, y in r] for r in p] for p in geom]
    return spark.createDataFrame([(i, real(geom), *rest) for i, geom, *rest in rows], f"id bigint, geom {GEOM}{more}")


def area(polygons):
    return sum(ring_area(np.asarray(r)) for p in polygons for r in p)


def blob(rng, x, y, r):
    a = np.sort(rng.random(rng.integers(3, 12))) * 2 * math.pi
    far = r * (0.4 + rng.random(len(a)))
    out = np.column_stack([x + far * np.cos(a), y + far * np.sin(a)])
    return np.round(out) if rng.random() < 0.3 else out


def test_clipping_agrees_with_the_overlap_of_fans():
    rng, done = np.random.default_rng(1), 0
    while done < 150:
        a, b = blob(rng, 0, 0, 10), blob(rng, rng.normal() * 6, rng.normal() * 6, 8)
        if any(ring_area(r) <= 0 or crossings(r) is not None for r in (a, b)):
            continue
        done += 1
        shared = overlaps([[[a]]], [[[b]]])[0]
        got = [area(clipping.clipped([[a]], [[b]], how)) for how in ("intersection", "difference", "union")]
        np.testing.assert_allclose(got, [shared, ring_area(a) - shared, ring_area(a) + ring_area(b) - shared], atol=0.02)


def test_clipping_keeps_corners_and_holes():
    square = [[np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)]]
    inner = [[np.array([(2, 2), (4, 2), (4, 4), (2, 4)], float)]]
    (outline, hole), = clipping.clipped(square, inner, "difference")
    assert len(outline) == 4 and len(hole) == 4 and ring_area(hole) == -4
    assert clipping.clipped(square, square, "difference") == [] and area(clipping.clipped([[outline, hole]], inner, "union")) == 100
    corner = [[np.array([(10, 10), (20, 10), (20, 20), (10, 20)], float)]]
    assert len(clipping.clipped(square, corner, "union")) == 2  # they touch at a point


def test_gaps_of_free_polygons(spark):
    """A missing plot, two missing ones with a free-standing plot inside, land too large, and the hole of a parcel."""
    a = 0.3
    missing = {(2, 2), (5, 5), (6, 5)}
    rows = [(10 * i + j, box(10 * i, 10 * j, 10 * i + 10, 10 * j + 10, a)) for i in range(9) for j in range(9) if (i, j) not in missing]
    rows += [(500, box(53, 53, 56, 56, a)), (501, box(-5, -5, 15, 15, a))]
    rows += [(600, [[ring([(200, 0), (240, 0), (240, 40), (200, 40)], a), ring([(210, 10), (230, 10), (230, 31), (210, 31)], a)]])]
    rows += [(601, [[ring([(300, 0), (340, 0), (340, 40), (300, 40)], a), ring([(310, 10), (329, 10), (329, 30), (310, 30)], a)]])]
    own = with_bounds(layer(spark, rows))
    got = {tuple(r.neighbours): r.area_m2 for r in coverage.gaps(own, 1.0, 400.0).collect()}
    want = {(12, 21, 23, 32): 100.0, (45, 54, 56, 64, 66, 75, 500): 191.0, (601,): 380.0}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 0.02 for k, v in want.items())
    lane = with_bounds(layer(spark, [(1, box(20, 20, 30, 24, a))]))
    less = {tuple(r.neighbours): r.area_m2 for r in coverage.gaps(own, 1.0, 400.0, lane).collect()}
    assert abs(less[12, 21, 23, 32] - 60) < 0.02 and len(less) == 3


def test_gap_between_borders_that_do_not_match(spark):
    """Neighbours with other corners on one border: the sliver between them is a gap of its own."""
    rows = [(1, [[[(0, 0), (10, 0), (10, 20), (0, 20)]]]), (2, [[[(10, 0), (20, 0), (20, 20), (10, 20), (11, 10)]]])]
    got = coverage.gaps(with_bounds(layer(spark, rows)), 1.0, 400.0).select("area_m2", "neighbours", "into").collect()
    assert [(r.area_m2, r.neighbours, r.into) for r in got] == [(10.0, [1, 2], 2)]


def test_gaps_between_long_roads(spark):
    """Roads of 480 km and of 1 km: products of their coordinates are greater than 64-bit numbers."""
    upright = [(k, box(k * 500, -50, k * 500 + 8, 480_050)) for k in range(3)]
    across = [(10 + k, box(-50, y, 1050, y + 8)) for k, y in enumerate((0, 200, 480_000))]
    found = {(round(r.gap.x), round(r.gap.y)): round(r.area_m2) for r in coverage.gaps(with_bounds(layer(spark, upright + across)), 1.0, 1e18).collect()}
    assert found == {(x, y): 492 * h for x in (8, 508) for y, h in ((8, 192), (208, 480_000 - 208))}


def test_no_gaps_in_odd_layers(spark):
    assert coverage.gaps(with_bounds(layer(spark, [])), 1.0, 400.0).collect() == []
    assert coverage.gaps(with_bounds(layer(spark, [(1, box(0, 0, 5, 5)), (2, box(0, 0, 5, 5)), (3, box(5, 5, 9, 9))])), 1.0, 400.0).collect() == []


def test_arcs_rebuild_the_layer(spark):
    rows = [(10 * i + j, box(10 * i, 10 * j, 10 * i + 10, 10 * j + (10 if i % 2 else 9), 0.2)) for i in range(5) for j in range(5)]
    own = layer(spark, rows)
    made = coverage.rebuilt(coverage.arcs(own)).join(own.withColumnRenamed("geom", "old"), "id")
    out = made.select(g.area(F.col("geom")).alias("a"), g.area(F.col("old")).alias("b")).collect()
    assert len(out) == 25 and all(abs(r.a - r.b) < 0.01 for r in out)


def test_lines_are_straightened_by_the_rules():
    line = np.array([(0, 0), (5, 1.5), (10, 0)], float)
    assert straight.straightened(line, 0.0, []).tolist() == [[0, 0], [10, 0]]
    house = [np.array([(4.5, -0.5), (5.5, -0.5), (5.5, 0.5), (4.5, 0.5)])]
    assert straight.straightened(line, 0.0, [house]).tolist() == line.tolist()
    bend = np.array([(0, 0), (10, 1), (11, 11)], float)
    got = straight.straightened(bend, 0.0, [])
    assert (got[[0, -1]] == bend[[0, -1]]).all() and np.allclose(got[1], [10.5, 0.5])
    assert straight.straightened(bend, math.pi / 4, []).tolist() == bend.tolist()  # no wall runs like it
    assert abs(straight.length_inside(np.array([(-5, 5), (15, 5)], float), [np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(4, 4), (4, 6), (6, 6), (6, 4)], float)]) - 8) < 1e-9


def wobbly(n, bulge=1.3, angle=0.0):
    """Tiles of 20 m whose inner borders bulge halfway, alike on both sides."""
    rows = []
    for i in range(n):
        for j in range(n):
            x, y = 20 * i, 20 * j
            mid = lambda ok, p: [p] if ok else []
            points = [(x, y), *mid(j > 0, (x + 10, y + bulge)), (x + 20, y), *mid(i < n - 1, (x + 20 + bulge, y + 10)), (x + 20, y + 20), *mid(j < n - 1, (x + 10, y + 20 + bulge)), (x, y + 20), *mid(i > 0, (x + bulge, y + 10))]
            rows.append((n * i + j, [[ring(points, angle)]]))
    return rows


def test_straightened_layer_keeps_the_land(spark):
    out = straighten.straightened(layer(spark, wobbly(4, angle=0.4)), layer(spark, [(1, box(5, 5, 9, 9, 0.4))]))
    rows = out.select("id", g.area(F.col("geom")).alias("a"), F.size(F.flatten(F.flatten("geom"))).alias("n")).collect()
    assert len(rows) == 16 and all(abs(r.a - 400) < 0.02 and r.n == 4 for r in rows)


def test_parcels_that_would_break_keep_their_borders(spark):
    """A parcel beside a border that would take its last land keeps its shape, and so does the neighbour there."""
    thin = [(1, [[[(0, 0), (20, 0), (20, 10), (10, 11.9), (0, 10)]]]), (2, [[[(0, 10), (10, 11.9), (20, 10), (20, 10.1), (10, 12.0), (0, 10.1)]]]), (3, [[[(0, 10.1), (10, 12.0), (20, 10.1), (20, 30), (0, 30)]]])]
    own = layer(spark, thin)
    out = straighten.straightened(own, layer(spark, []))
    got = {r.id: r.a for r in out.select("id", g.area(F.col("geom")).alias("a")).collect()}
    old = {r.id: r.a for r in own.select("id", g.area(F.col("geom")).alias("a")).collect()}
    assert got.keys() == old.keys() and abs(sum(got.values()) - sum(old.values())) < 1e-6


def test_shared_simplify_of_neighbours_agrees(spark):
    out = straighten.shared_simplify(layer(spark, wobbly(3, 0.8)), 1.0)
    layer_after = with_bounds(out)
    assert topology.overlap_pairs(layer_after.withColumn("area", g.area(F.col("geom"))), exact=True).isEmpty()
    assert coverage.gaps(layer_after, 0.0, 1e9).isEmpty()
    assert sorted({r.n for r in out.select(F.size(F.flatten(F.flatten("geom"))).alias("n")).collect()}) == [4]


def test_repair_leaves_sound_outlines_alone(spark):
    rows = [(1, box(0, 0, 20, 20, 0.5), 0.5), (2, box(20, 0, 40, 20, 0.5), 0.5), (3, box(38, 0, 60, 20, 0.5), 0.9), (4, box(0, 20, 3, 23, 0.5), 0.5), (5, box(100, 0, 120, 20, 0.5), 0.5)]
    parcels = layer(spark, rows, ", confidence double")
    fixed, log = repair.repaired(parcels)
    got = {r.id: r for r in fixed.collect()}
    old = {r.id: r.geom for r in parcels.collect()}
    assert {k for k in got if got[k].geom == old[k]} == {3, 5}
    assert [round(got[k].area_m2, 2) for k in (1, 2, 3, 5)] == [409.0, 360.0, 440.0, 400.0]
    assert sorted((r.action, tuple(r.parcel_ids)) for r in log.collect()) == [("merged", (4, 1)), ("overlap assigned", (3, 2))]


def test_equal_parcels_lose_contested_land_by_id(spark):
    """Turned boxes of one size whose computed areas differ in the last digits: the lesser id keeps the land."""
    turned = lambda x, y: [[[(0.8 * a - 0.6 * b, 0.6 * a + 0.8 * b) for a, b in ((x, y), (x + 21, y), (x + 21, y + 15), (x, y + 15))]]]
    parcels = layer(spark, [(138, turned(760.0, 40.0), 0.5), (139, turned(780.0, 40.0), 0.5)], ", confidence double")
    assert len({r.a for r in parcels.select(g.area(F.col("geom")).alias("a")).collect()}) == 2
    fixed, _ = repair.repaired(parcels)
    assert {r.id: round(r.area_m2, 3) for r in fixed.collect()} == {138: 315.0, 139: 300.0}


def test_fixed_layer_has_no_issues(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6):
        for j in range(6):
            x, y = 20 * i + rng.integers(0, 3), 20 * j + rng.integers(0, 3)
            rows.append((10 * i + j, box(float(x), float(y), float(x + rng.integers(16, 24)), float(y + rng.integers(16, 24)), 0.1), float(rng.integers(0, 5))))
    fixed, _ = repair.repaired(layer(spark, rows, ", confidence double"))
    left = {r.type for r in topology.issues(fixed.select("id", "geom")).collect()}
    assert left <= {"SLIVER", "TOO_SMALL"}


def test_splits_with_ids(spark):
    """A concave parcel in three, a cut that is refused for a small piece, one that misses, and one of no parcel."""
    horseshoe = [[[(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)]]]
    rows = [(4, horseshoe, "approved", "ai", 0.7), (9, box(100, 0, 120, 10), "approved", "ai", 0.7), (7, box(200, 0, 210, 10), "draft", "ai", 0.7)]
    own = layer(spark, rows, ", status string, source string, confidence double")
    lines = spark.createDataFrame([(4, [(-1.0, 20.0), (31.0, 20.0)]), (9, [(101.0, -1.0), (101.0, 11.0)]), (7, [(190.0, 50.0), (220.0, 50.0)]), (8, [(0.0, 0.0), (1.0, 1.0)]), (7, [(0.0, 0.0)])], "id bigint, line array<struct<x:double,y:double>>")
    pieces, refused = topology.split_parcels(own, lines)
    got = sorted((r.id, r.parent, round(r.area, 6), r.status, r.source, r.confidence) for r in pieces.collect())
    assert got == [(4, 4, 500.0, "draft", "edited", 0.7), (10, 4, 100.0, "draft", "edited", None), (11, 4, 100.0, "draft", "edited", None)]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [
        (7, "a line has two points or more"), (7, "the line does not cross the parcel"), (8, "no such parcel"), (9, "a piece is too small to be a parcel"),
    ]


def test_merges_with_ids(spark):
    """Corners that do not match, a hairline gap, an enclosed court, parcels apart, and a group of one."""
    rows = [
        (1, box(0, 0, 10, 10)), (2, box(10.01, 2, 20, 8)),
        (3, [[[(100, 0), (130, 0), (130, 30), (115, 30), (115, 20), (120, 20), (120, 10), (110, 10), (110, 20), (115, 20), (115, 30), (100, 30)]]]), (4, box(130, 0, 135, 5)),
        (5, box(200, 0, 210, 10)), (6, box(220, 0, 230, 10)), (7, box(300, 0, 310, 10)),
    ]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 4)], "id bigint, group bigint")
    got = {r.group: (r.id, r.area) for r in topology.merged_parcels(layer(spark, rows), groups).collect()}
    assert got.keys() == {1, 2} and got[1] == (1, pytest.approx(160, abs=0.1)) and got[2] == (3, pytest.approx(925, abs=0.1))


def test_shapes_are_merged_once_and_by_all_tasks(spark, monkeypatch):
    """The plan has the kernel once, behind a shuffle of a fixed number of partitions, which is not coalesced."""
    plans, write = {}, topology.written
    monkeypatch.setattr(topology, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    parcels = layer(spark, [(i, box(20 * i, 0, 20 * i + 20, 20, 0.3)) for i in range(6)])
    out = topology.merged_parcels(parcels, parcels.select("id", F.floor(F.col("id") / 2).alias("group")))
    assert sorted((r.group, r.id, round(r.area, 1)) for r in out.collect()) == [(0, 0, 800.0), (1, 2, 800.0), (2, 4, 800.0)]
    assert plans["merged-shapes"].count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plans["merged-shapes"]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_block_parcels_of_free_shapes(spark):
    """Two slanted houses, a bent road, a pond, a field: plots and open land tile the blocks, and nothing lies on a road."""
    from cadaspark.operators import blocks

    point = "array<struct<x:double,y:double>>"
    houses = layer(spark, [(1, box(60, 20, 70, 30, 0.2)), (2, box(82, 20, 92, 30, 0.2)), (3, [[[(150, 60), (170, 60), (170, 66), (156, 66), (156, 80), (150, 80)]]])])
    lines = spark.createDataFrame([(1, "road", [(-10.0, 5.0), (60.0, 8.0), (210.0, 50.0)]), (2, "rail", [(120.0, -10.0), (120.0, 110.0)])], f"id bigint, kind string, line {point}")
    pond, none = layer(spark, [(9, box(20, 60, 50, 90))]), layer(spark, [])
    zones = layer(spark, [(5, box(0, 55, 112, 100))]).withColumn("label", F.lit("Agricultural"))
    area = (0.0, 0.0, 200.0, 100.0)
    got = blocks.block_parcels(blocks.Layers(houses, lines, pond, none, zones), area)
    rows = got.collect()
    by = {r.building: r for r in rows if r.building}
    assert set(by) == {1, 2, 3} and [r.id for r in sorted(rows, key=lambda r: r.id)] == list(range(len(rows)))
    bars = blocks.barriers(blocks.Layers(houses, lines, pond, none, zones), area)
    own = with_bounds(got.select("id", "geom")).withColumn("area", g.area(F.col("geom")))
    assert topology.overlap_pairs(own, exact=True).isEmpty()
    from cadaspark.operators.spatial import overlay

    wide = bars.withColumn("area", g.area(F.col("geom")))
    assert overlay(own, wide, exact=True).filter("inter > 0.05").isEmpty()
    fields = [r for r in rows if r.landuse == "Agricultural"]
    assert fields and all(r.area_m2 <= 90 * 90 for r in fields)
    free = sum(r.area_m2 for r in rows)
    land = coverage.gaps(bars, 25.0, 1e18)
    assert abs(free - sum(r.area_m2 for r in blocks.inside(land, area).collect())) < 60
    assert by[1].road_connected and by[1].road_distance_m >= 4 - 0.01
    split = (by[1].x + by[2].x) / 2
    assert by[1].x < split < by[2].x and by[3].area_m2 > 12 * 20
