"""Regions, votes and nearest boxes against plain loops."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.functions.kernels import left_over
from cadaspark.operators import cells as raster_cells
from cadaspark.operators import comparison, scoring
from cadaspark.operators import layout, ranks, regions, repair, saving, siting, tiles, voting
from cadaspark.operators.spatial import box_pairs
from cadaspark.plans import fixtures as x
from cadaspark.sources import layers
from cadaspark.streaming import visits

SF = "/root/testdata/sf0.001"


def parts(label):
    """Connected cells of one label, by a flood over a dict of cells."""
    left, out = set(label), []
    while left:
        first = left.pop()
        todo, piece = [first], [first]
        while todo:
            a, b = todo.pop()
            for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if c in left and label[c] == label[first]:
                    left.remove(c)
                    todo.append(c)
                    piece.append(c)
        out.append(piece)
    return out


def around(piece, label):
    held = set(piece)
    return [label.get(c) for a, b in piece for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if c not in held]


def raster(seed, labels, share=1.0, n=22):
    rng = np.random.default_rng(seed)
    return {(i, j): int(rng.choice(labels)) for i in range(n) for j in range(n) if rng.random() < share}


def frame(spark, label):
    return spark.createDataFrame([(*c, v) for c, v in label.items()], "x int, y int, label int")


def cells_of(df):
    return {(r.x, r.y): r.label for r in df.collect()}


def test_regions_over_stretches(spark, monkeypatch):
    label = raster(1, [0, 1, 2], 0.9)
    monkeypatch.setattr(regions, "STRETCH", 5)
    got = {}
    for r in regions.regions(frame(spark, label)).collect():
        got.setdefault(r.region, set()).add((r.x, r.y))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts(label)))
    assert all(k == min((y << 32) + x for x, y in v) for k, v in got.items())


def test_absorbed(spark):
    label = raster(2, [1, 1, 1, 2, 3])
    want = dict(label)
    for piece in parts(label):
        near = around(piece, label)
        near = [v for v in near if v is not None]
        if len(piece) < 4 and near:
            into = min(set(near), key=lambda v: (-near.count(v), v))
            want |= dict.fromkeys(piece, into)
    assert cells_of(regions.absorbed(frame(spark, label), 4)) == want


def test_enclosures_absorbed(spark):
    label = raster(3, [1, 1, 1, 1, 2, 3])
    want = dict(label)
    for piece in parts(label):
        near = set(around(piece, label))
        if len(near) == 1 and None not in near and len(piece) * 30 <= 60:
            want |= dict.fromkeys(piece, near.pop())
    assert cells_of(regions.enclosures_absorbed(frame(spark, label), 30.0)) == want != label


def test_strips(spark):
    label = dict.fromkeys([(i, 0) for i in range(30)] + [(i, 1) for i in range(30)], 1) | dict.fromkeys([(i, j) for i in range(40, 52) for j in range(12)], 1) | dict.fromkeys([(i, 20) for i in range(20)], 1)
    got = regions.strips(frame(spark, label), 1.5).collect()
    assert [(r.region, r.area_m2, r.length_m) for r in got] == [(0, 135.0, 45.0)]


def test_merged_by_roofs(spark):
    rows = [(1, 7, 50), (2, 7, 50), (2, 8, 90), (3, 8, 10), (4, 9, 300), (5, 9, 300), (6, 0, 5), (3, 10, 85), (6, 10, 15), (4, 11, 84), (5, 11, 16)]
    cells = spark.createDataFrame([(p, r) for p, r, n in rows for _ in range(n)], "parcel bigint, roof bigint")
    got = {r.parcel: r.merged for r in regions.merged_by_roofs(cells, 1.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_fused(spark):
    first = {(i, 0): 3 for i in range(10)}
    scores = [(i, j, 0.9, 0.2) for i in range(10) for j in range(10)] + [(i, j, 0.9, 0.2) for i in range(20, 28) for j in range(4)]
    got = regions.fused(frame(spark, first), spark.createDataFrame(scores, "x int, y int, a double, b double")).collect()
    assert {(r.x, r.y): r.label for r in got} == first | {(i, j): 4 for i in range(10) for j in range(1, 10)}


def test_votes(spark):
    """Greedy clusters: falling scores, one item of a member, the best overlap with a cluster's first item."""
    rng = np.random.default_rng(6)
    boxes, rows = {}, []
    for item in range(60):
        site, member = item % 9, item % 4
        a, b = 40 * site + int(rng.integers(0, 4)), int(rng.integers(0, 4))
        boxes[item] = {(x, y) for x in range(a, a + 10) for y in range(b, b + 10)}
        rows.append((item, member, float(np.round(rng.random(), 2))))
    items = spark.createDataFrame(rows, "item bigint, member int, score double")
    masks = spark.createDataFrame([(i, x, y) for i, c in boxes.items() for x, y in c], "item bigint, x int, y int")
    made = []
    for item, member, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        over = [(-len(boxes[item] & boxes[c[0][0]]) / len(boxes[item] | boxes[c[0][0]]), k) for k, c in enumerate(made) if member not in {m for _, m, _ in c}]
        best = min(over, default=(0, -1))
        if -best[0] >= 0.5:
            made[best[1]].append((item, member, score))
        else:
            made.append([(item, member, score)])
    want = {}
    for c in made:
        mean = sum(s for *_, s in c) / len(c)
        fused = {p for p in set.union(*(boxes[i] for i, *_ in c)) if sum(p in boxes[i] for i, *_ in c) >= 0.5 * len(c)}
        if (len(c) >= 2 or mean >= 0.85) and len(fused) >= 20:
            want[c[0][0]] = (len(c), round(mean * min(1, len(c) / 3), 9), fused)
    kept, cells = voting.voted_masks(items, masks, 4)
    fused = {}
    for r in cells.collect():
        fused.setdefault(r.cluster, set()).add((r.x, r.y))
    assert {r.cluster: (r.votes, round(r.score, 9), fused[r.cluster]) for r in kept.collect()} == want and len(want) > 5


def test_nearest_box_at_any_distance(spark):
    box = "id bigint, x0 double, y0 double, x1 double, y1 double"
    own = [(1, 0.0, 0.0, 1.0, 1.0), (2, 5000.0, 0.0, 5001.0, 1.0), (3, 90.0, 9000.0, 91.0, 9001.0)]
    others = [(7, 3.0, 0.0, 4.0, 1.0), (8, 3.0, 0.0, 4.0, 1.0), (9, 4000.0, 10.0, 4001.0, 11.0)]
    got = {r.id: (r.other, round(r.distance, 6)) for r in layout.nearest_box(spark.createDataFrame(own, box), spark.createDataFrame(others, box)).collect()}
    gap = lambda a, b: float(np.hypot(max(0, b[1] - a[3], a[1] - b[3]), max(0, b[2] - a[4], a[2] - b[4])))
    assert got == {a[0]: min((round(gap(a, b), 6), b[0]) for b in others)[::-1] for a in own}


def test_quantiles_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 50)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(700, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.02, 0.5, 0.61, 0.98, 1.0]
    np.testing.assert_allclose(ranks.quantiles(df, F.col("v"), shares), np.quantile(values, shares), rtol=1e-12)
    assert ranks.quantiles(df.filter("v > 1e10"), F.col("v"), [0.5]) == [None]
    by = df.groupBy("v").count().filter("v is not null")
    got = {r.v: r.below for r in ranks.counts_below(by, "v", "count").collect()}
    assert all(got[v] == (values < v).sum() for v in got)


def test_left_over_parts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        others = [(a, b, a + c, b + d) for a, b, c, d in rng.integers([0, 0, 1, 1], [14, 14, 9, 9], (5, 4)).tolist()]
        free = {(i, j): 1 for i in range(2, 14) for j in range(3, 15) if not any(o[0] <= i and i + 1 <= o[2] and o[1] <= j and j + 1 <= o[3] for o in others)}
        got = [{(i, j) for a, b, c, d in p for i in range(a, c) for j in range(b, d)} for p in left_over((2, 3, 14, 15), others)]
        assert sorted(map(sorted, got)) == sorted(map(sorted, parts(free)))


def test_rest_of_a_footprint_stays(spark):
    box = "id bigint, x0 double, y0 double, x1 double, y1 double"
    first = spark.createDataFrame([(1, 10.0, 0.0, 14.0, 10.0), (2, 50.0, 0.0, 51.0, 2.0)], box)
    second = spark.createDataFrame([(5, 0.0, 0.0, 30.0, 10.0), (6, 11.0, 1.0, 13.0, 9.0), (7, 100.0, 0.0, 101.0, 5.0), (8, 13.0, 0.0, 15.5, 10.0)], box)
    got = sorted((r.source, r.id, round(r.area_m2, 6)) for r in siting.merged_sources(first, second).collect())
    assert got == [("a", "1", 40.0), ("b", "5", 95.0), ("b", "5", 155.0), ("b", "7", 5.0)]


def test_survey_mask(spark):
    hidden = {(0, 0), (0, 1), (5, 5), (5, 6), (9, 3), (8, 3), (7, 7)}
    cells = spark.createDataFrame([(i, j, None if (i, j) in hidden and (i + j) % 2 else float("nan") if (i, j) in hidden else 1.0) for i in range(10) for j in range(10)], "x int, y int, value double")
    assert {(r.x, r.y) for r in tiles.survey_mask(cells).filter("not valid").collect()} == {(0, 0), (0, 1), (9, 3), (8, 3)}


def test_hand_labels(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"crop{k}.json").write_text(json.dumps({"name": f"crop{k}", "y0": 20, "x0": 80, "size": 266, "lines": [[[1.5, 2], [3, 4]], [[5, 6], [7, 8], [9, 10]]][:k]}, indent=1))
    got = sorted((r.name, r.x0, r.size, r.line, len(r.vertices), r.vertices[0].x) for r in layers.hand_labels(spark, str(tmp_path / "*.json")).select("name", "x0", F.col("size").alias("size"), "line", "vertices").collect())
    assert got == [("crop1", 80, 266, 0, 2, 1.5), ("crop2", 80, 266, 0, 2, 1.5), ("crop2", 80, 266, 1, 3, 5.0)]


def test_summaries_and_removed_records(spark):
    one = spark.createDataFrame([(3, 0.5)], "parcels bigint, share double")
    assert json.loads(saving.as_summary(one).first()["json"]) == {"parcels": 3, "share": 0.5}
    layer = spark.createDataFrame([(1, "MATCH", 0.9, "R1")], "id bigint, record_status string, record_iou double, record_ref_id string")
    assert saving.without_record(layer).columns == ["id"]


def test_running_accuracy_over_micro_batches(spark, tmp_path):
    layer = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "id bigint, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, "corner", 0.5, 0.0), (2, "corner", 10.0, 11.5)], "point_id bigint, type string, x double, y double")
    for k in (1, 2):
        points.filter(f"point_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = visits.source(spark, str(tmp_path / "in"), points.schema, 1)
    got = sorted((r.batch, r.points, round(r.mean_m, 9)) for r in visits.running_accuracy(stream, layer).collect())
    assert [g[:2] for g in got] == [(0, 1), (1, 2)] and got[1][2] == 1.0


def test_repair_of_free_polygons(spark):
    """Bow-ties, parts, holes with parcels inside, duplicates, overlaps, slivers, small parcels and gaps."""

    def ring(*v):
        return [{"x": float(a), "y": float(b)} for a, b in v]

    def box(a, b, c, d):
        return ring((a, b), (c, b), (c, d), (a, d))

    rows = [
        (1, [[box(0, 0, 20, 20)]], 0.9),
        (2, [[box(15, 0, 40, 20)]], 0.5),  # overlaps 1 by 5 x 20
        (3, [[box(0, 0, 20, 20.2)]], 0.1),  # doubles 1
        (4, [[box(0, 20, 40, 21)]], 0.5),  # a sliver beside 1 and 2
        (5, [[box(0, 21, 15, 40)]], 0.5),
        (6, [[box(25, 21, 40, 40)]], 0.5),
        (7, [[box(15, 30, 25, 40)]], 0.5),  # with 4, 5 and 6 around a gap of 10 x 9
        (8, [[box(100, 0, 140, 40), box(110, 10, 120, 20), box(125, 25, 130, 30)]], 0.5),  # two holes
        (9, [[box(111, 11, 119, 19)]], 0.2),  # inside the first hole, of lower rank
        (10, [[box(126, 26, 129, 29)]], 0.8),  # inside the second, of higher rank but too small
        (11, [[ring((200, 0), (220, 20), (220, 0), (200, 20))]], 0.5),
        (12, [[box(300, 0, 320, 20)], [box(330, 0, 334, 4)]], None),
    ]
    parcels = spark.createDataFrame(rows, "id bigint, geom array<array<array<struct<x:double,y:double>>>>, confidence double")
    layer, log = repair.repaired(parcels)
    areas = {r.id: r.area_m2 for r in layer.collect()}
    done = sorted((r.action, tuple(r.parcel_ids), r.area_m2) for r in log.collect())
    assert ("removed duplicate", (3,), None) in done and ("overlap assigned", (1, 2), 100.0) in done
    assert ("enclosed, merged", (9, 8), None) in done and ("holes filled", (8,), None) in done and ("made valid", (11,), None) in done and ("kept largest part", (12,), None) in done
    assert [d[1][0] for d in done if d[0] == "merged"] == [4] and sorted((d[1], d[2]) for d in done if d[0] == "gap filled")[-1] == ((8,), 16.0)
    assert sorted(d[2] for d in done if d[0] == "gap filled") == [16.0, 90.0]
    assert set(areas) == {1, 2, 5, 6, 7, 8, 10, 11, 12}
    assert areas[1] + areas[2] + areas[5] + areas[6] + areas[7] == 40 * 40 and areas[8] == 1600 - 25 + 16 and areas[10] == 9 and areas[12] == 400
    assert abs(areas[11] - 100) <= 10


def test_layers_and_catalogues(spark, tmp_path):
    layer = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3)], "survey_id string, id bigint")
    layers.write_layer(layer, str(tmp_path / "layer"))
    one = spark.read.parquet(str(tmp_path / "layer")).filter("survey_id = 's2'")
    assert sorted(r.id for r in one.collect()) == [2, 3] and "PartitionFilters: [isnotnull(survey_id" in one._jdf.queryExecution().toString()
    for k in ("b", "a"):
        (tmp_path / "surveys" / k).mkdir(parents=True)
        (tmp_path / "surveys" / k / "meta.json").write_text(json.dumps({"name": f"survey {k}", "gsd": 0.1}, indent=1))
    got = [(r.folder, r.name) for r in layers.catalogue(spark, str(tmp_path / "surveys/*/meta.json"), "name string, gsd double").select("folder", F.col("name").alias("name")).collect()]
    assert got == [("a", "survey a"), ("b", "survey b")]


def test_survey_margins_and_renames(spark):
    points = spark.createDataFrame([(1, 10.0004, 5.0), (2, 10.0006, 5.0), (3, 9.0, 4.9996)], "id bigint, lon double, lat double")
    assert [r.id for r in layers.within_survey(points, (9.0, 5.0, 10.0, 6.0)).collect()] == [1, 3]
    assert layers.patch_starts(50, 8, 6) == [0, 6, 12, 18, 24, 30, 36, 42] and layers.patch_starts(51, 8, 6)[-2:] == [42, 43] and layers.patch_starts(5, 8, 6) == [0]


def test_strips_of_any_shape(spark):
    """A ring road and a crossing are strips, a courtyard and a thick block are none."""
    ring = {(i, j) for i in range(12) for j in range(12) if min(i, j, 11 - i, 11 - j) < 2}
    cross = {(100 + i, 10 + j) for i in range(30) for j in range(2)} | {(114 + i, j) for i in range(2) for j in range(30)}
    court = {(200 + i, j) for i in range(12) for j in range(12)}
    block = {(300 + i, j) for i in range(30) for j in range(14)}
    got = {r.region: r for r in regions.strips(frame(spark, dict.fromkeys(ring | cross | court | block, 1)), 1.5).collect()}
    assert set(got) == {0, 114}
    assert abs(got[0].length_m - 60) < 4 and abs(got[114].length_m - 58 * 1.5) < 1


def test_corridors_with_lanes(spark):
    """A paved lane joins the road, a lot does not; single cells go with the opening."""
    road = {(i, j) for i in range(60) for j in range(4)} | {(70, 70)}
    lane, lot = {(20 + i, 4 + j) for i in range(3) for j in range(30)}, {(60 + i, 20 + j) for i in range(20) for j in range(20)}
    cells = [(*c, c in road, c in lane or c in lot) for c in road | lane | lot]
    got = {(r.x, r.y) for r in regions.corridor_cells(spark.createDataFrame(cells, "x int, y int, road boolean, paved boolean"), 1.0, 32).collect()}
    assert {(21, 20), (30, 1), (0, 1)} <= got and (70, 70) not in got and (70, 30) not in got
    assert len(got & lane) > 80 and len(got & lot) < 12


def holes_of(cells, label):
    """Pieces of land that a label's cells cut off from the outside, by a flood from beyond the raster."""
    own = {c for c, v in cells.items() if v == label}
    lo, hi = [min(c[k] for c in own) - 1 for k in (0, 1)], [max(c[k] for c in own) + 1 for k in (0, 1)]
    free = {(i, j): 0 for i in range(lo[0], hi[0] + 1) for j in range(lo[1], hi[1] + 1) if (i, j) not in own}
    return [p for p in parts(free) if all(lo[0] < a < hi[0] and lo[1] < b < hi[1] for a, b in p)]


def resolved(cells, m2, corridor, most, rounds=6):
    """The rules of enclosures by plain loops."""
    now = dict(cells)
    for _ in range(rounds):
        taken, cuts = {}, {}
        for label in sorted({v for v in now.values() if v and v > 0 and v != corridor}):
            for hole in holes_of(now, label):
                held = [c for c in hole if (now.get(c) or 0) > 0]
                if len(hole) * m2 <= most:
                    for c in held:
                        taken[c] = max(taken.get(c, (0, 0)), (len(hole), -label))
                elif held:
                    cuts.setdefault(label, set()).add(sum(b for _, b in hole) // len(hole))
        after = now | {c: -v[1] for c, v in taken.items()}
        fresh, changed, line = max(v or 0 for v in now.values()), bool(taken), {}
        put = dict(after)
        for label in sorted(cuts):
            own = {c: 1 for c, v in after.items() if v == label and c not in taken}
            pieces = sorted(parts({c: 1 for c in own if c[1] not in cuts[label]}), key=lambda p: min((b, a) for a, b in p))
            if len(pieces) > 1:
                changed = True
                kept = max(pieces, key=len)
                for p in pieces:
                    if p is not kept:
                        fresh += 1
                        put |= dict.fromkeys(p, fresh)
                line |= {c: label for c in own if c[1] in cuts[label]}
        over = {}
        for (a, b), label in line.items():
            above = put.get((a, b - 1)) or 0
            over[a, b] = above if above > 0 and above != corridor else label
        if not changed:
            return now
        now = put | over
    return now


def test_enclosures_resolved(spark):
    """Two labels in one hole, a hole at a corner, an enclosed plot that splits its parcel, a corridor around land."""
    label = {(i, j): 1 for i in range(20) for j in range(20)}
    label |= {(3, 3): 2, (4, 3): 3, (8, 8): 4, (9, 9): 4}
    label |= {(12 + i, 11 + j): 5 for i in range(5) for j in range(6)}
    label |= {(30 + i, j): 9 for i in range(6) for j in range(6)} | {(31 + i, 1 + j): 6 for i in range(4) for j in range(4)}
    got = cells_of(regions.enclosures_resolved(frame(spark, label), 4.0, corridor=9))
    assert got == resolved(label, 4.0, 9, 60.0)
    assert got[3, 3] == got[4, 3] == got[8, 8] == got[9, 9] and got[31, 1] == 6 and got[13, 12] == 5
    assert len({v for c, v in got.items() if c[0] < 20}) == 3


def test_enclosures_on_random_rasters(spark):
    for seed in (11, 12):
        label = raster(seed, [1, 1, 1, 1, 2, 2, 3, 0], 0.97, 16)
        got = cells_of(regions.enclosures_resolved(frame(spark, label), 10.0, corridor=3))
        assert got == resolved(label, 10.0, 3, 60.0)


def test_parcels_by_block(spark):
    """Two walled blocks: no plot reaches over the wall, far land is open, sheds take no land."""
    land = {(i, j) for i in range(60) for j in range(20) if i != 20}
    house = {(17 + i, 8 + j): 3 for i in range(3) for j in range(4)} | {(24 + i, 8 + j): 5 for i in range(3) for j in range(4)} | {(33 + i, 3 + j): 7 for i in range(4) for j in range(4)} | {(10, 2): 8}
    cells = spark.createDataFrame([(i, j, (i, j) in land, house.get((i, j), 0)) for i in range(60) for j in range(20)], "x int, y int, land boolean, house int")
    got = {(r.x, r.y): r.parcel for r in raster_cells.parcels_by_block(cells, 2.0, turned=False).collect()}
    want = {}
    for c in land:
        near = [(max(abs(c[0] - a), abs(c[1] - b)), h) for (a, b), h in house.items() if h != 8 and (a < 20) == (c[0] < 20)]
        d, h = min(near)
        want[c] = h if d <= 10 else 100 + (c[0] > 20)
    names = {v: k + 1 for k, v in enumerate(sorted(set(want.values())))}
    assert got == {c: names[v] for c, v in want.items()}


def test_block_axes(spark):
    """In a slanted block plots are parted square to its long side."""
    turn = np.array([[np.cos(0.5), np.sin(0.5)], [-np.sin(0.5), np.cos(0.5)]])
    inside = lambda p: 0 <= p[0] < 60 and 0 <= p[1] < 16
    at = lambda i, j: np.array([i, j]) @ turn.T
    rows = [(i, j, True, 1 if 8 <= p[0] < 16 and 4 <= p[1] < 12 else 2 if 30 <= p[0] < 38 and 4 <= p[1] < 12 else 0) for i in range(-20, 70) for j in range(-20, 70) if inside(p := at(i, j))]
    got = {(r.x, r.y): r.parcel for r in raster_cells.parcels_by_block(spark.createDataFrame(rows, "x int, y int, land boolean, house int"), 1.0).collect()}
    middle = [p for (i, j), v in got.items() if 17 <= (p := at(i, j))[0] <= 29]
    assert len(middle) > 100
    wrong = [1 for (i, j), v in got.items() if 4 <= (p := at(i, j))[0] <= 42 and v != (1 if p[0] < 22.7 else 2)]
    assert len(wrong) < 40


def test_texture_and_green(spark):
    rng = np.random.default_rng(8)
    v = {(i, j): rng.integers(0, 255, 3).tolist() for i in range(30) for j in range(25) if rng.random() < 0.95}
    cells = spark.createDataFrame([(*c, *map(int, rgb)) for c, rgb in v.items()], "x int, y int, r int, g int, b int")
    got = {(r.x, r.y): r for r in raster_cells.boundary_evidence(cells).collect()}
    assert len(got) == len(v)
    for (i, j), (r, gr, b) in v.items():
        near = [sum(v[c]) / 3 for a in range(-2, 3) for e in range(-2, 3) if (c := (i + a, j + e)) in v]
        assert abs(got[i, j].texture - np.std(near)) < 1e-6 and got[i, j].green == ((2 * gr - r - b) / 255 > 0.08)


def test_merge_rate(spark):
    """Two houses under one component, one alone, one hardly covered, a small one; components end with their tile."""
    house = lambda t, a, b, k, n=4: {(t, a + i, b + j): k for i in range(n) for j in range(4)}
    truth = house(0, 0, 0, 1) | house(0, 6, 0, 2) | house(0, 20, 0, 3) | house(1, 0, 0, 1) | house(0, 30, 0, 5, 2)
    pred = {(0, i, j) for i in range(10) for j in range(4)} | {(0, 20, j) for j in range(4)} | {(1, i, j) for i in range(3) for j in range(4)} | {(0, 30, j) for j in range(4)}
    cells = [(*c, truth.get(c, 0), int(c in pred)) for c in sorted(set(truth) | pred)]
    out = scoring.merge_rate(spark.createDataFrame(cells, "tile int, x int, y int, truth bigint, pred bigint"), 1.0).first()
    assert (out.scored, out.merged, out.merge_rate, out.components) == (3, 2, 0.6667, 4)


def test_neighbours_by_rims(spark):
    rng = np.random.default_rng(3)
    label = {(0, i, j): int(v) for i in range(30) for j in range(30) if (v := (i // 7 + 1) * 10 + j // 9 if rng.random() < 0.9 and i % 7 < 5 else 0)}
    want = set()
    for (_, a, b), v in label.items():
        for (_, c, d), w in label.items():
            if v < w and max(abs(a - c), abs(b - d)) <= 3:
                want.add((v, w))
    cells = spark.createDataFrame([(*c, v) for c, v in label.items()], "tile int, x int, y int, truth bigint")
    assert {(r.a, r.b) for r in scoring.neighbour_pairs(cells).collect()} == want


def test_visits_without_a_place(spark):
    visits = spark.createDataFrame([(1, 7, 5.0, 50.0), (2, 7, None, 1.0), (3, 8, 1.0, 1.0), (4, None, 1.0, 1.0), (5, 7, 5.0, 5.0)], "obs_id int, parcel_id bigint, x double, y double")
    parcel = spark.createDataFrame([(7, [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]])], "id bigint, geom array<array<array<struct<x:double,y:double>>>>")
    got = {r.obs_id: (r.distance_m, r.on_site) for r in comparison.visit_distances(visits, parcel).collect()}
    assert got == {1: (40.0, False), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0.0, True)}


def test_records_by_their_polygons(spark):
    """A record whose extent crosses the survey's corner lies outside; one that only touches it lies inside."""
    shapes = [[[[(9.0, 12.0), (12.0, 9.0), (12.0, 12.0)]]], [[[(5.0, 10.0), (7.0, 12.0), (3.0, 12.0)]]], [[[(-5.0, -5.0), (15.0, -5.0), (15.0, 15.0), (-5.0, 16.0)]]], None, []]
    rows = spark.createDataFrame([(i, {"k": str(i)}, s) for i, s in enumerate(shapes)], "row bigint, attrs map<string,string>, geom array<array<array<struct<x:double,y:double>>>>")
    assert sorted(r.row for r in layers.import_records(rows, (0.0, 0.0, 10.0, 10.0)).collect()) == [1, 2]


@pytest.mark.parametrize("size", [5, 50, 51, 30_000])
def test_patches_that_hold_a_place(spark, size):
    """As many patches as there are: their starts are no literals of the plan."""
    patch, stride = 8, 6
    at = layers.patches_at(F.col("id"), size, patch, stride)
    got = spark.range(-3, size + 3).filter("id < 60 or id > 29900").select("id", F.sort_array(at).alias("at"))
    starts = layers.patch_starts(size, patch, stride)
    assert {r.id: r["at"] for r in got.collect()} == {v: [s for s in starts if s <= v < s + patch] for v in range(-3, size + 3) if v < 60 or v > 29900}
    cells = spark.createDataFrame([(0, size - 1, True)], "x int, y int, mask boolean")
    assert len(layers.patches(cells, 5, size, patch, stride)._jdf.queryExecution().toString()) < 40_000
    assert {(r.patch_x, r.patch_y) for r in layers.patches(cells, 5, size, patch, stride).collect()} == {(0, s) for s in starts if s <= size - 1 < s + patch}


def joins_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_never_broadcast(spark):
    """Joins of cells that an explode makes: a table's size says nothing about their number."""
    cells = x.instances(spark, SF)
    masks = spark.range(40).select((F.col("id") % 2).alias("item"), F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(30))))
    frames = [scoring.neighbour_pairs(cells), tiles.training_cells(x.parcels(spark, SF), 2.0), voting.mask_pairs(masks), box_pairs(x.parcels(spark, SF).select("id", "x0", "y0", "x1", "y1"), x.parcels(spark, SF).select("id", "x0", "y0", "x1", "y1"))]
    for df in frames:
        assert "BroadcastExchange" not in joins_of(df) and "SortMergeJoin" in joins_of(df)


def test_outlines_of_many_rings(spark):
    """A label of 22,500 cells that stand alone, each with a ring of its own, is chained in a time that grows with its rings."""
    cells = spark.range(22_500).select((F.col("id") % 150 * 2).cast("int").alias("x"), (F.floor(F.col("id") / 150) * 2).cast("int").alias("y"), F.lit(1).alias("label"))
    began = time.time()
    out = regions.outlines(cells, 1.0).select("area", F.size("rings").alias("n"), F.array_max(F.transform("rings", F.size)).alias("most")).collect()
    assert [tuple(r) for r in out] == [(22_500.0, 22_500, 4)]
    assert time.time() - began < 30
