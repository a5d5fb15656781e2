"""Operators without a SQL twin against plain loops, and invariants of repairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadaspark.operators import cells as c
from cadaspark.operators import graph
from cadaspark.operators import topology as t
from cadaspark.operators.graph import components, shared_folder
from cadaspark.plans import fixtures as x
from cadaspark.plans import registry
from cadaspark.sources import layers
from cadaspark.streaming import visits as v

SF = "/root/testdata/sf0.001"


def flood(points):
    left, out = set(points), {}
    while left:
        todo, piece = [left.pop()], []
        while todo:
            a, b = todo.pop()
            piece.append((a, b))
            for d, e in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                if (a + d, b + e) in left:
                    left.remove((a + d, b + e))
                    todo.append((a + d, b + e))
        name = min(q << 32 | p for p, q in piece)
        out |= dict.fromkeys(piece, name)
    return out


def test_label_components(spark):
    rng = np.random.default_rng(3)
    points = [(int(a), int(b)) for a, b in zip(*np.nonzero(rng.random((25, 25)) < 0.55), strict=True)]
    got = c.label_components(spark.createDataFrame(points, "x int, y int")).collect()
    assert {(r.x, r.y): r.component for r in got} == flood(points)


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), 500, 501, 900]], "node bigint")
    got = {r.node: r.component for r in components(nodes, links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 900: 900}


def test_ground_filter_is_tile_independent(spark):
    rng = np.random.default_rng(5)
    z = np.round(np.add.outer(np.arange(40) * 0.02, np.arange(40) * 0.01), 2)
    z[10:14, 20:26] += 6  # a building
    cells = spark.createDataFrame([(int(i), int(j), float(z[j, i] + 0.01 * rng.random())) for j in range(40) for i in range(40)], "x int, y int, value double")
    wide = c.ground_filter(cells, tile=64).toPandas().set_index(["x", "y"]).sort_index()
    tiled = c.ground_filter(cells, tile=16).toPandas().set_index(["x", "y"]).sort_index()
    pd.testing.assert_frame_equal(wide, tiled)
    raised = {(i, j) for (i, j), g in wide["ground"].items() if not g}
    assert {(i, j) for j in range(10, 14) for i in range(20, 26)} == raised


def test_ground_and_terrain_with_missing_cells(spark):
    """Against the whole raster at once; tiles do not show, and missing cells are no ground."""
    rng = np.random.default_rng(8)
    n, m = 70, 45
    z = np.add.outer(np.arange(n) * 0.03, np.arange(m) * 0.02) + rng.normal(0, 0.02, (n, m))
    z[20:29, 10:18] += 5
    z[50:53, 30:33] += 2
    z[rng.random((n, m)) < 0.04] = np.nan
    z[0, 0], z[22:24, 9:12] = np.nan, np.nan
    rows = [(j, i, float(z[i, j])) for i in range(n) for j in range(m) if not (np.isnan(z[i, j]) and (i + j) % 2)]  # some as NaN, some without a row
    cells = spark.createDataFrame(rows, "x int, y int, value double")
    surface, want = np.where(np.isnan(z), np.nanmax(z), z), np.isfinite(z)
    drop = 0.3
    for w, before in zip(c.WINDOWS, (0.0, *c.WINDOWS), strict=False):
        r = max(3, round(w) | 1) // 2
        box = lambda a, f: np.array([[f(a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]) for j in range(m)] for i in range(n)])  # noqa: B023, E731
        opened = box(box(surface, np.min), np.max)
        want &= surface - opened <= drop
        drop, surface = min(2.5, 0.15 * (w - before) + 0.3), opened
    for tile in (16, 256):
        got = c.ground_filter(cells, tile=tile).collect()
        assert len(got) == len(rows) and all(r.ground == want[r.y, r.x] for r in got)
    assert not want[24, 14] and want[5, 40]
    spots = [(i, j) for i in range(n) for j in range(m) if want[i, j]]
    base = z.copy()
    for j, i, _ in rows:
        if not want[i, j]:
            base[i, j] = min(((a - i) ** 2 + (b - j) ** 2, z[a, b]) for a, b in spots)[1]
    inside = {(j, i) for j, i, _ in rows}
    for tile in (16, 256):
        for r in c.terrain(cells, tile=tile).collect():
            near = [(min(max(a, 0), n - 1), min(max(b, 0), m - 1)) for a in (r.y - 1, r.y, r.y + 1) for b in (r.x - 1, r.x, r.x + 1)]
            if all((b, a) in inside for a, b in near):
                smooth = np.mean([base[a, b] for a, b in near])
                low = smooth if np.isnan(z[r.y, r.x]) else min(smooth, z[r.y, r.x])
                assert abs(r.dtm - low) < 1e-9
                assert np.isnan(z[r.y, r.x]) or abs(r.ndsm - max(0, z[r.y, r.x] - low)) < 1e-9


def test_nearest_fill_at_any_distance(spark):
    seeds = [(0, 0, 3), (1, 0, 3), (0, 1, 2), (300, 4, 9)]
    empty = [(5, 5), (150, 2), (149, 3), (900, 900), (2, 0)]
    got = {(r.x, r.y): (r.label, r.d2) for r in c.nearest_fill(spark.createDataFrame(empty, "x int, y int"), spark.createDataFrame(seeds, "x int, y int, label int")).collect()}
    assert got == {e: min((((e[0] - x) ** 2 + (e[1] - y) ** 2), k) for x, y, k in seeds)[::-1] for e in empty}


def test_sessions_over_micro_batches(spark, tmp_path):
    """A session that goes on in the next micro-batch is one session."""
    rows = [(1, 7, "2024-01-01 10:00:00"), (2, 8, "2024-01-01 10:30:00"), (3, 7, "2024-01-01 11:00:00")]
    df = spark.createDataFrame(rows, "obs_id bigint, parcel_id bigint, time string").withColumn("time", F.to_timestamp("time"))
    for part in (df.filter("obs_id <= 2"), df.filter("obs_id = 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = v.source(spark, str(tmp_path / "in"), df.schema, 1)
    got = sorted((r.parcel_id, r.visits) for r in v.run(v.sessions(stream), "sessions", "complete").collect())
    assert got == [(7, 2), (8, 1)]


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    try:
        shared_folder(Session(), "x")
    except ValueError:
        return
    raise AssertionError("a cluster's executors cannot share a local folder")


def test_auto_fix_leaves_no_overlap_and_keeps_the_ground(spark):
    boxes = x.parcels(spark, SF).unionByName(x.parcels(spark, SF).filter("id % 50 = 0").withColumn("id", F.col("id") + 10_000))
    fixed, log = t.auto_fix(boxes)
    assert fixed.groupBy("cx", "cy").count().filter("count > 1").isEmpty()
    before = t.box_cells(boxes).select("cx", "cy").distinct()
    assert before.exceptAll(fixed.select("cx", "cy")).isEmpty() and fixed.select("cx", "cy").exceptAll(before).isEmpty()
    assert fixed.groupBy("id").count().filter("count < 12").isEmpty()
    assert log.filter("action = 'removed duplicate'").count() == 4


def test_cells_of_the_fix_are_never_broadcast(spark, monkeypatch):
    plans, write = {}, t.written
    monkeypatch.setattr(t, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    t.auto_fix(x.parcels(spark, SF))
    assert "fix-owner" in plans and "Inner, Build" not in plans["fix-owner"]


def test_issues_do_not_depend_on_order_or_partitions(spark):
    layer = x.parcels_dirty(spark, SF)
    a = t.issues(layer).groupBy("type").count().orderBy("type").collect()
    b = t.issues(layer.orderBy(F.rand(3)).repartition(7)).groupBy("type").count().orderBy("type").collect()
    assert a == b and a


def test_rows_only_queries_have_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() >= 1, name


def test_late_visits_do_not_override(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 10:00:00", "confirmed"), (2, 7, "2024-01-01 09:00:00", "not_a_parcel"), (3, 8, "2024-01-02 09:00:00", "boundary_wrong")]
    df = spark.createDataFrame(rows, "obs_id bigint, parcel_id bigint, time string, verdict string").withColumn("time", F.to_timestamp("time"))
    for k, part in enumerate([df.filter("obs_id = 1"), df.filter("obs_id > 1")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.parcel_id: (r.field_verdict, r.status) for r in v.newest(v.run(v.latest_status(stream), "late", "update"), "parcel_id").collect()}
    assert got == {7: ("confirmed", "approved"), 8: ("boundary_wrong", "field_check")}


def test_geojson_file_and_logs(spark, tmp_path):
    (tmp_path / "l.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":1,"a":null},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[78.1,17.2]}},{"type":"Feature","properties":{},"geometry":null}]}')
    got = layers.features(spark, str(tmp_path / "l.geojson")).collect()
    assert [r.kind for r in got] == ["Polygon", "Point", None] and got[1].lon == 78.1 and len(got[0].geom[0][0]) == 4
    log = str(tmp_path / "log")
    layers.append_log(spark.createDataFrame([(1, "a")], "id int, note string"), log)
    layers.append_log(spark.createDataFrame([(2, "b")], "id int, note string"), log)
    assert {r.id for r in layers.read_log(spark, log, "id int, note string").collect()} == {1, 2}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


@pytest.mark.parametrize("most", [200_000, 300])
def test_rounds_of_components_do_not_grow_with_the_width(spark, monkeypatch, most):
    """A chain of 2,000 nodes with names in no order, whose edges fill one task or several."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", most)
    tables, write = [], graph.write_table
    monkeypatch.setattr(graph, "write_table", lambda df, name: tables.append(name) or write(df, name))
    names = np.random.default_rng(7).permutation(2000).tolist()
    links = spark.createDataFrame([*zip(names, names[1:]), (3000, 3001)], "a bigint, b bigint").repartition(4)
    got = {r.node: r.component for r in components(spark.range(3003).toDF("node").filter("node < 2000 or node >= 3000"), links).collect()}
    assert got == {**dict.fromkeys(range(2000), 0), 3000: 3000, 3001: 3000, 3002: 3002}
    assert len(tables) <= 12
