"""Queries on the work around models, and on extents and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.operators import scoring, tiles, topology
from cadaspark.operators.spatial import overlay
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query


@query(
    """select id as node, min(id) over (partition by j, run) as component, (i - min(i) over (partition by j, run)) * 20.0::double as dx from (
    select *, sum(brk) over (partition by j order by i) as run from (select p_partkey as id, (p_partkey % 50)::int as i, p_partkey // 50 as j, (p_size % 9 = 0)::int as brk from part))"""
)
def tile_groups(spark, sf_dir):
    """Tiles overlap their western neighbour unless their size says otherwise."""
    k = F.col("p_partkey")
    part = x.table(spark, sf_dir, "part")
    edges = part.filter((F.col("p_size") % 9 != 0) & (k % 50 > 0)).select((k - 1).alias("a"), k.alias("b"), F.lit(20.0).alias("dx"), F.lit(0.0).alias("dy"))
    return tiles.placed_tiles(part.select(k.alias("node")), edges).select("node", "component", "dx")


CELLS = """select cx, cy, min(id) as id from (select id, unnest(generate_series(ceil(x0 / 2 - 0.5)::int, ceil(x1 / 2 - 0.5)::int - 1)) as cx, y0, y1 from parcels where status = 'approved'),
    lateral (select unnest(generate_series(ceil(y0 / 2 - 0.5)::int, ceil(y1 / 2 - 0.5)::int - 1))) t(cy) group by all"""


@query(
    """select boundary, count(*) as cells from (select c.cx, c.cy, count(*) filter (where o.id = c.id) < 4 as boundary from owned c left join owned o on abs(c.cx - o.cx) + abs(c.cy - o.cy) = 1
    and o.cx between c.cx - 1 and c.cx + 1 group by all) group by boundary""",
    owned=CELLS,
)
def training_cells(spark, sf_dir):
    return tiles.training_cells(x.parcels(spark, sf_dir), 2.0).groupBy("boundary").agg(F.count("*").alias("cells"))


@query(
    """select g.x, g.y, case when count(h.x) = 0 then 'ground' when min(h.label) <> max(h.label) then 'seam' when count(h.x) = 9 then 'core' else 'ignore' end as kind from grid g
    left join grid h on abs(g.x - h.x) <= 1 and abs(g.y - h.y) <= 1 and h.label > 2 group by g.x, g.y"""
)
def weak_labels(spark, sf_dir):
    g = x.grid(spark, sf_dir).withColumn("label", F.when(F.col("label") > 2, F.col("label")).otherwise(0))
    return tiles.weak_labels(g)


@query(
    """select g.x, g.y, case when g.value = 1 then 'ignore' when g.y % 7 = 3 and g.label > 2 then 'ignore' when g.y % 7 = 3 then 'road' when count(h.x) = 0 then 'ground' when min(h.label) <> max(h.label) then 'seam' when count(h.x) = 9 then 'core' else 'ignore' end as kind from grid g
    left join grid h on abs(g.x - h.x) <= 1 and abs(g.y - h.y) <= 1 and h.label > 2 group by g.x, g.y, g.label, g.value"""
)
def labels_with_roads(spark, sf_dir):
    """Weak labels of footprints and roads; where they contradict one another nothing is taught."""
    g = x.grid(spark, sf_dir).withColumn("label", F.when(F.col("label") > 2, F.col("label")).otherwise(0))
    return tiles.labels_with_roads(g.withColumn("road", F.col("y") % 7 == 3).withColumn("valid", F.col("value") != 1))


@query("select count(*) as footprints, count(*) filter (where s >= 0.5) as found from (select truth, avg((pred > 0)::int) as s from instances where truth > 0 group by truth)")
def footprint_recall(spark, sf_dir):
    return tiles.footprint_recall(x.instances(spark, sf_dir))


@query("select id, status from parcels where source <> 'edited' and status not in (select status from parcels where id % 400 = 1)")
def leak_free_split(spark, sf_dir):
    p = x.parcels(spark, sf_dir)
    return tiles.leak_free(p.filter("source <> 'edited'"), p.filter("id % 400 = 1"), "status").select("id", "status")


@query(
    """select user_id, event_id, size from (select user_id, event_id, count(*) over (partition by user_id) as size, row_number() over (partition by user_id order by event_id) as k from events)
    where k = size // 2 + 1 order by size, user_id limit 20"""
)
def middle_frames(spark, sf_dir):
    return tiles.middle_items(x.table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("select x, y, value from (select a.x, b.y from (select unnest(generate_series(min(x) - 2, max(x) + 2)) as x from grid) a, (select unnest(generate_series(min(y) - 2, max(y) + 2)) as y from grid) b) t left join grid using (x, y)")
def tile_mosaic(spark, sf_dir):
    """The mosaic of all tiles and a margin of two, missing ones as nulls."""
    g = x.grid(spark, sf_dir).select("x", "y", "value")
    west, north, east, south = g.agg(F.min("x") - 2, F.min("y") - 2, F.max("x") + 2, F.max("y") + 2).first()
    return tiles.tiles_of_box(g, west, north, east, south).select("x", "y", "value")


@query("select x // 3 as x, y // 3 as y, round(avg(case when label <> 0 then value end), 5) as value, round(count(*) filter (where label <> 0) / 9, 5) as coverage from grid group by 1, 2")
def aligned_raster(spark, sf_dir):
    """A raster on a grid three times as coarse; missing cells do not count."""
    g = x.grid(spark, sf_dir).select("x", "y", F.when(F.col("label") != 0, F.col("value")).alias("value"))
    return tiles.aligned(g, 3).withColumn("value", F.round("value", 5)).withColumn("coverage", F.round("coverage", 5))


@query()
def survey_mask(spark, sf_dir):
    """Cells of a survey: no-data inside it counts, no-data at its edge does not."""
    return tiles.survey_mask(x.grid(spark, sf_dir).select("x", "y", F.when(F.col("mask"), F.col("value")).alias("value")))


ROWS = "select p_partkey // 3 as g, count(distinct p_partkey // 50) as lines, min(p_partkey) as id, count(*) as n from part group by 1"


@query("select g as grp, id, n * 400.0::double as area_m2 from row_groups where lines = 1", row_groups=ROWS)
def merge_parcels(spark, sf_dir):
    """Parcels merged by threes; groups that do not share a border are refused, the largest parcel's id stays."""
    k = F.col("p_partkey")
    base = x.table(spark, sf_dir, "part").select(k.alias("id"), (k % 50 * 20).cast("double").alias("x0"), (F.floor(k / 50) * 20).cast("double").alias("y0"))
    layer = x.geoms(base.withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 20))
    out = topology.merged_parcels(layer, base.select("id", F.floor(F.col("id") / 3).alias("group")))
    return out.select(F.col("group").alias("grp"), "id", F.col("area").alias("area_m2"))


@query()
def road_classifier(spark, sf_dir):
    cells = x.pixels(spark, sf_dir).select("prob", "height_m", (F.col("zone") % 2).cast("int").alias("fold"), (F.col("prob") * 3 + F.col("height_m") / 10 > 4).cast("int").alias("road"))
    return tiles.cell_classifier(cells, ["prob", "height_m"], "road")


@query("select min(x0) - 30 as west, min(y0) - 30 as south, max(x1) + 30 as east, max(y1) + 30 as north, round(avg((x0 + x1) / 2), 4) as mid_x, round(avg((y0 + y1) / 2), 4) as mid_y from parcels")
def layer_extent(spark, sf_dir):
    out = tiles.layer_extent(x.parcels(spark, sf_dir), 30)
    return out.withColumn("mid_x", F.round("mid_x", 4)).withColumn("mid_y", F.round("mid_y", 4))


@query(
    """select quantile_cont(a, 0.1) as p10, quantile_cont(a, 0.5) as p50, quantile_cont(a, 0.9) as p90, round(quantile_cont(a, 0.99), 4) as p99, count(*) filter (where a > 300) as large
    from (select (x1 - x0) * (y1 - y0) as a from parcels)"""
)
def area_profile(spark, sf_dir):
    return tiles.area_profile(x.parcels(spark, sf_dir), box_area(), 300).withColumn("p99", F.round("p99", 4))


@query("select id, greatest(x0, 100) as x0, greatest(y0, 50) as y0, least(x1, 700) as x1, least(y1, 600) as y1 from parcels where x0 < 700 and x1 > 100 and y0 < 600 and y1 > 50")
def clipped_to_extent(spark, sf_dir):
    """Boxes cut to a survey's extent; what lies outside is refused."""
    return tiles.clipped(x.parcels(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), (100, 50, 700, 600))


@query("select round(avg(l_quantity) filter (where l_discount >= 0.05), 4) as found_mean, round(avg(l_quantity) filter (where l_discount < 0.05), 4) as missed_mean from lineitem")
def found_contrast(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem").withColumn("found", F.col("l_discount") >= 0.05)
    out = scoring.contrast(li, "found", F.col("l_quantity"))
    return out.select(F.round("found_mean", 4).alias("found_mean"), F.round("missed_mean", 4).alias("missed_mean"))


@query(
    """select count(*) as truths, count(*) filter (where hit) as hit from (select b.id, exists (select 1 from parcels p where p.confidence >= 0.3 and b.x0 < p.x1 and p.x0 < b.x1 and b.y0 < p.y1 and p.y0 < b.y1) as hit from buildings b)"""
)
def hit_recall(spark, sf_dir):
    b = x.buildings(spark, sf_dir)
    hits = overlay(b, x.parcels(spark, sf_dir).filter("confidence >= 0.3").select("id", "x0", "y0", "x1", "y1")).select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return b.join(hits, "id", "left").agg(F.count("*").alias("truths"), F.count("hit").alias("hit"))


@query(
    """select p_brand as area, count(*) filter (where p_size % 6 = 0) as buildings, count(*) filter (where p_size % 6 = 1) as roads, count(*) filter (where p_size % 6 = 3) as water from part group by p_brand"""
)
def tag_probe(spark, sf_dir):
    """Elements of each kind by candidate area, from their tags."""
    tags = F.element_at(F.array(*[F.create_map(F.lit(a), F.lit("x")) for a in ("building", "highway", "railway", "water", "amenity", "landuse")]), (F.col("p_size") % 6 + 1).cast("int"))
    df = x.table(spark, sf_dir, "part").select(F.col("p_brand").alias("area"), tags.alias("tags"))
    has = lambda k: F.count_if(F.map_contains_key("tags", k))
    return df.groupBy("area").agg(has("building").alias("buildings"), has("highway").alias("roads"), has("water").alias("water"))


@query(
    """select id, round(km2, 6) as km2, round(km2, 6) > 0.35 as refused from (select o_orderkey as id, o_custkey % 90 / 1e4 * 111.32 * cos(radians(20 + o_orderkey % 50 / 2e4)) * (o_orderkey % 50 / 1e4) * 111.32 as km2 from orders where o_custkey % 90 > 0 and o_orderkey % 50 > 0)"""
)
def area_limits(spark, sf_dir):
    """Areas that someone asked for, and whether they are too large."""
    o = x.table(spark, sf_dir, "orders").filter("o_custkey % 90 > 0 and o_orderkey % 50 > 0")
    boxes = o.select(F.col("o_orderkey").alias("id"), F.lit(78.0).alias("west"), F.lit(20.0).alias("south"), (78 + F.col("o_custkey") % 90 / 1e4).alias("east"), (20 + F.col("o_orderkey") % 50 / 1e4).alias("north"))
    out = tiles.area_requests(boxes).withColumn("km2", F.round("km2", 6))
    return out.select("id", "km2", (F.col("refused") & (F.col("km2") > 0.35)).alias("refused"))


BLEND = """select x, y, least(least(i + 1, 16 - i), least(j + 1, 16 - j))::double as w, (value * (1 + tx + ty) % 10) / 10 as p from (select x, y, value, tx, ty, x - 8 * tx as i, y - 8 * ty as j from grid, unnest(generate_series(x // 8 - 1, x // 8)) a(tx), unnest(generate_series(y // 8 - 1, y // 8)) b(ty))"""


@query("select x, y, round(sum(w * p) / sum(w), 6) as score from blend group by x, y", blend=BLEND)
def blended_tiles(spark, sf_dir):
    """Scores of overlapping tiles, weighted by the distance to a tile's edge."""
    from cadaspark.operators.zonal import blended

    g = x.grid(spark, sf_dir).select("x", "y", "value")
    at = lambda c: F.explode(F.sequence(F.floor(F.col(c) / 8) - 1, F.floor(F.col(c) / 8)))
    t = g.withColumn("tx", at("x")).withColumn("ty", at("y")).withColumn("i", F.col("x") - 8 * F.col("tx")).withColumn("j", F.col("y") - 8 * F.col("ty"))
    t = tiles.weighted(t, 16).select(F.struct("x", "y").alias("cell"), "w", (F.col("value") * (1 + F.col("tx") + F.col("ty")) % 10 / 10).alias("p"))
    return blended(t).select("cell.x", "cell.y", F.round("score", 6).alias("score"))


@query("select id, x, case when x >= 600 then 'test' else 'train' end as fold from (select p_partkey as id, p_partkey % 50 * 20 as x, p_size % 20 / 20 as c from part) where c >= 0.9 and (x >= 600 or x + 64 <= 560)")
def crop_split(spark, sf_dir):
    """Covered crops on either side of a line; those that straddle it go."""
    k = F.col("p_partkey")
    crops = x.table(spark, sf_dir, "part").select(k.alias("id"), (k % 50 * 20).alias("x"), (F.col("p_size") % 20 / 20).alias("coverage"))
    return tiles.crop_split(crops, 600, 64, 40).select("id", "x", "fold")


@query(
    """select count(*) as cells from (select distinct cx + dx, cy + dy from owned, range(-2, 3) a(dx), range(-2, 3) b(dy))""",
    owned=CELLS,
)
def training_region(spark, sf_dir):
    """Cells around approved parcels that a training crop takes in."""
    return tiles.region_cells(x.parcels(spark, sf_dir), 2.0).agg(F.count("*").alias("cells"))
