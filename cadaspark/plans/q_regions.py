"""Queries on regions of rasters, votes on masks and layouts of boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geometry import ring_length
from cadaspark.operators import layout, regions, scoring, voting
from cadaspark.plans import fixtures as x
from cadaspark.plans.q_rules import BR, INTER, MEET
from cadaspark.plans.q_scoring import CONT, N
from cadaspark.plans.registry import query


@query()
def absorbed_regions(spark, sf_dir):
    """Labels after small regions went to their neighbours."""
    return regions.absorbed(x.grid(spark, sf_dir).select("x", "y", F.col("mask").cast("int").alias("label")), 12)


@query()
def absorbed_enclosures(spark, sf_dir):
    """Labels after small enclosed regions went to the land around them."""
    return regions.enclosures_absorbed(x.grid(spark, sf_dir).select("x", "y", F.col("mask").cast("int").alias("label")), 4.0)


@query()
def road_strips(spark, sf_dir):
    """Strip-like regions of a raster."""
    road = x.grid(spark, sf_dir).filter((F.col("y") % 6 == 0) | ((F.col("x") % 9 == 0) & F.col("mask")))
    return regions.strips(road.select("x", "y", F.lit(1).alias("label")), 1.5)


@query()
def roof_merges(spark, sf_dir):
    """Parcels that share a house, with the parcel that they become."""
    cells = x.instances(spark, sf_dir).select((F.col("truth") * 8 + F.col("tile")).alias("parcel"), (F.col("pred") * 8 + F.col("tile")).alias("roof"), F.col("truth").alias("t"), F.col("pred").alias("p"))
    return regions.merged_by_roofs(cells.select(F.when(F.col("t") > 0, F.col("parcel")).otherwise(0).alias("parcel"), F.when(F.col("p") > 0, F.col("roof")).otherwise(0).alias("roof")), 4.0)


@query()
def fused_labels(spark, sf_dir):
    """A first layer with the regions that two scores agree on beside it."""
    g = x.grid(spark, sf_dir)
    scores = g.select("x", "y", (F.col("value") / 50).alias("a"), F.when(F.col("y") % 40 < 20, 0.9).otherwise(0.1).alias("b"))
    return regions.fused(g.filter("label = 4 and value > 40").select("x", "y", F.lit(1).alias("label")), scores)


@query(
    """select label, count(*) * 4.0::double as area_m2, sum(2.0::double * (4 - n)) as perimeter_m from (select g.x, g.y, g.label, count(h.x) as n from grid g left join grid h on abs(g.x - h.x) + abs(g.y - h.y) = 1 and h.label = g.label
    where g.label > 0 group by all) group by label"""
)
def cell_outlines(spark, sf_dir):
    """Outlines of label cells: area and length of the rings."""
    out = regions.outlines(x.grid(spark, sf_dir).filter("label > 0").select("x", "y", "label"), 2.0)
    return out.select("label", F.col("area").alias("area_m2"), F.aggregate(F.transform("rings", ring_length), F.lit(0.0), lambda a, v: a + v).alias("perimeter_m"))


TARGETS = "select x, y, ['complete', 'negative', 'weak', 'partial'][(x // 10 + y // 10) % 4 + 1] as kind, value > 47 as building, label = 2 and value <= 47 as green, label = 4 and value <= 47 as road from grid"


@query(
    """select x, y, case when kind = 'negative' then case when green then 'green' else 'other' end when building then 'building' when kind <> 'complete' and road then 'road' when green then 'green' when kind = 'complete' then 'not_building' else 'ignored' end as target,
    kind <> 'partial' or green or building or exists (select 1 from tcells b where b.kind = 'partial' and b.building and abs(b.x - t.x) + abs(b.y - t.y) <= 10) as known from tcells t""",
    tcells=TARGETS,
)
def training_targets(spark, sf_dir):
    """What each training cell should be, and whether it is known."""
    kind = F.element_at(F.array(*map(F.lit, ("complete", "negative", "weak", "partial"))), ((F.floor(F.col("x") / 10) + F.floor(F.col("y") / 10)) % 4 + 1).cast("int"))
    plain = F.col("value") <= 47
    cells = x.grid(spark, sf_dir).select("x", "y", kind.alias("kind"), (~plain).alias("building"), ((F.col("label") == 2) & plain).alias("green"), ((F.col("label") == 4) & plain).alias("road"))
    return regions.targets(cells).withColumn("target", F.coalesce("target", F.lit("ignored")))


#: Three detectors see a parcel, each moved by a little and not all of them.
DETECTED = """select id * 4 + m as item, id, m, ((id * 7 + m * 13) % 100)::double / 100 as score, x0 + m * (id % 2) as x0, y0, x1 + m * (id % 2) as x1, y1 from parcels, range(0, 3) r(m) where (id + m) % 4 <> 0 and id % 5 <> 0"""
SITES = "select id, count(*) as votes, avg(score) as mean, arg_min(item, (-score, item)) as cluster_id from detected group by id having count(*) >= 2 or avg(score) >= 0.85"
SEEN = """select id, cx, cy, count(*) as n from detected, unnest(generate_series(x0::bigint, x1::bigint - 1)) as u(cx), unnest(generate_series(y0::bigint, y1::bigint - 1)) as v(cy) group by all"""


@query(
    """select cluster_id as cluster, votes, round(mean * least(1, votes / 3), 5) as score, (select count(*) from seen where seen.id = sites.id and seen.n >= 0.5 * votes) as cells from sites""",
    detected=DETECTED,
    sites=SITES,
    seen=SEEN,
)
def mask_votes(spark, sf_dir):
    """Clusters of masks that detectors agree on, with the size of their fused mask."""
    i, m = F.col("id"), F.col("m")
    boxes = x.parcels(spark, sf_dir).withColumn("m", F.explode(F.array(*map(F.lit, range(3))))).filter(((i + m) % 4 != 0) & (i % 5 != 0))
    items = boxes.select((i * 4 + m).alias("item"), m.alias("member"), (((i * 7 + m * 13) % 100) / 100).alias("score"))
    cells = boxes.select((i * 4 + m).alias("item"), (F.col("x0") + m * (i % 2)).cast("bigint").alias("a"), (F.col("x1") + m * (i % 2)).cast("bigint").alias("b"), F.col("y0").cast("bigint").alias("c"), F.col("y1").cast("bigint").alias("d"))
    masks = cells.withColumn("x", F.explode(F.sequence(F.col("a"), F.col("b") - 1))).withColumn("y", F.explode(F.sequence(F.col("c"), F.col("d") - 1))).select("item", "x", "y")
    kept, _ = voting.voted_masks(items, masks, 3)
    return kept.withColumn("score", F.round("score", 5))


@query(
    """select count(*) filter (where iou >= 0.5) as matched, count(*) filter (where coalesce(iou, 0) < 0.5 and coalesce(hit, 0) / n >= 0.5) as part, count(*) filter (where coalesce(iou, 0) < 0.5 and coalesce(hit, 0) / n < 0.5) as off
    from (select tile, pred, sum(inter) as n from cells_n where pred > 0 group by all) left join (select tile, pred, max(iou) as iou, sum(inter) as hit from cont group by all) using (tile, pred)""",
    cells_n=N,
    cont=CONT,
)
def shape_kinds(spark, sf_dir):
    """Predicted shapes that match a label, lie on labels in part, or are off them."""
    cells = x.instances(spark, sf_dir)
    return voting.shape_kinds(scoring.contingency(cells), cells.filter("pred > 0").groupBy("tile", "pred").agg(F.count("*").alias("n")))


@query("select count(*) as folds, round(avg(r), 3) as recall_mean, round(avg(p), 3) as precision_mean from (select l_linenumber, avg((l_returnflag = 'R')::int) as r, avg(l_discount) as p from lineitem group by 1)")
def fold_means(spark, sf_dir):
    """Means of a metric over folds."""
    folds = x.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("recall"), F.avg("l_discount").alias("precision"))
    return voting.fold_means(folds, ["recall", "precision"])


@query(
    """select id, i, j, least(x0 + (i + 1) * 35, x1) - (x0 + i * 35) as width, least(y0 + (j + 1) * 35, y1) - (y0 + j * 35) as height from zones, unnest(generate_series(0, 2)) a(i), unnest(generate_series(0, 2)) b(j)
    where label = 'Agricultural' and (least(x0 + (i + 1) * 35, x1) - (x0 + i * 35)) * (least(y0 + (j + 1) * 35, y1) - (y0 + j * 35)) >= 25 union all select id, -1, -1, x1 - x0, y1 - y0 from zones where label <> 'Agricultural'"""
)
def open_parcels(spark, sf_dir):
    """Open land as parcels: fields in cells, the rest whole."""
    out = layout.open_parcels(x.zones(spark, sf_dir).withColumnRenamed("label", "landuse"))
    return out.select("id", F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("j", F.lit(-1)).alias("j"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


@query(
    """select id % 40 as block, round(least(18, greatest(6, case when count(*) >= 3 then quantile_cont(x1 - x0, 0.35) + 1.5 else (select least(25, greatest(6, quantile_cont(least(x1 - x0, y1 - y0), 0.5) + 3)) from buildings) end)), 4) as width_m from buildings group by 1"""
)
def plot_widths(spark, sf_dir):
    """Typical plot width of each block."""
    b = x.buildings(spark, sf_dir)
    houses = b.select((F.col("id") % 40).alias("block"), (F.col("x1") - F.col("x0")).alias("width"), F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("narrow"))
    return layout.plot_widths(houses).withColumn("width_m", F.round("width_m", 4))


@query(
    """select count(*) as polygons, round(avg((exists (select 1 from parcels b where a.id <> b.id and least(a.x1 + 0.05, b.x1) >= greatest(a.x0 - 0.05, b.x0) and least(a.y1 + 0.05, b.y1) >= greatest(a.y0 - 0.05, b.y0)
    and 2 * (least(a.x1 + 0.05, b.x1) - greatest(a.x0 - 0.05, b.x0) + least(a.y1 + 0.05, b.y1) - greatest(a.y0 - 0.05, b.y0)) > 1))::int), 3) as share_touching from parcels a"""
)
def touching_share(spark, sf_dir):
    """Share of parcels that touch another."""
    return layout.touching_share(x.parcels(spark, sf_dir))


@query("select tx, ty, count(*) as footprints from (select unnest(generate_series(floor(x0 / 60)::bigint, floor(x1 / 60)::bigint)) as tx, y0, y1 from buildings), lateral (select unnest(generate_series(floor(y0 / 60)::bigint, floor(y1 / 60)::bigint))) t(ty) group by all having count(*) >= 6")
def candidate_tiles(spark, sf_dir):
    """Tiles with at least six footprints."""
    return layout.candidate_tiles(x.buildings(spark, sf_dir), 60.0)


BOTH = "select cx, cy, bool_or(a) as a, bool_or(not a) as b from ({0} union all {1}) group by all".format(
    *[f"select {flag} as a, unnest(generate_series(x0::bigint, x1::bigint - 1)) as cx, cy from {t}, lateral (select unnest(generate_series(y0::bigint, y1::bigint - 1))) u(cy)" for t, flag in (("parcels", "true"), ("government", "false"))]
)


@query("select case when a and b then 'both' when a then 'first' else 'second' end as kind, count(*) as cells from both_layers group by 1", both_layers=BOTH)
def layer_algebra(spark, sf_dir):
    """Square metres of parcels and government land: shared, and of one alone."""
    return layout.layer_algebra(x.parcels(spark, sf_dir), x.government(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("cells"))


@query(f"select b.id, round(coalesce(t, 0), 3) as taken, coalesce(t, 0) <= 0.1 * (x1 - x0) * (y1 - y0) as orphan from government b left join (select b.id, sum({INTER.format('p')}) as t from government b join parcels p on p.id <> b.id and {MEET.format('p')} group by b.id) s on s.id = b.id")
def orphan_holes(spark, sf_dir):
    """Enclosed areas that no other parcel fills."""
    out = layout.orphan_holes(x.government(spark, sf_dir).withColumn("owner", F.col("id")), x.parcels(spark, sf_dir))
    return out.withColumn("taken", F.round("taken", 3))


@query(f"select b.id, coalesce(max(o.parcel), arg_min(r.id, ({BR}, r.id))) as parcel from government b join parcels r on true left join (select b.id, arg_min(p.id, (-round({INTER.format('p')}, 6), p.id)) as parcel from government b join parcels p on {MEET.format('p')} group by b.id) o on o.id = b.id group by b.id")
def assigned_faces(spark, sf_dir):
    """Each face's parcel: the one that it covers most, else the nearest."""
    return layout.assigned(x.government(spark, sf_dir), x.parcels(spark, sf_dir))


STRIPS = "select id, x1 as x0, y0, x1 + 2 as x1, y1 from parcels"
RIMS = "select id, x0 - 0.05 as x0, y0 - 0.05 as y0, x1 + 0.05 as x1, y1 + 0.05 as y1 from parcels"


@query(f"select b.id, arg_min(p.id, (-round({INTER.format('p')}, 6), p.id)) as parcel from strip_land b join rim_land p on {MEET.format('p')} group by b.id", strip_land=STRIPS, rim_land=RIMS)
def restored_land(spark, sf_dir):
    """The parcel that takes each piece of uncovered land."""
    p = x.parcels(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")
    return layout.restored(p.select("id", F.col("x1").alias("x0"), "y0", (F.col("x1") + 2).alias("x1"), "y1"), p)
