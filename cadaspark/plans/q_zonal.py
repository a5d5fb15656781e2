"""Queries on zonal statistics and land cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions import rules
from cadaspark.functions.geometry import box_area
from cadaspark.operators import zonal as z
from cadaspark.operators.spatial import containing
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query

STATS = """select zone, count(*) as cells, count(*) filter (where class = 8) as built, count(*) filter (where class in (2, 5, 7)) as green, avg(prob) as certainty,
    quantile_cont(height_m, 0.5) filter (where class = 8) as height_m from pixels group by zone"""


@query("select zone, cells, built, green, round(certainty, 6) as certainty from zstats", zstats=STATS)
def zonal_stats(spark, sf_dir):
    return z.zonal_stats(x.pixels(spark, sf_dir)).select("zone", "cells", "built", "green", F.round("certainty", 6).alias("certainty"))


@query("select zone, round(height_m, 3) as height_m, case when height_m > 1.5 then greatest(1, round(height_m / 3)::int) end as storeys from zstats where height_m is not null", zstats=STATS)
def median_height_storeys(spark, sf_dir):
    return z.zonal_stats(x.pixels(spark, sf_dir)).filter("height_m is not null").select("zone", F.round("height_m", 3).alias("height_m"), "storeys")


@query("select zone, " + ", ".join(f"count(*) filter (where class = {k}) as c{k}" for k in range(1, 9)) + " from pixels group by zone")
def zone_class_pivot(spark, sf_dir):
    return z.class_counts(x.pixels(spark, sf_dir))


NAMES = "['bare land', 'grass / scrub', 'paved / developed', 'road', 'tree', 'water', 'agriculture', 'building']"
SHARES = f"select zone, {NAMES}[class] as name, count(*) as n, sum(count(*)) over (partition by zone) as t from pixels group by zone, class"


@query("select zone, name, round(100 * n / t, 1) as pct from shares where round(100 * n / t, 1) >= 1", shares=SHARES)
def land_cover_map(spark, sf_dir):
    return z.cover_shares(x.pixels(spark, sf_dir)).select("zone", F.explode("percent").alias("name", "pct"))


EVIDENCE = """select p.id as zone, count(b.id) as buildings, coalesce(max((b.x1 - b.x0) * (b.y1 - b.y0)), 0) as largest, max((p.x1 - p.x0) * (p.y1 - p.y0)) as area, max(p.id % 20) as front
    from parcels p left join buildings b on (b.x0 + b.x1) / 2 >= p.x0 and (b.x0 + b.x1) / 2 < p.x1 and (b.y0 + b.y1) / 2 >= p.y0 and (b.y0 + b.y1) / 2 < p.y1 group by p.id"""
TOP = "select zone, arg_max(name, (n / t, name)) as top, max(n / t) as top_share from shares where name <> 'building' group by zone"


@query(
    """select s.zone, case when built / cells >= 0.35 then 'Built-up' when top is null or top_share < 0.2 then 'Open / vacant land' when top = 'bare land' then 'Barren land'
      when top in ('grass / scrub', 'tree', 'agriculture') then 'Vegetated open land' when top = 'water' then 'Water' else 'Paved / developed open land' end as landcover,
    case when coalesce(w.n / w.t, 0) >= 0.5 then 'Water body' when buildings = 0 and green / cells >= 0.5 then 'Open space / green' when buildings = 0 then 'Vacant plot'
      when largest >= 1500 or area >= 3000 then 'Institutional / large complex' when height_m > 1.5 and round(height_m / 3) >= 4 and largest >= 300 then 'Residential - apartments'
      when front >= 12 and built / cells >= 0.7 then 'Commercial / mixed use' else 'Residential' end as land_use
    from zstats s join evidence e using (zone) left join top_cover c using (zone) left join (select * from shares where name = 'water') w using (zone)""",
    zstats=STATS,
    shares=SHARES,
    evidence=EVIDENCE,
    top_cover=TOP,
)
def land_use_rules(spark, sf_dir):
    p, b = x.parcels(spark, sf_dir), x.buildings(spark, sf_dir)
    centres = b.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), box_area().alias("area"))
    own = containing(centres, p.select("id", "x0", "y0", "x1", "y1")).groupBy(F.col("b_id").alias("zone")).agg(F.count("*").alias("buildings"), F.max("a_area").alias("largest_m2"))
    evidence = p.select(F.col("id").alias("zone"), box_area().alias("area_m2"), (F.col("id") % 20).alias("frontage_m")).join(own, "zone", "left")
    return z.parcel_attributes(x.pixels(spark, sf_dir), evidence).select("zone", "landcover", "land_use")


@query(
    """select id, round(0.6 * confidence + 0.4 * (id % 10) / 10, 4) as base,
    round((0.6 * confidence + 0.4 * (id % 10) / 10) * case when area > 1500 then greatest(0.35, sqrt(1500 / area)) else 1 end
      * case when thin < 0.25 then greatest(0.5, thin / 0.25) else 1 end, 4) as score,
    concat_ws('; ', case when confidence < 0.6 then 'uncertain segmentation' end, case when id % 10 / 10 < 0.35 then 'weak visible boundary' end,
      case when area > 1500 then 'very large for one plot' end, case when thin < 0.25 then 'irregular shape' end) as notes
    from (select id, confidence, (x1 - x0) * (y1 - y0) * k as area, 4 * pi() * (x1 - x0) * (y1 - y0) * k / (2 * (x1 - x0) * k + 2 * (y1 - y0)) ** 2 as thin
    from (select *, 1 + id % 13 as k from parcels))"""
)
def parcel_confidence(spark, sf_dir):
    p = x.parcels(spark, sf_dir).withColumn("x1", F.col("x0") + (F.col("x1") - F.col("x0")) * (1 + F.col("id") % 13))
    shaped = x.geoms(p).withColumn("area", g.area(F.col("geom"))).withColumn("thin", g.thinness(F.col("geom"))).withColumn("holes", g.holes(F.col("geom")))
    args = (F.col("area"), F.col("thin"), F.col("holes"), F.col("confidence"), F.col("id") % 10 / 10)
    return shaped.select("id", F.round(0.6 * F.col("confidence") + 0.4 * (F.col("id") % 10 / 10), 4).alias("base"), F.round(rules.confidence(*args), 4).alias("score"), F.array_join(rules.confidence_notes(*args), "; ").alias("notes"))


APP = "select zone, ['clutter', 'low vegetation', 'clutter', 'road', 'tree', 'clutter', 'low vegetation', 'building'][class] as app_class, sum(prob) as s from pixels group by all"


@query("select zone, app_class, round(case when t > 0 then s / t else 0 end, 8) as p from (select *, sum(s) over (partition by zone) as t from app)", app=APP)
def class_remap(spark, sf_dir):
    return z.remapped(x.pixels(spark, sf_dir)).select("zone", "app_class", F.round("p", 8).alias("p"))


@query("select l_partkey as cell, round(sum((1 + l_linenumber) * l_discount) / sum(1 + l_linenumber), 5) as score from lineitem group by 1")
def score_blend(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem")
    tiles = li.select(F.col("l_partkey").alias("cell"), (1 + F.col("l_linenumber")).alias("w"), F.col("l_discount").alias("p"))
    return z.blended(tiles).select("cell", F.round("score", 5).alias("score"))


@query(
    "select zone as building, arg_max(parcel, n * 1000000 - parcel) as parcel from (select zone, class - 1 as parcel, count(*) as n from pixels where class > 1 group by all) group by zone"
)
def building_owner(spark, sf_dir):
    cells = x.pixels(spark, sf_dir).select(F.col("zone").alias("building"), (F.col("class") - 1).alias("parcel"))
    return z.majority_owner(cells)


@query("select class, count(*) as cells, round(count(*) / sum(count(*)) over (), 5) as fraction from pixels group by class")
def class_fractions(spark, sf_dir):
    counts = x.pixels(spark, sf_dir).groupBy("class").agg(F.count("*").alias("cells"))
    total = counts.agg(F.sum("cells").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("class", "cells", F.round(F.col("cells") / F.col("t"), 5).alias("fraction"))  # one row


@query(
    """select p_partkey as id, round(least(1, greatest(0, (p_retailprice - lo) / greatest(hi - lo, 1e-9))), 5) as scaled
    from part, (select quantile_cont(p_retailprice, 0.02) as lo, quantile_cont(p_retailprice, 0.98) as hi from part)"""
)
def robust_scaling(spark, sf_dir):
    out = z.robust_scale(x.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "p_retailprice")
    return out.select("id", F.round("scaled", 5).alias("scaled"))
