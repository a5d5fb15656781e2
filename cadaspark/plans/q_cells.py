"""Queries on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.operators import cells as c
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query


@query()
def components(spark, sf_dir):
    out = c.label_components(x.grid(spark, sf_dir).filter("mask"))
    return out.groupBy("component").agg(F.count("*").alias("cells"))


@query(
    """select x, y, arg_max(label, n * 1000 - label) as label from (select g.x, g.y, h.label, count(*) as n from grid g join grid h on abs(g.x - h.x) <= 1 and abs(g.y - h.y) <= 1 group by all) group by x, y"""
)
def majority_filter(spark, sf_dir):
    return c.majority_filter(x.grid(spark, sf_dir))


@query(
    """select x, y, arg_min(label, d2 * 1000 + label) as label, min(d2)::double as d2 from (select g.x, g.y, h.label, (g.x - h.x) ** 2 + (g.y - h.y) ** 2 as d2 from grid g join grid h
    on h.value > 49 where not g.mask) group by x, y"""
)
def nearest_fill(spark, sf_dir):
    """Every unset cell takes the label of the nearest seed; seeds are few, so some are far."""
    g = x.grid(spark, sf_dir)
    return c.nearest_fill(g.filter("not mask"), g.filter("value > 49"))


@query(
    """select x, y, parcel from (select *, count(*) over (partition by parcel) as n from (select x, y, arg_min(house, d * 100000 + house) as parcel from (
    select g.x, g.y, h.y * 50 + h.x as house, greatest(abs(g.x - h.x), abs(g.y - h.y)) as d from grid g join grid h on abs(g.x - h.x) <= 8 and abs(g.y - h.y) <= 8 and h.value > 48
    where g.value > 5) group by x, y)) where n >= 10"""
)
def nearest_house_parcels(spark, sf_dir):
    g = x.grid(spark, sf_dir)
    houses = g.filter("value > 48").withColumn("house", F.col("y") * 50 + F.col("x"))
    return c.house_parcels(g.filter("value > 5"), houses, 8, 10)


@query()
def ground_filter(spark, sf_dir):
    """Ground of a surface with missing cells."""
    return c.ground_filter(x.grid(spark, sf_dir).filter("label <> 3"))


@query()
def terrain_model(spark, sf_dir):
    """Terrain below a surface and heights above it."""
    return c.terrain(x.grid(spark, sf_dir).withColumn("value", F.col("value") / 10))


@query(
    """select g.x, g.y, round(sqrt((coalesce(e.value, g.value) - coalesce(w.value, g.value)) ** 2 + (coalesce(n.value, g.value) - coalesce(s.value, g.value)) ** 2) / 2, 4) as edge from grid g
    left join grid e on e.x = g.x + 1 and e.y = g.y left join grid w on w.x = g.x - 1 and w.y = g.y left join grid n on n.x = g.x and n.y = g.y + 1 left join grid s on s.x = g.x and s.y = g.y - 1"""
)
def edge_strength(spark, sf_dir):
    return c.edge_strength(x.grid(spark, sf_dir)).withColumn("edge", F.round("edge", 4))


@query(
    """select g.x, g.y, case when min(h.label) <> max(h.label) then 'contact' when count(*) < 9 then 'boundary' else 'interior' end as kind from grid g
    join grid h on abs(g.x - h.x) <= 1 and abs(g.y - h.y) <= 1 and h.label > 0 where g.label > 0 group by g.x, g.y"""
)
def contact_masks(spark, sf_dir):
    return c.contact_mask(x.grid(spark, sf_dir))


@query()
def absorbed_pieces(spark, sf_dir):
    g = x.grid(spark, sf_dir)
    return c.small_pieces(g, c.label_components(g.filter("mask")), 25)


@query(
    """select id, case when a >= b and a >= d then 1 when b >= d then 2 else 3 end as class, greatest(a, b, d) as certainty from (select p_partkey as id, p_size % 7 as a, p_size % 5 as b, p_size % 3 as d from part)"""
)
def class_argmax(spark, sf_dir):
    df = x.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(*[F.col("p_size") % k for k in (7, 5, 3)]).alias("scores"))
    return c.best_class(df, "scores").drop("scores")
