"""Queries on shapes, tiles and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions import kernels
from cadaspark.functions import projection as p
from cadaspark.functions.rules import LANDUSE_LABELS, VERDICT_LABELS, looked_up
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query


def _places(spark, sf_dir):
    return x.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1000).alias("a"), (F.col("o_orderkey") % 900).alias("b"))


PLACES = "select o_orderkey as id, o_custkey % 1000 as a, o_orderkey % 900 as b from orders"


@query(
    """select id, round(a / 1024 * 360 - 180, 7) as lon, round(degrees(atan(sinh(pi() * (1 - 2 * b / 1024)))), 7) as lat, round(2 * pi() * 6378137 * cos(atan(sinh(pi() * (1 - 2 * b / 1024)))) / 256 / 1024, 5) as pixel_m from spots""",
    spots=PLACES,
)
def tile_corners(spark, sf_dir):
    """North-west corners of tiles and the ground size of their pixels."""
    out = _places(spark, sf_dir).withColumn("c", p.tile_corner(F.col("a"), F.col("b"), 10))
    return out.select("id", F.round("c.lon", 7).alias("lon"), F.round("c.lat", 7).alias("lat"), F.round(p.tile_pixel_size(F.col("c.lat"), F.lit(10)), 5).alias("pixel_m"))


@query(
    """select id, round(lon - w, 7) as west, round(lon + w, 7) as east, round(lat - 100 * 0.75 / 110574, 7) as south, round(lat + 100 * 0.75 / 110574, 7) as north from (select *, 100 / (111320 * cos(radians(lat))) as w from (select id, 10 + b / 100 as lat, 70 + a / 100 as lon from spots))""",
    spots=PLACES,
)
def boxes_around(spark, sf_dir):
    """Boxes of 200 by 150 metres around positions."""
    out = _places(spark, sf_dir).withColumn("r", p.geo_box(10 + F.col("b") / 100, 70 + F.col("a") / 100, F.lit(200.0), F.lit(0.75)))
    return out.select("id", *[F.round(f"r.{c}", 7).alias(c) for c in ("west", "east", "south", "north")])


@query("select id, 500000 + (a + 0.5) * 0.25 as x, 2200000 - (b + 0.5) * 0.25 as y, round((a + 0.5) * 0.25, 4) as back_x, round(-(b + 0.5) * 0.25, 4) as back_y from spots", spots=PLACES)
def pixel_positions(spark, sf_dir):
    """Pixel centres on the ground, and through degrees around an origin and back."""
    out = _places(spark, sf_dir).withColumn("q", p.pixel_to_ground(F.col("a"), F.col("b"), F.lit(500000.0), F.lit(2200000.0), F.lit(0.25)))
    there = p.local_inverse(F.col("q.x") - 500000, F.col("q.y") - 2200000, F.lit(78.0), F.lit(20.0))
    back = p.local_forward(F.col("d.lon"), F.col("d.lat"), F.lit(78.0), F.lit(20.0))
    return out.withColumn("d", there).withColumn("e", back).select("id", "q.x", "q.y", F.round("e.x", 4).alias("back_x"), F.round("e.y", 4).alias("back_y"))


def _corners(spark, sf_dir):
    """Parcels, every third as an L that lacks a quarter of its box."""
    a, b, c, d = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    mx, my = (a + c) / 2, (b + d) / 2
    whole = F.array(g.point(a, b), g.point(c, b), g.point(c, d), g.point(a, d))
    bent = F.array(g.point(a, b), g.point(c, b), g.point(c, my), g.point(mx, my), g.point(mx, d), g.point(a, d))
    return x.parcels(spark, sf_dir).withColumn("geom", F.array(F.array(F.when(F.col("id") % 3 == 0, bent).otherwise(whole))))


@query("select id, case when id % 3 = 0 then round(6 / 7, 6) else 1 end as solidity, case when id % 3 = 0 then 6 else 4 end as corners from parcels")
def drawn_roofs(spark, sf_dir):
    """Solidity of shapes; those that nearly fill their rectangle are drawn as rectangles."""
    out = _corners(spark, sf_dir).withColumn("r", kernels.rotated_rectangle("geom"))
    drawn = kernels.squared(F.col("geom"), F.col("r"))
    return out.select("id", F.round(kernels.solidity("geom"), 6).alias("solidity"), F.size(F.flatten(F.flatten(drawn))).alias("corners"))


@query("select id, case when id % 3 = 0 then round(x0 + (x1 - x0) / 4, 4) else round((x0 + x1) / 2, 4) end as x, round(case when id % 3 = 0 then y0 + (y1 - y0) * 0.75 else (y0 + y1) / 2 end, 4) as y, true as inside from parcels")
def inside_points(spark, sf_dir):
    """A point within each shape, in the middle of its widest span at three quarters of its height (boxes: at half)."""
    share = F.when(F.col("id") % 3 == 0, 0.75).otherwise(0.5)
    out = _corners(spark, sf_dir).withColumn("v", g.inside_point(F.col("geom"), share))
    return out.select("id", F.round("v.x", 4).alias("x"), F.round("v.y", 4).alias("y"), g.contains_point(F.col("geom"), F.col("v.x"), F.col("v.y")).alias("inside"))


@query("select id, case when id % 2 = 0 then 2 else 3 end as vertices from parcels")
def simplified_lines(spark, sf_dir):
    """Lines with a bend of 5 cm, simplified by 10 cm or by 1 cm."""
    a, b, c = F.col("x0"), F.col("y0"), F.col("x1")
    line = F.array(g.point(a, b), g.point((a + c) / 2, b + 0.05), g.point(c, b))
    out = x.parcels(spark, sf_dir).select("id", line.alias("line"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.01).alias("t"))
    return out.select("id", F.size(kernels.simplify_line("line", "t")).alias("vertices"))


@query("select p.id, 2 as parts, round(greatest((p.x1 - p.x0) * (p.y1 - p.y0), 144 + p.id % 90), 3) as area_m2 from parcels p")
def largest_parts(spark, sf_dir):
    """The larger part of shapes of two parts."""
    df = x.parcels(spark, sf_dir)
    other = g.box_geometry(F.col("x0") + 1000, F.col("y0"), F.col("x0") + 1001, F.col("y0") + 144 + F.col("id") % 90)
    out = x.geoms(df.withColumn("other", other)).withColumn("geom", F.concat("geom", "other"))
    return out.select("id", g.parts(F.col("geom")).alias("parts"), F.round(g.area(g.largest_part(F.col("geom"))), 3).alias("area_m2"))


TAGS = (*LANDUSE_LABELS, "cemetery")


@query(
    "select p_partkey as id, case when k in (0, 1, 2, 3) then 'Agricultural' when k in (4, 5, 6, 7) then 'Forest / Green Land' when k = 8 then 'Industrial' when k = 9 then 'Residential' when k in (10, 11) then 'Commercial' else 'none' end as label from (select *, p_partkey % 13 as k from part)"
)
def zone_labels(spark, sf_dir):
    """Labels of zoning tags; others have none."""
    k = F.col("p_partkey")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (k % len(TAGS) + 1).cast("int"))
    return x.table(spark, sf_dir, "part").select(k.alias("id"), F.coalesce(looked_up(LANDUSE_LABELS, tag), F.lit("none")).alias("label"))


@query(
    """select obs_id, case verdict when 'confirmed' then 'Boundary confirmed on site' when 'boundary_wrong' then 'Boundary is wrong -- needs editing' when 'not_a_parcel' then 'Not a real parcel'
    when 'part_of_neighbour' then 'Part of a neighbouring parcel -- needs merging' when 'could_not_access' then 'Could not access the site' else '' end as label from observations"""
)
def verdict_labels(spark, sf_dir):
    """What each visit's verdict is called."""
    return x.observations(spark, sf_dir).select("obs_id", F.coalesce(looked_up(VERDICT_LABELS, F.col("verdict")), F.lit("")).alias("label"))
