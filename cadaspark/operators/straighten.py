"""Borders of a whole layer made straight or simpler at once, so neighbours keep one border.

The layer's outlines are arcs between junctions (``coverage.arcs``); each arc is redrawn once and the
polygons are put together again.  Arcs beside open land stay as they are: what a new line would give
to open land or take from it belongs to the survey's edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.straight import fewer_points, middle_of, straight_line, wall_direction
from cadaspark.operators.coverage import arcs, rebuilt
from cadaspark.operators.graph import written
from cadaspark.operators.spatial import box_pairs, nearest, with_bounds
from cadaspark.operators.topology import measured, overlap_pairs, shape_issues

#: Metres around an arc in which a house may stand in the way of its new line.
REACH_M = 5.0


def named_in_issues(layer: DataFrame) -> DataFrame:
    """Parcels that checks of shapes and overlaps name."""
    own = written(measured(layer), "straight-measured")
    pairs = overlap_pairs(own.filter(F.size("geom") > 0), exact=True).select(F.array("a_id", "b_id").alias("parcel_ids"))
    found = shape_issues(own).select("parcel_ids").unionByName(pairs)
    return found.select(F.explode("parcel_ids").alias("id")).distinct()


def settled(lines: DataFrame) -> DataFrame:
    """id, geom of arcs (arc, line, new, left, right): new lines, but for parcels that checks complain about.

    All arcs of such a parcel go back to their old line, on both sides, so no gap opens; this is
    repeated until no parcel with an issue has a new line.
    """
    while True:
        changed = F.col("new").isNotNull()
        layer = written(rebuilt(lines.select(F.coalesce("new", "line").alias("line"), "left", "right")), "straight-layer")
        every = lines.select(F.explode(F.concat("left", "right")).alias("id")).distinct()
        lost = every.join(layer.filter(F.size("geom") > 0), "id", "left_anti")
        bad = named_in_issues(layer).unionByName(lost)
        sides = lines.filter(changed).select("arc", F.explode(F.concat("left", "right")).alias("id"))
        back = written(sides.join(bad, "id", "left_semi").select("arc").distinct(), "straight-back")
        if back.isEmpty():
            return layer
        lines = lines.join(back.withColumn("back", F.lit(True)), "arc", "left")
        lines = written(lines.withColumn("new", F.when(F.col("back").isNull(), F.col("new"))).drop("back"), "straight-lines")


def unlike(new: F.Column) -> F.Column:
    return F.when(new != F.col("line"), new)


def shared_simplify(layer: DataFrame, tolerance: float) -> DataFrame:
    """id, geom with fewer corners: every border is simplified once (Douglas-Peucker), its junctions stay.

    Borders with open land are simplified too.  Parcels that would become invalid, overlap another,
    be too small or a sliver keep their old borders.
    """
    own = written(arcs(layer), "arcs")
    return settled(written(own.withColumn("new", unlike(fewer_points("line", F.lit(float(tolerance))))), "straight-lines"))


def straightened(layer: DataFrame, buildings: DataFrame) -> DataFrame:
    """id, geom with straight borders: ``layer`` and ``buildings`` have id and geom in metres.

    A border between two parcels that barely bends becomes one line; of others the segments that
    nearly run along the nearest building's walls, or across them, are turned so.  A line that would
    run farther through a house than before is refused.  Junctions stay, neighbours keep one border,
    and the covered land stays the same.  Parcels that checks then complain about get their old
    borders back.
    """
    own = written(arcs(layer).withColumn("key", F.col("arc")), "arcs")
    inner = own.filter((F.size("left") > 0) & (F.size("right") > 0)).withColumn("m", middle_of("line"))
    houses = buildings.filter(g.area(F.col("geom")) > 0).withColumn("c", g.centroid(F.col("geom")))
    houses = written(with_bounds(houses.select("id", "geom", F.col("c.x").alias("x"), F.col("c.y").alias("y"), wall_direction("geom").alias("direction"))), "houses")
    bent = written(inner.filter("m.bends").select("arc", "line", F.col("m.x").alias("x"), F.col("m.y").alias("y")), "bent")
    if houses.isEmpty():
        directed = bent.select("arc", "line", F.lit(None).cast("double").alias("direction"))
    else:
        best = nearest(bent.select("arc", "x", "y"), "arc", houses.select("id", "x", "y", "direction"), 1, "id")
        directed = bent.select("arc", "line").join(best.select(F.col("a_arc").alias("arc"), F.col("b_direction").alias("direction")), "arc")
    directed = written(with_bounds(directed.withColumn("shape", F.array(F.array("line"))), "shape").drop("shape"), "directed")
    near = box_pairs(directed.select("arc", "x0", "y0", "x1", "y1"), houses.select("id", "x0", "y0", "x1", "y1"), REACH_M)
    near = near.select(F.col("a_arc").alias("arc"), F.col("b_id").alias("id")).join(houses.select("id", "geom"), "id").groupBy("arc").agg(F.collect_list("geom").alias("houses"))
    drawn = directed.join(near, "arc", "left").select("arc", straight_line("line", "direction", "houses").alias("new"))
    plain = inner.filter("not m.bends").filter(F.element_at("line", 1) != F.element_at("line", -1)).select("arc", F.array(F.element_at("line", 1), F.element_at("line", -1)).alias("new"))
    lines = own.drop("key").join(drawn.unionByName(plain), "arc", "left").withColumn("new", unlike(F.col("new")))
    return settled(written(lines, "straight-lines"))
