"""Comparison of a parcel layer with an existing record and with surveyed points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.geometry import box_area
from cadaspark.functions.kernels import rotated_rectangle, solidity
from cadaspark.operators.graph import written
from cadaspark.operators.ranks import quantiles
from cadaspark.operators.spatial import CELL, box_pairs, covered_area, nearest, overlay

# --- fixed values: results must equal these, so they are stated as they are ---
MATCH_IOU, PARTIAL_IOU, LEAST_SHARE = 0.75, 0.4, 0.2
OUTSIDE_SHARE, CROSSING_SHARE, LEAST_BUILDING_M2 = 0.5, 0.15, 4.0
UNRECORDED_SHARE = 0.15
#: Point types that count in the accuracy figures.
CORNER_TYPES = ("corner", "boundary", "bc", "parcel_corner", "boundary_corner", "pillar", "mark")
# --- end of fixed values ---


def record_overlay(layer: DataFrame, record: DataFrame, exact: bool = False) -> DataFrame:
    """id, ref_id, inter, iou, area, ref_area of all pairs that overlap."""
    pairs = overlay(layer, record, exact=exact)
    return pairs.select(F.col("a_id").alias("id"), F.col("b_ref_id").alias("ref_id"), "inter", "iou", F.col("a_area").alias("area"), F.col("b_area").alias("ref_area"))


def split_claims(pairs: DataFrame) -> DataFrame:
    """Record parcels that two parcels or more cover by a fifth each: ref_id, claimants."""
    return pairs.filter(F.col("inter") / F.col("ref_area") >= LEAST_SHARE).groupBy("ref_id").agg(F.count("*").alias("claimants")).filter("claimants >= 2")


def status_chain(iou: Column, merged: Column, split: Column, share: Column) -> Column:
    return (
        F.when(iou >= MATCH_IOU, "MATCH")
        .when((merged >= 2) | (split & (share >= LEAST_SHARE)), "SPLIT_OR_MERGED")
        .when(iou >= PARTIAL_IOU, "BOUNDARY_DIFFERS")
        .when(share >= LEAST_SHARE, "SPLIT_OR_MERGED")
        .otherwise("NOT_IN_RECORD")
    )


def record_status(layer: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row a parcel: id, status, iou, share, ref_id (null if not in the record), area, ref_area.

    ``layer`` has ``id``; ties of the best match go to the least ref_id.
    """
    claimed = pairs.join(split_claims(pairs), "ref_id", "left").withColumn("split", F.col("claimants").isNotNull() & (F.col("inter") / F.col("ref_area") >= LEAST_SHARE))
    both = (F.col("inter") / F.col("ref_area") >= LEAST_SHARE) & (F.col("inter") / F.col("area") >= LEAST_SHARE)
    # the least ref_id wins a tie: min_by over (-iou, ref_id)
    best = F.min_by(F.struct("ref_id", "iou", "ref_area"), F.struct((-F.col("iou")).alias("k"), "ref_id"))
    each = claimed.groupBy("id").agg(best.alias("best"), F.sum("inter").alias("covered"), F.count_if(both).alias("merged"), F.bool_or("split").alias("split"), F.first("area").alias("area"))
    out = layer.select("id").join(each, "id", "left")
    share = F.coalesce(F.col("covered") / F.col("area"), F.lit(0.0))
    status = status_chain(F.coalesce("best.iou", F.lit(0.0)), F.coalesce("merged", F.lit(0)), F.coalesce("split", F.lit(False)), share)
    ref = F.when(F.col("status") != "NOT_IN_RECORD", F.col("best.ref_id"))
    return out.withColumn("status", status).select("id", "status", F.coalesce("best.iou", F.lit(0.0)).alias("iou"), share.alias("share"), ref.alias("ref_id"), "area", F.col("best.ref_area").alias("ref_area"))


def missing_from_layer(record: DataFrame, pairs: DataFrame, status: DataFrame) -> DataFrame:
    """Record parcels that no counted parcel matches best and none covers by a fifth."""
    seen = pairs.filter(F.col("inter") / F.col("ref_area") >= LEAST_SHARE).select("ref_id")
    return record.join(status.filter("ref_id is not null").select("ref_id"), "ref_id", "left_anti").join(seen, "ref_id", "left_anti")


def comparison_summary(status: DataFrame) -> DataFrame:
    """One row: counts of every status, agreement %, mean IoU and median area difference of matches."""
    kinds = ("MATCH", "BOUNDARY_DIFFERS", "SPLIT_OR_MERGED", "NOT_IN_RECORD")
    good = F.col("status").isin("MATCH", "BOUNDARY_DIFFERS")
    difference = F.when(good, F.abs(F.col("area") - F.col("ref_area")) / F.col("ref_area"))
    status = written(status, "record-status")
    (median,) = quantiles(status, difference, [0.5])
    return status.agg(
        F.count("*").alias("parcels"),
        *[F.count_if(F.col("status") == k).alias(k.lower()) for k in kinds],
        (100 * F.count_if(F.col("status") == "MATCH") / F.greatest(F.count("*"), F.lit(1))).alias("agreement_pct"),
        F.avg(F.when(good, F.col("iou"))).alias("mean_iou"),
        (100 * F.lit(median).cast("double")).alias("median_area_diff_pct"),
    )


def buildings_vs_record(buildings: DataFrame, record: DataFrame) -> DataFrame:
    """Buildings mostly outside the record or across one of its boundaries: id, type, area_m2."""
    big = buildings.filter(box_area() >= LEAST_BUILDING_M2).withColumn("area", box_area())
    pairs = overlay(big.drop("area"), record).select(F.col("a_id").alias("id"), F.col("b_ref_id").alias("ref_id"), "inter")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("inter"), F.desc("ref_id")))
    sums = pairs.withColumn("rank", rank).groupBy("id").agg(F.sum("inter").alias("inside"), F.max(F.when(F.col("rank") == 2, F.col("inter"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("ref_id"))).alias("first_ref"), F.max(F.when(F.col("rank") == 2, F.col("ref_id"))).alias("second_ref"))
    out = big.select("id", "area").join(sums, "id", "left")
    outside = F.greatest(F.lit(0.0), F.col("area") - F.coalesce("inside", F.lit(0.0)))
    kind = F.when(outside / F.col("area") > OUTSIDE_SHARE, "OUTSIDE_RECORD").when(F.col("second") / F.col("area") >= CROSSING_SHARE, "CROSSES_RECORD")
    out = out.withColumn("type", kind).filter("type is not null")
    return out.select("id", "type", F.when(F.col("type") == "OUTSIDE_RECORD", outside).otherwise(F.col("second")).alias("area_m2"), "first_ref", "second_ref")


def annotated(layer: DataFrame, status: DataFrame) -> DataFrame:
    """The layer with record_status, record_iou and record_ref_id (null without a comparison)."""
    return layer.join(status.select("id", F.col("status").alias("record_status"), F.col("iou").alias("record_iou"), F.col("ref_id").alias("record_ref_id")), "id", "left")


def unrecorded(buildings: DataFrame, record: DataFrame) -> DataFrame:
    """id, share (covered by the record, overlapping record parcels once) and unrecorded (share below 0.15)."""
    out = buildings.select("id", box_area().alias("area")).join(covered_area(buildings, record), "id", "left")
    share = F.coalesce("covered", F.lit(0.0)) / F.col("area")
    return out.select("id", share.alias("share"), (F.round(share, 9) < UNRECORDED_SHARE).alias("unrecorded"))  # no rounding error decides


def corners(layer: DataFrame) -> DataFrame:
    """Vertices of a box layer: id, vertex, x, y."""
    at = [F.struct(F.lit(k).alias("vertex"), F.col(f"x{i}").alias("x"), F.col(f"y{j}").alias("y")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    return layer.select("id", F.explode(F.array(*at)).alias("v")).select("id", "v.vertex", "v.x", "v.y")


def vertex_errors(points: DataFrame, layer: DataFrame) -> DataFrame:
    """point_id, type, error_m: distance to the nearest vertex of the layer."""
    found = nearest(points, "point_id", corners(layer).select(F.col("id").alias("tie"), "x", "y"), 1, "tie", cell=10.0)
    return found.select(F.col("a_point_id").alias("point_id"), F.col("a_type").alias("type"), F.col("distance").alias("error_m"))


def outline_distance(x: str, y: str, box: str) -> Column:
    """Distance of a point to the outline of a box (not to its inside)."""
    dx = F.greatest(F.col(f"{box}x0") - F.col(x), F.lit(0.0), F.col(x) - F.col(f"{box}x1"))
    dy = F.greatest(F.col(f"{box}y0") - F.col(y), F.lit(0.0), F.col(y) - F.col(f"{box}y1"))
    inner = F.least(F.col(x) - F.col(f"{box}x0"), F.col(f"{box}x1") - F.col(x), F.col(y) - F.col(f"{box}y0"), F.col(f"{box}y1") - F.col(y))
    return F.when((dx == 0) & (dy == 0), inner).otherwise(F.hypot(dx, dy))


def outline_errors(points: DataFrame, layer: DataFrame, reach: float = CELL) -> DataFrame:
    """point_id, error_m: distance to the nearest outline; the search widens, with its cells, until all are found."""
    span = layer.agg(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).first()
    found, todo = None, points
    while True:
        boxed = todo.select("point_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        pairs = box_pairs(boxed, layer, reach, max(CELL, reach)).withColumn("error_m", outline_distance("a_x0", "a_y0", "b_"))
        least = written(pairs.filter(F.col("error_m") <= reach).groupBy(F.col("a_point_id").alias("point_id")).agg(F.min("error_m").alias("error_m")), "outline-errors")
        found = least if found is None else found.unionByName(least)
        todo = written(todo.join(least, "point_id", "left_anti"), "outline-todo")
        if reach >= max(v or 0.0 for v in span) + CELL or todo.isEmpty():
            return found
        reach *= 4


def corner_error() -> Column:
    """The error of corner points (points without a type are corners), null for others."""
    return F.when(F.coalesce("type", F.lit("corner")).isin(*CORNER_TYPES), F.col("error_m"))


def point_accuracy(errors: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One row over corner points: n, mean, RMSE, CE90, max and % within the tolerance."""
    e = corner_error()
    errors = written(errors, "point-errors")
    (ce90,) = quantiles(errors, e, [0.9])
    return errors.agg(
        F.count("*").alias("points"),
        F.count(e).alias("corner_points"),
        F.avg(e).alias("mean_m"),
        F.sqrt(F.avg(e * e)).alias("rmse_m"),
        F.lit(ce90).cast("double").alias("ce90_m"),
        F.max(e).alias("max_m"),
        (100 * F.avg((e <= tolerance).cast("int"))).alias("within_pct"),
    )


def dense_cluster(points: DataFrame, k: int = 3, reach: float = 30.0) -> DataFrame:
    """Points whose k-th other neighbour is nearer than ``reach``: id, distance_m."""
    found = nearest(points, "id", points, k + 1, "id")  # the point itself is its first neighbour
    return found.filter((F.col("rank") == k + 1) & (F.col("distance") < reach)).select(F.col("a_id").alias("id"), F.col("distance").alias("distance_m"))


#: A visit this near to its parcel is on site (fixed value).
ON_SITE_M = 30.0


def visit_distances(visits: DataFrame, parcels: DataFrame) -> DataFrame:
    """Visits (batch or stream) with distance_m to their parcel's polygon (0 inside) and on_site (30 m or less).

    ``visits`` has parcel_id, x and y, ``parcels`` id and geom.  A visit without a position, or of no
    known parcel, has no distance and is neither on site nor off it.
    """
    own = visits.join(parcels.select(F.col("id").alias("parcel_id"), F.col("geom").alias("__geom")), "parcel_id", "left")
    distance = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("__geom").isNotNull(), g.point_distance(F.col("__geom"), F.col("x"), F.col("y")))
    return own.withColumn("distance_m", distance).withColumn("on_site", F.col("distance_m") <= ON_SITE_M).drop("__geom")


# --- fixed values of shapes that fill in missed roofs: square metres, share of the hull, metres ---
FILL_M2, FILL_SOLIDITY, FILL_WIDTH_M = 20.0, 0.75, 3.5
# --- end of fixed values ---


def plausible_fills(layer: DataFrame) -> DataFrame:
    """The shapes (id, geom) that may be a missed roof: large, full and wide enough.

    Width is the short side of the least rectangle around the shape.
    """
    full = layer.filter(g.area(F.col("geom")) >= FILL_M2).withColumn("__s", solidity("geom")).withColumn("__r", rotated_rectangle("geom"))
    return full.filter((F.round("__s", 9) >= FILL_SOLIDITY) & (F.round(F.col("__r.short_m"), 9) >= FILL_WIDTH_M)).drop("__s", "__r")
