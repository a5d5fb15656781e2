"""Layouts of boxes: subdivision, plot widths, touching neighbours, candidate tiles, unions and leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.operators.graph import written
from cadaspark.operators.ranks import quantiles
from cadaspark.operators.spatial import CELL, box_pairs, covered_area, overlay, within_distance
from cadaspark.operators.topology import box_cells

# --- fixed values: results must equal these, so they are stated as they are ---
LEAST_PIECE_M2, UNSPLIT_M2, TARGET_CELLS, CELL_LEAST_M, CELL_MOST_M = 25.0, 4000.0, 10, 35.0, 90.0
VACANT_CAP_M2, VACANT_CELL_M = 20000.0, 90.0
FIELDS = ("Agricultural", "Forest / Green Land")
PLOT_WIDTH_M, PLOT_RANGE_M, SIDE_MARGIN_M, BLOCK_RANGE_M = 12.0, (6.0, 25.0), 1.5, (6.0, 18.0)
HOLE_TAKEN = 0.1
# --- end of fixed values ---
BOX = ("x0", "y0", "x1", "y1")


def subdivided(boxes: DataFrame, side: str) -> DataFrame:
    """id, piece and box of the grid cells that a box is cut into; pieces below 25 square metres go."""
    last = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.col(side)).cast("int") - 1
    out = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(last("x0", "x1"), F.lit(0))))).withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(last("y0", "y1"), F.lit(0)))))
    x, y = F.col("x0") + F.col("i") * F.col(side), F.col("y0") + F.col("j") * F.col(side)
    cut = out.select("id", "i", "j", x.alias("x0"), y.alias("y0"), F.least(x + F.col(side), F.col("x1")).alias("x1"), F.least(y + F.col(side), F.col("y1")).alias("y1"))
    return cut.filter(box_area() >= LEAST_PIECE_M2)


def field_cells(open_land: DataFrame) -> DataFrame:
    """Open land with its ``side``: fields in about ten cells, untagged land only when it is very large, else null (one parcel)."""
    area = box_area()
    side = F.when(F.col("landuse").isin(*FIELDS) & (area > UNSPLIT_M2), F.greatest(F.lit(CELL_LEAST_M), F.least(F.lit(CELL_MOST_M), F.sqrt(area / TARGET_CELLS)))).when(~F.col("landuse").isin(*FIELDS) & (area > VACANT_CAP_M2), F.lit(VACANT_CELL_M))
    return open_land.withColumn("side", side)


def open_parcels(open_land: DataFrame) -> DataFrame:
    """All parcels of open land: whole pieces, and the cells of those that are subdivided (i, j; null if whole)."""
    marked = field_cells(open_land)
    whole = marked.filter("side is null").filter(box_area() >= LEAST_PIECE_M2).select("id", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), *BOX)
    return whole.unionByName(subdivided(marked.filter("side is not null"), "side"))


def plot_widths(houses: DataFrame) -> DataFrame:
    """block, width_m: the typical plot of a block, from the narrower houses of three or more, else the survey's.

    ``houses`` has block, width (along the row) and narrow (its shorter side).
    """
    (middle,) = quantiles(houses, F.col("narrow"), [0.5])
    survey = PLOT_WIDTH_M if middle is None else min(max(middle + 2 * SIDE_MARGIN_M, PLOT_RANGE_M[0]), PLOT_RANGE_M[1])
    fits = F.when(F.col("width") <= PLOT_RANGE_M[1], F.col("width"))
    by = houses.groupBy("block").agg(F.percentile(fits, F.lit(0.35)).alias("p"), F.count(fits).alias("n"))  # houses of one block
    width = F.when(F.col("n") >= 3, F.col("p") + SIDE_MARGIN_M).otherwise(F.lit(survey))
    return by.select("block", F.least(F.greatest(width, F.lit(BLOCK_RANGE_M[0])), F.lit(BLOCK_RANGE_M[1])).alias("width_m"))


def touching_share(boxes: DataFrame, grow: float = 0.05, least: float = 1.0) -> DataFrame:
    """One row: polygons above one square metre, and the share that meets another over more than a metre of outline."""
    big = boxes.filter(box_area() > 1).select("id", *BOX)
    w = F.least(F.col("a_x1") + grow, F.col("b_x1")) - F.greatest(F.col("a_x0") - grow, F.col("b_x0"))
    h = F.least(F.col("a_y1") + grow, F.col("b_y1")) - F.greatest(F.col("a_y0") - grow, F.col("b_y0"))
    hits = box_pairs(big, big, grow, extra=F.col("a_id") != F.col("b_id")).filter((w >= 0) & (h >= 0) & (2 * (w + h) > least)).select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return big.join(hits, "id", "left").agg(F.count("*").alias("polygons"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("share_touching"))


def candidate_tiles(boxes: DataFrame, size: float, least: int = 6) -> DataFrame:
    """tx, ty, footprints of the tiles that at least six footprints meet."""
    at = lambda c: F.floor(F.col(c) / size)
    tiles = boxes.withColumn("tx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("ty", F.explode(F.sequence(at("y0"), at("y1"))))
    return tiles.groupBy("tx", "ty").agg(F.count("*").alias("footprints")).filter(F.col("footprints") >= least)


def layer_algebra(first: DataFrame, second: DataFrame, size: float = 1.0) -> DataFrame:
    """cx, cy, kind of the cells of two layers: both, first or second; a union is all of them, a difference one kind."""
    a, b = (box_cells(d.select("id", *BOX), size).select("cx", "cy").distinct() for d in (first, second))
    out = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["cx", "cy"], "full")
    return out.select("cx", "cy", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("kind"))


def orphan_holes(holes: DataFrame, parcels: DataFrame) -> DataFrame:
    """id, taken, orphan: a hole that other parcels fill by a tenth or less belongs to the parcel around it."""
    pairs = overlay(holes.select("id", "owner", *BOX), parcels.select("id", *BOX), extra=F.col("a_owner") != F.col("b_id"))
    taken = pairs.groupBy(F.col("a_id").alias("id")).agg(F.sum("inter").alias("taken"))
    return holes.join(taken, "id", "left").select("id", F.coalesce("taken", F.lit(0.0)).alias("taken"), (F.coalesce("taken", F.lit(0.0)) <= HOLE_TAKEN * box_area()).alias("orphan"))


def nearest_box(boxes: DataFrame, others: DataFrame, reach: float = CELL) -> DataFrame:
    """id, other, distance: the nearest other box (ties: least id), at any distance; the search widens with its cells."""
    span = others.select(*BOX).unionByName(boxes.select(*BOX)).agg(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).first()
    found, todo = None, boxes.select("id", *BOX)
    while True:
        pairs = within_distance(todo, others.select("id", *BOX), reach, max(CELL, reach))
        best = written(pairs.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("distance", "b_id")).alias("m")).select("id", F.col("m.b_id").alias("other"), "m.distance"), "nearest-box")
        found = best if found is None else found.unionByName(best)
        todo = written(todo.join(best, "id", "left_anti"), "nearest-box-todo")
        if reach >= sum(v or 0.0 for v in span) or todo.isEmpty():
            return found
        reach *= 4


def assigned(faces: DataFrame, parcels: DataFrame) -> DataFrame:
    """id, parcel: each face goes to the parcel that it covers most (ties: least id), or to the nearest one."""
    pairs = overlay(faces.select("id", *BOX), parcels.select("id", *BOX)).groupBy(F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct(F.round("inter", 6), -F.col("b_id"))).alias("parcel"))
    pairs = written(pairs, "assigned")
    rest = faces.join(pairs, "id", "left_anti")
    return pairs.unionByName(nearest_box(rest, parcels).select("id", F.col("other").alias("parcel")))


def restored(pieces: DataFrame, parcels: DataFrame, grow: float = 0.05) -> DataFrame:
    """id, parcel: uncovered land goes to the parcel whose 5 cm rim takes most of it, or to the nearest one."""
    grown = parcels.select("id", (F.col("x0") - grow).alias("x0"), (F.col("y0") - grow).alias("y0"), (F.col("x1") + grow).alias("x1"), (F.col("y1") + grow).alias("y1"))
    return assigned(pieces, grown)


def uncovered_share(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """id, rest_m2: what the other layer leaves of each box."""
    return boxes.select("id", box_area().alias("area")).join(covered_area(boxes, others), "id", "left").select("id", (F.col("area") - F.coalesce("covered", F.lit(0.0))).alias("rest_m2"))
