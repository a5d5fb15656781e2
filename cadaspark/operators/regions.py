"""Regions of label rasters as cell tables: components, absorption, strips, merging, outlines and targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_geometry
from cadaspark.operators.cells import SIDES, in_tiles
from cadaspark.operators.coverage import followed, ring_names
from cadaspark.operators.graph import components as graph_components
from cadaspark.operators.graph import written
from cadaspark.operators.numbering import ranked
from cadaspark.operators.topology import merged

# --- fixed values: results must equal these, so they are stated as they are ---
ABSORB_M2 = 60.0
CORRIDOR_M2, CORRIDOR_M, ELONGATION = 60.0, 10.0, 3.0
ROOF_SHARE, ROOF_MOST_M2 = 0.85, 250.0
FUSED_SCORE, FUSED_CELLS = 0.5, 80
KNOWN_CELLS = 10
ENCLOSURE_ROUNDS = 6
PAVED_LOT_M = 10.0
# --- end of fixed values ---

#: Cells of a row that one task numbers at once; length of a cell's side where rims are chained.
STRETCH, STEP = 4096, 5000


def beside(cells: DataFrame, *columns: str) -> DataFrame:
    """Each cell's four neighbours: the given columns and ``x``, ``y`` of the neighbour."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in SIDES])
    return cells.select(*columns, F.col("x").alias("__x"), F.col("y").alias("__y"), F.explode(steps).alias("d")).select(*columns, (F.col("__x") + F.col("d.dx")).alias("x"), (F.col("__y") + F.col("d.dy")).alias("y"))


def regions(cells: DataFrame) -> DataFrame:
    """x, y, label, region: connected cells (four sides) of one label; named by the least (y, x) as y * 2^32 + x.

    Cells of a row are joined to runs in stretches of bounded length, so the search works on runs.
    """
    own = cells.select("x", "y", "label").withColumn("stretch", F.floor(F.col("x") / STRETCH))
    row = W.partitionBy("y", "stretch").orderBy("x")
    goes_on = (F.col("x") - F.lag("x").over(row) == 1) & F.col("label").eqNullSafe(F.lag("label").over(row))
    own = own.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(row))
    heads = own.groupBy("y", "stretch", "run").agg(F.min("x").alias("lo")).withColumn("node", F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("lo"))
    named = written(own.join(heads.drop("lo"), ["y", "stretch", "run"]).select("x", "y", "label", "node"), "runs")
    moved = lambda dx, dy: named.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("label").alias("l"), F.col("node").alias("b"))
    met = lambda df, dx, dy: df.join(moved(dx, dy), ["x", "y"]).filter(F.col("label").eqNullSafe(F.col("l"))).select(F.col("node").alias("a"), "b")
    links = met(named, 0, 1).unionByName(met(named.filter(F.pmod("x", F.lit(STRETCH)) == 0), 1, 0)).filter("a <> b").distinct()
    return named.join(graph_components(named.select("node").distinct(), links), "node").select("x", "y", "label", F.col("component").alias("region"))


def absorbed(cells: DataFrame, least: int) -> DataFrame:
    """x, y, label: regions of fewer than ``least`` cells take the label that they border most (ties: least label).

    Small regions beside small ones take labels as they stood before; regions without a neighbour stay.
    """
    named = written(regions(cells), "regions")
    small = named.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") < least).select("region")
    rim = beside(named.join(small, "region", "left_semi"), "region")
    counts = rim.join(named.select("x", "y", F.col("label").alias("into"), F.col("region").alias("other")), ["x", "y"]).filter("region <> other").groupBy("region", "into").agg(F.count("*").alias("n"))
    best = counts.groupBy("region").agg(F.max_by("into", F.struct("n", -F.col("into"))).alias("into"))
    return named.join(best, "region", "left").select("x", "y", F.coalesce("into", "label").alias("label"))


def enclosures_absorbed(cells: DataFrame, cell_m2: float, most_m2: float = ABSORB_M2) -> DataFrame:
    """x, y, label: regions inside one other label's land, of at most ``most_m2``, take that label.

    ``cells`` is whole: a region at a place without a cell is not enclosed.  Larger enclosed regions stay.
    """
    named = written(regions(cells), "regions")
    rim = beside(named, "region").join(named.select("x", "y", F.col("label").alias("into"), F.col("region").alias("other")), ["x", "y"], "left").filter("other is null or region <> other")
    around = rim.groupBy("region").agg(F.min("into").alias("into"), F.max("into").alias("high"), F.count_if(F.col("other").isNull()).alias("open"))
    size = named.groupBy("region").agg(F.count("*").alias("n"))
    shut = around.filter("open = 0 and into = high").join(size, "region").filter(F.col("n") * cell_m2 <= most_m2).select("region", "into")
    return named.join(shut, "region", "left").select("x", "y", F.coalesce("into", "label").alias("label"))


def hole_rings(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """label, ring, cells, row of every hole of a label, and the upright edges (ring, x, y) around each.

    A hole is land that the label's cells cut off from the outside, a step over a corner being none;
    ``row`` is the mean y of its cells.  Found from the label's rim alone: edges between its cells and
    others are chained to closed walks, and a walk with other land inside it is a hole.
    """
    own = cells.select("x", "y", "label")
    near = beside(own.select("x", "y", "label", F.col("x").alias("ox"), F.col("y").alias("oy")), "label", "ox", "oy")
    rim = near.join(own.withColumnRenamed("label", "other"), ["x", "y"], "left").filter(~F.col("label").eqNullSafe(F.col("other")))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    corner = lambda right, up: F.struct((F.col("ox") + right).cast("bigint").alias("cx"), (F.col("oy") + up).cast("bigint").alias("cy"), ((F.col("ox") + right) * STEP).cast("bigint").alias("x"), ((F.col("oy") + up) * STEP).cast("bigint").alias("y"), F.col("label"))
    # directed so that the other land lies on the left
    u = F.when(dx == 1, corner(1, 1)).when(dx == -1, corner(0, 0)).when(dy == 1, corner(0, 1)).otherwise(corner(1, 0))
    v = F.when(dx == 1, corner(1, 0)).when(dx == -1, corner(0, 1)).when(dy == 1, corner(1, 1)).otherwise(corner(0, 0))
    edges = written(rim.select(F.monotonically_increasing_id().alias("key"), u.alias("u"), v.alias("v")), "rim-edges")
    walks = written(followed(edges), "rim-walks")
    named = written(walks.join(ring_names(walks), "key").select("ring", "u", "v"), "rim-rings")
    turn = F.col("u.cx") * F.col("v.cy") - F.col("v.cx") * F.col("u.cy")
    moment = F.when(F.col("u.cx") == F.col("v.cx"), F.col("u.cx") * (F.col("v.cy") * F.col("v.cy") - F.col("u.cy") * F.col("u.cy"))).otherwise(0)
    sized = named.groupBy("ring").agg(F.first("u.label").alias("label"), (F.sum(turn) / 2).cast("bigint").alias("cells"), F.sum(moment).alias("moment")).filter("cells > 0")
    sized = written(sized.select("label", "ring", "cells", F.floor((F.col("moment") - F.col("cells")) / 2 / F.col("cells")).cast("bigint").alias("row")), "holes")
    upright = named.filter("u.cx = v.cx").select("ring", F.col("u.cx").alias("x"), F.least("u.cy", "v.cy").alias("y"))
    return sized, upright.join(sized.select("ring"), "ring", "left_semi")


def hole_cells(upright: DataFrame) -> DataFrame:
    """ring, x, y: the cells inside each ring, row by row between its upright edges."""
    rows = upright.groupBy("ring", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.sequence(F.element_at("xs", i), F.element_at("xs", i + 1) - 1))
    return rows.select("ring", F.explode(F.flatten(spans)).alias("x"), "y")


def enclosures_resolved(cells: DataFrame, cell_m2: float, corridor: int | None = None, most_m2: float = ABSORB_M2, rounds: int = ENCLOSURE_ROUNDS) -> DataFrame:
    """x, y, label after no label encloses other land; 0 and null are no label, ``corridor`` may enclose anything.

    What a hole of at most ``most_m2`` holds takes the label around it (of several such holes the
    largest counts).  A larger one that holds labelled land stays, and the label around it is cut along
    the hole's middle row: its greatest piece keeps the label (ties: the first in rows from below),
    the others get numbers after the greatest label in the order of labels and first cells, and each
    cell of the cut takes the label of the cell in the row before it, unless that is none or the
    corridor.  Rounds end when nothing changes.  All labels are looked at as they stand when a round
    begins.
    """
    now = written(cells.select("x", "y", F.coalesce(F.col("label"), F.lit(0)).cast("bigint").alias("label")), "enclosures")
    for _ in range(rounds):
        around = now.filter((F.col("label") > 0) & ~F.col("label").eqNullSafe(corridor))
        holes, upright = hole_rings(around)
        if holes.isEmpty():
            break
        inside = hole_cells(upright).join(holes, "ring").join(now.filter("label > 0").select("x", "y", F.col("label").alias("held")), ["x", "y"])
        inside = written(inside, "hole-cells")
        small = F.col("cells") * cell_m2 <= most_m2
        taken = inside.filter(small).groupBy("x", "y").agg(F.max_by("label", F.struct("cells", -F.col("label"))).alias("into"))
        cuts = inside.filter(~small).select("label", "row").distinct()
        after = written(now.join(taken, ["x", "y"], "left").select("x", "y", F.coalesce("into", "label").alias("label"), F.col("into").isNotNull().alias("new")), "absorbed")
        cut = after.filter("not new").join(cuts.withColumnRenamed("row", "y"), ["label", "y"], "left_semi").select("x", "y", "label")
        split = after.filter("not new").join(cuts.select("label").distinct(), "label", "left_semi").join(cut.select("x", "y"), ["x", "y"], "left_anti")
        pieces = written(regions(split), "cut-pieces")
        sizes = pieces.groupBy("label", "region").agg(F.count("*").alias("n"))
        kept = sizes.groupBy("label").agg(F.max_by("region", F.struct("n", -F.col("region"))).alias("region"), F.count("*").alias("pieces"))
        rest = sizes.join(kept.select("region"), "region", "left_anti").select("label", "region")
        most = now.agg(F.coalesce(F.max("label"), F.lit(0)).alias("most"))
        fresh = ranked(rest.withColumn("all", F.lit(0)), "all", [F.col("label"), F.col("region")], "k", F.col("label")).crossJoin(F.broadcast(most)).select("region", (F.col("most") + F.col("k")).alias("fresh"))  # one row
        renamed = pieces.join(fresh, "region").select("x", "y", "fresh")
        apart = kept.filter("pieces > 1").select("label")
        line = cut.join(apart, "label", "left_semi")
        put = after.join(renamed, ["x", "y"], "left").select("x", "y", F.coalesce("fresh", "label").alias("label"))
        put = written(put, "cut-labels")
        above = put.select("x", (F.col("y") + 1).alias("y"), F.col("label").alias("above"))
        joined = line.join(above, ["x", "y"], "left")
        ok = (F.coalesce("above", F.lit(0)) > 0) & ~F.col("above").eqNullSafe(corridor)
        line = joined.select("x", "y", F.when(ok, F.col("above")).otherwise(F.col("label")).alias("over"))
        new = written(put.join(line, ["x", "y"], "left").select("x", "y", F.coalesce("over", "label").alias("label")), "enclosures")
        if taken.isEmpty() and apart.isEmpty():
            break
        now = new
    return now


def corridor_cells(cells: DataFrame, gsd: float, tile: int = 256) -> DataFrame:
    """x, y of road cells (``road``) with lanes of paved ground (``paved``), after an opening by one cell.

    Paved ground that is ``PAVED_LOT_M`` wide all round is a lot and no lane.
    """
    r = max(1, round(PAVED_LOT_M / gsd / 2))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = (pdf["y"] - pdf["y"].min()).to_numpy() + r + 2, (pdf["x"] - pdf["x"].min()).to_numpy() + r + 2
        road, paved = (np.zeros((y.max() + r + 3, x.max() + r + 3), bool) for _ in range(2))
        road[y, x], paved[y, x] = pdf["road"], pdf["paved"]
        disc = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
        lanes = road | (paved & ~opened(road | paved, disc))
        return pdf.loc[opened(lanes, [(0, 0), *SIDES])[y, x] & pdf["inside"].to_numpy(), ["x", "y"]]

    return in_tiles(cells, ["road", "paved"], work, "x int, y int", tile, 2 * r + 2)


def opened(mask: np.ndarray, shape: list[tuple[int, int]]) -> np.ndarray:
    """Erosion by a shape, then dilation; what lies beyond the array is empty."""

    def moved(m: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros_like(m)
        h, w = m.shape
        out[max(0, -a) : h - max(0, a), max(0, -b) : w - max(0, b)] = m[max(0, a) : h - max(0, -a), max(0, b) : w - max(0, -b)]
        return out

    core = np.logical_and.reduce([moved(mask, a, b) for a, b in shape])
    return np.logical_or.reduce([moved(core, -a, -b) for a, b in shape])


def strips(cells: DataFrame, gsd: float) -> DataFrame:
    """region, area_m2, length_m, width_m of strip-like regions: long for their mean width and no yards.

    A region's length is that of its middle line, found from its rim: a strip of length l and width w
    has a rim of 2 (l + w) and an area of l w, and so have its bends, crossings and rings but for the
    corners.  (A ragged rim makes a region longer; an opening, as in :func:`corridor_cells`, smooths it.)
    """
    named = written(regions(cells), "regions")
    sides = beside(named, "region").join(named.select("x", "y", F.col("region").alias("other")), ["x", "y"], "left").filter("other is null or region <> other").groupBy("region").agg(F.count("*").alias("rim"))
    by = named.groupBy("region").agg(F.count("*").alias("n")).join(sides, "region")
    rim = F.col("rim").cast("double")
    length = (rim + F.sqrt(F.greatest(rim * rim - 16 * F.col("n"), F.lit(0.0)))) / 4
    out = by.select("region", (F.col("n") * gsd * gsd).alias("area_m2"), (length * gsd).alias("length_m"))
    out = out.withColumn("width_m", F.col("area_m2") / F.col("length_m"))
    return out.filter((F.col("area_m2") >= CORRIDOR_M2) & (F.col("length_m") >= CORRIDOR_M) & (F.col("length_m") >= ELONGATION * F.col("width_m")))


def merged_by_roofs(cells: DataFrame, cell_m2: float) -> DataFrame:
    """parcel, merged: parcels that share a house-sized roof become one, named by the least of them.

    ``cells`` has parcel and roof (0: none).  A roof with 85 % on one parcel merges nothing, and
    parcels with less than 15 % of it stay out.
    """
    n = cells.filter("parcel > 0 and roof > 0").groupBy("roof", "parcel").agg(F.count("*").alias("n"))
    size = n.groupBy("roof").agg(F.sum("n").alias("t"), F.max("n").alias("most")).filter((F.col("t") * cell_m2 <= ROOF_MOST_M2) & (F.col("most") / F.col("t") < ROOF_SHARE))
    held = n.join(size, "roof").filter(F.round(F.col("n") / F.col("t"), 12) >= round(1 - ROOF_SHARE, 12))
    hubs = held.groupBy("roof").agg(F.min("parcel").alias("hub"))
    links = held.join(hubs, "roof").select(F.col("parcel").alias("a"), F.col("hub").alias("b")).filter("a <> b")
    nodes = cells.filter("parcel > 0").select(F.col("parcel").cast("bigint").alias("node")).distinct()
    return graph_components(nodes, links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))).toDF("parcel", "merged")


def outlines(cells: DataFrame, size: float) -> DataFrame:
    """label, rings, area of every label: edges that two of its cells share cancel, the rest are chained."""
    x0, y0 = F.col("x") * F.lit(size), F.col("y") * F.lit(size)
    boxes = cells.filter("label is not null").select(F.struct("x", "y").alias("id"), "label", box_geometry(x0, y0, x0 + size, y0 + size).alias("geom"))
    return merged(boxes.select("id", "geom"), boxes.select("id", F.col("label").alias("group"))).withColumnRenamed("group", "label")


def fused(first: DataFrame, scores: DataFrame) -> DataFrame:
    """x, y, label: all cells of the first layer, and regions of 80 cells or more where both scores agree off it.

    ``scores`` has a and b; a region is added where their mean exceeds one half.  New labels follow the
    greatest one, in the order of the regions' first cells.
    """
    free = scores.filter((F.col("a") + F.col("b")) / 2 > FUSED_SCORE).join(first.filter("label > 0").select("x", "y"), ["x", "y"], "left_anti")
    named = written(regions(free.select("x", "y", F.lit(1).alias("label"))), "fused")
    big = named.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") >= FUSED_CELLS).select("region")
    most = first.agg(F.coalesce(F.max("label"), F.lit(0)).cast("bigint").alias("most"))
    numbers = ranked(big.withColumn("all", F.lit(0)), "all", [F.col("region")], "k", F.shiftright("region", 32)).crossJoin(F.broadcast(most)).select("region", (F.col("most") + F.col("k")).alias("label"))  # one row
    return first.filter("label > 0").select("x", "y", F.col("label").cast("bigint").alias("label")).unionByName(named.drop("label").join(numbers, "region").select("x", "y", "label"))


def targets(cells: DataFrame) -> DataFrame:
    """x, y, target, known: what a training cell should be, by how completely its tile is labelled.

    ``cells`` has kind (complete, negative, weak, partial), building, green and road.  ``target`` is
    building, green, road, other, not_building or null (ignored); in partial tiles only green cells
    and those within ten steps of a building are known.
    """
    near = cells.filter("kind = 'partial' and building").select("x", "y")
    steps = F.flatten(F.array(*[F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for b in range(abs(a) - KNOWN_CELLS, KNOWN_CELLS - abs(a) + 1)]) for a in range(-KNOWN_CELLS, KNOWN_CELLS + 1)]))
    rim = beside(near.withColumn("__k", F.lit(1)), "__k").join(near, ["x", "y"], "left_anti").select("x", "y").distinct()  # cells next to a building
    edge = beside(rim.withColumn("__k", F.lit(1)), "__k").join(near, ["x", "y"], "left_semi").select("x", "y").distinct()  # buildings' outer cells
    reach = edge.withColumn("d", F.explode(steps)).select((F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct().withColumn("reached", F.lit(True))
    out = cells.join(reach, ["x", "y"], "left")
    target = (
        F.when((F.col("kind") == "negative") & F.col("green"), "green").when(F.col("kind") == "negative", "other")
        .when(F.col("building"), "building").when((F.col("kind") != "complete") & F.col("road"), "road").when(F.col("green"), "green").when(F.col("kind") == "complete", "not_building")
    )
    known = (F.col("kind") != "partial") | F.col("green") | F.col("building") | F.coalesce("reached", F.lit(False))
    return out.select("x", "y", target.alias("target"), known.alias("known"))
