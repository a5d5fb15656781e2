"""Work around models: tile graphs, training cells, weak labels, recall, sampling and a cell classifier."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.functions.projection import area_km2
from cadaspark.operators.cells import SIDES, offsets
from cadaspark.operators.graph import written
from cadaspark.operators.ranks import quantiles
from cadaspark.operators.regions import regions
from cadaspark.operators.numbering import coarse, ranked
from cadaspark.operators.topology import box_cells


def placed_tiles(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component, dx, dy: groups of overlapping tiles and positions relative to the least tile.

    ``edges`` has a, b and the offset of b from a.  Every round takes the least group around a tile,
    composing offsets, and then jumps to that group's own group.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    ways = written(edges.select("a", "b", "dx", "dy").unionByName(back), "tile-ways")
    now = written(tiles.select("node", F.col("node").alias("component"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")), "tile-places")
    pick = lambda c, x, y: F.struct(c.alias("component"), x.alias("dx"), y.alias("dy"))
    while True:
        around = ways.join(now.toDF("b", "c", "x", "y"), "b").groupBy("a").agg(F.min(pick(F.col("c"), F.col("x") - F.col("dx"), F.col("y") - F.col("dy"))).alias("m"))
        # the tile's position: its neighbour's position less the step from the tile to the neighbour
        own = pick(F.col("component"), F.col("dx"), F.col("dy"))
        pulled = now.join(around.toDF("node", "m"), "node", "left").select("node", F.col("component").alias("old"), F.least(own, F.coalesce("m", own)).alias("p"))
        further = now.select(F.col("node").alias("root"), F.col("component").alias("c"), F.col("dx").alias("x"), F.col("dy").alias("y"))
        jumped = pulled.join(further, F.col("p.component") == F.col("root"))
        step = jumped.select("node", "old", F.least(F.col("p"), pick(F.col("c"), F.col("p.dx") + F.col("x"), F.col("p.dy") + F.col("y"))).alias("p"))
        done = written(step.select("node", "old", "p.component", "p.dx", "p.dy"), "tile-places")
        now = done.select("node", "component", "dx", "dy")
        if done.filter("old <> component").isEmpty():
            return now


def training_cells(boxes: DataFrame, size: float) -> DataFrame:
    """cx, cy, boundary of approved parcels' cells: boundary where a side has another owner or none."""
    cells = box_cells(boxes.filter("status = 'approved'"), size).groupBy("cx", "cy").agg(F.min("id").alias("id"))
    beside = cells.select("cx", "cy", "id", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in SIDES])).alias("d"))
    beside = beside.select("cx", "cy", "id", (F.col("cx") + F.col("d.dx")).alias("ox"), (F.col("cy") + F.col("d.dy")).alias("oy"))
    met = beside.join(cells.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("id").alias("other")).hint("merge"), ["ox", "oy"], "left")  # far more cells than the boxes' size lets expect
    return met.groupBy("cx", "cy").agg(F.bool_or(F.col("other").isNull() | (F.col("other") != F.col("id"))).alias("boundary"))


def weak_labels(cells: DataFrame, reach: int = 1) -> DataFrame:
    """x, y, kind around footprints: core (all neighbours of the same one), seam (two are near), ignore (a rim)."""
    near = offsets(cells.filter("label > 0").select("x", "y", F.col("label").alias("own")), reach).select(F.col("ox").alias("x"), F.col("oy").alias("y"), "own")
    by = near.groupBy("x", "y").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"))
    out = cells.select("x", "y").join(by, ["x", "y"], "left")
    kind = F.when(F.col("n").isNull(), "ground").when(F.col("lo") != F.col("hi"), "seam").when(F.col("n") == (2 * reach + 1) ** 2, "core").otherwise("ignore")
    return out.select("x", "y", kind.alias("kind"))


def labels_with_roads(cells: DataFrame, reach: int = 1) -> DataFrame:
    """:func:`weak_labels` with roads: x, y, kind; ``cells`` has road and valid besides the footprints' label.

    A road off the footprints is a road, one on a footprint contradicts it and is ignored, as is what
    the survey does not cover.
    """
    marked = weak_labels(cells, reach).join(cells.select("x", "y", (F.col("label") > 0).alias("inside"), "road", "valid"), ["x", "y"])
    kind = F.when(~F.col("valid"), "ignore").when(F.col("road") & F.col("inside"), "ignore").when(F.col("road"), "road").otherwise(F.col("kind"))
    return marked.select("x", "y", kind.alias("kind"))


def footprint_recall(cells: DataFrame) -> DataFrame:
    """One row: footprints and those with half of their cells predicted or more."""
    each = cells.filter("truth > 0").groupBy("truth").agg(F.avg((F.col("pred") > 0).cast("int")).alias("share"))
    return each.agg(F.count("*").alias("footprints"), F.count_if(F.col("share") >= 0.5).alias("found"))


def leak_free(train: DataFrame, test: DataFrame, source: str) -> DataFrame:
    """Training rows whose source no test row has."""
    return train.join(test.select(source).distinct(), source, "left_anti")


def middle_items(items: DataFrame, sequence: str, order: str, n: int) -> DataFrame:
    """The middle item of each sequence, shortest sequences first: the first ``n``."""
    sizes = items.groupBy(sequence).agg(F.count("*").alias("size")).withColumnRenamed(sequence, "__sequence")
    marked = ranked(items, sequence, [F.col(order)], "__rank", coarse(items, order))
    both = marked.join(sizes, marked[sequence].eqNullSafe(F.col("__sequence"))).filter(F.col("__rank") == F.floor(F.col("size") / 2) + 1)
    return both.orderBy("size", sequence).limit(n).drop("__rank", "__sequence")


def tiles_of_box(tiles: DataFrame, west: int, north: int, east: int, south: int) -> DataFrame:
    """The mosaic of a tile range: x, y and the tile's columns (null where a tile is missing)."""
    one = tiles.sparkSession.range(1).select(F.explode(F.sequence(F.lit(west), F.lit(east))).alias("x"))
    return one.withColumn("y", F.explode(F.sequence(F.lit(north), F.lit(south)))).join(tiles, ["x", "y"], "left")


def balanced(df: DataFrame, label: str, key: list[str], ratio: int = 6) -> DataFrame:
    """All positive rows and about ``ratio`` times as many negative ones, chosen by a hash of ``key``."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    share = min(1.0, ratio * n["p"] / max(1, n["q"]))
    return df.filter((F.col(label) == 1) | (F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(share * 1_000_000)))


#: Trees of the road classifier and their depth (fixed values).
TREES, DEPTH = 80, 14


def cell_classifier(df: DataFrame, features: list[str], label: str, folds: int = 2, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """A random forest of cells, cross-validated by ``fold``: fold, rows, auc."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="features").transform(df).withColumn("label", F.col(label).cast("double"))
    rows = []
    for k in range(folds):
        train = balanced(ready.filter(F.col("fold") != k), label, features)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(train)
        scored = model.transform(ready.filter(F.col("fold") == k))
        rows.append((k, scored.count(), float(BinaryClassificationEvaluator().evaluate(scored))))
    return df.sparkSession.createDataFrame(rows, "fold int, rows bigint, auc double")


def area_profile(df: DataFrame, area: Column, large: float) -> DataFrame:
    """One row: the 10th, 50th, 90th and 99th percentile of areas, and how many exceed ``large``."""
    values = quantiles(df, area, [0.1, 0.5, 0.9, 0.99])
    return df.agg(*[F.lit(v).cast("double").alias(f"p{k}") for k, v in zip((10, 50, 90, 99), values, strict=True)], F.count_if(area > large).alias("large"))


def aligned(cells: DataFrame, factor: int) -> DataFrame:
    """x, y, value, coverage on a coarser grid: the mean of the cells with a value, and their share of the new cell."""
    fine = cells.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y"))
    value = F.nanvl(F.col("value").cast("double"), F.lit(None))
    return fine.agg(F.avg(value).alias("value"), (F.count(value) / factor**2).alias("coverage"))


def survey_mask(cells: DataFrame) -> DataFrame:
    """x, y, valid: cells with a value, and cells without one that no chain of such cells joins to the raster's edge."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(None))
    west, north, east, south = cells.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    empty = cells.filter(value.isNull()).select("x", "y", F.lit(0).alias("label"))
    named = written(regions(empty), "no-data")
    outer = named.filter(F.col("x").isin(west, east) | F.col("y").isin(north, south)).select("region").distinct()
    outside = named.join(outer, "region", "left_semi").select("x", "y", F.lit(True).alias("out"))
    return cells.join(outside, ["x", "y"], "left").select("x", "y", F.col("out").isNull().alias("valid"))


def clipped(boxes: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """Boxes cut to an extent (west, south, east, north); those outside are refused."""
    lit = lambda v: F.lit(float(v))
    west, south, east, north = extent
    out = boxes.filter((F.col("x0") < east) & (F.col("x1") > west) & (F.col("y0") < north) & (F.col("y1") > south))
    return out.withColumn("x0", F.greatest("x0", lit(west))).withColumn("y0", F.greatest("y0", lit(south))).withColumn("x1", F.least("x1", lit(east))).withColumn("y1", F.least("y1", lit(north)))


#: Largest area of one survey in square kilometres (fixed value).
MOST_KM2 = 0.35


def area_requests(boxes: DataFrame, most_km2: float = MOST_KM2) -> DataFrame:
    """Adds ``km2`` and ``refused`` (too large, or empty) to boxes in degrees (west, south, east, north)."""
    km2 = area_km2(*map(F.col, ("west", "south", "east", "north")))
    return boxes.withColumn("km2", km2).withColumn("refused", F.coalesce((F.col("km2") > most_km2) | (F.col("east") <= F.col("west")) | (F.col("north") <= F.col("south")), F.lit(True)))


def layer_extent(boxes: DataFrame, margin: float) -> DataFrame:
    """One row: the extent of a layer with a margin, and the mean of its centres."""
    middle = lambda a, b: F.avg((F.col(a) + F.col(b)) / 2)
    return boxes.agg((F.min("x0") - margin).alias("west"), (F.min("y0") - margin).alias("south"), (F.max("x1") + margin).alias("east"), (F.max("y1") + margin).alias("north"), middle("x0", "x1").alias("mid_x"), middle("y0", "y1").alias("mid_y"))


def tile_weight(kind: str, i: Column, crop: int) -> Column:
    """Weight of a tile's cell along one axis: flat, ramp (cells to the nearer edge) or hann."""
    if kind == "ramp":
        return F.least(i + 1, crop - i).cast("double")
    return F.lit(1.0) if kind == "flat" else 0.5 - 0.5 * F.cos(2 * pi * (i + 0.5) / crop)


def weighted(tiles: DataFrame, crop: int, kind: str = "ramp") -> DataFrame:
    """Adds the weight ``w`` of each cell (i, j in its tile): the lesser ramp of both axes, else the product."""
    a, b = tile_weight(kind, F.col("i"), crop), tile_weight(kind, F.col("j"), crop)
    return tiles.withColumn("w", F.least(a, b) if kind == "ramp" else a * b)


def crop_split(crops: DataFrame, line: float, size: int, buffer: int, coverage: float = 0.9) -> DataFrame:
    """Adds ``fold`` to covered crops: train west of the buffer before the line, test east of it; crops that straddle go."""
    fold = F.when(F.col("x") >= line, "test").when(F.col("x") + size <= line - buffer, "train")
    return crops.filter(F.col("coverage") >= coverage).withColumn("fold", fold).filter("fold is not null")


def region_cells(boxes: DataFrame, size: float, reach: int = 2) -> DataFrame:
    """cx, cy of the cells within two steps, also diagonal ones, of approved parcels' cells."""
    cells = box_cells(boxes.filter("status = 'approved'"), size).select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    return offsets(cells, reach).select(F.col("ox").alias("cx"), F.col("oy").alias("cy")).distinct()
