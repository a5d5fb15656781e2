"""Spatial joins as equi-joins on grid cells.

Every layer carries its bounding boxes as ``x0, y0, x1, y1``.  Boxes are exploded to the cells that
they touch, the layers are joined on the cell, and a pair is kept only in the cell where both boxes
begin (the greater of the least cells), so no pair is found twice and no ``distinct`` is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.functions.geometry import bounds, box_area, box_distance, box_overlap, union_area
from cadaspark.operators.graph import written

#: Default side of a cell in metres: a few times the side of a usual parcel.
CELL = 50.0


def with_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    b = bounds(F.col(geom))
    return df.withColumn("__b", b).select(*df.columns, "__b.x0", "__b.y0", "__b.x1", "__b.y1")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as the session has for shuffles or cores, however few their bytes are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def celled(df: DataFrame, prefix: str, cell: float, grow: float = 0.0) -> DataFrame:
    """``df`` (columns already named) once for each cell that its grown box touches."""
    at = lambda c, d: F.floor((F.col(f"{prefix}{c}") + d) / cell)
    own = df.withColumn(f"{prefix}cx", at("x0", -grow)).withColumn(f"{prefix}cy", at("y0", -grow))
    return own.withColumn("cx", F.explode(F.sequence(F.col(f"{prefix}cx"), at("x1", grow)))).withColumn("cy", F.explode(F.sequence(F.col(f"{prefix}cy"), at("y1", grow))))


def box_pairs(left: DataFrame, right: DataFrame, reach: float = 0.0, cell: float = CELL, extra: Column | None = None) -> DataFrame:
    """Pairs whose boxes are within ``reach`` on both axes; columns get the prefixes ``a_``, ``b_``."""
    a, b = celled(named(left, "a_"), "a_", cell, reach), celled(named(right, "b_"), "b_", cell)
    near = (F.col("a_x0") - reach <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1") + reach) & (F.col("a_y0") - reach <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1") + reach)
    once = (F.col("cx") == F.greatest("a_cx", "b_cx")) & (F.col("cy") == F.greatest("a_cy", "b_cy"))
    keep = near & once if extra is None else near & once & extra
    # rows for each cell are many more than a table's size lets expect, so they are never broadcast
    return a.join(b.hint("merge"), ["cx", "cy"]).filter(keep).drop("cx", "cy", "a_cx", "a_cy", "b_cx", "b_cy")


def overlay(left: DataFrame, right: DataFrame, cell: float = CELL, exact: bool = False, extra: Column | None = None) -> DataFrame:
    """Pairs with ``inter`` > 0, the overlap area, and ``a_area``, ``b_area``.

    Layers of boxes need their corners alone; with ``exact`` both carry ``geom`` and ``area``, and
    the overlap of the polygons themselves is computed.
    """
    pairs = box_pairs(left, right, cell=cell, extra=extra)
    if exact:
        from cadaspark.functions.kernels import overlap_area

        # the kernel is the costly part: pairs are few bytes but much work, so they are not coalesced by size
        pairs = spread(pairs).withColumn("inter", overlap_area("a_geom", "b_geom"))
    else:
        pairs = pairs.withColumn("inter", box_overlap("a_", "b_")).withColumn("a_area", box_area("a_")).withColumn("b_area", box_area("b_"))
    return pairs.filter("inter > 0").withColumn("iou", F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter")))


def covered_area(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """``key`` and ``covered``: the area of each box of ``left`` that the boxes of ``right`` cover together.

    Boxes without an overlap have no row.  Where boxes of ``right`` overlap, the area counts once.
    """
    pairs = box_pairs(left.select(key, "x0", "y0", "x1", "y1"), right.select("x0", "y0", "x1", "y1"))
    part = F.struct(F.greatest("a_x0", "b_x0").alias("x0"), F.greatest("a_y0", "b_y0").alias("y0"), F.least("a_x1", "b_x1").alias("x1"), F.least("a_y1", "b_y1").alias("y1"))
    parts = pairs.select(F.col(f"a_{key}").alias(key), part.alias("p")).filter("p.x0 < p.x1 and p.y0 < p.y1")
    return parts.groupBy(key).agg(F.collect_set("p").alias("parts")).select(key, union_area(F.col("parts")).alias("covered"))


def within_distance(left: DataFrame, right: DataFrame, reach: float, cell: float = CELL) -> DataFrame:
    """Pairs of boxes at most ``reach`` apart, with ``distance``."""
    return box_pairs(left, right, reach, cell).withColumn("distance", box_distance("a_", "b_")).filter(F.col("distance") <= reach)


def containing(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Points (``x``, ``y``) with the boxes that hold them (lower sides included, upper excluded)."""
    p = named(points, "a_").withColumn("cx", F.floor(F.col("a_x") / cell)).withColumn("cy", F.floor(F.col("a_y") / cell))
    b = celled(named(boxes, "b_"), "b_", cell)
    inside = (F.col("a_x") >= F.col("b_x0")) & (F.col("a_x") < F.col("b_x1")) & (F.col("a_y") >= F.col("b_y0")) & (F.col("a_y") < F.col("b_y1"))
    return p.join(b.hint("merge"), ["cx", "cy"]).filter(inside).drop("cx", "cy", "b_cx", "b_cy")


def nearest(points: DataFrame, key: str, targets: DataFrame, k: int, tie: str, cell: float = CELL) -> DataFrame:
    """The ``k`` nearest targets (``x``, ``y``) of every point, with ``distance`` and ``rank``.

    A round looks at the nine cells around a point.  A point is done when it has ``k`` targets no
    farther than a cell's side; only the others go on, to cells four times as wide, until a cell
    spans both layers.  Rounds are written, so none is computed twice.
    """
    span = points.select("x", "y").unionByName(targets.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    most = max([0.0, *(v for v in span if v is not None)])
    found, todo = None, points
    ring = F.sequence(F.lit(-1), F.lit(1))
    while True:
        b = named(targets, "b_").withColumn("cx", F.floor(F.col("b_x") / cell)).withColumn("cy", F.floor(F.col("b_y") / cell))
        a = named(todo, "a_").withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        a = a.withColumn("cx", F.floor(F.col("a_x") / cell) + F.col("dx")).withColumn("cy", F.floor(F.col("a_y") / cell) + F.col("dy")).drop("dx", "dy")
        pairs = a.join(b.hint("merge"), ["cx", "cy"]).drop("cx", "cy").withColumn("distance", F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
        if k == 1:  # an aggregate combines before the shuffle
            own, rest = [c for c in pairs.columns if c.startswith("a_")], [c for c in pairs.columns if not c.startswith("a_")]
            best = pairs.groupBy(*own).agg(F.min_by(F.struct(*rest), F.struct("distance", f"b_{tie}")).alias("best"))
            ranked = best.select(*own, "best.*", F.lit(1).alias("rank"))
        else:
            order = W.partitionBy(f"a_{key}").orderBy("distance", f"b_{tie}")
            ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        last = cell >= most
        ranked = written(ranked, "nearest")
        if not last:
            full = ranked.filter((F.col("rank") == k) & (F.col("distance") <= cell)).select(F.col(f"a_{key}").alias(key))
            ranked = ranked.join(full.withColumnRenamed(key, f"a_{key}"), f"a_{key}", "left_semi") if k > 1 else ranked.filter(F.col("distance") <= cell)
        found = ranked if found is None else found.unionByName(ranked)
        if last:
            return found
        todo = written(todo.join(full, key, "left_anti"), "nearest-todo")
        if todo.isEmpty():
            return found
        cell *= 4
