"""Zonal statistics, land cover and land use of parcels from classified cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.rules import APP_CLASSES, COVER, REMAP, cover_label, land_use, looked_up, storeys
from cadaspark.operators.ranks import quantiles


def zonal_stats(cells: DataFrame) -> DataFrame:
    """A row a zone: cells, built, green (vegetation), certainty (mean of prob), median height, storeys."""
    built = F.col("class") == 8
    out = cells.groupBy("zone").agg(
        F.count("*").alias("cells"),
        F.count_if(built).alias("built"),
        F.count_if(F.col("class").isin(2, 5, 7)).alias("green"),
        F.avg("prob").alias("certainty"),
        F.percentile(F.when(built, F.col("height_m")), F.lit(0.5)).alias("height_m"),
    )
    return out.withColumn("storeys", storeys(F.col("height_m")))


def class_counts(cells: DataFrame) -> DataFrame:
    """zone x class cross table with zeros: c1 .. c8."""
    return cells.groupBy("zone").agg(*[F.count_if(F.col("class") == k).alias(f"c{k}") for k in range(1, 9)])


def cover_shares(cells: DataFrame) -> DataFrame:
    """zone, shares (map of class name to share), percent (classes of 1 % or more, one decimal)."""
    wide = class_counts(cells)
    total = sum((F.col(f"c{k}") for k in range(2, 9)), F.col("c1"))
    entries = F.array(*[F.struct(F.lit(COVER[k - 1]).alias("k"), (F.col(f"c{k}") / total).alias("v")) for k in range(1, 9)])
    out = wide.select("zone", F.map_filter(F.map_from_entries(entries), lambda k, v: v > 0).alias("shares"))
    percent = F.map_filter(F.transform_values("shares", lambda k, v: F.round(100 * v, 1)), lambda k, v: v >= 1)
    return out.withColumn("percent", percent)


def parcel_attributes(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row a zone: land cover label, land use.  ``evidence`` has zone, buildings, largest_m2, frontage_m, area_m2."""
    joined = zonal_stats(cells).join(cover_shares(cells), "zone").join(evidence, "zone", "left").fillna(0, ["buildings", "largest_m2", "frontage_m", "area_m2"])
    share = lambda name: F.coalesce(F.element_at("shares", F.lit(name)), F.lit(0.0))
    green = F.col("green") / F.col("cells")
    cover = F.col("built") / F.col("cells")
    return joined.select("zone", "cells", cover.alias("cover"), "height_m", "storeys", "percent", cover_label(cover, F.col("shares")).alias("landcover"), land_use(F.col("buildings"), F.col("largest_m2"), cover, F.col("frontage_m"), F.col("height_m"), F.col("area_m2"), share("water"), green)["use"].alias("land_use"))


def remapped(cells: DataFrame) -> DataFrame:
    """zone, app_class, p: probabilities summed by the application's classes and renormalised."""
    app = cells.withColumn("app_class", looked_up({k: APP_CLASSES[v] for k, v in REMAP.items()}, F.col("class"))).groupBy("zone", "app_class").agg(F.sum("prob").alias("s"))
    total = app.groupBy("zone").agg(F.sum("s").alias("t"))
    return app.join(total, "zone").select("zone", "app_class", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("p"))


def blended(scores: DataFrame) -> DataFrame:
    """Weighted mean of overlapping tile scores: cell, score."""
    return scores.groupBy("cell").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("score"))


def majority_owner(cells: DataFrame) -> DataFrame:
    """Most frequent parcel under each building (ties: least id); cells without a parcel do not count."""
    counts = cells.filter("parcel > 0").groupBy("building", "parcel").agg(F.count("*").alias("n"))
    return counts.groupBy("building").agg(F.max_by("parcel", F.struct("n", -F.col("parcel"))).alias("parcel"))


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    """Adds ``scaled``: 0 at the 2nd and 1 at the 98th percentile, clipped."""
    low, high = quantiles(df, F.col(column), [0.02, 0.98])
    span = max((high or 0.0) - (low or 0.0), 1e-9)
    return df.withColumn("scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - F.lit(low)) / span)))
