"""Review queues: filters, orders and top-k reports (the limit is the feature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def certainty() -> Column:
    """Confidence with null (drawn by hand) as 0, i.e. first in a queue."""
    return F.coalesce(F.col("confidence"), F.lit(0.0))


def ranked(df: DataFrame, *order: Column, n: int) -> DataFrame:
    """The first ``n`` rows in an order, with ``rank``; the window sees those rows alone."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def review_queue(parcels: DataFrame, status: str | None = None, n: int = 200) -> DataFrame:
    """Parcels with issues first, then by confidence; ``parcels`` has ``issues`` (array, null if none)."""
    wanted = parcels if status is None else parcels.filter(F.col("status") == status)
    return ranked(wanted, F.coalesce(F.size("issues") <= 0, F.lit(True)).asc(), certainty(), F.col("id"), n=n)


def next_to_review(parcels: DataFrame, selected: list[int]) -> DataFrame:
    return parcels.filter((F.col("status") == "draft") & ~F.col("id").isin(selected)).orderBy(certainty(), "id").limit(1)


def field_queue(parcels: DataFrame, lat: float | None, lon: float | None, status: str = "field_check", n: int = 150) -> DataFrame:
    """By distance to the middle of the box (``lat``, ``lon`` columns) when a position is given, else by confidence."""
    from cadaspark.functions.projection import haversine

    wanted = parcels.filter(F.col("status") == status)
    if lat is None or lon is None:
        return ranked(wanted, certainty(), F.col("id"), n=n)
    wanted = wanted.withColumn("distance_m", F.round(haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), 2))
    return ranked(wanted, F.col("distance_m"), F.col("id"), n=n)


def priority(landlocked: DataFrame, unrecorded: DataFrame, everything: DataFrame, n: int = 8) -> DataFrame:
    """Landlocked parcels, then unrecorded ones, then the rest, each once: id, grade."""
    a = landlocked.select("id", F.lit(1).alias("grade"))
    b = unrecorded.select("id").join(a, "id", "left_anti").withColumn("grade", F.lit(2))
    c = everything.select("id").join(a, "id", "left_anti").join(b.select("id"), "id", "left_anti").withColumn("grade", F.lit(3))
    return ranked(a.unionByName(b).unionByName(c), F.col("grade"), F.col("id"), n=n)


def top_per_group(df: DataFrame, group: str, *order: Column, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= n)


def most_alerts(buildings: DataFrame, n: int = 8) -> DataFrame:
    """Buildings with the most alerts first (ties: least id)."""
    return ranked(buildings, F.size("alerts").desc(), F.col("id"), n=n)
