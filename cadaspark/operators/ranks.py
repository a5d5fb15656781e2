"""Exact ranks and quantiles of a whole column, without one task that sees all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.operators.graph import written

#: Ranges that a column is counted in at once, and rows that one task may sort.
RANGES, FEW = 1024, 1_000_000


def range_of(value: Column, low: float, high: float) -> Column:
    """The value's range, 0 to ``RANGES`` - 1, between the least and the greatest value."""
    width = (high - low) / RANGES
    return F.least(F.lit(RANGES - 1), F.floor((value - low) / (width if width > 0 else 1.0)))


def kth(values: DataFrame, k: int, low: float, high: float) -> float:
    """The value of rank ``k`` (from 0) in column ``v``: ranges are counted and the one that holds it is narrowed."""
    while low < high:
        own = values.filter(F.col("v").between(low, high)).withColumn("r", range_of(F.col("v"), low, high))
        counts = own.groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("r").collect()  # at most RANGES rows
        for c in counts:
            if k < c["n"]:
                break
            k -= c["n"]
        if c["n"] <= FEW and c["low"] < c["high"]:
            rest = values.filter(F.col("v").between(c["low"], c["high"]))
            return rest.agg(F.element_at(F.array_sort(F.collect_list("v")), k + 1).alias("v")).first()["v"]
        low, high = c["low"], c["high"]
    return low


def quantiles(df: DataFrame, column: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls do not count, and without values all are null."""
    values = written(df.select(column.cast("double").alias("v")).filter("v is not null"), "quantile-values")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    if n <= FEW:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0])
    out = []
    for share in shares:
        at = share * (n - 1)
        below = kth(values, math.floor(at), low, high)
        out.append(below if at == math.floor(at) else below + (kth(values, math.ceil(at), low, high) - below) * (at - math.floor(at)))
    return out


def counts_below(by: DataFrame, value: str, count: str) -> DataFrame:
    """Adds ``below``: the sum of ``count`` over all lesser values; a row a distinct value, ranges have prefix sums."""
    by = written(by, "rank-counts")
    low, high = by.agg(F.min(value), F.max(value)).first()
    marked = by.withColumn("__r", range_of(F.col(value), float(low or 0), float(high or 0)))
    sums = marked.groupBy("__r").agg(F.sum(count).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most RANGES rows
    inside = F.coalesce(F.sum(count).over(W.partitionBy("__r").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__own", inside).join(F.broadcast(sums.select("__r", before.alias("__before"))), "__r").withColumn("below", F.col("__before") + F.col("__own")).drop("__r", "__own", "__before")
