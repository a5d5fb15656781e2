"""Identifiers and defaults of a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.operators.graph import written
from cadaspark.operators.ranks import counts_below


def ranked(df: DataFrame, group: str, order: list[Column], out: str, block: Column) -> DataFrame:
    """Adds ``out``: the row's number within its group in an order that starts with ``block``.

    ``block`` is a coarse value of the first sort key (such as a band of latitude); rows are numbered
    within blocks and blocks by their counts, so a large group is spread over many tasks.
    """
    marked = df.withColumn("__block", block)
    counts = written(marked.groupBy(group, "__block").agg(F.count("*").alias("__n")), "blocks")
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__group"), F.col("__block").alias("__start"), before.alias("__before"))
    numbered = marked.withColumn("__k", F.row_number().over(W.partitionBy(group, "__block").orderBy(*order)))
    same = numbered[group].eqNullSafe(starts["__group"]) & numbered["__block"].eqNullSafe(starts["__start"])
    return numbered.join(starts, same).withColumn(out, F.col("__before") + F.col("__k")).drop("__block", "__k", "__before", "__group", "__start")


def coarse(df: DataFrame, column: str) -> Column:
    """A coarse value of a sort key that rises with it: a thousand of a number, the day of a time, the beginning of a text."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.to_date(column)
    if kind == "string":
        return F.left(column, F.lit(4))
    return F.col(column) if kind == "date" else F.floor(F.col(column) / 1000)


def with_defaults(parcels: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Unknown or missing status becomes draft, missing source manual."""
    return parcels.withColumn("status", F.when(F.col("status").isin(*statuses), F.col("status")).otherwise("draft")).withColumn("source", F.coalesce("source", F.lit("manual")))


def padded(number: Column, width: int) -> Column:
    """The number with leading zeros; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def provisional_pin(survey: Column, number: Column) -> Column:
    return F.concat_ws("-", F.upper(survey), padded(number, 4))


def by_length(df: DataFrame, key: str, length: str, out: str) -> DataFrame:
    """Adds ``out``: 1 for the longest row (ties: least key)."""
    return ranked(df.withColumn("__all", F.lit(1)), "__all", [F.desc(length), F.col(key)], out, -F.floor(length)).drop("__all")


def compacted(df: DataFrame, key: str, out: str) -> DataFrame:
    """The distinct values of ``key`` with their numbers from 1, in order."""
    return ranked(df.select(key).distinct().withColumn("__all", F.lit(1)), "__all", [F.col(key)], out, F.floor(F.col(key) / 10_000)).select(key, F.col(out).cast("bigint").alias(out))


def sequenced(df: DataFrame, prefix: str, order: list[Column], block: Column, width: int = 3) -> DataFrame:
    """Adds ``point_id``: the prefix with the row's number among its prefix's rows."""
    out = ranked(df, prefix, order, "__number", block)
    return out.withColumn("point_id", F.concat_ws("-", F.col(prefix), padded(F.col("__number"), width))).drop("__number")


def split_at(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the first value of ``column`` up to which at least ``share`` of the rows lie, and that share."""
    counts = counts_below(df.groupBy(column).agg(F.count("*").alias("n")), column, "n")
    total = counts.agg(F.sum("n").alias("total"))
    upto = (F.col("below") + F.col("n")) / F.col("total")
    return counts.crossJoin(F.broadcast(total)).withColumn("share", upto).filter(F.col("share") >= share).groupBy().agg(F.min(F.struct(column, "share")).alias("s")).select("s.*")  # one row


def with_new_ids(df: DataFrame, wanting: str, key: str = "id") -> DataFrame:
    """Rows with ``wanting`` get numbers after the greatest id, in the order of the old ids."""
    most = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__most"))
    new = df.filter(wanting).crossJoin(F.broadcast(most))  # one row
    new = ranked(new.withColumn("__all", F.lit(0)), "__all", [F.col(key)], "__k2", F.floor(F.col(key) / 100_000))
    new = new.withColumn(key, F.col("__most") + F.col("__k2")).select(*df.columns)
    return df.filter(~F.expr(wanting)).unionByName(new)
