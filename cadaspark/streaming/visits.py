"""Field visits and edits as streams.

Every function takes a streaming (or batch) DataFrame of visits and returns one; :func:`run` drives a
stream over all available input into Parquet below the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.functions.rules import VERDICT_STATUS, looked_up
from cadaspark.operators.comparison import corner_error, vertex_errors
from cadaspark.operators.graph import removed, shared_folder
from cadaspark.operators.ranks import counts_below

LATE = "10 minutes"


def source(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream over Parquet files, ``files`` of them in a micro-batch (all that there are, if not given)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All results of a stream over the input there is now.

    Append mode writes to a file sink.  In update mode each micro-batch is written with its number;
    readers take the last row of a key (see :func:`newest`).  In complete mode every micro-batch
    holds the whole result, so the last one alone is read.
    """
    spark = stream.sparkSession
    folder, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", folder).outputMode("append").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(folder)
    query = writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/n={n}")).start()
    query.awaitTermination()
    every = spark.read.parquet(folder)
    if mode == "complete":
        last = every.agg(F.max("n")).first()[0]  # a partition column
        return every.filter(F.col("n") == last)
    return every


def newest(results: DataFrame, *keys: str) -> DataFrame:
    """The last micro-batch's row of every key."""
    rest = [c for c in results.columns if c not in (*keys, "batch", "n")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def latest_status(visits: DataFrame) -> DataFrame:
    """Status that each parcel's latest visit sets; a late visit never overrides a newer one (update mode)."""
    last = visits.groupBy("parcel_id").agg(F.max(F.struct("time", "obs_id", "verdict")).alias("v"))
    return last.select("parcel_id", F.col("v.verdict").alias("field_verdict"), looked_up(VERDICT_STATUS, F.col("v.verdict")).alias("status"))


def without_repeats(visits: DataFrame, late: str = LATE) -> DataFrame:
    return visits.withWatermark("time", late).dropDuplicatesWithinWatermark(["obs_id"])


def verdict_windows(visits: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Visits by verdict in tumbling windows."""
    by = visits.withWatermark("time", late).groupBy(F.window("time", width).alias("w"), "verdict").agg(F.count("*").alias("visits"))
    return by.select(F.col("w.start").alias("start"), "verdict", "visits")


def on_site_share(visits: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Share of visits on site in sliding windows."""
    by = visits.withWatermark("time", late).groupBy(F.window("time", width, step).alias("w")).agg(F.avg(F.col("on_site").cast("int")).alias("share"))
    return by.select(F.col("w.start").alias("start"), "share")


def sessions(visits: DataFrame, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    """Visits of a parcel in sessions that a pause ends.

    In append mode a session comes once, when the watermark has passed it, and its state goes; in
    complete mode all sessions so far come with every micro-batch, and all state stays.
    """
    by = visits.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), "parcel_id").agg(F.count("*").alias("visits"))
    return by.select("parcel_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "visits")


def enriched(visits: DataFrame, parcels: DataFrame) -> DataFrame:
    """Stream-static join: visits with their parcel's status and whether they were on site."""
    return visits.join(parcels.select(F.col("id").alias("parcel_id"), F.col("status").alias("parcel_status")), "parcel_id", "left")


def edit_windows(edits: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    by = edits.withWatermark("t", late).groupBy(F.window("t", width).alias("w")).agg(F.count("*").alias("edits"))
    return by.select(F.col("w.start").alias("start"), "edits")


#: Parts of a metre in which errors are counted.
PARTS = 1_000_000


def error_counts(errors: DataFrame) -> DataFrame:
    """part (null: no corner point), n, total, squares, most: errors counted by millionths of a metre.

    Two such tables add up row by row, so a stream's errors need not be kept.
    """
    e = corner_error()
    by = errors.groupBy(F.floor(e * PARTS).alias("part")).agg(F.count("*").alias("n"), F.sum(e).alias("total"), F.sum(e * e).alias("squares"), F.max(e).alias("most"))
    return by.fillna(0.0, ["total", "squares"])


def added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("most").alias("most"))


def accuracy_of(counts: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The row of :func:`comparison.point_accuracy` from counted errors; CE90 is exact to a millionth of a metre."""
    corner = counts.filter("part is not null")
    n, least = corner.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("part")).first()
    ce90 = None
    if n:
        at = 0.9 * (n - 1)
        below = counts_below(corner.select("part", "n", (F.col("total") / F.col("n")).alias("e")), "part", "n")
        wanted = F.array(*[F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("e"))) for k in (math.floor(at), math.ceil(at))])
        low, high = below.agg(wanted.alias("v")).first()["v"]
        ce90 = low + (high - low) * (at - math.floor(at))
    sums = counts.agg(
        F.sum("n").alias("points"), F.coalesce(F.sum(F.when(F.col("part").isNotNull(), F.col("n"))), F.lit(0)).alias("corner_points"),
        F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("most").alias("max_m"),
        F.sum(F.when(F.col("most") <= tolerance, F.col("n"))).alias("within"),
    )
    c = F.nullif("corner_points", F.lit(0))
    return sums.select("points", "corner_points", (F.col("total") / c).alias("mean_m"), F.sqrt(F.col("squares") / c).alias("rmse_m"), F.lit(ce90).cast("double").alias("ce90_m"), "max_m", (100 * F.coalesce("within", F.lit(0)) / c).alias("within_pct"))


def running_accuracy(corners: DataFrame, layer: DataFrame, name: str = "corners") -> DataFrame:
    """Accuracy after every micro-batch of recorded corners: batch, points and the accuracy so far.

    A micro-batch reads its own rows and the counts that the one before left, and writes new counts
    under its number; a repeated micro-batch begins from the same counts, so it counts once.  Counts
    have a row a distinct millionth of a metre, whatever the number of corners.
    """
    spark = corners.sparkSession
    folder, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")

    def add(df: DataFrame, n: int) -> None:
        own = error_counts(vertex_errors(df, layer))
        whole = own if n == 0 else added(own.unionByName(spark.read.parquet(f"{folder}/counts/n={n - 1}")))
        whole.write.mode("overwrite").parquet(f"{folder}/counts/n={n}")
        now = spark.read.parquet(f"{folder}/counts/n={n}")
        accuracy_of(now).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/accuracy/n={n}")
        if n > 1:
            removed(spark, f"{folder}/counts/n={n - 2}")

    corners.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.parquet(f"{folder}/accuracy").drop("n")
