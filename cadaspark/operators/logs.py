"""Field-visit and edit logs, version history and review counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.rules import VERDICT_STATUS, cleaned, looked_up
from cadaspark.operators.numbering import coarse, ranked

STATUSES = ("draft", "approved", "rejected", "field_check")
KEPT_VERSIONS, LATEST = 50, 200


def status_counts(parcels: DataFrame) -> DataFrame:
    """One row: parcels, a count for every status (zeros included) and the share reviewed in %."""
    return parcels.agg(
        F.count("*").alias("parcels"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        (100 * F.count_if(F.col("status") != "draft") / F.greatest(F.count("*"), F.lit(1))).alias("reviewed_pct"),
    )


def effort(parcels: DataFrame, record_status: str | None = None) -> DataFrame:
    """Share of approved parcels that nobody edited, and of compared parcels that match the record."""
    approved = F.col("status") == "approved"
    columns = [(100 * F.count_if(approved & (F.col("source") == "ai")) / F.nullif(F.count_if(approved), F.lit(0))).alias("as_drawn_pct")]
    if record_status:
        columns.append((100 * F.count_if(F.col(record_status) == "MATCH") / F.nullif(F.count(record_status), F.lit(0))).alias("record_match_pct"))
    return parcels.agg(*columns)


def field_summary(visits: DataFrame) -> DataFrame:
    """One row: visits, distinct parcels, visits on site, and visits by verdict as a map."""
    by = visits.groupBy("verdict").agg(F.count("*").alias("n"))
    totals = visits.agg(F.count("*").alias("visits"), F.countDistinct("parcel_id").alias("parcels_visited"), F.count_if("on_site").alias("on_site"))
    verdicts = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("by_verdict"))  # a row a verdict
    return totals.crossJoin(F.broadcast(verdicts))


def running_visits(visits: DataFrame) -> DataFrame:
    """Each visit with the number of visits of its parcel so far."""
    own = visits.select("obs_id", "parcel_id", "time")
    return ranked(own, "parcel_id", [F.col("time"), F.col("obs_id")], "field_visits", coarse(own, "time")).select("obs_id", "parcel_id", "field_visits")


def latest_status(visits: DataFrame) -> DataFrame:
    """Review status that the latest visit of each parcel sets (ties: greatest obs_id)."""
    last = visits.groupBy("parcel_id").agg(F.max_by(F.struct("verdict", "on_site", "time"), F.struct("time", "obs_id")).alias("v"))
    return last.select("parcel_id", F.col("v.verdict").alias("field_verdict"), looked_up(VERDICT_STATUS, F.col("v.verdict")).alias("status"), F.col("v.on_site").alias("field_on_site"), F.col("v.time").alias("time"))


def version_rank(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``age``: 1 for a key's newest version."""
    first = order[0]
    marked = versions.withColumn("__coarse", coarse(versions, first))
    sizes = marked.groupBy(key).agg(F.count("*").alias("__size"))
    back = ranked(marked, key, [F.col(c) for c in order], "__from_old", F.col("__coarse"))
    both = back.join(sizes.withColumnRenamed(key, "__key"), back[key].eqNullSafe(F.col("__key")))
    return both.withColumn("age", (F.col("__size") + 1 - F.col("__from_old")).cast("bigint")).drop("__coarse", "__size", "__from_old", "__key")


def last_versions(versions: DataFrame, key: str, order: list[str], kept: int = KEPT_VERSIONS) -> DataFrame:
    return version_rank(versions, key, order).filter(F.col("age") <= kept)


def undone(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The version before the last of each key that has one."""
    return version_rank(versions, key, order).filter("age = 2").drop("age")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two versions has, with ``change`` = removed or added."""
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def edit_activity(edits: DataFrame, width: str = "1 day") -> DataFrame:
    return edits.groupBy(F.window("t", width).alias("w")).agg(F.count("*").alias("edits"), F.countDistinct("parcels").alias("parcels")).select(F.col("w.start").alias("start"), "edits", "parcels")


def latest_entries(edits: DataFrame, n: int = LATEST) -> DataFrame:
    """Newest entries of the log, a top-k report."""
    return edits.orderBy(F.desc("t"), F.desc("edit_id")).limit(n)


def without(layer: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The layer without deleted rows."""
    return layer.join(gone.select(key), key, "left_anti")


def soft_deleted(layer: DataFrame, gone: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """The layer with ``deleted_at`` on the rows that go; they can be restored by clearing it."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    before = F.col("deleted_at") if "deleted_at" in layer.columns else F.lit(None).cast("timestamp")
    return layer.withColumn("deleted_at", before).join(marks, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("__gone"), at))).drop("__gone")


def current(layer: DataFrame) -> DataFrame:
    """What a layer shows: rows that are not deleted."""
    return layer.filter("deleted_at is null").drop("deleted_at")


def renamed(surveys: DataFrame, names: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Surveys (id, name) with their new names, and the log entries; empty names are refused and change nothing."""
    wanted = names.select("id", cleaned(F.col("name"), 120).alias("__new")).filter(F.col("__new") != "")
    out = surveys.join(wanted, "id", "left")
    log = out.filter("__new is not null").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("t"), F.concat(F.lit("renamed from '"), F.col("name"), F.lit("' to '"), F.col("__new"), F.lit("'")).alias("action"))
    return out.withColumn("name", F.coalesce("__new", "name")).drop("__new"), log
