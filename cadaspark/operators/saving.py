"""The save of a layer: defaults, measures, checks, annotation, counts, log entry and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.operators import topology
from cadaspark.operators.graph import written
from cadaspark.operators.logs import STATUSES, status_counts
from cadaspark.operators.numbering import provisional_pin, ranked, with_defaults
from cadaspark.operators.siting import note

#: Columns that a comparison with a record adds to parcels (fixed values).
RECORD_COLUMNS = ("record_status", "record_iou", "record_ref_id")


def stamp(at: Column) -> Column:
    """A time as logs and versions show it."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def numbered_issues(found: DataFrame) -> DataFrame:
    """Adds ``n``: issues from 1 in the order of their types, then parcels."""
    marked = found.withColumn("__all", F.lit(1)).withColumn("__first", F.coalesce(F.array_min("parcel_ids"), F.lit(-1)))
    order = [F.col("type"), F.col("__first"), F.col("parcel_ids").cast("string"), F.col("amount")]
    out = ranked(marked, "__all", order, "n", F.struct("type", F.floor(F.col("__first") / 10_000).alias("part")))
    return out.drop("__all", "__first")


def saved(parcels: DataFrame, survey: str, action: str, at: Column, corridors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a save makes of ``parcels`` (id, geom, status, source): layer, issues, review counts and log entry.

    Unknown statuses become drafts, missing sources are by hand, missing PINs follow from survey and
    id, areas and perimeters are measured, and each parcel lists the types of its issues.  ``corridors``
    (geom and box) are no gaps.
    """
    layer = with_defaults(parcels if "prov_pin" in parcels.columns else parcels.withColumn("prov_pin", F.lit(None).cast("string")), STATUSES)
    pin = F.coalesce(F.nullif("prov_pin", F.lit("")), provisional_pin(F.lit(survey), F.col("id")))
    layer = layer.withColumn("prov_pin", pin).withColumn("area_m2", F.round(g.area(F.col("geom")), 1)).withColumn("perimeter_m", F.round(g.perimeter(F.col("geom")), 1))
    issues = written(numbered_issues(topology.issues(parcels.select("id", "geom"), corridors)), "issues")
    marked = layer.drop("issues").join(topology.issue_types(issues), "id", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    counts = status_counts(marked)
    by_type = issues.groupBy("type").agg(F.count("*").alias("n")).agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))), F.create_map().cast("map<string,bigint>")).alias("issues"))  # a row a type
    review = counts.crossJoin(by_type)  # one row each
    log = marked.agg(F.count("*").alias("parcels")).crossJoin(issues.agg(F.count("*").alias("issues"))).select(stamp(at).alias("t"), F.lit(action).alias("action"), "parcels", "issues")  # one row each
    return marked, issues, review, log


def without_record(parcels: DataFrame) -> DataFrame:
    """The layer after its record was removed: the comparison's columns go."""
    return parcels.drop(*RECORD_COLUMNS)


def baked(layer: DataFrame, alerts: DataFrame) -> DataFrame:
    """A layer with ``area_m2``, ``alerts`` and a verification ``note`` in its rows, for viewers without an engine."""
    out = layer.join(alerts.select("id", "area_m2", "alerts"), "id", "left")
    return out.withColumn("alerts", F.coalesce("alerts", F.array().cast(dict(alerts.dtypes)["alerts"]))).withColumn("note", note())


def as_summary(one_row: DataFrame) -> DataFrame:
    """A table of one row as one JSON text, as summaries are kept beside their data."""
    return one_row.select(F.to_json(F.struct(*one_row.columns)).alias("json"))
