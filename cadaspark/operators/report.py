"""A survey's report and its statistics: one row of nested tables each, from the results of other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.rules import LAND_USES, width_class
from cadaspark.operators.logs import STATUSES

# --- fixed values: results must equal these, so they are stated as they are ---
ENCROACHMENTS, ISSUES, COVER_SHARE = 12, 15, 0.005
ROAD_CLASSES = ("lane", "street", "main road")
NARROW_M = 3.0
# --- end of fixed values ---


def first_rows(df: DataFrame, order: list[Column], row: Column, n: int, out: str) -> DataFrame:
    """One row: the first ``n`` rows of a table as an array in their order, a top-k report."""
    top = df.orderBy(*order).limit(n)
    return top.agg(F.collect_list(F.struct(F.struct(*order_keys(top)).alias("k"), row.alias("v"))).alias("l")).select(F.transform(F.array_sort("l"), lambda x: x["v"]).alias(out))


def order_keys(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if c.startswith("__")]


def road_lengths(segments: DataFrame) -> DataFrame:
    """One row: length_m, median_width_m, narrow_m and by_class (class and metres, all classes) of segments with width_m and length_m."""
    kind = width_class(F.col("width_m"))
    by = F.array(*[F.struct(F.lit(c).alias("class"), F.round(F.coalesce(F.sum(F.when(kind == c, F.col("length_m"))), F.lit(0.0)), 1).alias("length_m")) for c in ROAD_CLASSES])
    narrow = F.coalesce(F.sum(F.when(F.col("width_m") < NARROW_M, F.col("length_m"))), F.lit(0.0))
    return segments.agg(F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("length_m"), F.median("width_m").alias("median_width_m"), narrow.alias("narrow_m"), by.alias("by_class"))


def fractions(cells: DataFrame, kind: str, least: float = 0.0) -> DataFrame:
    """One row: ``fractions``, an array of kind and share of all cells, greatest first (ties: the lesser kind)."""
    by = cells.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n"))
    whole = by.agg(F.sum("n").alias("all"), F.collect_list(F.struct((-F.col("n")).alias("k"), "kind", "n")).alias("l"))  # a row a kind
    share = F.transform(F.array_sort("l"), lambda x: F.struct(x["kind"].alias("kind"), (x["n"] / F.col("all")).alias("share")))
    return whole.select(F.coalesce(F.filter(share, lambda s: s["share"] >= least), F.array().cast("array<struct<kind:string,share:double>>")).alias("fractions"))


def survey_statistics(attributes: DataFrame, buildings: DataFrame, on_road: DataFrame, segments: DataFrame, cells: DataFrame, area_m2: float) -> DataFrame:
    """One row of a survey's statistics: counts, road lengths, class fractions, land uses (zeros included) and area_km2.

    ``attributes`` has land_use, ``on_road`` the kinds of :func:`siting.road_encroachment`, ``cells`` class.
    """
    uses = F.map_from_arrays(F.array(*map(F.lit, LAND_USES)), F.array(*[F.count_if(F.col("land_use") == u) for u in LAND_USES]))
    out = attributes.agg(F.count("*").alias("parcels"), uses.alias("land_use_count")).crossJoin(buildings.agg(F.count("*").alias("buildings")))
    kinds = on_road.agg(F.count_if(F.col("kind") == "encroachment").alias("encroachments"), F.count_if(F.col("kind") == "road_conflict").alias("road_building_conflicts"))
    out = out.crossJoin(kinds).crossJoin(road_lengths(segments)).crossJoin(fractions(cells, "class"))  # one row each
    return out.withColumn("class_fraction", F.map_from_entries(F.transform("fractions", lambda f: F.struct(f["kind"], F.round(f["share"], 3))))).drop("fractions").withColumn("area_km2", F.round(F.lit(area_m2 / 1e6), 3))


def survey_report(
    parcels: DataFrame, buildings: DataFrame, on_road: DataFrame, issues: DataFrame, segments: DataFrame, cells: DataFrame,
    comparison: DataFrame | None = None, accuracy: DataFrame | None = None, against_record: DataFrame | None = None,
) -> DataFrame:
    """One row: kpis, land_use, land_cover, roads, encroachments (the 12 largest), comparison, issues (the first 15) and review.

    ``parcels`` has status, area_m2 and land_use, ``on_road`` id, kind, overlap_m2 and depth_m, ``issues``
    type and parcel_ids, ``cells`` class.  ``comparison`` is a row of :func:`comparison.comparison_summary`,
    ``accuracy`` one of :func:`comparison.point_accuracy`, ``against_record`` the buildings of
    :func:`comparison.buildings_vs_record`; what is not given is null.
    """
    n = F.count("*")
    reviewed = F.round(100 * F.count_if(F.col("status") != "draft") / F.greatest(n, F.lit(1)))
    own = parcels.agg(
        n.alias("parcels"), F.round(F.coalesce(F.sum("area_m2"), F.lit(0.0)) / 1e6, 3).alias("area_km2"), reviewed.alias("reviewed_pct"),
        F.struct(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).alias("review"),
        F.array(*[F.struct(F.lit(u).alias("use"), F.count_if(F.col("land_use") == u).alias("parcels")) for u in LAND_USES]).alias("uses"),
    )
    found = on_road.filter("kind = 'encroachment'")
    large = found.withColumn("__k", -F.col("overlap_m2")).withColumn("__id", F.col("id"))
    top = first_rows(large, [F.col("__k"), F.col("__id")], F.struct("id", F.round("overlap_m2", 1).alias("area_m2"), F.round("depth_m", 1).alias("depth_m")), ENCROACHMENTS, "encroachments")
    listed = issues.withColumn("__t", F.col("type")).withColumn("__p", F.col("parcel_ids").cast("string"))
    head = first_rows(listed, [F.col("__t"), F.col("__p")], F.struct("type", "parcel_ids"), ISSUES, "issues")
    out = own.crossJoin(buildings.agg(n.alias("buildings"))).crossJoin(found.agg(n.alias("encroachments_found"))).crossJoin(issues.agg(n.alias("problems")))  # one row each
    out = out.crossJoin(top).crossJoin(head).crossJoin(road_lengths(segments)).crossJoin(fractions(cells, "class", COVER_SHARE).withColumnRenamed("fractions", "land_cover"))  # one row each
    for name, row in (("comparison", comparison), ("accuracy", accuracy)):
        if row is not None:
            out = out.crossJoin(row.select(F.struct(*row.columns).alias(name)))  # one row
    if against_record is not None:
        kinds = against_record.agg(F.count_if(F.col("type") == "CROSSES_RECORD").alias("crosses_record"), F.count_if(F.col("type") == "OUTSIDE_RECORD").alias("outside_record"))
        out = out.crossJoin(kinds.select(F.struct(*kinds.columns).alias("against_record")))  # one row
    used = F.filter(F.transform("uses", lambda u: F.struct(u["use"].alias("use"), u["parcels"].alias("parcels"), F.round(100 * u["parcels"] / F.greatest(F.col("parcels"), F.lit(1))).alias("share_pct"))), lambda u: u["parcels"] > 0)
    kpis = F.struct(
        "parcels", "buildings", F.round("length_m").alias("road_m"), "area_km2", F.col("problems").alias("topology_problems"),
        F.col("encroachments_found").alias("encroachments"), "reviewed_pct", F.col("review.approved").alias("approved"),
    )
    rest = [F.col(c) if c in out.columns else F.lit(None).alias(c) for c in ("comparison", "accuracy", "against_record")]
    return out.select(kpis.alias("kpis"), used.alias("land_use"), "land_cover", F.col("by_class").alias("roads"), "encroachments", "encroachments_found", *rest, "issues", "review")
