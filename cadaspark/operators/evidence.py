"""What is known of each parcel: buildings, frontage, encroachment, land use with its reason, and the survey's totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.functions.rules import LAND_USES, cover_label, encroachment_note, land_use
from cadaspark.operators.siting import road_encroachment
from cadaspark.operators.spatial import covered_area, overlay, within_distance
from cadaspark.operators.zonal import cover_shares, zonal_stats

#: Buildings below this size are not counted; a road this near gives frontage (fixed values).
LEAST_BUILDING_M2, ROAD_SIDE_M = 20.0, 1.0
BOX = ("x0", "y0", "x1", "y1")


def owners(buildings: DataFrame, parcels: DataFrame) -> DataFrame:
    """id, parcel: the parcel that a building covers most (ties: least id); buildings on none have no row."""
    pairs = overlay(buildings.select("id", *BOX), parcels.select("id", *BOX))
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct(F.round("inter", 6), -F.col("b_id"))).alias("parcel"))


def frontage(parcels: DataFrame, roads: DataFrame) -> DataFrame:
    """id, frontage_road_m: the greatest width of the roads at a parcel's side; parcels at no road have no row."""
    near = within_distance(parcels.select("id", *BOX), roads.select("width_m", *BOX), ROAD_SIDE_M)
    return near.groupBy(F.col("a_id").alias("id")).agg(F.max("b_width_m").alias("frontage_road_m"))


def parcel_evidence(parcels: DataFrame, buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """A row a parcel: id, area_m2, buildings, largest_m2, cover, frontage_road_m, road_frontage."""
    big = buildings.withColumn("size", box_area()).filter(F.col("size") >= LEAST_BUILDING_M2)
    own = owners(big, parcels).join(big.select("id", "size"), "id").groupBy("parcel").agg(F.count("*").alias("buildings"), F.max("size").alias("largest_m2"))
    out = parcels.select("id", box_area().alias("area_m2")).join(own.withColumnRenamed("parcel", "id"), "id", "left").join(covered_area(parcels, buildings), "id", "left").join(frontage(parcels, roads), "id", "left")
    return out.select(
        "id", "area_m2", F.coalesce("buildings", F.lit(0)).alias("buildings"), F.coalesce("largest_m2", F.lit(0.0)).alias("largest_m2"), (F.coalesce("covered", F.lit(0.0)) / F.col("area_m2")).alias("cover"),
        F.coalesce("frontage_road_m", F.lit(0.0)).alias("frontage_road_m"), F.col("frontage_road_m").isNotNull().alias("road_frontage"),
    )


def encroachment(parcels: DataFrame, buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """id, encroachment_m2: what the buildings of a parcel take of roads, one decimal; parcels without have no row."""
    found = road_encroachment(buildings, roads).filter("kind = 'encroachment'").select("id", "overlap_m2")
    return found.join(owners(buildings, parcels), "id").groupBy(F.col("parcel").alias("id")).agg(F.round(F.sum("overlap_m2"), 1).alias("encroachment_m2"))


def attribute_rows(parcels: DataFrame, buildings: DataFrame, roads: DataFrame, cells: DataFrame) -> DataFrame:
    """A row a parcel: evidence, land use with its reason, land cover, encroachment and notes.

    ``cells`` has zone (the parcel), class, prob and height_m; parcels without cells have no land cover.
    """
    stats = zonal_stats(cells).join(cover_shares(cells), "zone").withColumnRenamed("zone", "id").drop("storeys")
    out = parcel_evidence(parcels, buildings, roads).join(stats, "id", "left").join(encroachment(parcels, buildings, roads), "id", "left")
    out = out.withColumn("shares", F.coalesce("shares", F.create_map().cast("map<string,double>")))
    share = lambda *names: sum((F.coalesce(F.element_at("shares", F.lit(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    green = share("tree", "grass / scrub", "agriculture")
    use = land_use(F.col("buildings"), F.col("largest_m2"), F.col("cover"), F.col("frontage_road_m"), F.col("height_m"), F.col("area_m2"), share("water"), green)
    built = F.coalesce(F.col("built") / F.col("cells"), F.lit(0.0))
    return out.withColumn("use", use).select(
        "id", F.round("area_m2", 1).alias("area_m2"), F.round(100 * built, 1).alias("built_pct"), F.round(100 * green, 1).alias("veg_pct"), "road_frontage", "buildings", F.round(100 * F.col("cover"), 1).alias("building_cover_pct"),
        F.round("frontage_road_m", 1).alias("frontage_road_m"), F.round(F.when(F.col("use.storeys").isNotNull(), F.col("height_m")), 1).alias("height_m"), F.col("use.storeys").alias("storeys"), F.col("use.use").alias("land_use"), F.col("use.reason").alias("land_use_reason"),
        cover_label(built, F.col("shares")).alias("landcover"), F.coalesce("percent", F.create_map().cast("map<string,double>")).alias("land_cover_pct"), "encroachment_m2",
        F.array_compact(F.array(F.when(F.col("encroachment_m2").isNotNull(), encroachment_note(F.col("encroachment_m2"))))).alias("notes"),
    )


def survey_stats(attributes: DataFrame, buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """One row: parcels, buildings, encroachments, conflicts and the parcels of every land use (zeros included)."""
    on_road = road_encroachment(buildings, roads).agg(F.count_if(F.col("kind") == "encroachment").alias("encroachments"), F.count_if(F.col("kind") == "road_conflict").alias("road_building_conflicts"))
    counts = attributes.agg(F.count("*").alias("parcels"), F.map_from_arrays(F.array(*map(F.lit, LAND_USES)), F.array(*[F.count_if(F.col("land_use") == u) for u in LAND_USES])).alias("land_use_count"))
    return counts.crossJoin(buildings.agg(F.count("*").alias("buildings"))).crossJoin(on_road)  # one row each
