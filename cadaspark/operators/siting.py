"""Setback, access and encroachment rules between layers of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.functions.kernels import uncovered_parts
from cadaspark.functions.rules import width_class, zone_label
from cadaspark.operators.layout import nearest_box
from cadaspark.operators.spatial import box_pairs, covered_area, overlay, within_distance

# --- fixed values: results must equal these, so they are stated as they are ---
RAIL_M, WATER_M, ROAD_M, GOVERNMENT_M2 = 30.0, 15.0, 200.0, 1.0
ENCROACH_M2, ENCROACH_DEPTH_M, CONFLICT_SHARE = 4.0, 1.0, 0.35
LEAST_FOOTPRINT_M2, SEAM_M, LEAST_ADDED_M2 = 4.0, 0.5, 12.0
#: Codes of alerts, in the order in which a building lists them.
ALERTS = ("RAIL_BUFFER", "WATER_BUFFER", "GOVT_ENCROACH", "NO_ROAD", "UNRECORDED")
# --- end of fixed values ---

#: What each rule rests on, in our words.
CITATIONS = {"RAIL_BUFFER": "safety distance to railway lines", "WATER_BUFFER": "protection strip along water", "GOVT_ENCROACH": "public land", "NO_ROAD": "access to a mapped road", "UNRECORDED": "building register"}


def nearest_within(buildings: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """id, distance of buildings at most ``reach`` from a line."""
    pairs = within_distance(buildings, lines, reach, cell=max(200.0, reach))
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.min("distance").alias("distance"))


def government_overlap(buildings: DataFrame, government: DataFrame) -> DataFrame:
    """id, area_m2: the part of a building that government land as a whole covers, above 1 m2."""
    return covered_area(buildings, government).filter(F.col("covered") > GOVERNMENT_M2).select("id", F.col("covered").alias("area_m2"))


def without_road(buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Buildings with no road within 200 m; none where there are no roads at all."""
    near = nearest_within(buildings, roads, ROAD_M)
    some = roads.limit(1).select(F.lit(True).alias("some"))
    return buildings.join(near, "id", "left_anti").crossJoin(F.broadcast(some)).drop("some")  # one row at most


def alerts(buildings: DataFrame, lines: DataFrame, government: DataFrame, roads: DataFrame, unrecorded: DataFrame | None = None) -> DataFrame:
    """A row a building: id, area_m2, alerts (array of type, msg, citation)."""
    rail = nearest_within(buildings, lines.filter("kind = 'rail'"), RAIL_M).select("id", F.col("distance").alias("rail"))
    water = nearest_within(buildings, lines.filter("kind = 'water'"), WATER_M).select("id", F.col("distance").alias("water"))
    public = government_overlap(buildings, government).select("id", F.col("area_m2").alias("public"))
    lost = without_road(buildings, roads).select("id", F.lit(True).alias("lost"))
    out = buildings.withColumn("area_m2", F.round(box_area(), 1)).select("id", "area_m2").join(rail, "id", "left").join(water, "id", "left").join(public, "id", "left").join(lost, "id", "left")
    out = out.withColumn("new", F.lit(False)) if unrecorded is None else out.join(unrecorded.select("id", F.col("unrecorded").alias("new")), "id", "left")
    one = lambda test, kind, text, *args: F.when(test, F.struct(F.lit(kind).alias("type"), F.format_string(text, *args).alias("msg"), F.lit(CITATIONS[kind]).alias("citation")))
    found = F.array_compact(F.array(
        one(F.col("rail").isNotNull(), "RAIL_BUFFER", "%.0f m from a railway line (limit 30 m)", F.coalesce("rail", F.lit(0.0))),
        one(F.col("water").isNotNull(), "WATER_BUFFER", "%.0f m from water (limit 15 m)", F.coalesce("water", F.lit(0.0))),
        one(F.col("public").isNotNull(), "GOVT_ENCROACH", "%.0f m2 on government land", F.coalesce("public", F.lit(0.0))),
        one(F.coalesce("lost", F.lit(False)), "NO_ROAD", "no road within %d m", F.lit(int(ROAD_M))),
        one(F.coalesce("new", F.lit(False)), "UNRECORDED", "%s", F.lit("not in the building register")),
    ))
    return out.select("id", "area_m2", found.alias("alerts"))


def note(alerts_column: str = "alerts") -> F.Column:
    """Numbered lines of a building's alerts."""
    return F.array_join(F.transform(F.col(alerts_column), lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a["type"], F.lit(": "), a["msg"])), "\n")


def road_encroachment(buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Buildings on a road by 4 m2 or more: id, kind, overlap_m2, depth_m.

    Above 35 % of the building the layers disagree (``road_conflict``); otherwise the short side of
    the largest part on a road must be 1 m or more (``encroachment``).
    """
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    pairs = overlay(buildings, roads).select(F.col("a_id").alias("id"), "inter", "a_area", F.least(w, h).alias("depth"))
    each = pairs.groupBy("id").agg(F.sum("inter").alias("overlap_m2"), F.first("a_area").alias("area"), F.max_by("depth", "inter").alias("depth_m")).filter(F.col("overlap_m2") >= ENCROACH_M2)
    kind = F.when(F.col("overlap_m2") / F.col("area") > CONFLICT_SHARE, "road_conflict").when(F.col("depth_m") >= ENCROACH_DEPTH_M, "encroachment")
    return each.withColumn("kind", kind).filter("kind is not null").select("id", "kind", "overlap_m2", "depth_m")


def zoned_land_use(parcels: DataFrame, zones: DataFrame, government: DataFrame, buildings: DataFrame) -> DataFrame:
    """id, landuse by zoning; ties of the largest overlap go to the lesser zone id."""
    pairs = overlay(parcels.select("id", "x0", "y0", "x1", "y1"), zones)
    best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct("b_label", "inter"), F.struct("inter", -F.col("b_id"))).alias("best"))
    box = parcels.select("id", "x0", "y0", "x1", "y1")
    public = box_pairs(box, government).select(F.col("a_id").alias("id")).distinct().withColumn("public", F.lit(True))
    built = overlay(box, buildings).select(F.col("a_id").alias("id")).distinct().withColumn("built", F.lit(True))
    out = parcels.select("id", box_area().alias("area")).join(best, "id", "left").join(public, "id", "left").join(built, "id", "left")
    return out.select("id", zone_label(F.coalesce("public", F.lit(False)), F.col("best.b_label"), F.col("best.inter"), F.col("area"), F.coalesce("built", F.lit(False))).alias("landuse"))


def merged_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """source, id, part, area_m2: all boxes of the first source, and of the second what the first does not cover.

    Boxes of 4 square metres or less do not count.  A box of the second source that meets none of the
    first stays whole; of the others the parts outside a seam of half a metre stay, if they have 12
    square metres or more (often the neighbours that the first source missed).
    """
    own, rest = (d.filter(box_area() > LEAST_FOOTPRINT_M2).select("id", "x0", "y0", "x1", "y1") for d in (first, second))
    box = lambda p, grow=0.0: F.struct(*[(F.col(f"{p}{c}") + (-grow if c.endswith("0") else grow)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    met = box_pairs(rest, own).groupBy(F.col("a_id").alias("id")).agg(F.first(box("a_")).alias("box"), F.collect_list(box("b_", SEAM_M)).alias("near"))
    parts = met.select("id", F.posexplode(uncovered_parts("box", "near")).alias("part", "p")).filter(F.col("p.area") >= LEAST_ADDED_M2)
    whole = rest.join(met.select("id"), "id", "left_anti")
    key = F.col("id").cast("string").alias("id")
    return (
        own.select(F.lit("a").alias("source"), key, F.lit(0).alias("part"), box_area().alias("area_m2"))
        .unionByName(whole.select(F.lit("b").alias("source"), key, F.lit(0).alias("part"), box_area().alias("area_m2")))
        .unionByName(parts.select(F.lit("b").alias("source"), key, "part", F.col("p.area").alias("area_m2")))
    )


def hole_contents(parcels: DataFrame, holes: DataFrame, grow: float = 0.05) -> DataFrame:
    """Parcels that lie within a hole grown by 5 cm: hole_id, id."""
    pairs = box_pairs(holes, parcels, grow)
    inside = (F.col("b_x0") >= F.col("a_x0") - grow) & (F.col("b_y0") >= F.col("a_y0") - grow) & (F.col("b_x1") <= F.col("a_x1") + grow) & (F.col("b_y1") <= F.col("a_y1") + grow)
    return pairs.filter(inside).select(F.col("a_id").alias("hole_id"), F.col("b_id").alias("id"))


def nearest_attribute(layer: DataFrame, others: DataFrame, attribute: str) -> DataFrame:
    """id, ``attribute`` and distance of the nearest other box (ties: least id), at any distance."""
    found = nearest_box(layer, others)
    return found.join(others.select(F.col("id").alias("other"), attribute), "other").select("id", attribute, "distance")


def lengths_by_class(segments: DataFrame) -> DataFrame:
    """class, roads, length_m, median_width_m and narrow_m (length below 3 m) of road segments by width."""
    out = segments.withColumn("class", width_class(F.col("width_m")))
    return out.groupBy("class").agg(F.count("*").alias("roads"), F.sum("length_m").alias("length_m"), F.median("width_m").alias("median_width_m"), F.sum(F.when(F.col("width_m") < 3, F.col("length_m")).otherwise(0)).alias("narrow_m"))
