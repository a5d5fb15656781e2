"""Parcels from vector layers: blocks between roads, rails and water, plots around buildings, open land, and the whole upload job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.clipping import clipped_to
from cadaspark.functions.plots import capsule, distance_to_segment, plot_of, reach_of
from cadaspark.functions.rules import zone_label
from cadaspark.operators import siting
from cadaspark.operators.coverage import gaps
from cadaspark.operators.graph import written
from cadaspark.operators.numbering import ranked
from cadaspark.operators.spatial import box_pairs, overlay, with_bounds

# --- fixed values: results must equal these, so they are stated as they are ---
HALF_WIDTH_M = {"road": 4.0, "rail": 8.0, "water": 3.0}
SETBACK_M, LEAST_M2, ROAD_M = 7.0, 25.0, 200.0
FIELDS = ("Agricultural", "Forest / Green Land")
FIELD_UNSPLIT_M2, FIELD_LEAST_M, FIELD_MOST_M, FIELD_CELLS = 4000.0, 35.0, 90.0, 10
VACANT_UNSPLIT_M2, VACANT_CELL_M = 20000.0, 90.0
UNRECORDED_SHARE = 0.15
# --- end of fixed values ---
EVERY_M2 = 1e18


@dataclass(frozen=True)
class Layers:
    """Vector layers in metres: lines have id, kind (road, rail, water) and line; the others id and geom.

    ``buildings`` may have unrecorded, ``zones`` have label.
    """

    buildings: DataFrame
    lines: DataFrame
    water: DataFrame
    government: DataFrame
    zones: DataFrame


def segments(lines: DataFrame) -> DataFrame:
    """kind, p, q of every segment of the lines."""
    steps = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.element_at("line", i).alias("p"), F.element_at("line", i + 1).alias("q")))
    return lines.filter(F.size("line") > 1).select("kind", F.explode(steps).alias("s")).select("kind", "s.p", "s.q")


def barriers(layers: Layers, area: tuple[float, float, float, float]) -> DataFrame:
    """id, geom and box of what no parcel may cover: lines with their width, water, and a frame around the area."""
    x0, y0, x1, y1 = area
    half = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in HALF_WIDTH_M.items()])
    wide = segments(layers.lines).select(capsule(F.col("p"), F.col("q"), half).alias("geom"))
    boxes = [(x0 - 1, y0 - 1, x1 + 1, y0), (x0 - 1, y1, x1 + 1, y1 + 1), (x0 - 1, y0, x0, y1), (x1, y0, x1 + 1, y1)]
    sides = layers.lines.sparkSession.createDataFrame([tuple(map(float, b)) for b in boxes], "a double, b double, c double, d double")
    frame = sides.select(g.box_geometry(*map(F.col, "abcd")).alias("geom"))
    whole = wide.unionByName(layers.water.select("geom")).unionByName(frame).withColumn("id", F.monotonically_increasing_id())
    return written(with_bounds(whole), "barriers")


def inside(found: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """The gaps that lie in the area."""
    x, y = F.col("gap.x"), F.col("gap.y")
    return found.filter((x >= area[0]) & (x < area[2]) & (y >= area[1]) & (y < area[3]))


def plots(buildings: DataFrame, blocks: DataFrame, barred: DataFrame) -> DataFrame:
    """building, block, geom: the land nearer to each building's centre than to another's in its block, up to 7 m around it."""
    centred = buildings.select("id", "geom", g.centroid(F.col("geom")).alias("c")).filter("c is not null")
    spots = written(centred.select("id", "geom", "c", reach_of("geom", "c", F.lit(SETBACK_M)).alias("reach"), F.col("c.x").alias("x0"), F.col("c.y").alias("y0"), F.col("c.x").alias("x1"), F.col("c.y").alias("y1")), "centres")
    near = box_pairs(spots.select("id", "x0", "y0", "x1", "y1"), blocks.select("block", "x0", "y0", "x1", "y1"))
    near = near.select(F.col("a_id").alias("id"), F.col("a_x0").alias("x"), F.col("a_y0").alias("y"), F.col("b_block").alias("block"))
    held = near.join(blocks.select("block", "geom"), "block").filter(g.contains_point(F.col("geom"), F.col("x"), F.col("y")))
    own = written(spots.join(held.groupBy("id").agg(F.min("block").alias("block")), "id"), "centres-in-blocks")
    wide = own.select("id", "block", "c", (F.col("x0") - 2 * F.col("reach")).alias("x0"), (F.col("y0") - 2 * F.col("reach")).alias("y0"), (F.col("x1") + 2 * F.col("reach")).alias("x1"), (F.col("y1") + 2 * F.col("reach")).alias("y1"))
    # buildings with one centre: the lesser id has the plot
    apart = (F.col("a_block") == F.col("b_block")) & (F.col("a_id") != F.col("b_id")) & ((F.col("a_c") != F.col("b_c")) | (F.col("a_id") > F.col("b_id")))
    rivals = box_pairs(wide, own.select("id", "block", "c", "x0", "y0", "x1", "y1"), extra=apart)
    rivals = rivals.groupBy(F.col("a_id").alias("id")).agg(F.collect_list("b_c").alias("others"), F.max(F.col("a_c") == F.col("b_c")).alias("same"))
    caps = own.select("id", (F.col("x0") - F.col("reach")).alias("x0"), (F.col("y0") - F.col("reach")).alias("y0"), (F.col("x1") + F.col("reach")).alias("x1"), (F.col("y1") + F.col("reach")).alias("y1"))
    met = box_pairs(caps, barred.select("id", "x0", "y0", "x1", "y1")).select(F.col("a_id").alias("id"), F.col("b_id").alias("bar"))
    bars = met.join(barred.select(F.col("id").alias("bar"), "geom"), "bar").groupBy("id").agg(F.collect_list("geom").alias("barred"))
    ready = own.select("id", "block", "geom", "c").join(rivals, "id", "left").filter("same is null or not same").join(bars, "id", "left")
    shaped = ready.select(F.col("id").alias("building"), "block", plot_of("geom", "c", "others", "barred", F.lit(SETBACK_M)).alias("geom"))
    return written(shaped, "plots").filter(F.size("geom") > 0)  # a filter before the write would cut every plot twice


def in_cells(pieces: DataFrame, side: Column) -> DataFrame:
    """geom of each part of the pieces in a grid of squares from its south-west corner; specks go."""
    at = lambda lo, hi: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / F.col("side")) - 1, F.lit(0)).cast("int")))
    cells = with_bounds(pieces.withColumn("side", side)).withColumn("i", at("x0", "x1")).withColumn("j", at("y0", "y1"))
    a, b = F.col("x0") + F.col("i") * F.col("side"), F.col("y0") + F.col("j") * F.col("side")
    cut = cells.select(clipped_to(g.box_geometry(a, b, a + F.col("side"), b + F.col("side")), "geom").alias("parts"))
    return cut.select(F.explode("parts").alias("p")).select(F.array("p").alias("geom"))


def classified(pieces: DataFrame, layers: Layers) -> DataFrame:
    """``pieces`` (key, geom, built) with landuse by zoning: the zone of the largest overlap (ties: the lesser id)."""
    box = ("x0", "y0", "x1", "y1")
    own = written(with_bounds(pieces).withColumn("area", g.area(F.col("geom"))), "pieces")
    zones = with_bounds(layers.zones).withColumn("area", g.area(F.col("geom")))
    pairs = overlay(own.select("key", "geom", "area", *box), zones.select("id", "label", "geom", "area", *box), exact=True)
    best = pairs.groupBy(F.col("a_key").alias("key")).agg(F.max_by(F.struct("b_label", "inter"), F.struct("inter", -F.col("b_id"))).alias("best"))
    public = with_bounds(layers.government).withColumn("area", g.area(F.col("geom")))
    met = overlay(own.select("key", "geom", "area", *box), public.select("id", "geom", "area", *box), exact=True).select(F.col("a_key").alias("key")).distinct().withColumn("public", F.lit(True))
    out = own.join(best, "key", "left").join(met, "key", "left")
    return out.withColumn("landuse", zone_label(F.coalesce("public", F.lit(False)), F.col("best.b_label"), F.col("best.inter"), F.col("area"), F.col("built"))).drop("best", "public")


def block_parcels(layers: Layers, area: tuple[float, float, float, float]) -> DataFrame:
    """Parcels of an area: id, building (null: open land), geom, area_m2, perimeter_m, landuse, road_connected, road_distance_m, x, y, unrecorded.

    Blocks are what roads (8 m wide), rails (16 m), waterways (6 m) and water leave of the area.  A
    building has the land up to 7 m around it that is nearer to its centre than to that of another
    building in its block; the rest of a block is open land by piece, of which fields above 4000 and
    other land above 20,000 square metres are cut into squares.  Parcels below 25 square metres are
    left out.  Roads are looked for within 200 m: farther ones, and none, give a null distance.
    Ids are numbered from west to east.
    """
    bars = barriers(layers, area)
    blocks = inside(gaps(bars, LEAST_M2, EVERY_M2), area).select("geom").withColumn("block", F.monotonically_increasing_id())
    blocks = written(with_bounds(blocks), "blocks")
    own = plots(layers.buildings, blocks, bars)
    taken = bars.select("id", "geom").unionByName(own.select((-F.col("building") - 1).alias("id"), "geom"))
    open_land = inside(gaps(with_bounds(taken), 1e-3, EVERY_M2), area).select("geom").withColumn("key", F.monotonically_increasing_id()).withColumn("built", F.lit(False))
    rest = written(classified(open_land, layers).select("geom", "area", "landuse"), "open-land")
    field = F.col("landuse").isin(*FIELDS)
    whole = rest.filter(F.col("area") <= F.when(field, FIELD_UNSPLIT_M2).otherwise(VACANT_UNSPLIT_M2)).select("geom")
    split = rest.filter(F.col("area") > F.when(field, FIELD_UNSPLIT_M2).otherwise(VACANT_UNSPLIT_M2))
    side = F.when(field, F.greatest(F.lit(FIELD_LEAST_M), F.least(F.lit(FIELD_MOST_M), F.sqrt(F.col("area") / FIELD_CELLS)))).otherwise(VACANT_CELL_M)
    pieces = whole.unionByName(in_cells(split, side)).withColumn("building", F.lit(None).cast("bigint"))
    every = own.select("geom", F.col("building").cast("bigint").alias("building")).unionByName(pieces).filter(g.area(F.col("geom")) >= LEAST_M2)
    every = written(every.withColumn("key", F.monotonically_increasing_id()).withColumn("built", F.col("building").isNotNull()), "parcels")
    known = written(classified(every, layers), "classified")
    roads = segments(layers.lines.filter("kind = 'road'"))
    reach = [f(F.col(f"p.{c}"), F.col(f"q.{c}")).alias(f"{c}{k}") for c in "xy" for f, k in ((F.least, 0), (F.greatest, 1))]
    near = box_pairs(known.select("key", "x0", "y0", "x1", "y1"), roads.select("p", "q", *reach), ROAD_M).select(F.col("a_key").alias("key"), F.col("b_p").alias("p"), F.col("b_q").alias("q"))
    far = near.join(known.select("key", "geom"), "key").withColumn("m", distance_to_segment("geom", "p", "q")).groupBy("key").agg(F.min("m").alias("m"))
    out = known.join(far.filter(F.col("m") <= ROAD_M), "key", "left").withColumn("c", g.centroid(F.col("geom")))
    flags = layers.buildings.select(F.col("id").cast("bigint").alias("building"), (F.col("unrecorded") if "unrecorded" in layers.buildings.columns else F.lit(False)).alias("new"))
    out = out.join(flags, "building", "left").withColumn("all", F.lit(0))
    numbered = ranked(out, "all", [F.col("x0"), F.col("y0"), F.col("key")], "id", F.floor(F.col("x0") / 100))
    return numbered.select(
        (F.col("id") - 1).cast("bigint").alias("id"), "building", "geom", F.round("area", 1).alias("area_m2"), F.round(g.perimeter(F.col("geom")), 1).alias("perimeter_m"), "landuse",
        F.col("m").isNotNull().alias("road_connected"), F.round("m", 1).alias("road_distance_m"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.coalesce("new", F.lit(False)).alias("unrecorded"),
    )


def upload_parcels(layers: Layers, register: DataFrame, area: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an upload of detected buildings gives: buildings, parcels and a row of counts.

    A building with less than 15 % of its land in ``register`` (id, geom) is unrecorded.  ``buildings``
    have id, geom, unrecorded, area_m2, alerts and note; distances of alerts are those of boxes.
    """
    box = ("x0", "y0", "x1", "y1")
    sized = written(with_bounds(layers.buildings.select("id", "geom").withColumn("area", g.area(F.col("geom"))).filter("area > 0")), "detected")
    known = with_bounds(register).withColumn("area", g.area(F.col("geom")))
    shared = overlay(sized.select("id", "geom", "area", *box), known.select("id", "geom", "area", *box), exact=True).groupBy(F.col("a_id").alias("id")).agg(F.sum("inter").alias("m2"))
    flagged = written(sized.join(shared, "id", "left").withColumn("unrecorded", F.coalesce("m2", F.lit(0.0)) / F.col("area") < UNRECORDED_SHARE).drop("m2"), "flagged")
    lines = with_bounds(layers.lines.withColumn("shape", F.array(F.array("line"))), "shape").drop("shape", "line")
    alerts = siting.alerts(flagged.select("id", *box), lines.filter("kind <> 'road'").select("id", "kind", *box), with_bounds(layers.government).select("id", *box), lines.filter("kind = 'road'").select("id", *box), flagged.select("id", "unrecorded"))
    buildings = written(flagged.select("id", "geom", "unrecorded").join(alerts, "id").withColumn("note", siting.note()), "uploaded")
    parcels = written(block_parcels(Layers(flagged.select("id", "geom", "unrecorded"), layers.lines, layers.water, layers.government, layers.zones), area), "uploaded-parcels")
    counts = buildings.agg(F.count("*").alias("buildings"), F.count_if("unrecorded").alias("unrecorded"), F.count_if(F.size("alerts") > 0).alias("flagged"))
    return buildings, parcels, counts.crossJoin(parcels.agg(F.count("*").alias("parcels"), F.count("building").alias("plots")))  # one row each
