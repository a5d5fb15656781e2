"""Topology checks of a parcel layer and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.clipping import merged_shapes
from cadaspark.functions.kernels import is_valid, make_valid, overlap_area, split_by_line
from cadaspark.operators.coverage import gaps
from cadaspark.operators.graph import written
from cadaspark.operators.numbering import ranked
from cadaspark.operators.spatial import box_pairs, overlay, spread, with_bounds

OVERLAP_M2, GAP_LEAST_M2, GAP_MOST_M2 = 0.5, 1.0, 400.0
SLIVER_THINNESS, SLIVER_M2, LEAST_M2, DUPLICATE_IOU = 0.12, 60.0, 12.0, 0.95

SEVERITY = {"INVALID": "high", "OVERLAP": "high", "DUPLICATE": "high", "HOLE": "medium", "MULTIPART": "medium", "TOO_SMALL": "medium", "SLIVER": "medium", "GAP": "medium"}
#: What our repair does about each type.
FIXES = {
    "INVALID": "outlines are cut at their crossings",
    "HOLE": "filled, unless a parcel of higher confidence lies inside",
    "MULTIPART": "the largest part stays",
    "TOO_SMALL": "it goes to the parcel that it borders most",
    "SLIVER": "it goes to the parcel that it borders most",
    "OVERLAP": "shared land goes to the parcel of higher confidence, then area, then the lesser id",
    "DUPLICATE": "the parcel of lower rank is dropped",
    "GAP": "it goes to the parcel with the longest border",
}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def measured(parcels: DataFrame) -> DataFrame:
    """Adds ``valid``; ``geom`` becomes valid; adds ``area``, ``perimeter``, ``thinness``, ``plain`` (a box) and the box.

    Boxes are valid as they are; only other shapes go through the kernels, and of them only those
    that need it through the repair.
    """
    marked = parcels.withColumn("plain", g.is_box(F.col("geom")))
    checked = written(marked.filter("not plain").withColumn("valid", is_valid("geom")), "checked")
    out = marked.filter("plain").withColumn("valid", F.lit(True)).unionByName(checked.filter("valid")).unionByName(checked.filter("not valid").withColumn("geom", make_valid("geom")))
    out = out.withColumn("area", g.area(F.col("geom"))).withColumn("perimeter", g.perimeter(F.col("geom"))).withColumn("thinness", g.thinness(F.col("geom")))
    return with_bounds(out)


def too_small(area: Column) -> Column:
    return area < LEAST_M2


def sliver(area: Column, thinness: Column) -> Column:
    return (area >= LEAST_M2) & (area <= SLIVER_M2) & (thinness < SLIVER_THINNESS)


def shape_issues(layer: DataFrame) -> DataFrame:
    """``type``, ``parcel_ids``, ``amount`` of the checks on single parcels of a measured layer."""
    one = lambda test, kind, amount: F.when(test, F.struct(F.lit(kind).alias("type"), amount.cast("double").alias("amount")))
    found = F.array_compact(F.array(
        one(~F.col("valid"), "INVALID", F.col("area")),
        one(g.holes(F.col("geom")) > 0, "HOLE", g.holes(F.col("geom"))),
        one(g.parts(F.col("geom")) > 1, "MULTIPART", g.parts(F.col("geom"))),
        one(too_small(F.col("area")), "TOO_SMALL", F.col("area")),
        one(sliver(F.col("area"), F.col("thinness")), "SLIVER", F.col("thinness")),
    ))
    return layer.select(F.array("id").alias("parcel_ids"), F.explode(found).alias("i")).select("i.type", "parcel_ids", "i.amount")


def overlap_pairs(layer: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs of parcels that share more than 0.5 square metres: OVERLAP, or DUPLICATE at IoU 0.95.

    With ``exact`` the layer has ``geom`` and ``area``: pairs of boxes are decided by their corners,
    and only the ids of the other pairs fetch their shapes for the kernel.
    """
    each = F.col("a_id") < F.col("b_id")
    if exact:
        plain = F.col("plain") if "plain" in layer.columns else g.is_box(F.col("geom"))
        slim = layer.select("id", "x0", "y0", "x1", "y1", "area", plain.alias("plain"))
        near = written(box_pairs(slim, slim, extra=each).select("a_id", "b_id", "a_area", "b_area", g.box_overlap("a_", "b_").alias("inter"), (F.col("a_plain") & F.col("b_plain")).alias("plain")).filter("inter > 0"), "near-pairs")
        shapes = layer.select("id", "geom")
        rest = near.filter("not plain").drop("inter").join(shapes.toDF("a_id", "a_geom"), "a_id").join(shapes.toDF("b_id", "b_geom"), "b_id")
        # the kernel is the costly part: pairs are few bytes but much work, so they are not coalesced by size
        rest = written(spread(rest).withColumn("inter", overlap_area("a_geom", "b_geom")).drop("a_geom", "b_geom"), "exact-pairs")  # a filter on its result would run it again
        pairs = near.filter("plain").unionByName(rest).withColumn("iou", F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter")))
    else:
        slim = layer.select("id", "x0", "y0", "x1", "y1")
        pairs = overlay(slim, slim, extra=each)
    pairs = pairs.filter(F.col("inter") > OVERLAP_M2)
    kind = F.when(F.col("iou") >= DUPLICATE_IOU, "DUPLICATE").otherwise("OVERLAP")
    return pairs.select("a_id", "b_id", "inter", "iou", (100 * F.col("inter") / F.least("a_area", "b_area")).alias("pct_of_smaller"), kind.alias("type"))


def issues(parcels: DataFrame, corridors: DataFrame | None = None) -> DataFrame:
    """All issues of a parcel layer (``id``, ``geom``): type, severity, parcel_ids, amount, suggested_fix.

    ``corridors`` (``geom`` and its box), such as roads, may lie between parcels without being a gap.
    """
    layer = written(measured(parcels), "measured")
    found = shape_issues(layer).unionByName(overlap_pairs(layer, exact=True).select("type", F.array("a_id", "b_id").alias("parcel_ids"), F.col("inter").alias("amount")))
    open_land = gaps(layer.filter(F.size("geom") > 0), GAP_LEAST_M2, GAP_MOST_M2, corridors)
    found = found.unionByName(open_land.select(F.lit("GAP").alias("type"), F.col("neighbours").alias("parcel_ids"), F.col("area_m2").alias("amount")))
    return found.select("type", looked_up(SEVERITY, F.col("type")).alias("severity"), "parcel_ids", "amount", looked_up(FIXES, F.col("type")).alias("suggested_fix"))


def issue_types(found: DataFrame) -> DataFrame:
    """Sorted distinct issue types of each parcel."""
    return found.select(F.explode("parcel_ids").alias("id"), "type").groupBy("id").agg(F.sort_array(F.collect_set("type")).alias("issues"))


def outline_edges(layer: DataFrame, cell: float = 50.0) -> DataFrame:
    """Edges of all outlines keyed by the line that carries them.

    ``line`` names the undirected line to the millimetre, ``lo`` and ``hi`` the edge's ends along it;
    long edges are cut at multiples of ``cell`` so that no line gathers a whole district.
    """
    rings = layer.select("id", F.explode(F.transform("geom", lambda p: F.element_at(p, 1))).alias("ring"))
    e = rings.select("id", F.explode(g.edges(F.col("ring"))).alias("e")).select("id", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))
    length = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))
    e = e.withColumn("length", length).filter("length > 1e-9")
    flip = (F.col("qx") < F.col("px")) | ((F.col("qx") == F.col("px")) & (F.col("qy") < F.col("py")))
    ux, uy = F.when(flip, -1.0).otherwise(1.0) * (F.col("qx") - F.col("px")) / F.col("length"), F.when(flip, -1.0).otherwise(1.0) * (F.col("qy") - F.col("py")) / F.col("length")
    e = e.withColumn("ux", F.round(ux, 6)).withColumn("uy", F.round(uy, 6))
    e = e.withColumn("offset", F.round(F.col("px") * F.col("uy") - F.col("py") * F.col("ux"), 3) + 0.0)
    along = lambda x, y: F.col(x) * F.col("ux") + F.col(y) * F.col("uy")
    e = e.withColumn("s", along("px", "py")).withColumn("t", along("qx", "qy")).withColumn("lo", F.least("s", "t")).withColumn("hi", F.greatest("s", "t"))
    return e.select("id", "ux", "uy", "offset", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))).alias("cell")).withColumn("lo", F.greatest("lo", F.col("cell") * cell)).withColumn("hi", F.least("hi", (F.col("cell") + 1) * cell))


def shared_borders(layer: DataFrame) -> DataFrame:
    """``a_id``, ``b_id`` (both orders), ``shared_m``: length of common outline of two parcels."""
    e = outline_edges(layer)
    key = ["ux", "uy", "offset", "cell"]
    a = e.select(*key, F.col("id").alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = e.select(*key, F.col("id").alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    common = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    pairs = a.join(b, key).filter((F.col("a_id") != F.col("b_id")) & (common > 1e-9))
    return pairs.groupBy("a_id", "b_id").agg(F.sum(common).alias("shared_m"))


def best_neighbour(layer: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted parcel the one with the longest shared border (ties: least id)."""
    borders = shared_borders(layer).join(wanted.select(F.col("id").alias("a_id")), "a_id", "left_semi")
    best = F.max_by(F.struct("b_id", "shared_m"), F.struct(F.round("shared_m", 6), -F.col("b_id")))
    return borders.groupBy("a_id").agg(best.alias("best")).select(F.col("a_id").alias("id"), F.col("best.b_id").alias("neighbour"), F.col("best.shared_m").alias("shared_m"))


def box_cells(boxes: DataFrame, size: float = 1.0) -> DataFrame:
    """``id``, ``cx``, ``cy`` of the grid cells whose centres a box layer covers."""
    first = lambda c: F.ceil(F.col(c) / size - 0.5)
    last = lambda c: F.ceil(F.col(c) / size - 0.5) - 1
    ok = boxes.filter((last("x1") >= first("x0")) & (last("y1") >= first("y0")))
    return ok.withColumn("cx", F.explode(F.sequence(first("x0"), last("x1")))).withColumn("cy", F.explode(F.sequence(first("y0"), last("y1")))).select("id", "cx", "cy")


def auto_fix(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair a layer of boxes; returns its cells (``id``, ``cx``, ``cy``) and the change log.

    ``boxes`` has id, x0, y0, x1, y1 and confidence.  Parcels are compared as one-metre cells, each of
    which goes to one parcel: duplicates are dropped, contested cells go to the parcel of higher
    rank (confidence, then area, then the lesser id), parcels left too small go to the neighbour
    with the longest border.  The covered area stays the same.
    """
    layer = boxes.withColumn("area", g.box_area())
    rank = F.struct(F.col("confidence"), F.col("area"), -F.col("id"))
    pairs = overlap_pairs(layer).filter("type = 'DUPLICATE'")
    ranks = layer.select("id", rank.alias("rank"))
    loser = F.when(F.col("ra") >= F.col("rb"), F.col("b_id")).otherwise(F.col("a_id"))
    dropped = pairs.join(ranks.toDF("a_id", "ra"), "a_id").join(ranks.toDF("b_id", "rb"), "b_id").select(loser.alias("id")).distinct()
    dropped = written(dropped, "fix-dropped")
    stay = layer.join(dropped, "id", "left_anti")
    # cells are far more than the boxes' size lets expect: they carry their rank, and no join of them is broadcast
    cells = box_cells(stay.withColumn("id", F.struct("id", rank.alias("rank"))))
    owner = written(cells.groupBy("cx", "cy").agg(F.max_by("id.id", "id.rank").alias("id"), F.count("*").alias("n")), "fix-owner")
    cut = box_cells(stay).join(owner.filter("n > 1").withColumnRenamed("id", "owner").hint("merge"), ["cx", "cy"]).filter("id <> owner")
    log = dropped.select(F.array("id").alias("parcel_ids"), F.lit("removed duplicate").alias("action"), F.lit(0.0).alias("area_m2"))
    log = log.unionByName(cut.groupBy("id", "owner").agg(F.count("*").cast("double").alias("area_m2")).select(F.array("owner", "id").alias("parcel_ids"), F.lit("overlap assigned").alias("action"), "area_m2"))
    while True:
        sizes = owner.groupBy("id").agg(F.count("*").alias("cells"))
        small = sizes.filter(F.col("cells") < LEAST_M2)
        mine = owner.join(small.select("id"), "id", "left_semi")
        near = [mine.select("id", (F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        beside = near[0].unionByName(near[1]).unionByName(near[2]).unionByName(near[3])
        met = beside.join(owner.select("cx", "cy", F.col("id").alias("other")).hint("merge"), ["cx", "cy"]).filter("id <> other").groupBy("id", "other").agg(F.count("*").alias("m"))
        target = met.groupBy("id").agg(F.max_by("other", F.struct("m", -F.col("other"))).alias("into"))
        # of two small neighbours that want each other only the lesser id moves in a round
        moving = target.join(target.select(F.col("id").alias("into"), F.lit(True).alias("mutual")), "into", "left").filter(F.col("mutual").isNull() | (F.col("id") < F.col("into")))
        moving = written(moving.select("id", "into"), "fix-moves")
        if moving.isEmpty():
            return owner.select("id", "cx", "cy"), log
        merged = moving.join(sizes, "id").select(F.array("id", "into").alias("parcel_ids"), F.lit("too small, merged").alias("action"), F.col("cells").cast("double").alias("area_m2"))
        log = written(log.unionByName(merged), "fix-log")
        owner = written(owner.join(moving, "id", "left").select("cx", "cy", F.coalesce("into", "id").alias("id"), "n"), "fix-owner")


def merged(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Outlines of merged parcels: edges that two members share cancel, the rest are chained to rings.

    ``layer`` has ``id`` and ``geom`` with common vertices, ``groups`` has ``id`` and ``group``.
    Returns ``group``, ``rings`` and ``area``; a group of one piece has one outline.
    """
    import pandas as pd

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple, list] = {}
        for r in rows.itertuples():
            after.setdefault((r.px, r.py), []).append((r.qx, r.qy))
        rings = []
        for start in sorted(after):  # the least point left begins a ring
            while start in after:
                ring, at = [], start
                while at in after:
                    ring.append(at)
                    step = after[at].pop()
                    if not after[at]:
                        del after[at]
                    at = step
                rings.append([{"x": x, "y": y} for x, y in ring])
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "rings": [rings]})

    rings = layer.join(groups, "id").select("group", F.explode(F.flatten("geom")).alias("ring"))
    e = rings.select("group", F.explode(g.edges(F.col("ring"))).alias("e")).select("group", *[F.round(f"e.{a}.{b}", 3).alias(a + b) for a in "pq" for b in "xy"])
    end = lambda k: F.struct(F.col(k + "x").alias("x"), F.col(k + "y").alias("y"))
    undirected = [F.least(end("p"), end("q")).alias("u"), F.greatest(end("p"), end("q")).alias("v")]
    alone = e.select("*", *undirected).groupBy("group", "u", "v").agg(F.count("*").alias("n"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("qx").alias("qx"), F.first("qy").alias("qy")).filter("n = 1")
    kind = dict(groups.dtypes)["group"]
    out = alone.select("group", "px", "py", "qx", "qy").groupBy("group").applyInPandas(chain, f"group {kind}, rings array<array<struct<x:double,y:double>>>")
    return out.withColumn("area", F.abs(F.aggregate(F.transform("rings", g.signed_ring_area), F.lit(0.0), lambda a, v: a + v)))


def merged_parcels(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """group, id, geom, area of merged parcels; the largest member's id stays (ties: least id).

    Hairline gaps of up to 2 cm between members are closed, and enclosed open land of at most 400
    square metres is taken in.  Groups of one parcel, and groups whose members do not join to one
    polygon, are refused and have no row.
    """
    members = layer.join(groups, "id").withColumn("__area", g.area(F.col("geom")))
    order = F.struct((-F.col("__area")).alias("k"), F.col("id"), F.col("geom"))
    sized = members.groupBy("group").agg(F.array_sort(F.collect_list(order)).alias("m")).filter(F.size("m") > 1)
    # the kernel is the costly part: groups are not coalesced by size, and a filter on its result would run it again
    out = spread(sized).select("group", F.col("m")[0]["id"].alias("id"), merged_shapes(F.transform("m", lambda v: v["geom"])).alias("geom"))
    out = written(out, "merged-shapes")
    return out.filter(F.size("geom") == 1).withColumn("area", g.area(F.col("geom")))


def split_parcels(layer: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of parcels cut along lines (``id``, ``line``), and the cuts that are refused (``id``, ``reason``).

    A line reaches 5 m past its ends.  The largest piece keeps its parcel's id (ties: the westernmost
    corner first), the others get numbers after the greatest id of the layer, in the order of their
    parcels and sizes.  All pieces are drafts by hand (``source`` edited) without confidence, but for
    the largest one's; other columns are the parcel's own.
    """
    known = lines.filter(F.size("line") >= 2)
    wrong = lines.filter(F.coalesce(F.size("line"), F.lit(0)) < 2).select("id", F.lit("a line has two points or more").alias("reason"))
    missing = known.join(layer.select("id"), "id", "left_anti").select("id", F.lit("no such parcel").alias("reason"))
    cut = written(layer.join(known, "id").withColumn("pieces", split_by_line("geom", "line")).drop("line"), "split-pieces")
    few, least = F.size("pieces") < 2, F.array_min(F.transform("pieces", lambda p: p["area"])) < LEAST_M2
    reason = F.when(few, "the line does not cross the parcel").when(least, "a piece is too small to be a parcel")
    refused = wrong.unionByName(missing).unionByName(cut.select("id", reason.alias("reason")).filter("reason is not null"))
    parts = cut.filter(~few & ~least).select("*", F.posexplode("pieces").alias("piece", "p"))
    out = parts.withColumn("geom", F.col("p.geom")).withColumn("area", F.col("p.area")).withColumn("parent", F.col("id")).drop("pieces", "p")
    most = layer.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__most"))
    rest = ranked(out.filter("piece > 0").withColumn("__all", F.lit(0)), "__all", [F.col("parent"), F.col("piece")], "__number", F.floor(F.col("parent") / 100_000))
    rest = rest.crossJoin(F.broadcast(most)).withColumn("id", (F.col("__most") + F.col("__number")).cast(dict(layer.dtypes)["id"]))  # one row
    if "confidence" in layer.columns:
        rest = rest.withColumn("confidence", F.lit(None).cast(dict(layer.dtypes)["confidence"]))
    whole = out.filter("piece = 0").unionByName(rest.select(*out.columns))
    for column, value in (("status", "draft"), ("source", "edited")):
        if column in layer.columns:
            whole = whole.withColumn(column, F.lit(value))
    return whole, refused
