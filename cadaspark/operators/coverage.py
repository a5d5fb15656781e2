"""A polygon layer as a table of noded edges: enclosed gaps, and arcs between junctions.

Outlines become segments on whole tenths of a millimetre.  A segment is cut where another one ends on it or
crosses it, found by an equi-join on grid cells, so edges of neighbours are equal to the last digit
wherever their outlines run together.  An edge points so that its parcel lies on its left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.clipping import NEAR, UNIT, nested, walked
from cadaspark.functions.kernels import GEOMETRY_TYPE, LINE_TYPE, overlap_area, plain
from cadaspark.operators.graph import components, written
from cadaspark.operators.spatial import box_pairs, with_bounds

#: Side of a cell of the join and of a block of the map, in units (see ``clipping``).
CELL, BLOCK = 250_000, 2_000_000
NODE = "struct<x: bigint, y: bigint>"


def node(x: Column, y: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def directed_edges(layer: DataFrame) -> DataFrame:
    """id, u, v: edges of all rings on whole tenths of a millimetre, the parcel on the left."""
    rings = layer.select("id", F.explode("geom").alias("polygon")).select("id", F.posexplode("polygon").alias("ring_no", "ring"))
    rings = rings.withColumn("turned", (g.signed_ring_area(F.col("ring")) > 0) != (F.col("ring_no") == 0))
    e = rings.select("id", "turned", F.explode(g.edges(F.col("ring"))).alias("e"))
    end = lambda k: node(F.round(F.col(f"e.{k}.x") * UNIT), F.round(F.col(f"e.{k}.y") * UNIT))
    e = e.select("id", "turned", end("p").alias("p"), end("q").alias("q")).filter("p <> q")
    return e.select("id", F.when(F.col("turned"), F.col("q")).otherwise(F.col("p")).alias("u"), F.when(F.col("turned"), F.col("p")).otherwise(F.col("q")).alias("v"))


def cuts(segments: DataFrame) -> DataFrame:
    """a, b, points: where segments (a < b) are cut by others, those that are."""
    low = lambda c: F.least(f"a.{c}", f"b.{c}")
    high = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    own = segments.select("a", "b", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    p, q, r, s = F.col("a_a"), F.col("a_b"), F.col("b_a"), F.col("b_b")
    # products of doubles: exact for segments of up to some kilometres, and those of 64-bit numbers overflow at 300 km
    dx, dy = (q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double")
    length = F.sqrt(dx * dx + dy * dy)
    # two segments from one point cut one another only where they run along one line: most pairs of a layer end here
    joined = (p == r) | (p == s) | (q == r) | (q == s)
    along_one = F.abs(dx * (s["y"] - r["y"]) - dy * (s["x"] - r["x"])) <= (NEAR + 1) * length
    pairs = box_pairs(own, own, NEAR, CELL, ((p != r) | (q != s)) & (~joined | along_one))

    def on(v: Column) -> Column:
        """The point, where it lies on the first segment and is none of its ends."""
        across = F.abs(dx * (v["y"] - p["y"]) - dy * (v["x"] - p["x"])) / length
        along = (dx * (v["x"] - p["x"]) + dy * (v["y"] - p["y"])) / length
        return F.when((across <= NEAR) & (along > 0) & (along < length) & (v != p) & (v != q), v)

    # where two segments cross inside both, computed from the lesser one, so both get one point
    first = F.struct(p, q) < F.struct(r, s)
    pick = lambda x, y: F.when(first, x).otherwise(y)
    k, m, n, o = pick(p, r), pick(q, s), pick(r, p), pick(s, q)
    ex, ey, fx, fy = (v.cast("double") for v in (m["x"] - k["x"], m["y"] - k["y"], o["x"] - n["x"], o["y"] - n["y"]))
    turn = ex * fy - ey * fx
    t = ((n["x"] - k["x"]) * fy - (n["y"] - k["y"]) * fx) / turn
    w = ((n["x"] - k["x"]) * ey - (n["y"] - k["y"]) * ex) / turn
    meet = node(F.round(k["x"] + t * ex), F.round(k["y"] + t * ey))
    crossing = F.when(turn != 0, F.when((t > 0) & (t < 1) & (w > 0) & (w < 1), meet))
    ends_on = F.array_compact(F.array(on(r), on(s)))
    ends_at = F.array_compact(F.array(on(r), on(s), F.when(_near(p, r, s) | _near(q, r, s), p)))  # an end of either lies on the other
    points = F.when(F.size(ends_at) > 0, ends_on).otherwise(F.array_compact(F.array(crossing)))
    found = pairs.select(p.alias("a"), q.alias("b"), F.explode(points).alias("point")).filter("point <> a and point <> b")
    return found.groupBy("a", "b").agg(F.collect_set("point").alias("points"))


def _near(v: Column, r: Column, s: Column) -> Column:
    """Whether a point lies on a segment, ends included."""
    dx, dy = (s["x"] - r["x"]).cast("double"), (s["y"] - r["y"]).cast("double")
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dx * (v["x"] - r["x"]) + dy * (v["y"] - r["y"])) / square))
    return F.hypot(v["x"] - r["x"] - t * dx, v["y"] - r["y"] - t * dy) <= NEAR


def noded(edges: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """``edges`` (u, v and more columns) cut where they meet one another (and ``others``)."""
    turned = F.col("v") < F.col("u")
    ends = lambda df: df.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    segments = ends(edges) if others is None else ends(edges).unionByName(ends(others))
    found = cuts(written(segments.distinct(), "segments"))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    keyed = edges.select(*rest, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), turned.alias("turned")).join(found, ["a", "b"], "left")
    along = lambda p: (p["x"] - F.col("a.x")).cast("double") * (F.col("b.x") - F.col("a.x")) + (p["y"] - F.col("a.y")).cast("double") * (F.col("b.y") - F.col("a.y"))
    inner = F.transform(F.array_sort(F.transform("points", lambda p: F.struct(along(p).alias("at"), p.alias("p")))), lambda s: s["p"])
    chain = F.concat(F.array("a"), F.coalesce(inner, F.array().cast(f"array<{NODE}>")), F.array("b"))
    steps = F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    out = keyed.select(*rest, "turned", F.explode(steps).alias("s")).filter("s.p <> s.q")
    return out.select(*rest, F.when(F.col("turned"), F.col("s.q")).otherwise(F.col("s.p")).alias("u"), F.when(F.col("turned"), F.col("s.p")).otherwise(F.col("s.q")).alias("v"))


def two_sided(edges: DataFrame) -> DataFrame:
    """a, b, left, right: undirected edges (a < b) with the ids at either side of the way from a to b."""
    forth = F.col("u") < F.col("v")
    side = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("id"))))
    return edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(side(forth).alias("left"), side(~forth).alias("right"))


def rim(layer: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, ids: edges between covered land (on their left) and open land; ``ids`` are the parcels there."""
    both = two_sided(edges)
    one = both.filter("size(left) = 0 or size(right) = 0")
    left = F.size("left") > 0
    one = written(one.select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(left, F.col("left")).otherwise(F.col("right")).alias("ids")), "one-sided")
    # edges that run through another parcel have covered land on both sides
    x, y = (F.col("u.x") + F.col("v.x")) / 2 / UNIT, (F.col("u.y") + F.col("v.y")) / 2 / UNIT
    middles = one.select("u", "v", "ids", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    near = box_pairs(middles, layer.select("id", "x0", "y0", "x1", "y1"), extra=~F.array_contains(F.col("a_ids"), F.col("b_id")))
    near = near.select(F.col("a_u").alias("u"), F.col("a_v").alias("v"), F.col("a_x0").alias("x"), F.col("a_y0").alias("y"), F.col("b_id").alias("id"))
    hidden = near.join(layer.select("id", "geom"), "id").filter(g.contains_point(F.col("geom"), F.col("x"), F.col("y")) & (rings_distance(F.col("geom"), F.col("x"), F.col("y")) > NEAR / UNIT))
    return one.join(hidden.select("u", "v").distinct(), ["u", "v"], "left_anti")


def rings_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge of any ring."""
    return F.array_min(F.transform(F.flatten(F.transform(F.flatten(geom), g.edges)), lambda e: g.segment_distance(x, y, e)))


def followed(edges: DataFrame) -> DataFrame:
    """Adds ``next``: the edge that goes on around the face on the left, the first one clockwise from the way back.

    ``edges`` has key, u, v.
    """
    out = edges.select(F.col("key").alias("next"), F.col("u").alias("v"), F.col("v").alias("to"))
    angle = lambda p, q: F.atan2((q["y"] - p["y"]).cast("double"), (q["x"] - p["x"]).cast("double"))
    turn = F.pmod(angle(F.col("v"), F.col("u")) - angle(F.col("v"), F.col("to")), F.lit(2 * np.pi))
    turn = F.when(F.col("to") == F.col("u"), 7.0).otherwise(turn)  # straight back comes last
    best = edges.join(out, "v").groupBy("key").agg(F.min_by("next", F.struct(turn, "next")).alias("next"))
    return edges.join(best, "key")


def blocked_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of a graph on the map: ``nodes`` has node and block, ``links`` a and b.

    Links within a block are joined there, in one task a block; only what reaches over takes part in
    the search.
    """

    def joined(table: pa.Table) -> pa.Table:
        ends = np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()])
        names, at = np.unique(ends, return_inverse=True)
        a, b = at[: table.num_rows], at[table.num_rows :]
        label = np.arange(len(names))
        while True:  # the least label around, then that label's own label
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            np.minimum.at(least, label, least)
            least = least[least]
            if np.array_equal(least, label):
                return pa.table({"node": names, "local": names[label]})
            label = least

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}"))
    placed = written(links.join(side("a"), "a").join(side("b"), "b"), "links")
    inner = placed.filter("block_a = block_b").select(F.col("block_a").alias("block"), "a", "b")
    local = inner.groupBy("block").applyInArrow(lambda t: joined(t), "node bigint, local bigint")
    local = written(nodes.select("node").join(local, "node", "left").select("node", F.coalesce("local", "node").alias("local")), "locals")
    name = lambda c: local.select(F.col("node").alias(c), F.col("local").alias(f"local_{c}"))
    beyond = placed.filter("block_a <> block_b").select("a", "b").join(name("a"), "a").join(name("b"), "b").select(F.col("local_a").alias("a"), F.col("local_b").alias("b"))
    names = components(local.select(F.col("local").alias("node")).distinct(), beyond.distinct())
    return local.join(names.withColumnRenamed("node", "local"), "local").select("node", "component")


def block(at: Column) -> Column:
    return F.struct(F.floor(at["x"] / BLOCK).alias("x"), F.floor(at["y"] / BLOCK).alias("y"))


def ring_names(edges: DataFrame) -> DataFrame:
    """key, ring of edges with ``next``: the least key of the closed walk."""
    nodes = edges.select(F.col("key").alias("node"), block(F.col("u")).alias("block"))
    return blocked_components(nodes, edges.select(F.col("key").alias("a"), F.col("next").alias("b"))).toDF("key", "ring")


def gaps(layer: DataFrame, least: float, most: float, corridors: DataFrame | None = None) -> DataFrame:
    """gap, area_m2, neighbours, into, geom: enclosed land that no parcel covers, of more than ``least`` and at most ``most`` m2.

    ``layer`` has id, valid geom and its box.  Parcels that stand free inside a gap do not count to it,
    nor does the land of ``corridors`` (geom and box), which may lie between parcels.  A gap's name is
    its least corner; parcels that only touch it at a point are no neighbours, and ``into`` is the one
    with the longest border (ties: least id).
    """
    edges = noded(directed_edges(layer))
    border = rim(layer, written(edges, "noded"))
    # seen from the open land: turned round, so that it lies on the left
    open_side = border.select(F.monotonically_increasing_id().alias("key"), F.col("v").alias("u"), F.col("u").alias("v"), "ids")
    walks = followed(written(open_side, "rim"))
    walks = written(walks, "rim-walks")
    rings = walks.join(ring_names(walks), "key")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cross = exact("u.x") * exact("v.y") - exact("v.x") * exact("u.y")
    rings = written(rings.select("ring", "u", "v", "ids", cross.alias("c")), "rim-rings")
    sized = rings.groupBy("ring").agg(
        (F.sum("c").cast("double") / (2 * UNIT * UNIT)).alias("area"), F.min("u").alias("corner"),
        *[f(F.col(f"u.{c}") / UNIT).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))],
    )
    sized = written(sized, "rim-sizes")
    holes, islands = sized.filter("area > 0"), sized.filter("area < 0")
    free = holes.join(island_areas(rings, holes, islands), "ring", "left").withColumn("area_m2", F.col("area") - F.coalesce("filled", F.lit(0.0)))
    wanted = written(free.filter((F.col("area_m2") > least)).select("ring", "corner", "area_m2", "inner").filter(F.col("area_m2") <= most if corridors is None else F.lit(True)), "gaps")
    own = wanted.select("ring", F.explode(F.concat(F.array("ring"), F.coalesce("inner", F.array().cast("array<bigint>")))).alias("part"))
    parts = rings.withColumnRenamed("ring", "part").join(own, "part")
    along = parts.select("ring", F.explode("ids").alias("id"), F.hypot(F.col("u.x") - F.col("v.x"), F.col("u.y") - F.col("v.y")).alias("m")).groupBy("ring", "id").agg(F.sum("m").alias("m"))
    sides = along.groupBy("ring").agg(F.array_sort(F.collect_list("id")).alias("neighbours"), F.max_by("id", F.struct(F.round("m"), -F.col("id"))).alias("into"))
    shapes = parts.groupBy("ring").agg(F.collect_list(F.struct("part", "u", "v")).alias("edges")).select("ring", chained("edges").alias("geom"))
    out = wanted.join(sides, "ring").join(shapes, "ring").select("corner", "area_m2", "neighbours", "into", "geom")
    if corridors is not None:
        named = written(with_bounds(out).withColumn("gap_id", F.monotonically_increasing_id()), "gap-shapes")
        met = box_pairs(named.select("gap_id", "x0", "y0", "x1", "y1", "geom"), corridors.select("x0", "y0", "x1", "y1", "geom"))
        inside = met.withColumn("m2", overlap_area("a_geom", "b_geom")).groupBy(F.col("a_gap_id").alias("gap_id")).agg(F.sum("m2").alias("m2"))
        out = named.join(inside, "gap_id", "left").withColumn("area_m2", F.col("area_m2") - F.coalesce("m2", F.lit(0.0))).filter((F.col("area_m2") > least) & (F.col("area_m2") <= most))
    return out.select(F.struct((F.col("corner.x") / UNIT).alias("x"), (F.col("corner.y") / UNIT).alias("y")).alias("gap"), "area_m2", "neighbours", "into", "geom")


def island_areas(rings: DataFrame, holes: DataFrame, islands: DataFrame) -> DataFrame:
    """ring, filled, inner: what stands free in each hole; an island counts to the smallest hole around it."""
    box = ("x0", "y0", "x1", "y1")
    spots = islands.select("ring", "area", "corner", *box)
    inside = (F.col("a_x0") >= F.col("b_x0")) & (F.col("a_y0") >= F.col("b_y0")) & (F.col("a_x1") <= F.col("b_x1")) & (F.col("a_y1") <= F.col("b_y1"))
    near = written(box_pairs(spots, holes.select("ring", "area", *box), extra=inside), "islands")
    # even-odd over the hole's edges, a little above the island's least corner, which is none of theirs in general
    y = F.col("a_corner.y") + 0.5
    hits = near.join(rings.select(F.col("ring").alias("b_ring"), "u", "v"), "b_ring")
    at = F.col("u.x") + (y - F.col("u.y")) / (F.col("v.y") - F.col("u.y")) * (F.col("v.x") - F.col("u.x"))
    crossed = ((F.col("u.y") > y) != (F.col("v.y") > y)) & (at > F.col("a_corner.x") + 0.5)
    odd = hits.filter(crossed).groupBy("a_ring", "b_ring").agg(F.count("*").alias("n"), F.first("a_area").alias("area"), F.first("b_area").alias("size")).filter("n % 2 = 1")
    around = odd.groupBy("a_ring").agg(F.min_by(F.struct("b_ring", "area"), F.struct("size", "b_ring")).alias("s"))
    return around.groupBy(F.col("s.b_ring").alias("ring")).agg((-F.sum("s.area")).alias("filled"), F.array_sort(F.collect_list("a_ring")).alias("inner"))


@F.pandas_udf(GEOMETRY_TYPE)
def chained(edges: pd.Series) -> pd.Series:
    """Polygons of directed edges (part, u, v in units); the edges of a part are walked together."""
    rows = []
    for row in edges:
        parts: dict[int, list] = {}
        for e in row:
            parts.setdefault(e["part"], []).append(((e["u"]["x"], e["u"]["y"]), (e["v"]["x"], e["v"]["y"])))
        rows.append(plain(nested([r for p in sorted(parts) for r in walked(set(parts[p]))])))
    return pd.Series(rows, dtype=object)


def arcs(layer: DataFrame) -> DataFrame:
    """arc, line, left, right of a layer (id, geom): outlines between junctions, in metres.

    At a junction any number of edges but two meet, or two with other parcels beside them.  ``left``
    and ``right`` are the ids at the line's sides, empty on open land; a closed line begins and ends
    at one point.
    """
    both = two_sided(noded(directed_edges(layer))).withColumn("key", F.monotonically_increasing_id())
    both = written(both, "two-sided")
    pair = lambda p, q: F.struct(F.col(p).alias("l"), F.col(q).alias("r"))
    ends = both.select("key", F.col("a").alias("at"), pair("left", "right").alias("sides")).unionByName(both.select("key", F.col("b").alias("at"), pair("right", "left").alias("sides")))
    # going out of a node along one edge and along the other, the sides are swapped
    met = ends.groupBy("at").agg(F.count("*").alias("n"), F.min(F.struct("key", "sides")).alias("first"), F.max(F.struct("key", "sides")).alias("last"))
    through = met.filter((F.col("n") == 2) & (F.col("first.sides.l") == F.col("last.sides.r")) & (F.col("first.sides.r") == F.col("last.sides.l")))
    links = through.select(F.col("first.key").alias("a"), F.col("last.key").alias("b")).filter("a <> b")
    named = blocked_components(both.select(F.col("key").alias("node"), block(F.col("a")).alias("block")), links).toDF("key", "arc")
    parts = both.join(named, "key").groupBy("arc").agg(F.collect_list(F.struct("a", "b")).alias("edges"), F.min(F.struct("a", "b", "left", "right")).alias("least"))
    line = polyline("edges")
    turned = F.array_position(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: (F.element_at("line", i) == point_of("least.a")) & (F.element_at("line", i + 1) == point_of("least.b"))), True) == 0
    out = parts.withColumn("line", line).withColumn("turned", turned)
    return out.select("arc", "line", F.when(F.col("turned"), F.col("least.right")).otherwise(F.col("least.left")).alias("left"), F.when(F.col("turned"), F.col("least.left")).otherwise(F.col("least.right")).alias("right"))


def point_of(n: str) -> Column:
    return g.point(F.col(f"{n}.x") / UNIT, F.col(f"{n}.y") / UNIT)


@F.pandas_udf(LINE_TYPE)
def polyline(edges: pd.Series) -> pd.Series:
    """The one line that undirected edges (a, b) make, from its lesser end; a closed one from its least point."""
    rows = []
    for row in edges:
        around: dict[tuple, list] = {}
        for e in row:
            p, q = (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])
            around.setdefault(p, []).append(q)
            around.setdefault(q, []).append(p)
        at = min((p for p, qs in around.items() if len(qs) == 1), default=min(around))
        line, before = [at], None
        while True:
            step = min((q for q in around[at] if q != before), default=None)
            if step is None:
                break
            before, at = at, step
            line.append(at)
            if at == line[0]:
                break
        rows.append([{"x": x / UNIT, "y": y / UNIT} for x, y in line])
    return pd.Series(rows, dtype=object)


def border_lengths(layer: DataFrame) -> DataFrame:
    """id, other, m (both orders): length of the border that two parcels share from either side."""
    both = two_sided(noded(directed_edges(layer))).filter("size(left) > 0 and size(right) > 0")
    m = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) / UNIT
    one = both.select("left", "right", m.alias("m"))
    pairs = one.select(F.explode("left").alias("id"), "right", "m").select("id", F.explode("right").alias("other"), "m").filter("id <> other")
    ways = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "m"))
    return ways.groupBy("id", "other").agg(F.sum("m").alias("m"))


def rebuilt(lines: DataFrame) -> DataFrame:
    """id, geom: polygons of arcs (line, left, right); neighbours have one border by construction."""
    n = lambda p: node(F.round(p["x"] * UNIT), F.round(p["y"] * UNIT))
    steps = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(n(F.element_at("line", i)).alias("u"), n(F.element_at("line", i + 1)).alias("v")))
    e = lines.select("left", "right", F.explode(steps).alias("e")).filter("e.u <> e.v")
    forth = e.select(F.explode("left").alias("id"), F.lit(0).alias("part"), "e.u", "e.v")
    back = e.select(F.explode("right").alias("id"), F.lit(0).alias("part"), F.col("e.v").alias("u"), F.col("e.u").alias("v"))
    return forth.unionByName(back).groupBy("id").agg(F.collect_list(F.struct("part", "u", "v")).alias("edges")).select("id", chained("edges").alias("geom"))
