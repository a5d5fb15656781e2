"""Neighbourhood operators on label rasters, as cell tables and as tile jobs with a halo."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.operators.graph import written
from cadaspark.operators.numbering import compacted, ranked
from cadaspark.operators.spatial import nearest

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
REACH, SPECK_CELLS = 20, 25


def offsets(df: DataFrame, reach: int) -> DataFrame:
    """Each cell once for every cell at most ``reach`` away on both axes (``ox``, ``oy``)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("ox", F.explode(F.transform(steps, lambda d: F.col("x") + d))).withColumn("oy", F.explode(F.transform(steps, lambda d: F.col("y") + d)))


def label_components(cells: DataFrame) -> DataFrame:
    """x, y, component of set cells by their four sides; the name is the least (y, x) as y * 2^32 + x."""
    from cadaspark.operators.regions import regions

    return regions(cells.select("x", "y", F.lit(1).alias("label"))).select("x", "y", F.col("region").alias("component"))


def majority_filter(cells: DataFrame, reach: int = 1) -> DataFrame:
    """x, y, label: the most frequent label within ``reach`` (ties: least label)."""
    near = offsets(cells.select("x", "y", "label"), reach).groupBy(F.col("ox").alias("x"), F.col("oy").alias("y"), "label").agg(F.count("*").alias("n"))
    best = near.groupBy("x", "y").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return best.join(cells.select("x", "y"), ["x", "y"], "left_semi")


def nearest_fill(empty: DataFrame, seeds: DataFrame, cell: float = 8.0) -> DataFrame:
    """x, y, label, d2: the nearest seed's label and squared distance (ties: least label), at any distance.

    Only seeds with a neighbour that is none can be nearest, so the search runs over rims.
    """
    held = seeds.select("x", "y").distinct()
    full = offsets(held, 1).groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.count("*").alias("n")).filter("n = 9").select("x", "y")
    rims = seeds.select("x", "y", "label").join(full, ["x", "y"], "left_anti")
    asked = empty.select("x", "y").distinct().withColumn("cell", F.struct("x", "y"))
    found = nearest(asked, "cell", rims, 1, "label", cell)
    return found.select(F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("b_label").alias("label"), ((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2).alias("d2"))


def in_tiles(cells: DataFrame, columns: list[str], work: Callable, schema: str, tile: int = 64, halo: int = 8) -> DataFrame:
    """Run ``work(frame)`` on every tile with its halo; the result's cells outside the tile are cut off.

    ``frame`` has x, y, ``columns`` and ``inside``; the work returns x, y and its own columns for
    cells that are inside.  A tile is one group of bounded size.
    """
    lo = lambda c: F.floor((F.col(c) - halo) / tile)
    hi = lambda c: F.floor((F.col(c) + halo) / tile)
    spread = cells.select("x", "y", *columns).withColumn("tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("ty", F.explode(F.sequence(lo("y"), hi("y"))))
    spread = spread.withColumn("inside", (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty")))
    return spread.groupBy("tx", "ty").applyInPandas(lambda pdf: work(pdf), schema)


def as_raster(pdf: pd.DataFrame, column: str, empty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = (pdf["y"] - pdf["y"].min()).to_numpy(), (pdf["x"] - pdf["x"].min()).to_numpy()
    out = np.full((y.max() + 1, x.max() + 1), empty)
    out[y, x] = pdf[column]
    return out, y, x


def windowed(raster: np.ndarray, reach: int, pick: Callable) -> np.ndarray:
    """Least or greatest value of square windows, one axis after the other."""
    for axis in (0, 1):
        wide = np.pad(raster, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        raster = pick(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis), axis=-1)
    return raster


# --- fixed values of the ground filter, in metres ---
WINDOWS, SLOPE, FIRST_DROP, MOST_DROP, SMOOTH = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), 0.15, 0.3, 2.5, 3.0
# --- end of fixed values ---


def window_cells(metres: float, gsd: float) -> int:
    """Cells of a window's side: odd, three at least."""
    return max(3, round(metres / gsd) | 1)


def extent(cells: DataFrame) -> tuple[int, int, int, int]:
    return cells.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()


def framed(pdf: pd.DataFrame, column: str, edges: tuple, tile: int, halo: int, empty: float) -> tuple[np.ndarray, int, int]:
    """A tile with its halo, cut at the raster's own edges, as an array, and its least x and y."""
    x0, y0 = (max(int(pdf[t].iloc[0]) * tile - halo, e) for t, e in (("tx", edges[0]), ("ty", edges[1])))
    x1, y1 = (min((int(pdf[t].iloc[0]) + 1) * tile + halo - 1, e) for t, e in (("tx", edges[2]), ("ty", edges[3])))
    out = np.full((y1 - y0 + 1, x1 - x0 + 1), empty)
    out[pdf["y"] - y0, pdf["x"] - x0] = pdf[column]
    return out, x0, y0


def ground_filter(cells: DataFrame, gsd: float = 1.0, tile: int = 256, windows: tuple[float, ...] = WINDOWS, slope: float = SLOPE, first: float = FIRST_DROP, most: float = MOST_DROP) -> DataFrame:
    """x, y, ground: False where an opening lowers the surface by more than its threshold.

    Windows double from round to round; the first threshold is ``first``, the next ones follow the
    window's growth in the round before.  Cells without a value (null, NaN, or no row) never lower
    a surface, and are no ground; tiles do not show in the result.
    """
    reaches = [window_cells(w, gsd) // 2 for w in windows]
    steps = [w - b for w, b in zip(windows, (0.0, *windows), strict=False)]
    drops = [first, *(min(most, slope * step + first) for step in steps)]
    edges, halo = extent(cells), 2 * sum(reaches)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        surface, x0, y0 = framed(pdf, "value", edges, tile, halo, np.nan)
        ground = np.isfinite(surface)
        surface = np.where(ground, surface, np.inf)
        for r, drop in zip(reaches, drops, strict=False):
            opened = windowed(windowed(surface, r, np.min), r, np.max)
            with np.errstate(invalid="ignore"):
                ground &= surface - opened <= drop
            surface = opened
        out = pdf[["x", "y"]].assign(ground=ground[pdf["y"] - y0, pdf["x"] - x0])
        return out[pdf["inside"].to_numpy()]

    return in_tiles(cells, ["value"], work, "x int, y int, ground boolean", tile, halo)


def terrain(cells: DataFrame, gsd: float = 1.0, tile: int = 256) -> DataFrame:
    """x, y, dtm, ndsm of every cell of a surface: the ground below it and its height above.

    Cells that are no ground take the nearest ground's height (ties: the least), heights are
    smoothed by a square mean, mirrored at the raster's edges, and never lie above the surface.
    Without any ground all is as low as the lowest cell.  ``ndsm`` is null where there is no value.
    """
    flags = written(cells.join(ground_filter(cells, gsd, tile), ["x", "y"]), "ground")
    ground = flags.filter("ground")
    if ground.isEmpty():
        low = cells.agg(F.min(F.nanvl("value", F.lit(None))).alias("dtm"))
        return cells.select("x", "y", "value").crossJoin(F.broadcast(low)).select("x", "y", "dtm", F.greatest(F.col("value") - F.col("dtm"), F.lit(0.0)).alias("ndsm"))  # one row
    filled = nearest_fill(flags.filter("not ground"), ground.select("x", "y", F.col("value").alias("label")))
    whole = written(ground.select("x", "y", "value", F.col("value").alias("base")).unionByName(flags.filter("not ground").select("x", "y", "value").join(filled.select("x", "y", F.col("label").alias("base")), ["x", "y"])), "terrain")
    edges, size = extent(cells), max(3, int(SMOOTH / gsd))
    before = size // 2

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        base, x0, y0 = framed(pdf, "base", edges, tile, size, np.nan)
        for axis in (0, 1):
            wide = np.pad(base, [(before, size - 1 - before) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            base = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis).mean(axis=-1)
        value = pdf["value"].astype(float)
        smooth = base[pdf["y"] - y0, pdf["x"] - x0]
        dtm = np.where(np.isfinite(value), np.minimum(smooth, value), smooth)
        return pdf[["x", "y"]].assign(dtm=dtm, ndsm=np.maximum(value - dtm, 0))[pdf["inside"].to_numpy()]

    return in_tiles(whole, ["value", "base"], work, "x int, y int, dtm double, ndsm double", tile, size)


def edge_strength(cells: DataFrame, tile: int = 64) -> DataFrame:
    """x, y, edge: length of the central-difference gradient."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, y, x = as_raster(pdf, "value", np.nan)
        pad = np.pad(v, 1, constant_values=np.nan)
        near = [np.where(np.isnan(n), v, n) for n in (pad[1:-1, 2:], pad[1:-1, :-2], pad[2:, 1:-1], pad[:-2, 1:-1])]
        edge = np.hypot(near[0] - near[1], near[2] - near[3]) / 2
        return pdf[["x", "y"]].assign(edge=edge[y, x])[pdf["inside"].to_numpy()]

    return in_tiles(cells, ["value"], work, "x int, y int, edge double", tile, 1)


#: Excess of green over red and blue, as a share of full brightness, from which land is green (fixed value).
GREEN = 0.08


def green_excess(r: Column, g: Column, b: Column) -> Column:
    """How much greener than red and blue a colour of 0 to 255 is: -2 to 2."""
    return (2 * g - r - b) / 255.0


def texture(cells: DataFrame, reach: int = 2, tile: int = 128) -> DataFrame:
    """x, y, texture: standard deviation of ``value`` in the square window around each cell, over the cells there are.

    A tile's windows come from running sums, so a window's size does not matter.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, y, x = as_raster(pdf, "value", np.nan)
        some = np.isfinite(v)
        middle = v[some].mean() if some.any() else 0.0
        v = np.where(some, v - middle, 0.0)

        def sums(a: np.ndarray) -> np.ndarray:
            for axis in (0, 1):
                wide = np.pad(a, [(reach + 1, reach) if k == axis else (0, 0) for k in (0, 1)])
                run = np.cumsum(wide, axis=axis)
                size = 2 * reach + 1
                a = run[size:] - run[:-size] if axis == 0 else run[:, size:] - run[:, :-size]
            return a

        n, total, square = sums(some.astype(float)), sums(v), sums(v * v)
        n = np.maximum(n, 1)
        out = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
        return pdf[["x", "y"]].assign(texture=out[y, x])[pdf["inside"].to_numpy()]

    return in_tiles(cells, ["value"], work, "x int, y int, texture double", tile, reach)


def boundary_evidence(cells: DataFrame, reach: int = 2) -> DataFrame:
    """x, y, edge, texture, green of cells with r, g, b (0 to 255): gradient of brightness, its spread, and green land."""
    grey = cells.withColumn("value", (F.col("r") + F.col("g") + F.col("b")) / 3)
    out = cells.select("x", "y", green_excess(F.col("r"), F.col("g"), F.col("b")).alias("excess"))
    out = out.join(edge_strength(grey), ["x", "y"]).join(texture(grey, reach), ["x", "y"])
    return out.select("x", "y", "edge", "texture", "excess", (F.col("excess") > GREEN).alias("green"))


def house_parcels(block: DataFrame, houses: DataFrame, reach: int = REACH, least: int = SPECK_CELLS) -> DataFrame:
    """x, y, parcel: cells of a block go to the nearest house by chessboard distance within ``reach``.

    Ties go to the lesser house; parcels of fewer than ``least`` cells are dropped.
    """
    cells = block.select("x", "y").join(houses.select("x", "y", "house"), ["x", "y"], "full").select("x", "y", "house")
    inner = written(cells.join(block.select("x", "y").withColumn("land", F.lit(True)), ["x", "y"], "left").withColumn("block", F.lit(0).cast("bigint")), "block-cells")
    own = nearest_houses(inner.select("x", "y", "block", "house", "land"), reach).filter("land").select("x", "y", "parcel")
    big = own.groupBy("parcel").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return own.join(big.select("parcel"), "parcel", "left_semi")


def nearest_houses(cells: DataFrame, reach: float, frames: DataFrame | None = None, tile: int = 64) -> DataFrame:
    """x, y, land, parcel: the nearest house of the cell's own block within ``reach`` cells (ties: the lesser house).

    ``cells`` has block, house (null: none) and land.  The distance is the greater of the two ways along
    the block's axes; ``frames`` (block, angle) gives their direction, else rows and columns.  A tile
    looks at the houses' outer cells in its halo, so no cell is copied for each place in reach.
    """
    angled = cells.withColumn("angle", F.lit(0.0)) if frames is None else cells.join(frames, "block", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))
    halo = int(np.ceil(reach * (1.0 if frames is None else np.sqrt(2))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in pdf.groupby("block"):
            asked = own[own["inside"] & own["land"].fillna(False).astype(bool)]
            house = own[own["house"].notna()]
            if not len(asked) or not len(house):
                continue
            a = float(own["angle"].iloc[0])
            turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            p, names = asked[["x", "y"]].to_numpy(float) @ turn, house["house"].to_numpy(np.int64)
            held = house[["x", "y"]].to_numpy(np.int64)
            outer = outer_cells(held, names)
            q, names = held[outer].astype(float) @ turn, names[outer]
            order = np.argsort(names, kind="stable")
            q, names = q[order], names[order]
            best, who = np.full(len(p), np.inf), np.full(len(p), -1)
            for at in range(0, len(q), 256):  # houses ascend, so a tie keeps the lesser one
                d = np.abs(p[:, None] - q[None, at : at + 256]).max(axis=2).round(9)
                k = d.argmin(axis=1)
                near = d[np.arange(len(p)), k]
                new = near < best
                best[new], who[new] = near[new], names[at + k[new]]
            own_house = asked["house"].notna().to_numpy()
            who = np.where(own_house, asked["house"].fillna(-1).to_numpy(), who).astype(np.int64)
            ok = own_house | (best <= reach)
            parts.append(asked[["x", "y", "land"]].assign(parcel=who)[ok])
        return pd.concat(parts) if parts else pd.DataFrame({"x": [], "y": [], "land": [], "parcel": []}).astype({"x": int, "y": int, "land": bool, "parcel": int})

    return in_tiles(angled, ["block", "house", "land", "angle"], work, "x int, y int, land boolean, parcel bigint", tile, halo)


def outer_cells(held: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which cells of houses have a side neighbour that is not of the same house."""
    span = held.max(axis=0) - held.min(axis=0) + 3
    grid = np.full(span, -1, np.int64)
    at = held - held.min(axis=0) + 1
    grid[at[:, 0], at[:, 1]] = names
    full = np.ones(len(held), bool)
    for dx, dy in SIDES:
        full &= grid[at[:, 0] + dx, at[:, 1] + dy] == names
    return ~full


# --- fixed values of parcels around houses, in metres and square metres ---
OUTBUILDING_M2, SPECK_M2, OPEN_REACH_M = 30.0, 25.0, 20.0
# --- end of fixed values ---


def block_frames(cells: DataFrame) -> DataFrame:
    """block, angle: the direction of the longer side of the least rectangle around each block's cells.

    Only the first and last cell of each row can be corners of the hull, so a block is as many points as it has rows.
    """
    from cadaspark.functions.kernels import rectangle

    ends = cells.groupBy("block", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))

    def angle(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = rectangle(np.concatenate([pdf[["a", "y"]].to_numpy(float), pdf[["b", "y"]].to_numpy(float)]))[0]
        sides = np.diff(corners[:3], axis=0) if len(corners) > 3 else np.zeros((2, 2))
        d = sides[0] if np.hypot(*sides[0]) >= np.hypot(*sides[1]) else sides[1]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "angle": [float(np.arctan2(d[1], d[0]))]})

    return ends.groupBy("block").applyInPandas(angle, "block bigint, angle double")


def parcels_by_block(cells: DataFrame, gsd: float, turned: bool = True) -> DataFrame:
    """x, y, parcel of the land of a raster: plots around houses, and open land by piece.

    ``cells`` has x, y, land (no road, and within the survey) and house (0 or null: none).  Blocks are
    connected pieces of land.  In a block each cell goes to the nearest house of 30 square metres or
    more within 20 m, measured along the block's own axes (along rows and columns, if not
    ``turned``); other land is open, a parcel a piece.  Plots that share a house become one; parcels
    below 25 square metres are dropped; parcels are numbered from 1, plots in the order of their
    houses, then open land in the order of its first cells.
    """
    from cadaspark.operators.regions import merged_by_roofs, regions

    land = cells.filter("land")
    named = written(regions(land.select("x", "y", F.lit(1).alias("label"))).select("x", "y", F.col("region").alias("block")), "blocks")
    big = cells.filter("house > 0").groupBy("house").agg(F.count("*").alias("n")).filter(F.col("n") * gsd * gsd >= OUTBUILDING_M2).select("house")
    roofs = land.select("x", "y", "house").filter("house > 0")
    own = written(named.join(roofs.join(big, "house", "left_semi"), ["x", "y"], "left").withColumn("land", F.lit(True)), "block-houses")
    frames = written(block_frames(named), "block-frames") if turned else None
    plots = nearest_houses(own.withColumn("house", F.col("house").cast("bigint")), OPEN_REACH_M / gsd, frames).select("x", "y", "parcel")
    plots = written(plots, "plots")
    most = plots.agg(F.coalesce(F.max("parcel"), F.lit(0)).alias("most"))
    rest = regions(named.join(plots, ["x", "y"], "left_anti").select("x", "y", F.lit(1).alias("label")))
    heads = ranked(rest.select("region").distinct().withColumn("all", F.lit(0)), "all", [F.col("region")], "k", F.shiftright("region", 32))
    heads = heads.crossJoin(F.broadcast(most)).select("region", (F.col("most") + F.col("k")).alias("parcel"))  # one row
    every = written(plots.unionByName(rest.join(heads, "region").select("x", "y", "parcel")), "all-parcels")
    shared = every.join(roofs.select("x", "y", F.col("house").alias("roof")), ["x", "y"], "left").select("parcel", F.coalesce("roof", F.lit(0)).cast("bigint").alias("roof"))
    whole = every.join(merged_by_roofs(shared, gsd * gsd), "parcel").select("x", "y", F.col("merged").alias("parcel"))
    size = whole.groupBy("parcel").agg(F.count("*").alias("n")).filter(F.col("n") * gsd * gsd >= SPECK_M2)
    numbers = compacted(size, "parcel", "number")
    return whole.join(numbers, "parcel").select("x", "y", F.col("number").alias("parcel"))


def contact_mask(cells: DataFrame, reach: int = 1) -> DataFrame:
    """x, y, kind: contact where two instances are within ``reach``, boundary at a rim, else interior."""
    near = offsets(cells.filter("label > 0").select("x", "y", F.col("label").alias("other")), reach).select(F.col("ox").alias("x"), F.col("oy").alias("y"), "other")
    by = near.groupBy("x", "y").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.count("*").alias("n"))
    full = (2 * reach + 1) ** 2
    kind = F.when(F.col("lo") != F.col("hi"), "contact").when(F.col("n") < full, "boundary").otherwise("interior")
    return cells.filter("label > 0").select("x", "y").join(by, ["x", "y"]).select("x", "y", kind.alias("kind"))


def small_pieces(cells: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """piece, into: the label that a piece under ``least`` cells borders most (ties: least label)."""
    small = pieces.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") < least).select("component")
    rim = pieces.join(small, "component", "left_semi").select("component", "x", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in SIDES])).alias("d"))
    met = rim.select("component", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).join(cells.select("x", "y", "label"), ["x", "y"])
    outside = met.join(pieces.select("x", "y", F.col("component").alias("own")), ["x", "y"], "left").filter(F.col("own").isNull() | (F.col("own") != F.col("component")))
    counts = outside.groupBy("component", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("component").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("into"))


def best_class(df: DataFrame, scores: str) -> DataFrame:
    """Adds ``class`` (place of the greatest score, from 1; ties: the first) and ``certainty``."""
    most = F.array_max(scores)
    return df.withColumn("class", F.array_position(scores, most).cast("int")).withColumn("certainty", most)
