"""Shapes of plots around buildings: numpy inside Arrow UDFs, and round buffers of lines as columns."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadaspark.functions.clipping import together, without
from cadaspark.functions.kernels import GEOMETRY_TYPE, as_arrow, as_rings, cross, half_plane, hull, plain, point_line, ring_area, unpacked, unpacked_lists, within

#: Corners of a quarter of a round end.
QUARTER = 16


def capsule(p: Column, q: Column, half: Column) -> Column:
    """The land within ``half`` metres of a segment: a geometry with round ends."""
    direction = F.atan2(q["y"] - p["y"], q["x"] - p["x"])

    def end(at: Column, start: float) -> Column:
        angle = lambda k: direction + start + k * (pi / 2 / QUARTER)
        corner = lambda k: F.struct((at["x"] + half * F.cos(angle(k))).alias("x"), (at["y"] + half * F.sin(angle(k))).alias("y"))
        return F.transform(F.sequence(F.lit(0), F.lit(2 * QUARTER)), corner)

    return F.array(F.array(F.concat(end(q, -pi / 2), end(p, pi / 2))))


def grown(rings: list[np.ndarray], by: float) -> list[list[np.ndarray]]:
    """A polygon and the land within ``by`` of its outline, with pointed corners."""
    r = rings[0] if ring_area(rings[0]) > 0 else rings[0][::-1]
    step = np.roll(r, -1, axis=0) - r
    out = np.column_stack([step[:, 1], -step[:, 0]]) / np.hypot(*step.T)[:, None] * by
    p, q = r + out, np.roll(r, -1, axis=0) + out
    turn = cross(np.roll(step, 1, axis=0), step)
    before, after = np.roll(step, 1, axis=0), step

    def meet(k: int) -> np.ndarray:
        t = cross(p[k] - q[k - 1], after[k]) / cross(before[k], after[k])
        return q[k - 1] + t * before[k]

    if (turn >= 0).all():
        corners = [meet(k) if abs(turn[k]) > 1e-9 else p[k] for k in range(len(r))]
        return [[np.array(corners)]]
    parts = [[rings]] + [[[np.array([r[k], p[k], q[k], r[(k + 1) % len(r)]])]] for k in range(len(r))]
    parts += [[[np.array([r[k], q[k - 1], meet(k), p[k]])]] for k in range(len(r)) if turn[k] > 1e-9]
    return together(parts)


def plot(geom, centre: np.ndarray, others: np.ndarray, barred: list, margin: float) -> list[list[np.ndarray]]:
    """Land within ``margin`` of a building, nearer to its centre than to ``others`` and off ``barred`` shapes.

    Of several parts the one that holds the centre counts, or else the largest.
    """
    rings = as_rings(geom)
    if not rings:
        return []
    shape = grown(rings, margin)[0][0]
    for c in others:
        d = c - centre
        shape = half_plane(shape, (c + centre) / 2, np.array([-d[1], d[0]]), 1.0)
        if len(shape) < 3:
            return []
    parts = without([[shape]], barred) if barred else [[shape]]
    held = [p for p in parts if within(centre, p[0])]
    return held[:1] or parts[:1]


@F.arrow_udf(GEOMETRY_TYPE)
def plot_of(geom: pa.Array, centre: pa.Array, others: pa.Array, barred: pa.Array, margin: pa.Array) -> pa.Array:
    """:func:`plot` of each building; ``others`` are points, ``barred`` geometries."""
    rows = []
    for g, c, o, b, m in zip(unpacked(geom), centre.to_pylist(), others.to_pylist(), unpacked_lists(barred), margin.to_pylist(), strict=True):
        near = np.array([(p["x"], p["y"]) for p in o or ()], float).reshape(-1, 2)
        rows.append(plain(plot(g, np.array([c["x"], c["y"]]), near, b, m)))
    return as_arrow(rows, GEOMETRY_TYPE)


@F.arrow_udf(T.DoubleType())
def reach_of(geom: pa.Array, centre: pa.Array, margin: pa.Array) -> pa.Array:
    """How far from its centre a plot can reach at most."""
    out = []
    for g, c, m in zip(unpacked(geom), centre.to_pylist(), margin.to_pylist(), strict=True):
        rings = as_rings(g)
        corners = np.concatenate([r for p in grown([hull(rings[0])], m) for r in p]) if rings else np.zeros((0, 2))
        out.append(float(np.hypot(corners[:, 0] - c["x"], corners[:, 1] - c["y"]).max()) if len(corners) else 0.0)
    return pa.array(out, pa.float64())


@F.arrow_udf(T.DoubleType())
def distance_to_segment(geom: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
    """Distance of a geometry's outline to a segment (0 where they meet, or the segment begins inside)."""
    out = []
    for g, a, b in zip(unpacked(geom), p.to_pylist(), q.to_pylist(), strict=True):
        rings = as_rings(g)
        if not rings:
            out.append(None)
            continue
        s, t = np.array([a["x"], a["y"]]), np.array([b["x"], b["y"]])
        u = np.concatenate(rings)
        v = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
        d, e = t - s, v - u
        turn = cross(d[None], e)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = cross(u - s, e) / turn, cross(u - s, d[None]) / turn
        if ((turn != 0) & (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)).any() or sum(within(s, r) for r in rings) % 2:
            out.append(0.0)
            continue
        ends = [point_line(np.array([s, t]), i, j).min() for i, j in zip(u, v, strict=True)]
        out.append(float(min(point_line(u, s, t).min(), *ends)))
    return pa.array(out, pa.float64())
