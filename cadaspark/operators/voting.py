"""Votes of several detectors on masks: clusters by overlap, fused masks and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.operators.graph import components, written
from cadaspark.operators.scoring import SOLO_SCORE, VOTES

#: Least overlap of masks that mean one object, and cells of a fused mask (fixed values).
MATCH_IOU, LEAST_MASK = 0.5, 20
#: Names of groups that one call decides.
GROUPS_A_CALL = 4096


def mask_pairs(masks: DataFrame) -> DataFrame:
    """a, b, iou of masks that overlap by half of their union or more; ``masks`` has item, x, y."""
    sizes = masks.groupBy("item").agg(F.count("*").alias("n")).hint("merge")
    # cells may come from shapes by an explode, so that a table's size says nothing about their number: no broadcast
    both = masks.select("x", "y", F.col("item").alias("a")).join(masks.select("x", "y", F.col("item").alias("b")).hint("merge"), ["x", "y"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    both = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("iou", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return both.filter(F.col("iou") >= MATCH_IOU).select("a", "b", "iou")


def clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, cluster: items by falling score join the cluster whose first item they match best.

    A cluster has one item of a member; ``items`` has item, member and score (ties: least item).
    Items that match, directly or over others, are decided together; such a group is as large as the
    stack of masks over one place.
    """
    group = components(items.select(F.col("item").alias("node")), pairs.select("a", "b")).toDF("item", "group")
    ways = pairs.select(F.col("a").alias("item"), "b", "iou").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("b"), "iou"))
    near = ways.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("b", "iou"))).alias("near"))
    rows = items.join(group.hint("merge"), "item").join(near.hint("merge"), "item", "left")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[int, set]] = []
        out, last = {}, None
        for r in pdf.sort_values(["group", "score", "item"], ascending=[True, False, True]).itertuples():
            if r.group != last:
                made, last = [], r.group
            near = dict(r.near) if r.near is not None else {}
            open_ = [(-near[first], k) for k, (first, members) in enumerate(made) if first in near and r.member not in members]
            if open_:
                k = min(open_)[1]
                made[k][1].add(r.member)
            else:
                made.append((r.item, {r.member}))
                k = len(made) - 1
            out[r.item] = made[k][0]
        return pd.DataFrame({"item": list(out), "cluster": list(out.values())})

    # a call costs far more than a group: groups of near names go together
    return rows.groupBy(F.floor(F.col("group") / GROUPS_A_CALL).alias("part")).applyInPandas(decide, "item bigint, cluster bigint")


def voted_masks(items: DataFrame, masks: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """Kept clusters (cluster, votes, score) and their fused masks (cluster, x, y).

    A cluster stays with two votes or a mean score of 0.85; a cell stays where half of the cluster's
    masks have it; masks of fewer than 20 cells go.
    """
    of = written(clusters(items, written(mask_pairs(masks), "mask-pairs")), "clusters")
    by = of.join(items.select("item", "score"), "item").groupBy("cluster").agg(F.count("*").alias("votes"), F.avg("score").alias("mean"))
    by = by.filter((F.col("votes") >= VOTES) | (F.col("mean") >= SOLO_SCORE))
    cells = masks.join(of.hint("merge"), "item").groupBy("cluster", "x", "y").agg(F.count("*").alias("n")).join(by.select("cluster", "votes").hint("merge"), "cluster").filter(F.col("n") >= 0.5 * F.col("votes"))
    cells = written(cells.select("cluster", "x", "y"), "fused-masks")
    big = cells.groupBy("cluster").agg(F.count("*").alias("cells")).filter(F.col("cells") >= LEAST_MASK)
    kept = by.join(big, "cluster").select("cluster", "votes", (F.col("mean") * F.least(F.lit(1.0), F.col("votes") / min(3, members))).alias("score"), "cells")
    return kept, cells.join(big.select("cluster"), "cluster", "left_semi")


def shape_kinds(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row: predicted shapes that match a label (IoU 0.5), lie half on labels, or are off them.

    ``pairs`` is a contingency table (tile, pred, inter, iou), ``shapes`` has tile, pred and n cells.
    """
    on = pairs.groupBy("tile", "pred").agg(F.max("iou").alias("iou"), F.sum("inter").alias("on"))
    out = shapes.join(on, ["tile", "pred"], "left")
    kind = F.when(F.col("iou") >= MATCH_IOU, "matched").when(F.col("on") / F.col("n") >= 0.5, "part").otherwise("off")
    return out.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "part", "off")])


def fold_means(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: number of folds and the mean of each metric, three decimals."""
    return folds.agg(F.count("*").alias("folds"), *[F.round(F.avg(m), 3).alias(f"{m}_mean") for m in metrics])
