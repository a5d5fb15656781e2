"""Scores of predictions against truth, splits and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.operators.graph import written
from cadaspark.operators.ranks import counts_below, quantiles
from cadaspark.operators.spatial import containing

FOUND_IOU, VOTES, SOLO_SCORE, LEAST_CELLS, ON_LABEL = 0.5, 2, 0.85, 20, 0.3
#: Footprints from this size on count for the merge rate.
SCORED_M2 = 12.0


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """truth, pred, n of a classification, from partial counts."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """A row a class: tp, fp, fn, iou, f1; the matrix has a row a pair of classes."""
    hit = matrix.filter("truth = pred").select(F.col("truth").alias("class"), F.col("n").alias("tp"))
    rows = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("in_truth"))
    cols = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("in_pred"))
    out = rows.join(cols, "class", "full").join(hit, "class", "left").fillna(0, ["in_truth", "in_pred", "tp"])
    fp, fn = F.col("in_pred") - F.col("tp"), F.col("in_truth") - F.col("tp")
    return out.select("class", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + fp + fn)).alias("iou"), (2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + fp + fn)).alias("f1"))


def contingency(cells: DataFrame, by: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Cells of every pair of truth and predicted instance that meet, with both sizes and the IoU."""
    n = cells.groupBy(*by, "truth", "pred").agg(F.count("*").alias("inter"))
    t = n.groupBy(*by, "truth").agg(F.sum("inter").alias("t"))
    p = n.groupBy(*by, "pred").agg(F.sum("inter").alias("p"))
    pairs = n.filter("truth > 0 and pred > 0").join(t, [*by, "truth"]).join(p, [*by, "pred"])
    return pairs.withColumn("iou", F.col("inter") / (F.col("t") + F.col("p") - F.col("inter")))


def neighbour_pairs(cells: DataFrame, reach: int = 3) -> DataFrame:
    """Pairs of truth instances with cells at most ``reach`` apart on both axes: tile, a, b."""
    own = cells.filter("truth > 0").select("tile", "x", "y", "truth")
    # every cell is moved many times, so that sizes of tables say nothing about the rows: no broadcast
    # of two cells of different instances so near, two cells at the rims are as near: only those are moved about
    sides = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    beside = own.select("tile", "truth", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(sides).alias("d")).select("tile", "truth", "ox", "oy", (F.col("ox") + F.col("d.dx")).alias("x"), (F.col("oy") + F.col("d.dy")).alias("y"))
    inner = beside.join(own.hint("merge"), ["tile", "x", "y", "truth"]).groupBy("tile", "ox", "oy").agg(F.count("*").alias("n")).filter("n = 4").select("tile", F.col("ox").alias("x"), F.col("oy").alias("y"))
    own = own.join(inner.hint("merge"), ["tile", "x", "y"], "left_anti")
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = own.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("tile", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("truth").alias("a"))
    return moved.join(own.withColumnRenamed("truth", "b").hint("merge"), ["tile", "x", "y"]).filter("a < b").select("tile", "a", "b").distinct()


def instance_scores(cells: DataFrame, partial: bool = False) -> DataFrame:
    """A row a tile: total, found (best IoU 0.5), iou_sum, shapes, extra, pairs, merged, pix_i, pix_u.

    In ``partial`` tiles a shape that lies mostly on unlabelled ground may be a real one and is no extra.
    """
    pairs = contingency(cells)
    truths = cells.filter("truth > 0").select("tile", "truth").distinct()
    preds = cells.filter("pred > 0").select("tile", "pred").distinct()
    best = pairs.groupBy("tile", "truth").agg(F.max("iou").alias("iou"), F.max_by("pred", F.struct("inter", -F.col("pred"))).alias("main"))
    reached = pairs.groupBy("tile", "pred").agg(F.max("iou").alias("iou"), (F.sum("inter") / F.first("p")).alias("on_label"))
    counts = F.coalesce(F.col("on_label") > ON_LABEL, F.lit(False)) if partial else F.lit(True)
    t = truths.join(best, ["tile", "truth"], "left").groupBy("tile").agg(F.count("*").alias("total"), F.count_if(F.col("iou") >= FOUND_IOU).alias("found"), F.sum(F.when(F.col("iou") >= FOUND_IOU, F.col("iou")).otherwise(0.0)).alias("iou_sum"))
    p = preds.join(reached, ["tile", "pred"], "left").groupBy("tile").agg(F.count("*").alias("shapes"), F.count_if((F.coalesce("iou", F.lit(0.0)) < FOUND_IOU) & counts).alias("extra"))
    near = neighbour_pairs(cells).join(best.select("tile", F.col("truth").alias("a"), F.col("main").alias("ma")), ["tile", "a"], "left").join(best.select("tile", F.col("truth").alias("b"), F.col("main").alias("mb")), ["tile", "b"], "left")
    near = near.groupBy("tile").agg(F.count("*").alias("pairs"), F.count_if(F.col("ma") == F.col("mb")).alias("merged"))
    pix = cells.groupBy("tile").agg(F.count_if((F.col("truth") > 0) & (F.col("pred") > 0)).alias("pix_i"), F.count_if((F.col("truth") > 0) | (F.col("pred") > 0)).alias("pix_u"))
    return pix.join(t, "tile", "left").join(p, "tile", "left").join(near, "tile", "left").fillna(0)


def rolled_up(tiles: DataFrame) -> DataFrame:
    """One row over tiles: recall, precision, f1, outline IoU, merge rate, building IoU."""
    s = tiles.agg(*[F.sum(c).alias(c) for c in ("total", "found", "iou_sum", "shapes", "extra", "pairs", "merged", "pix_i", "pix_u")])
    over = lambda a, b: a / F.greatest(F.lit(1), b)
    recall, precision = over(F.col("found"), F.col("total")), over(F.col("found"), F.col("found") + F.col("extra"))
    return s.select(recall.alias("recall"), precision.alias("precision"), (2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)).alias("f1"), over(F.col("iou_sum"), F.col("found")).alias("outline_iou"), over(F.col("merged"), F.col("pairs")).alias("merge_rate"), over(F.col("pix_i"), F.col("pix_u")).alias("building_iou"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1 at every threshold, from one pass over the rows."""
    hits = [(F.count_if((F.col(score) >= t) & (F.col(label) == 1)), F.count_if(F.col(score) >= t)) for t in thresholds]
    one = df.agg(F.count_if(F.col(label) == 1).alias("positive"), *[c.alias(f"{n}{i}") for i, h in enumerate(hits) for n, c in zip(("tp", "pp"), h, strict=True)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp")) for i, t in enumerate(thresholds)])
    out = one.select("positive", F.explode(rows).alias("r")).select("positive", "r.*")
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("pp")), F.col("tp") / F.greatest(F.lit(1), F.col("positive"))
    return out.select("threshold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc, from counts by distinct score (ties count half), so no sort of all rows in one task."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return counts_below(by, "s", "n").agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def match_rates(best: DataFrame) -> DataFrame:
    """One row from best IoUs: n, mean, % at 0.5 and at 0.75."""
    at = lambda t: 100 * F.avg((F.col("iou") >= t).cast("int"))
    return best.agg(F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), at(0.5).alias("pct_50"), at(0.75).alias("pct_75"))


def geo_split(df: DataFrame, x: str, share: float, buffer: float) -> DataFrame:
    """Adds ``fold``: test east of the quantile of ``x``, train west of the buffer strip, else dropped."""
    (line,) = quantiles(df, F.col(x), [1 - share])
    return df.withColumn("fold", F.when(F.col(x) > F.lit(line), "test").when(F.col(x) < F.lit(line) - buffer, "train").otherwise("buffer"))


def boundary_f(pred: DataFrame, truth: DataFrame, reach: int = 1) -> DataFrame:
    """One row: precision, recall, f of boundary cells within ``reach`` cells of the other side."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    grown = lambda d: d.select(F.explode(F.transform(steps, lambda k: F.col("x") + k)).alias("x"), "y").select("x", F.explode(F.transform(steps, lambda k: F.col("y") + k)).alias("y")).distinct()
    hit = lambda a, b: a.join(grown(b).withColumn("h", F.lit(1)), ["x", "y"], "left").agg(F.avg(F.coalesce("h", F.lit(0))).alias("v"))
    p, r = hit(pred, truth).toDF("precision"), hit(truth, pred).toDF("recall")
    return p.crossJoin(r).withColumn("f", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))  # one row each


def voted(items: DataFrame, members: int) -> DataFrame:
    """Clusters of detections that agree: site, votes, score; kept with two votes or a mean of 0.85.

    ``items`` has site (detections of one site overlap by an IoU of 0.5), member and score; a member
    counts once a site, with its best score.
    """
    best = items.groupBy("site", "member").agg(F.max("score").alias("score"))
    out = best.groupBy("site").agg(F.count("*").alias("votes"), F.avg("score").alias("mean")).filter((F.col("votes") >= VOTES) | (F.col("mean") >= SOLO_SCORE))
    return out.select("site", "votes", (F.col("mean") * F.least(F.lit(1.0), F.col("votes") / min(3, members))).alias("score"))


def packed_labels(masks: DataFrame, least: int = LEAST_CELLS) -> DataFrame:
    """One label a cell from overlapping masks: the best score wins; small remains go."""
    won = masks.groupBy("x", "y").agg(F.max_by("mask", F.struct("score", -F.col("mask"))).alias("label"))
    won = written(won, "packed-labels")
    big = won.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("label")
    return won.join(big, "label", "left_semi").select("x", "y", "label")


def label_votes(tiles: DataFrame) -> DataFrame:
    """Cells set by at least half of the tiles that cover them."""
    by = tiles.groupBy("x", "y").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    return by.filter(F.col("m") >= F.greatest(F.lit(1), F.ceil(0.5 * F.col("n")))).select("x", "y")


def repeats(small: int, large: int) -> int:
    """How often a small source is repeated to come to about a quarter of the large one."""
    return max(1, round(large / 4 / max(1, small)))


def rebalanced(df: DataFrame, kind: str, small: str) -> DataFrame:
    """Rows of the ``small`` kind repeated, the others once; adds ``copy``."""
    n = {r[kind]: r["n"] for r in df.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # a row a kind
    times = repeats(n.get(small, 0), sum(v for k, v in n.items() if k != small))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(kind) == small, times).otherwise(1))))


def contrast(df: DataFrame, found: str, value: Column) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(found), value)).alias("found_mean"), F.avg(F.when(~F.col(found), value)).alias("missed_mean"))


def evaluated(layer: DataFrame, buildings: DataFrame, inner: tuple[float, float, float, float]) -> DataFrame:
    """The boxes of ``layer`` that hold the middle of a building and have their own in the inner box."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    x, y = middle("x0", "x1"), middle("y0", "y1")
    west, south, east, north = inner
    own = layer.filter((x > west) & (x < east) & (y > south) & (y < north))
    held = containing(buildings.select(x.alias("x"), y.alias("y")), own.select("id", "x0", "y0", "x1", "y1")).select(F.col("b_id").alias("id")).distinct()
    return own.join(held, "id", "left_semi")


def pixel_scores(cells: DataFrame, ignored: int = 255) -> DataFrame:
    """One row: precision, recall, f1 and iou of set cells; cells whose truth is ``ignored`` do not count."""
    of = lambda t, p: F.count_if((F.col("truth") > 0 if t else F.col("truth") == 0) & (F.col("pred") > 0 if p else F.col("pred") == 0))
    n = cells.filter(F.col("truth") != ignored).agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"))
    over = lambda a, b: a / F.greatest(F.lit(1), b)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return n.select(over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp, tp + fp + fn).alias("iou"))


def merge_rate(cells: DataFrame, cell_m2: float, least_m2: float = SCORED_M2) -> DataFrame:
    """One row: footprints scored, those merged with another, their share, and the predicted components.

    ``cells`` has tile, x, y, truth and pred (0: none) of whole tiles.  A footprint of ``least_m2`` or
    more is scored where one connected predicted component covers half of it, and it is merged where
    that component covers half of another one as well.
    """
    from cadaspark.operators.regions import regions

    # tiles are set apart, so that components do not run from one into the next
    span = cells.agg(F.min("x").alias("lo"), (F.max("x") - F.min("x") + 2).alias("width"), F.min("tile").alias("first"))
    placed = cells.crossJoin(F.broadcast(span)).withColumn("x", F.col("x") - F.col("lo") + (F.col("tile") - F.col("first")) * F.col("width"))  # one row
    placed = written(placed.select("x", "y", "tile", "truth", "pred"), "merge-cells")
    named = written(regions(placed.filter("pred > 0").select("x", "y", F.lit(1).alias("label"))).select("x", "y", "region"), "merge-regions")
    both = placed.filter("truth > 0").join(named, ["x", "y"], "left")
    size = both.groupBy("tile", "truth").agg(F.count("*").alias("size")).filter(F.col("size") * cell_m2 >= least_m2)
    shares = both.filter("region is not null").groupBy("tile", "truth", "region").agg(F.count("*").alias("n"))
    best = shares.groupBy("tile", "truth").agg(F.max_by(F.struct("region", "n"), F.struct("n", -F.col("region"))).alias("b"))
    owned = size.join(best, ["tile", "truth"]).filter(F.col("b.n") >= 0.5 * F.col("size")).select(F.col("b.region").alias("region"))
    each = owned.groupBy("region").agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("merged"))
    return out.withColumn("merge_rate", F.round(F.col("merged") / F.greatest("scored", F.lit(1)), 4)).crossJoin(named.agg(F.countDistinct("region").alias("components")))  # one row each
