"""URLs allowed or blocked by rules, and where no rule fits by two character language models.

URLs that rules allow and URLs that rules block each train a smoothed Markov model of variable order:
a character's probability interpolates (Witten and Bell) the counts after each context of 0 to
``ORDER`` characters, and contexts that were never seen fall through to shorter ones.  A URL's score
is the difference of its two log-likelihoods for each character.  A fifth of the decided URLs train
neither model; their scores calibrate the odds (Platt), and a URL is allowed from even odds on.

Counts are a table of all runs of ``ORDER`` + 1 characters of all URLs, which grows with the corpus;
levels of the model and scores are joins with it, nothing of it is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.llm.common import joined_by_count, stored

ORDER = 4
#: Characters that stand before and after a URL's own.
START, END = "\x02", "\x03"
#: Remainder of crc32(url) that a URL for calibration has.
FOLDS, FOLD = 5, 0
#: Scores are summed as whole numbers of this fraction, so sums do not depend on order.
UNIT = 1 << 32
#: Scores for each character are counted in steps of 1 / STEPS, from -WIDEST to WIDEST, to calibrate.
STEPS, WIDEST = 100, 20
#: Rows of the model (about 40 bytes each) that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits (ties: the longer host, then block), or nulls."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def grams(url: Column, order: int) -> Column:
    """Runs of ``order`` + 1 characters, one that ends at each character of the URL and its end."""
    padded = F.concat(F.lit(START * order), F.coalesce(url, F.lit("")), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - order), lambda i: padded.substr(i, F.lit(order + 1)))


def model_of(counts: DataFrame, order: int) -> DataFrame:
    """``gram``, ``diff``: log-probability of its last character, accepted less rejected, in units.

    ``counts`` has each ``gram`` with how often it occurs in ``accepted`` and ``rejected`` URLs.
    """
    level = None
    for size in range(1, order + 2):
        own = counts.groupBy(F.right("gram", F.lit(size)).alias("g")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        context = W.partitionBy(F.expr(f"left(g, {size - 1})"))  # a row a character that follows the context
        for c in ("accepted", "rejected"):
            own = own.withColumn(f"{c}_n", F.sum(c).over(context)).withColumn(f"{c}_t", F.sum((F.col(c) > 0).cast("int")).over(context))
        if level is None:
            own = own.withColumn("p_accepted", F.lit(1 / 256)).withColumn("p_rejected", F.lit(1 / 256))
        else:
            own = own.join(level.withColumnRenamed("g", "tail"), F.expr("right(g, length(g) - 1)") == F.col("tail"))
        smooth = lambda c: F.when(
            F.col(f"{c}_n") > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"p_{c}")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))
        ).otherwise(F.col(f"p_{c}"))
        level = own.select("g", smooth("accepted").alias("p_accepted"), smooth("rejected").alias("p_rejected"))
    return level.select(F.col("g").alias("gram"), F.round(F.log(F.col("p_accepted") / F.col("p_rejected")) * UNIT).cast("bigint").alias("diff"))


def calibrated(bins: list) -> tuple[float, float]:
    """Slope and offset of the log-odds of being accepted, from (step, accepted, rejected) counts."""
    at, yes, no = (np.array([b[k] for b in bins], float) for k in range(3))
    if not yes.sum() or not no.sum():
        return 1.0, 0.0
    x = at / STEPS
    # Platt's targets: a class of n rows aims at (n + 1) / (n + 2), and both classes weigh the same
    high, low = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
    yes, no = yes / yes.sum(), no / no.sum()
    w, target = yes + no, (yes * high + no * low) / np.maximum(yes + no, 1e-300)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
        g, h = w * (target - p), np.maximum(w * p * (1 - p), 1e-12)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * x).sum() - 1e-6 * slope, g.sum() - 1e-6 * offset])
        slope, offset = slope + float(np.clip(step[0], -5, 5)), offset + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return (slope, offset) if slope > 0 else (1.0, 0.0)


def judged_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict, score, odds.

    ``score`` is the difference of log-likelihoods for each character, ``odds`` the calibrated
    log-odds of being accepted; both are null where a rule decides, but for pages of the calibration.
    Null and empty URLs have empty hosts and paths, fit no rule and are judged by what the models make
    of an end at once; very long URLs are scored whole; repeated rows get equal results; without
    accepted or without rejected URLs the odds are the score itself; an empty table gives an empty
    result; other columns of ``pages`` are not read, whatever their names.
    """
    slim = pages.select(pages[page_id].alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"))
    slim = slim.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    slim = slim.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    slim = slim.withColumn("held", F.crc32("url") % FOLDS == FOLD)
    rows = stored(slim.select("page_id", "url", "host", "path", "ruled.*", "held", F.monotonically_increasing_id().alias("row")), "url-rows")

    # every URL's grams are in the table, those of URLs that do not train with counts of zero
    trains = lambda v: (F.col("verdict").eqNullSafe(v) & ~F.col("held")).cast("bigint")
    every = rows.select(trains("allow").alias("a"), trains("block").alias("r"), F.explode(grams(F.col("url"), order)).alias("gram"))
    counts = stored(every.groupBy("gram").agg(F.sum("a").alias("accepted"), F.sum("r").alias("rejected"), F.count("*").alias("n")), "url-grams")
    model = stored(model_of(counts, order).join(counts.select("gram", "n"), "gram"), "url-model")

    places = rows.filter(F.col("verdict").isNull() | F.col("held")).select("row", F.explode(grams(F.col("url"), order)).alias("gram"))
    if model.count() <= BROADCAST_ROWS:
        met = places.join(F.broadcast(model.drop("n")), "gram")
    else:
        met = joined_by_count(stored(places, "url-places"), model, ["gram"], "n")
    scores = stored(met.groupBy("row").agg((F.sum("diff") / F.count("*") / UNIT).alias("score")), "url-scores")
    out = rows.join(scores, "row", "left")

    at = F.round(F.greatest(F.least(F.col("score"), F.lit(WIDEST)), F.lit(-WIDEST)) * STEPS).cast("int")
    is_a = lambda v: F.sum((F.col("verdict") == v).cast("bigint"))
    bins = out.filter("held and verdict is not null").groupBy(at.alias("at")).agg(is_a("allow"), is_a("block"))  # at most 2 * WIDEST * STEPS + 1
    slope, offset = calibrated([tuple(b) for b in bins.orderBy("at").collect()])
    odds = F.col("score") * slope + offset
    verdict = F.coalesce("verdict", F.when(odds >= 0, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", odds.alias("odds"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
