"""Queries on scores, splits and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.operators import scoring as s
from cadaspark.plans import fixtures as x
from cadaspark.plans.q_comparison import ALL, _pairs
from cadaspark.plans.registry import query

MATRIX = "select l_returnflag as truth, case when l_linestatus = 'O' then 'N' else 'R' end as pred, count(*) as n from lineitem group by all"
SCORES = """select c as class, coalesce(tp, 0) as tp, coalesce(p, 0) - coalesce(tp, 0) as fp, coalesce(t, 0) - coalesce(tp, 0) as fn from (select truth as c from matrix union select pred from matrix)
    left join (select truth as c, sum(n) as t from matrix group by 1) using (c) left join (select pred as c, sum(n) as p from matrix group by 1) using (c)
    left join (select truth as c, n as tp from matrix where truth = pred) using (c)"""


@query("select class, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / greatest(1, tp + fp + fn), 5) as iou, round(2 * tp / greatest(1, 2 * tp + fp + fn), 5) as f1 from cscores", matrix=MATRIX, cscores=SCORES)
def confusion_iou(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem").withColumn("pred", F.when(F.col("l_linestatus") == "O", "N").otherwise("R"))
    return s.class_scores(s.confusion(li, "l_returnflag", "pred")).withColumn("iou", F.round("iou", 5)).withColumn("f1", F.round("f1", 5))


N = "select tile, truth, pred, count(*) as inter from instances group by all"
CONT = """select tile, truth, pred, inter, inter / (t + p - inter) as iou from cells_n join (select tile, truth, sum(inter) as t from cells_n group by all) using (tile, truth)
    join (select tile, pred, sum(inter) as p from cells_n group by all) using (tile, pred) where truth > 0 and pred > 0"""
TILES = """select px.tile, total, found, iou_sum, coalesce(shapes, 0) as shapes, coalesce(extra, 0) as extra, coalesce(pairs, 0) as pairs, coalesce(merged, 0) as merged, pix_i, pix_u
  from (select tile, count(*) filter (where truth > 0 and pred > 0) as pix_i, count(*) filter (where truth > 0 or pred > 0) as pix_u from instances group by tile) px
  left join (select tile, count(*) as total, count(*) filter (where iou >= 0.5) as found, coalesce(sum(iou) filter (where iou >= 0.5), 0) as iou_sum
    from (select distinct tile, truth from instances where truth > 0) left join (select tile, truth, max(iou) as iou from cont group by all) using (tile, truth) group by tile) t on t.tile = px.tile
  left join (select tile, count(*) as shapes, count(*) filter (where coalesce(iou, 0) < 0.5) as extra
    from (select distinct tile, pred from instances where pred > 0) left join (select tile, pred, max(iou) as iou from cont group by all) using (tile, pred) group by tile) p on p.tile = px.tile
  left join (select near.tile, count(*) as pairs, count(*) filter (where ma.main = mb.main) as merged from near left join main_hit ma on ma.tile = near.tile and ma.truth = a
    left join main_hit mb on mb.tile = near.tile and mb.truth = b group by near.tile) q on q.tile = px.tile"""
NEAR = """select distinct u.tile, u.truth as a, v.truth as b from instances u join instances v on u.tile = v.tile and abs(u.x - v.x) <= 3 and abs(u.y - v.y) <= 3 and u.truth < v.truth and u.truth > 0"""
MAIN = "select tile, truth, arg_max(pred, inter * 1000000 - pred) as main from cont group by all"
V = {"cells_n": N, "cont": CONT, "near": NEAR, "main_hit": MAIN, "tscores": TILES}


@query("select tile, truth, pred, inter, round(iou, 5) as iou from cont", cells_n=N, cont=CONT)
def instance_contingency(spark, sf_dir):
    return s.contingency(x.instances(spark, sf_dir)).select("tile", "truth", "pred", "inter", F.round("iou", 5).alias("iou"))


@query("select tile, total, found, round(iou_sum, 4) as iou_sum, shapes, extra, pairs, merged, pix_i, pix_u from tscores", **V)
def instance_scores(spark, sf_dir):
    return s.instance_scores(x.instances(spark, sf_dir)).withColumn("iou_sum", F.round("iou_sum", 4))


@query(
    """select round(f / t, 4) as recall, round(f / (f + e), 4) as precision, round(i / f, 4) as outline_iou, round(m / p, 4) as merge_rate, round(pi / pu, 4) as building_iou
    from (select sum(total) as t, sum(found) as f, sum(extra) as e, sum(iou_sum) as i, sum(merged) as m, sum(pairs) as p, sum(pix_i) as pi, sum(pix_u) as pu from tscores)""",
    **V,
)
def score_rollup(spark, sf_dir):
    out = s.rolled_up(s.instance_scores(x.instances(spark, sf_dir)))
    return out.select(*[F.round(c, 4).alias(c) for c in ("recall", "precision", "outline_iou", "merge_rate", "building_iou")])


STEPS = [round(0.05 * k, 2) for k in range(1, 20)]


@query(
    f"""select threshold, round(tp / greatest(1, pp), 5) as precision, round(tp / pos, 5) as recall, round(case when tp > 0 then 2 * tp / (pp + pos) else 0 end, 5) as f1 from (
    select t as threshold, count(*) filter (where l_discount * 10 >= t and l_returnflag = 'R') as tp, count(*) filter (where l_discount * 10 >= t) as pp, count(*) filter (where l_returnflag = 'R') as pos
    from lineitem, (select unnest([{', '.join(f'{t}::double' for t in STEPS)}]) as t) group by t)"""
)
def threshold_sweep(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return s.threshold_sweep(li, "score", "label", STEPS).select("threshold", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """select round((sum(r) filter (where l = 1) - count(*) filter (where l = 1) * (count(*) filter (where l = 1) + 1) / 2) / (count(*) filter (where l = 1)::double * count(*) filter (where l = 0)), 6) as auc
    from (select l, k + (c - 1) / 2 as r from (select (l_returnflag = 'R')::int as l, rank() over (order by l_quantity) as k, count(*) over (partition by l_quantity) as c from lineitem))"""
)
def roc_auc(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return s.roc_auc(li, "l_quantity", "label").select(F.round("auc", 6).alias("auc"))


@query("select count(*) as n, round(avg(iou), 5) as mean_iou, round(100 * avg((iou >= 0.5)::int), 4) as pct_50, round(100 * avg((iou >= 0.75)::int), 4) as pct_75 from (select id, max(iou) as iou from rec_pairs group by id)", **ALL)
def iou_match_rates(spark, sf_dir):
    out = s.match_rates(_pairs(spark, sf_dir).groupBy("id").agg(F.max("iou").alias("iou")))
    return out.select("n", F.round("mean_iou", 5).alias("mean_iou"), F.round("pct_50", 4).alias("pct_50"), F.round("pct_75", 4).alias("pct_75"))


@query("select id, case when x0 > q then 'test' when x0 < q - 40 then 'train' else 'buffer' end as fold from parcels, (select quantile_cont(x0, 0.75) as q from parcels)")
def geo_split(spark, sf_dir):
    return s.geo_split(x.parcels(spark, sf_dir).select("id", "x0"), "x0", 0.25, 40.0).select("id", "fold")


@query(
    """select site, votes, round(mean * least(1, votes / 3), 5) as score from (select site, count(*) as votes, avg(score) as mean from (
    select l_partkey as site, l_linenumber as member, max(l_discount * 10) as score from lineitem group by all) group by site) where votes >= 2 or mean >= 0.85"""
)
def vote_fusion(spark, sf_dir):
    items = x.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_linenumber").alias("member"), (F.col("l_discount") * 10).alias("score"))
    return s.voted(items, 7).withColumn("score", F.round("score", 5))


MASKS = "select (l_partkey % 40)::int as x, (l_suppkey % 25)::int as y, (l_orderkey % 30)::int as mask, max(l_quantity) as score from lineitem group by all"


@query("select x, y, label from (select *, count(*) over (partition by label) as c from (select x, y, arg_max(mask, score * 1000 - mask) as label from masks group by x, y)) where c >= 20", masks=MASKS)
def packed_labels(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem")
    masks = li.groupBy((F.col("l_partkey") % 40).cast("int").alias("x"), (F.col("l_suppkey") % 25).cast("int").alias("y"), (F.col("l_orderkey") % 30).cast("int").alias("mask")).agg(F.max("l_quantity").alias("score"))
    return s.packed_labels(masks)


@query("select x, y from (select (l_partkey % 40)::int as x, (l_suppkey % 25)::int as y, sum((l_quantity > 30)::int) as m, count(*) as c from lineitem group by all) where m >= greatest(1, ceil(0.5 * c))")
def label_votes(spark, sf_dir):
    li = x.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).cast("int").alias("x"), (F.col("l_suppkey") % 25).cast("int").alias("y"), (F.col("l_quantity") > 30).cast("int").alias("m"))
    return s.label_votes(li)


@query("select source, count(*) * case when source = 'edited' then greatest(1, round((select count(*) from parcels where source <> 'edited') / 4 / (select count(*) from parcels where source = 'edited')))::int else 1 end as row_count from parcels group by source")
def rebalanced_sources(spark, sf_dir):
    return s.rebalanced(x.parcels(spark, sf_dir).select("id", "source"), "source", "edited").groupBy("source").agg(F.count("*").alias("row_count"))


RIM = "select x, y from instances u where {0} > 0 and exists (select 1 from instances v where abs(u.x - v.x) + abs(u.y - v.y) = 1 and v.{0} <> u.{0})"


@query(
    """select round(p, 5) as precision, round(r, 5) as recall from (select avg(exists (select 1 from rim_t t where abs(t.x - q.x) <= 1 and abs(t.y - q.y) <= 1)::int) as p from rim_p q),
    (select avg(exists (select 1 from rim_p q where abs(t.x - q.x) <= 1 and abs(t.y - q.y) <= 1)::int) as r from rim_t t)""",
    rim_t=RIM.format("truth"),
    rim_p=RIM.format("pred"),
)
def boundary_score(spark, sf_dir):
    cells = x.instances(spark, sf_dir)
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))

    def rim(name):
        near = cells.select("x", "y", F.col(name).alias("v"), steps.alias("d")).filter("v > 0").select("x", "y", "v", (F.col("x") + F.col("d.dx")).alias("u"), (F.col("y") + F.col("d.dy")).alias("w"))
        return near.join(cells.select(F.col("x").alias("u"), F.col("y").alias("w"), F.col(name).alias("o")), ["u", "w"]).filter("v <> o").select("x", "y").distinct()

    out = s.boundary_f(rim("pred"), rim("truth"))
    return out.select(F.round("precision", 5).alias("precision"), F.round("recall", 5).alias("recall"))


@query(
    """select tile, count(*) as shapes, count(*) filter (where coalesce(iou, 0) < 0.5 and coalesce(hit, 0) / n > 0.3) as extra from (select tile, pred, sum(inter) as n from cells_n where pred > 0 group by all)
    left join (select tile, pred, max(iou) as iou, sum(inter) as hit from cont group by all) using (tile, pred) group by tile""",
    cells_n=N,
    cont=CONT,
)
def partial_label_extras(spark, sf_dir):
    """Shapes that match no label, in tiles that are labelled in part."""
    return s.instance_scores(x.instances(spark, sf_dir), partial=True).filter("shapes > 0").select("tile", "shapes", "extra")


HELD = "select p.id from parcels p where (x0 + x1) / 2 > 100 and (x0 + x1) / 2 < 900 and (y0 + y1) / 2 > 20 and exists (select 1 from buildings b where (b.x0 + b.x1) / 2 >= p.x0 and (b.x0 + b.x1) / 2 < p.x1 and (b.y0 + b.y1) / 2 >= p.y0 and (b.y0 + b.y1) / 2 < p.y1)"


@query("select count(*) as n, round(avg(iou), 5) as mean_iou, round(100 * avg((iou >= 0.5)::int), 4) as pct_50, round(100 * avg((iou >= 0.75)::int), 4) as pct_75 from (select h.id, coalesce(max(iou), 0) as iou from held h left join rec_pairs r on r.id = h.id group by h.id)", held=HELD, **ALL)
def private_plot_rates(spark, sf_dir):
    """Match rates of the parcels that hold a building, away from the survey's edge."""
    own = s.evaluated(x.parcels(spark, sf_dir), x.buildings(spark, sf_dir), (100, 20, 900, 1e9))
    best = own.select("id").join(_pairs(spark, sf_dir).groupBy("id").agg(F.max("iou").alias("iou")), "id", "left").fillna(0.0, ["iou"])
    out = s.match_rates(best)
    return out.select("n", F.round("mean_iou", 5).alias("mean_iou"), F.round("pct_50", 4).alias("pct_50"), F.round("pct_75", 4).alias("pct_75"))


@query(
    """select round(tp / (tp + fp), 5) as precision, round(tp / (tp + fn), 5) as recall, round(2 * tp / (2 * tp + fp + fn), 5) as f1, round(tp / (tp + fp + fn), 5) as iou from (select count(*) filter (where truth > 0 and pred > 0) as tp,
    count(*) filter (where truth = 0 and pred > 0) as fp, count(*) filter (where truth > 0 and pred = 0) as fn from instances where (x + y) % 11 <> 0)"""
)
def pixel_scores(spark, sf_dir):
    """Cell scores of a prediction; unlabelled cells do not count."""
    cells = x.instances(spark, sf_dir).withColumn("truth", F.when((F.col("x") + F.col("y")) % 11 == 0, 255).otherwise((F.col("truth") > 0).cast("int")))
    return s.pixel_scores(cells).select(*[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query()
def merge_rates(spark, sf_dir):
    """Footprints that one predicted component joins."""
    return s.merge_rate(x.instances(spark, sf_dir), 4.0)
