"""Queries on topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.operators import topology as t
from cadaspark.operators.coverage import gaps
from cadaspark.operators.graph import written
from cadaspark.operators.spatial import with_bounds
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query

OVERLAPS = """select a.id as a_id, b.id as b_id, i as inter, i / (aa + ba - i) as iou, 100 * i / least(aa, ba) as pct from (
  select a, b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i,
    (a.x1 - a.x0) * (a.y1 - a.y0) as aa, (b.x1 - b.x0) * (b.y1 - b.y0) as ba
  from {0} a join {0} b on a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1) where i > 0.5"""

SHAPES = """
  select id, 'INVALID' as type, (x1 - x0) * (y1 - y0) / 2 as amount from dirty_all where bow
  union all select id, 'MULTIPART', 2 from dirty_all where bow
  union all select id, 'HOLE', 1 from dirty_all where holed and not bow
  union all select id, 'TOO_SMALL', (x1 - x0) * (y1 - y0) from dirty_all where (x1 - x0) * (y1 - y0) < 12
  union all select id, 'SLIVER', 4 * pi() * (x1 - x0) * (y1 - y0) / (4 * (x1 - x0 + y1 - y0) ** 2) from dirty_all
    where (x1 - x0) * (y1 - y0) between 12 and 60 and 4 * pi() * (x1 - x0) * (y1 - y0) / (4 * (x1 - x0 + y1 - y0) ** 2) < 0.12"""
#: The holes of parcels are enclosed land; those of two parcels with one outline are one gap.
GAPS = "select id, 'GAP' as type from {0} where holed and not bow and (x1 - x0 - 8) * (y1 - y0 - 8) between 1 and 400"
#: Bow-ties and holed parcels overlap with their own duplicates alone, over their whole areas.
PAIRS = OVERLAPS.replace("{0}", "dirty_all")
KIND = "case when iou >= 0.95 then 'DUPLICATE' else 'OVERLAP' end"


@query(f"select a_id, b_id, round(inter, 3) as inter_m2, round(iou, 4) as iou, round(pct, 4) as pct_of_smaller, {KIND} as type from pairs", pairs=OVERLAPS.replace("{0}", "parcels"))
def overlap_pairs(spark, sf_dir):
    out = t.overlap_pairs(x.parcels(spark, sf_dir))
    return out.select("a_id", "b_id", F.round("inter", 3).alias("inter_m2"), F.round("iou", 4).alias("iou"), F.round("pct_of_smaller", 4).alias("pct_of_smaller"), "type")


@query("select a_id, b_id from pairs where iou >= 0.95", pairs=PAIRS)
def duplicate_parcels(spark, sf_dir):
    layer = written(t.measured(x.parcels_dirty(spark, sf_dir)), "measured")
    return t.overlap_pairs(layer, exact=True).filter("type = 'DUPLICATE'").select("a_id", "b_id")


@query(f"select type, count(*) as issues from (select type from shapes union all select {KIND} from pairs union all select type from ({GAPS.format('dirty')})) group by type", pairs=PAIRS, shapes=SHAPES)
def issue_counts(spark, sf_dir):
    return t.issues(x.parcels_dirty(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("issues"))


@query(
    f"""select id, string_agg(distinct type, ',' order by type) as issues from (select id, type from shapes union all {GAPS.format('dirty_all')}
    union all select a_id, {KIND} from pairs union all select b_id, {KIND} from pairs) group by id""",
    pairs=PAIRS,
    shapes=SHAPES,
)
def parcel_issue_list(spark, sf_dir):
    return t.issue_types(t.issues(x.parcels_dirty(spark, sf_dir))).select("id", F.concat_ws(",", "issues").alias("issues"))


@query("select id, type, round(amount, 4) as amount from shapes where type in ('TOO_SMALL', 'SLIVER')", shapes=SHAPES)
def slivers_and_small(spark, sf_dir):
    found = t.shape_issues(t.measured(x.parcels_dirty(spark, sf_dir))).filter(F.col("type").isin("TOO_SMALL", "SLIVER"))
    return found.select(F.element_at("parcel_ids", 1).alias("id"), "type", F.round("amount", 4).alias("amount"))


BORDERS = """select a.id as a_id, b.id as b_id,
    (case when a.x0 = b.x0 then 1 else 0 end + case when a.x1 = b.x1 then 1 else 0 end + case when a.x0 = b.x1 then 1 else 0 end + case when a.x1 = b.x0 then 1 else 0 end)
      * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
    + (case when a.y0 = b.y0 then 1 else 0 end + case when a.y1 = b.y1 then 1 else 0 end + case when a.y0 = b.y1 then 1 else 0 end + case when a.y1 = b.y0 then 1 else 0 end)
      * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) as shared_m
    from parcels a join parcels b on a.id <> b.id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1"""


@query("select a_id, b_id, round(shared_m, 3) as shared_m from borders where shared_m > 0", borders=BORDERS)
def shared_border_length(spark, sf_dir):
    return t.shared_borders(x.geoms(x.parcels(spark, sf_dir))).select("a_id", "b_id", F.round("shared_m", 3).alias("shared_m"))


@query(
    """select a_id as id, arg_max(b_id, shared_m * 1e9 - b_id) as neighbour, round(max(shared_m), 3) as shared_m from borders
    where shared_m > 0 and a_id in (select id from parcels where (x1 - x0) * (y1 - y0) < 250) group by a_id""",
    borders=BORDERS,
)
def best_merge_neighbour(spark, sf_dir):
    layer = x.parcels(spark, sf_dir)
    small = layer.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < 250)
    return t.best_neighbour(x.geoms(layer), small).select("id", "neighbour", F.round("shared_m", 3).alias("shared_m"))


TILES = """select p_partkey as id, (p_partkey % 50)::int as i, (p_partkey // 50)::int as j, p_size from part"""


@query(
    """select (i * 5)::bigint as x, (j * 5)::bigint as y, 400.0::double as area_m2 from tiles t where p_size % 7 = 0 and (select count(*) from tiles u where u.p_size % 7 <> 0
    and abs(t.i - u.i) + abs(t.j - u.j) = 1) = 4""",
    tiles=TILES,
)
def coverage_gaps(spark, sf_dir):
    p = F.col("p_partkey")
    base = x.table(spark, sf_dir, "part").filter(F.col("p_size") % 7 != 0).select(p.alias("id"), (p % 50 * 20).cast("double").alias("x0"), (F.floor(p / 50) * 20).cast("double").alias("y0"))
    layer = with_bounds(x.geoms(base.withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 20)))
    out = gaps(layer, t.GAP_LEAST_M2, t.GAP_MOST_M2)
    return out.select((F.col("gap.x") / 4).cast("bigint").alias("x"), (F.col("gap.y") / 4).cast("bigint").alias("y"), "area_m2")


@query()
def auto_fix_log(spark, sf_dir):
    _, log = t.auto_fix(x.parcels(spark, sf_dir))
    return log.select(F.concat_ws(",", F.col("parcel_ids").cast("array<string>")).alias("parcel_ids"), "action", "area_m2")


@query(
    """select g as grp, count(*) as members, sum((x1 - x0) * (y1 - y0)) as area_m2 from (select *, id // 2 as g from tiles) group by g""",
    tiles="select p_partkey as id, (p_partkey % 50 * 20)::double as x0, (p_partkey // 50 * 20)::double as y0, (p_partkey % 50 * 20 + 20)::double as x1, (p_partkey // 50 * 20 + 20)::double as y1 from part",
)
def merged_parcels(spark, sf_dir):
    p = F.col("p_partkey")
    base = x.table(spark, sf_dir, "part").select(p.alias("id"), (p % 50 * 20).cast("double").alias("x0"), (F.floor(p / 50) * 20).cast("double").alias("y0"))
    layer = x.geoms(base.withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 20))
    groups = base.select("id", F.floor(F.col("id") / 2).alias("group"))
    return t.merged(layer, groups).select(F.col("group").alias("grp"), "area").join(groups.groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("members")), "grp").select("grp", "members", F.col("area").alias("area_m2"))
