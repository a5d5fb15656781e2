"""Queries on logs, versions and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.operators import comparison, logs, queues, siting
from cadaspark.plans import fixtures as x
from cadaspark.plans.q_comparison import ALL, NEAREST, _status
from cadaspark.plans.q_rules import BR, INTER, MEET, UNRECORDED
from cadaspark.plans.registry import query

CASES = ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in logs.STATUSES)


@query(f"select count(*) as parcels, {CASES}, round(100.0 * count(*) filter (where status <> 'draft') / count(*), 4) as reviewed_pct from parcels")
def status_counts(spark, sf_dir):
    return logs.status_counts(x.parcels(spark, sf_dir)).withColumn("reviewed_pct", F.round("reviewed_pct", 4))


@query("select round(100.0 * count(*) filter (where status = 'approved' and source = 'ai') / count(*) filter (where status = 'approved'), 4) as as_drawn_pct from parcels")
def effort_kpis(spark, sf_dir):
    return logs.effort(x.parcels(spark, sf_dir)).withColumn("as_drawn_pct", F.round("as_drawn_pct", 4))


@query(
    """select count(*) as visits, count(distinct parcel_id) as parcels_visited, count(*) filter (where on_site) as on_site,
    (select string_agg(verdict || '=' || n, ',' order by verdict) from (select verdict, count(*) as n from observations group by verdict)) as by_verdict from observations"""
)
def field_summary(spark, sf_dir):
    out = logs.field_summary(x.observations(spark, sf_dir))
    text = F.array_join(F.transform(F.map_entries("by_verdict"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("by_verdict", text)


@query("select obs_id, parcel_id, count(*) over (partition by parcel_id order by time, obs_id rows between unbounded preceding and current row) as field_visits from observations")
def running_visits(spark, sf_dir):
    return logs.running_visits(x.observations(spark, sf_dir))


LATEST = """select parcel_id, verdict as field_verdict, case verdict when 'confirmed' then 'approved' when 'not_a_parcel' then 'rejected' else 'field_check' end as status, on_site as field_on_site from observations qualify row_number() over (partition by parcel_id order by time desc, obs_id desc) = 1"""


@query(LATEST)
def latest_status(spark, sf_dir):
    return logs.latest_status(x.observations(spark, sf_dir)).drop("time")


@query("select parcels as parcel_id, edit_id, age from (select *, row_number() over (partition by parcels order by t desc, edit_id desc) as age from edits) where age <= 50")
def last_versions(spark, sf_dir):
    return logs.last_versions(x.edits(spark, sf_dir), "parcels", ["t", "edit_id"]).select(F.col("parcels").alias("parcel_id"), "edit_id", "age")


@query("select parcels as parcel_id, edit_id, action from (select *, row_number() over (partition by parcels order by t desc, edit_id desc) as age from edits) where age = 2")
def undo_versions(spark, sf_dir):
    return logs.undone(x.edits(spark, sf_dir), "parcels", ["t", "edit_id"]).select(F.col("parcels").alias("parcel_id"), "edit_id", "action")


@query(
    """select id, status, change from (
      (select id, status, 'removed' as change from parcels where id % 10 = 3 or id % 25 = 0)
      union all (select id, 'approved' as status, 'added' from parcels where id % 10 = 3)) where not (change = 'removed' and id % 10 = 3 and status = 'approved')
      and not (change = 'added' and id in (select id from parcels where status = 'approved'))"""
)
def version_diff(spark, sf_dir):
    old = x.parcels(spark, sf_dir).select("id", "status")
    new = old.filter("id % 25 <> 0 or id % 10 = 3").withColumn("status", F.when(F.col("id") % 10 == 3, "approved").otherwise(F.col("status")))
    return logs.version_diff(old, new)


@query("select date_trunc('day', t) as start, count(*) as edits, count(distinct parcels) as parcels from edits group by 1")
def edit_activity(spark, sf_dir):
    return logs.edit_activity(x.edits(spark, sf_dir))


@query("select edit_id, action from edits order by t desc, edit_id desc limit 200")
def latest_log(spark, sf_dir):
    return logs.latest_entries(x.edits(spark, sf_dir)).select("edit_id", "action")


@query("select p.id, p.status from parcels p where id not in (select s_suppkey from supplier)")
def deleted_parcels(spark, sf_dir):
    return logs.without(x.parcels(spark, sf_dir).select("id", "status"), x.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


ISSUES = """select distinct a.id from parcels a join parcels b on a.id <> b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
    where (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5"""


@query("select id, row_number() over (order by (id not in (select id from with_issues)), confidence, id) as rank from parcels where status = 'draft' order by rank limit 200", with_issues=ISSUES)
def review_queue(spark, sf_dir):
    from cadaspark.operators.topology import issue_types, overlap_pairs

    p = x.parcels(spark, sf_dir)
    found = issue_types(overlap_pairs(p).select("type", F.array("a_id", "b_id").alias("parcel_ids")))
    return queues.review_queue(p.join(found, "id", "left"), "draft").select("id", "rank")


@query("select id, confidence from parcels where status = 'draft' and id not in (0, 4, 8) order by confidence, id limit 1")
def next_to_review(spark, sf_dir):
    return queues.next_to_review(x.parcels(spark, sf_dir), [0, 4, 8]).select("id", "confidence")


@query(
    """select id, row_number() over (order by d, id) as rank, d as distance_m from (select id, round(2 * 6371000 * asin(sqrt(sin(radians(lat - 20.001) / 2) ** 2
    + cos(radians(20.001)) * cos(radians(lat)) * sin(radians(lon - 78.002) / 2) ** 2)), 2) as d from (select id, 20 + (y0 + y1) / 2 / 110574 as lat, 78 + (x0 + x1) / 2 / 104000 as lon
    from parcels where status = 'field_check')) order by rank limit 150"""
)
def field_queue(spark, sf_dir):
    p = x.parcels(spark, sf_dir).withColumn("lat", 20 + (F.col("y0") + F.col("y1")) / 2 / 110574).withColumn("lon", 78 + (F.col("x0") + F.col("x1")) / 2 / 104000)
    return queues.field_queue(p, 20.001, 78.002).select("id", "rank", "distance_m")


@query("select id, round(iou, 4) as iou from rec_status where status <> 'MATCH' order by rec_status.iou, id limit 150", **ALL)
def disagreements_topk(spark, sf_dir):
    out = queues.ranked(_status(spark, sf_dir).filter("status <> 'MATCH'").select("id", "iou"), F.col("iou"), F.col("id"), n=150)
    return out.select("id", F.round("iou", 4).alias("iou"))


@query("select point_id, round(error_m, 4) as error_m from errors order by round(errors.error_m, 6) desc, point_id limit 100", errors=NEAREST)
def worst_points_topk(spark, sf_dir):
    e = comparison.vertex_errors(x.gnss(spark, sf_dir), x.parcels(spark, sf_dir)).withColumn("k", F.round("error_m", 6))
    return queues.ranked(e, F.desc("k"), F.col("point_id"), n=100).select("point_id", F.round("error_m", 4).alias("error_m"))


@query(f"select b.id, round(sum({INTER.format('r')}), 3) as overlap_m2 from buildings b join roads r on {MEET.format('r')} group by b.id having sum({INTER.format('r')}) >= 4 order by 2 desc, 1 limit 12")
def encroachments_top12(spark, sf_dir):
    found = siting.road_encroachment(x.buildings(spark, sf_dir), x.roads(spark, sf_dir).withColumn("x1", F.col("x1"))).select("id", F.round("overlap_m2", 3).alias("overlap_m2"))
    return queues.ranked(found, F.desc("overlap_m2"), F.col("id"), n=12).select("id", "overlap_m2")


@query(
    f"""select id, grade, row_number() over (order by grade, id) as rank from (select id, min(grade) as grade from (select b.id, 1 as grade from buildings b join roads r on true
    group by b.id having min({BR}) > 200 union all select id, 2 from new_buildings where unrecorded union all select id, 3 from buildings) group by id) order by rank limit 8""",
    new_buildings=UNRECORDED,
)
def priority_union(spark, sf_dir):
    b = x.buildings(spark, sf_dir)
    return queues.priority(siting.without_road(b, x.roads(spark, sf_dir)), comparison.unrecorded(b, x.records(spark, sf_dir)).filter("unrecorded"), b)


@query("select zone, class, n, rank from (select zone, class, count(*) as n, row_number() over (partition by zone order by count(*) desc, class) as rank from pixels group by zone, class) where rank <= 3")
def dominant_classes(spark, sf_dir):
    counts = x.pixels(spark, sf_dir).groupBy("zone", "class").agg(F.count("*").alias("n"))
    return queues.top_per_group(counts, "zone", F.desc("n"), F.col("class"), n=3)


@query(
    f"""select (select count(*) from parcels) as parcels, (select round(sum((x1 - x0) * (y1 - y0)), 1) from parcels) as area_m2,
    (select count(*) from observations) as visits, (select count(*) from rec_status where status = 'MATCH') as matches,
    (select count(*) from (select b.id from buildings b join roads r on {MEET.format('r')} group by b.id)) as buildings_on_roads""",
    **ALL,
)
def survey_report(spark, sf_dir):
    """The tables of a survey report as one row."""
    from cadaspark.operators.spatial import overlay

    p = x.parcels(spark, sf_dir).agg(F.count("*").alias("parcels"), F.round(F.sum(box_area()), 1).alias("area_m2"))
    v = logs.field_summary(x.observations(spark, sf_dir)).select("visits")
    m = comparison.comparison_summary(_status(spark, sf_dir)).select(F.col("match").alias("matches"))
    e = overlay(x.buildings(spark, sf_dir), x.roads(spark, sf_dir)).agg(F.countDistinct("a_id").alias("buildings_on_roads"))
    return p.crossJoin(v).crossJoin(m).crossJoin(e)  # one row each
