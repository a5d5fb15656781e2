"""Queries on the comparison with the record and with surveyed points."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions.kernels import boundary_offset
from cadaspark.operators import comparison as c
from cadaspark.operators.graph import written
from cadaspark.operators.spatial import containing, with_bounds
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query

PAIRS = """select id, ref_id, i as inter, i / (area + ref_area - i) as iou, area, ref_area from (
  select a.id, b.ref_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i,
    (a.x1 - a.x0) * (a.y1 - a.y0) as area, (b.x1 - b.x0) * (b.y1 - b.y0) as ref_area
  from parcels a join records b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)"""
CLAIMS = "select ref_id, count(*) as claimants from rec_pairs where inter / ref_area >= 0.2 group by ref_id having count(*) >= 2"
EACH = """select p.id, coalesce(max(iou), 0) as iou, coalesce(sum(inter) / max(p.area), 0) as share, max(p.area) as area,
    count(*) filter (where inter / ref_area >= 0.2 and inter / p.area >= 0.2) as merged,
    coalesce(bool_or(inter / ref_area >= 0.2 and ref_id in (select ref_id from rec_claims)), false) as split
  from (select id, (x1 - x0) * (y1 - y0) as area from parcels) p left join rec_pairs using (id) group by p.id"""
STATUS = """select e.id, case when e.iou >= 0.75 then 'MATCH' when merged >= 2 or (split and share >= 0.2) then 'SPLIT_OR_MERGED' when e.iou >= 0.4 then 'BOUNDARY_DIFFERS'
    when share >= 0.2 then 'SPLIT_OR_MERGED' else 'NOT_IN_RECORD' end as status, e.iou, share, e.area, b.ref_id as best, b.ref_area
  from rec_each e left join (select * from rec_pairs qualify row_number() over (partition by id order by iou desc, ref_id) = 1) b on e.id = b.id"""
ALL = {"rec_pairs": PAIRS, "rec_claims": CLAIMS, "rec_each": EACH, "rec_status": STATUS}


def _pairs(spark, sf_dir):
    return c.record_overlay(x.parcels(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), x.records(spark, sf_dir))


def _status(spark, sf_dir):
    return c.record_status(x.parcels(spark, sf_dir), written(_pairs(spark, sf_dir), "pairs"))


@query("select id, ref_id, round(inter, 3) as inter_m2, round(iou, 4) as iou from rec_pairs", **ALL)
def overlay_areas(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "ref_id", F.round("inter", 3).alias("inter_m2"), F.round("iou", 4).alias("iou"))


@query("select id, ref_id, round(inter, 3) as inter_m2, round(iou, 4) as iou from rec_pairs", **ALL)
def overlay_areas_polygons(spark, sf_dir):
    """The same by the general polygon kernel."""
    shaped = lambda df: with_bounds(x.geoms(df)).withColumn("area", g.area(F.col("geom")))
    out = c.record_overlay(shaped(x.parcels(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")), shaped(x.records(spark, sf_dir)), exact=True).filter("inter > 1e-6")
    return out.select("id", "ref_id", F.round("inter", 3).alias("inter_m2"), F.round("iou", 4).alias("iou"))


@query("select id, best as ref_id, round(iou, 4) as iou from rec_status where best is not null", **ALL)
def best_record_match(spark, sf_dir):
    best = F.min_by(F.struct("ref_id", "iou"), F.struct((-F.col("iou")).alias("k"), "ref_id"))
    return _pairs(spark, sf_dir).groupBy("id").agg(best.alias("b")).select("id", "b.ref_id", F.round("b.iou", 4).alias("iou"))


@query("select id, status, round(iou, 4) as iou, round(share, 4) as share, case when status <> 'NOT_IN_RECORD' then best end as ref_id from rec_status", **ALL)
def record_status(spark, sf_dir):
    return _status(spark, sf_dir).select("id", "status", F.round("iou", 4).alias("iou"), F.round("share", 4).alias("share"), "ref_id")


@query("select ref_id, claimants from rec_claims", **ALL)
def split_claims(spark, sf_dir):
    return c.split_claims(_pairs(spark, sf_dir))


@query(
    """select ref_id from records where ref_id not in (select best from rec_status where status <> 'NOT_IN_RECORD' and best is not null)
    and ref_id not in (select ref_id from rec_pairs where inter / ref_area >= 0.2)""",
    **ALL,
)
def missing_from_layer(spark, sf_dir):
    pairs = written(_pairs(spark, sf_dir), "pairs")
    return c.missing_from_layer(x.records(spark, sf_dir), pairs, c.record_status(x.parcels(spark, sf_dir), pairs)).select("ref_id")


@query(
    """select count(*) as parcels, count(*) filter (where status = 'MATCH') as match, count(*) filter (where status = 'BOUNDARY_DIFFERS') as boundary_differs,
    count(*) filter (where status = 'SPLIT_OR_MERGED') as split_or_merged, count(*) filter (where status = 'NOT_IN_RECORD') as not_in_record,
    round(100.0 * count(*) filter (where status = 'MATCH') / count(*), 3) as agreement_pct,
    round(avg(iou) filter (where status in ('MATCH', 'BOUNDARY_DIFFERS')), 4) as mean_iou,
    round(100 * quantile_cont(abs(area - ref_area) / ref_area, 0.5) filter (where status in ('MATCH', 'BOUNDARY_DIFFERS')), 4) as median_area_diff_pct from rec_status""",
    **ALL,
)
def comparison_summary(spark, sf_dir):
    out = c.comparison_summary(_status(spark, sf_dir))
    return out.withColumn("agreement_pct", F.round("agreement_pct", 3)).withColumn("mean_iou", F.round("mean_iou", 4)).withColumn("median_area_diff_pct", F.round("median_area_diff_pct", 4))


@query(
    """select id, type, round(case when type = 'OUTSIDE_RECORD' then outside else second end, 3) as area_m2 from (
    select id, outside, second, case when outside / area > 0.5 then 'OUTSIDE_RECORD' when second / area >= 0.15 then 'CROSSES_RECORD' end as type from (
    select b.id, max(b.area) as area, greatest(0, max(b.area) - coalesce(sum(i), 0)) as outside, max(i) filter (where k = 2) as second
    from (select *, (x1 - x0) * (y1 - y0) as area from buildings) b left join hits using (id) group by b.id)) where type is not null""",
    hits="""select id, i, row_number() over (partition by id order by i desc, ref_id desc) as k from (
      select b.id, r.ref_id, (least(b.x1, r.x1) - greatest(b.x0, r.x0)) * (least(b.y1, r.y1) - greatest(b.y0, r.y0)) as i
      from buildings b join records r on b.x0 < r.x1 and r.x0 < b.x1 and b.y0 < r.y1 and r.y0 < b.y1)""",
)
def buildings_vs_record(spark, sf_dir):
    return c.buildings_vs_record(x.buildings(spark, sf_dir), x.records(spark, sf_dir)).select("id", "type", F.round("area_m2", 3).alias("area_m2"))


@query("select p.id, source, s.status as record_status, round(iou, 3) as record_iou from parcels p left join rec_status s using (id)", **ALL)
def annotated_parcels(spark, sf_dir):
    return c.annotated(x.parcels(spark, sf_dir), _status(spark, sf_dir)).select("id", "source", "record_status", F.round("record_iou", 3).alias("record_iou"))


NEAREST = """select point_id, type, min(sqrt((x - vx) ** 2 + (y - vy) ** 2)) as error_m from gnss join (
    select x0 as vx, y0 as vy from parcels union all select x1, y0 from parcels union all select x1, y1 from parcels union all select x0, y1 from parcels) v
    on abs(x - vx) < 5 and abs(y - vy) < 5 group by point_id, type"""


@query("select point_id, type, round(error_m, 4) as error_m from errors", errors=NEAREST)
def nearest_vertex_error(spark, sf_dir):
    return c.vertex_errors(x.gnss(spark, sf_dir), x.parcels(spark, sf_dir)).select("point_id", "type", F.round("error_m", 4).alias("error_m"))


@query(
    """select count(*) as points, count(e) as corner_points, round(avg(e), 4) as mean_m, round(sqrt(avg(e * e)), 4) as rmse_m, round(quantile_cont(e, 0.9), 4) as ce90_m,
    round(max(e), 4) as max_m, round(100 * avg((e <= 1)::int), 3) as within_pct from (select case when type = 'corner' then error_m end as e from errors)""",
    errors=NEAREST,
)
def point_accuracy(spark, sf_dir):
    out = c.point_accuracy(c.vertex_errors(x.gnss(spark, sf_dir), x.parcels(spark, sf_dir)))
    return out.select("points", "corner_points", *[F.round(k, 4).alias(k) for k in ("mean_m", "rmse_m", "ce90_m", "max_m")], F.round("within_pct", 3).alias("within_pct"))


@query(
    """select point_id, round(min(case when dx = 0 and dy = 0 then inner_ else sqrt(dx * dx + dy * dy) end), 4) as error_m from (
    select point_id, greatest(x0 - x, 0, x - x1) as dx, greatest(y0 - y, 0, y - y1) as dy, least(x - x0, x1 - x, y - y0, y1 - y) as inner_
    from gnss join parcels on x > x0 - 5 and x < x1 + 5 and y > y0 - 5 and y < y1 + 5) group by point_id"""
)
def boundary_line_error(spark, sf_dir):
    return c.outline_errors(x.gnss(spark, sf_dir), x.parcels(spark, sf_dir)).select("point_id", F.round("error_m", 4).alias("error_m"))


@query(
    """select id, round(d, 4) as distance_m from (select a.id, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) as d,
    row_number() over (partition by a.id order by sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), b.id) as k
    from centres a join centres b on abs(a.cx - b.cx) <= 30 and abs(a.cy - b.cy) <= 30) where k = 4 and d < 21.5""",
    centres="select id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from parcels",
)
def knn3_dense_cluster(spark, sf_dir):
    centres = x.parcels(spark, sf_dir).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return c.dense_cluster(centres, reach=21.5).select("id", F.round("distance_m", 4).alias("distance_m"))


@query(
    """select b.id as building_id, p.id as parcel_id from (select id, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y from buildings) b
    join parcels p on b.x >= p.x0 and b.x < p.x1 and b.y >= p.y0 and b.y < p.y1"""
)
def point_in_parcel(spark, sf_dir):
    centres = x.buildings(spark, sf_dir).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return containing(centres, x.parcels(spark, sf_dir)).select(F.col("a_id").alias("building_id"), F.col("b_id").alias("parcel_id"))


VISITS = "select obs_id, parcel_id, x0 + distance_m - 15 as vx, y0 + 5.0 as vy, x0, y0, x1, y1 from observations join parcels on id = parcel_id"


@query(
    """select obs_id, round(greatest(0, x0 - vx, vx - x1), 2) as distance_m, greatest(0, x0 - vx, vx - x1) <= 30 as on_site from visits""",
    visits=VISITS,
)
def visit_distance(spark, sf_dir):
    """Distance of each visit's position to its parcel's polygon (0 inside)."""
    p = x.parcels(spark, sf_dir)
    visits = x.observations(spark, sf_dir).drop("on_site").join(p, F.col("parcel_id") == F.col("id"))
    visits = visits.withColumn("vx", F.col("x0") + F.col("distance_m") - 15).withColumn("vy", F.col("y0") + 5)
    sent = visits.select("obs_id", "parcel_id", F.col("vx").alias("x"), F.col("vy").alias("y"))
    return c.visit_distances(sent, x.geoms(p)).select("obs_id", F.round("distance_m", 2).alias("distance_m"), "on_site")


@query(
    """select s.id, round(100 * (s.area - ref_area) / ref_area, 1) + 0 as area_diff_pct, round(greatest(abs(r.x0 - p.x0), abs(r.x1 - p.x1)), 2) as boundary_offset_m
    from rec_status s join parcels p using (id) join records r on r.ref_id = s.best where s.status = 'MATCH'""",
    **ALL,
)
def boundary_offsets(spark, sf_dir):
    """Area difference and Hausdorff distance of matched outlines."""
    good = _status(spark, sf_dir).filter("status = 'MATCH'")
    p, r = x.geoms(x.parcels(spark, sf_dir)).select("id", F.col("geom").alias("ga")), x.geoms(x.records(spark, sf_dir)).select("ref_id", F.col("geom").alias("gb"))
    both = good.join(p, "id").join(r, "ref_id")
    return both.select("id", (F.round(100 * (F.col("area") - F.col("ref_area")) / F.col("ref_area"), 1) + F.lit(0.0)).alias("area_diff_pct"), F.round(boundary_offset("ga", "gb"), 2).alias("boundary_offset_m"))


@query("select id from (select *, (x1 - x0) * 4 + 8 * (y1 - y0 - 4) as m2, (x1 - x0) * (y1 - y0) as hull from parcels) where m2 >= 20 and round(m2 / hull, 9) >= 0.75")
def plausible_fills(spark, sf_dir):
    """Horseshoes that are full enough to be a missed roof."""
    x0, y0, x1, y1 = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    ring = F.array(g.point(x0, y0), g.point(x1, y0), g.point(x1, y1), g.point(x1 - 4, y1), g.point(x1 - 4, y0 + 4), g.point(x0 + 4, y0 + 4), g.point(x0 + 4, y1), g.point(x0, y1))
    return c.plausible_fills(x.parcels(spark, sf_dir).select("id", F.array(F.array(ring)).alias("geom"))).select("id")
