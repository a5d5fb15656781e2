"""Streaming queries: run over all available input and equal to the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.operators.comparison import visit_distances
from cadaspark.plans import fixtures as x
from cadaspark.plans.q_comparison import NEAREST, VISITS
from cadaspark.plans.registry import query
from cadaspark.streaming import visits as v

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf_dir):
    return x.as_observations(v.source(spark, f"{sf_dir}/events.parquet*", EVENTS))


LATEST = """select parcel_id, verdict as field_verdict, case verdict when 'confirmed' then 'approved' when 'not_a_parcel' then 'rejected' else 'field_check' end as status from observations qualify row_number() over (partition by parcel_id order by time desc, obs_id desc) = 1"""


@query(LATEST)
def stream_latest_status(spark, sf_dir):
    return v.newest(v.run(v.latest_status(_stream(spark, sf_dir)), "latest", "update"), "parcel_id")


@query("select obs_id, parcel_id, verdict from observations")
def stream_dedup(spark, sf_dir):
    """Every visit is sent twice and comes out once."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return v.run(v.without_repeats(twice).select("obs_id", "parcel_id", "verdict"), "dedup")


@query("select date_trunc('hour', time) as start, verdict, count(*) as visits from observations group by all")
def stream_verdict_windows(spark, sf_dir):
    return v.newest(v.run(v.verdict_windows(_stream(spark, sf_dir)), "windows", "update"), "start", "verdict")


@query(
    """select w as start, round(avg(on_site::int), 5) as share from (select on_site, unnest([time_bucket(interval 30 minute, time), time_bucket(interval 30 minute, time) - interval 30 minute]) as w from observations) group by w"""
)
def stream_on_site_share(spark, sf_dir):
    out = v.newest(v.run(v.on_site_share(_stream(spark, sf_dir)), "share", "update"), "start")
    return out.withColumn("share", F.round("share", 5))


@query(
    """select parcel_id, min(time) as start, max(time) + interval 2 hour as end, count(*) as visits from (select *, sum(new) over (partition by parcel_id order by time, obs_id) as k from (
    select *, case when time - lag(time) over (partition by parcel_id order by time, obs_id) < interval 2 hour then 0 else 1 end as new from observations)) group by parcel_id, k"""
)
def stream_sessions(spark, sf_dir):
    return v.run(v.sessions(_stream(spark, sf_dir)), "sessions", "complete").drop("batch", "n")


@query("select obs_id, parcel_id, status as parcel_status, on_site from observations left join parcels on id = parcel_id")
def stream_enriched(spark, sf_dir):
    out = v.enriched(_stream(spark, sf_dir), x.parcels(spark, sf_dir))
    return v.run(out.select("obs_id", "parcel_id", "parcel_status", "on_site"), "enriched")


@query("select obs_id, round(greatest(0, x0 - vx, vx - x1), 2) as distance_m, greatest(0, x0 - vx, vx - x1) <= 30 as on_site from visits", visits=VISITS)
def stream_visit_distance(spark, sf_dir):
    """A stream's visits with their distance to the parcel, by a join with the layer."""
    p = x.parcels(spark, sf_dir)
    at = p.select(F.col("id").alias("parcel_id"), "x0", "y0")
    sent = _stream(spark, sf_dir).drop("on_site").join(at, "parcel_id").select("obs_id", "parcel_id", (F.col("x0") + F.col("distance_m") - 15).alias("x"), (F.col("y0") + 5).alias("y"))
    out = visit_distances(sent, x.geoms(p)).select("obs_id", F.round("distance_m", 2).alias("distance_m"), "on_site")
    return v.run(out, "distances")


@query("select date_trunc('day', t) as start, count(*) as edits from edits group by 1")
def stream_edit_windows(spark, sf_dir):
    e = v.source(spark, f"{sf_dir}/events.parquet*", EVENTS).select(F.col("ts").alias("t"))
    return v.newest(v.run(v.edit_windows(e), "edits", "update"), "start")


@query(
    """select count(*) as points, count(e) as corner_points, round(avg(e), 4) as mean_m, round(sqrt(avg(e * e)), 4) as rmse_m, round(quantile_cont(e, 0.9), 4) as ce90_m,
    round(max(e), 4) as max_m, round(100 * avg((e <= 1)::int), 3) as within_pct from (select case when type = 'corner' then error_m end as e from errors)""",
    errors=NEAREST,
)
def stream_corner_accuracy(spark, sf_dir):
    """Accuracy after the last corner that a stream recorded."""
    orders = v.source(spark, f"{sf_dir}/orders.parquet*", spark.read.parquet(f"{sf_dir}/orders.parquet").schema)
    out = v.running_accuracy(x.as_gnss(spark, sf_dir, orders), x.parcels(spark, sf_dir))
    last = out.agg(F.max("batch").alias("batch"))
    out = out.join(F.broadcast(last), "batch")  # one row
    return out.select("points", "corner_points", *[F.round(k, 4).alias(k) for k in ("mean_m", "rmse_m", "ce90_m", "max_m")], F.round("within_pct", 3).alias("within_pct"))
