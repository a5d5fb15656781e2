"""Queries on siting rules and land use from zoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_area
from cadaspark.operators import comparison, siting
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query

DIST = "sqrt(greatest(0, {b}.x0 - {a}.x1, {a}.x0 - {b}.x1) ** 2 + greatest(0, {b}.y0 - {a}.y1, {a}.y0 - {b}.y1) ** 2)"
BR, BL = DIST.format(a="b", b="r"), DIST.format(a="b", b="l")
INTER = "(least(b.x1, {0}.x1) - greatest(b.x0, {0}.x0)) * (least(b.y1, {0}.y1) - greatest(b.y0, {0}.y0))"
MEET = "b.x0 < {0}.x1 and {0}.x0 < b.x1 and b.y0 < {0}.y1 and {0}.y0 < b.y1"

#: Square metres of a building on any government land; corners of both layers are whole metres.
PUBLIC = f"""select id, count(*)::double as area_m2 from (select distinct b.id, cx, cy from buildings b join government g on {MEET.format("g")},
  unnest(generate_series(greatest(b.x0, g.x0)::bigint, least(b.x1, g.x1)::bigint - 1)) as u(cx), unnest(generate_series(greatest(b.y0, g.y0)::bigint, least(b.y1, g.y1)::bigint - 1)) as v(cy)) group by id"""
RULES = f"""
  select b.id, case kind when 'rail' then 'RAIL_BUFFER' else 'WATER_BUFFER' end as type from buildings b join setback_lines l on {BL} <= case kind when 'rail' then 30 else 15 end group by all
  union all select id, 'GOVT_ENCROACH' from on_public where area_m2 > 1
  union all select b.id, 'NO_ROAD' from buildings b join roads r on true group by b.id having min({BR}) > 200"""


@query("select id, string_agg(type, ',' order by type) as alerts from rule_hits group by id", on_public=PUBLIC, rule_hits=RULES)
def setback_alerts(spark, sf_dir):
    out = siting.alerts(x.buildings(spark, sf_dir), x.setback_lines(spark, sf_dir), x.government(spark, sf_dir), x.roads(spark, sf_dir))
    return out.filter(F.size("alerts") > 0).select("id", F.array_join(F.array_sort(F.transform("alerts", lambda a: a["type"])), ",").alias("alerts"))


@query("select count(*) as buildings, (select count(distinct id) from rule_hits) as flagged from buildings", on_public=PUBLIC, rule_hits=RULES)
def alert_summary(spark, sf_dir):
    out = siting.alerts(x.buildings(spark, sf_dir), x.setback_lines(spark, sf_dir), x.government(spark, sf_dir), x.roads(spark, sf_dir))
    return out.agg(F.count("*").alias("buildings"), F.count_if(F.size("alerts") > 0).alias("flagged"))


@query("select id from rule_hits where type = 'NO_ROAD'", on_public=PUBLIC, rule_hits=RULES)
def no_road_access(spark, sf_dir):
    return siting.without_road(x.buildings(spark, sf_dir), x.roads(spark, sf_dir)).select("id")


@query("select id, round(area_m2, 3) as area_m2 from on_public where area_m2 > 1", on_public=PUBLIC)
def government_overlap(spark, sf_dir):
    return siting.government_overlap(x.buildings(spark, sf_dir), x.government(spark, sf_dir)).select("id", F.round("area_m2", 3).alias("area_m2"))


@query(
    """select id, case when ov / area > 0.35 then 'road_conflict' else 'encroachment' end as kind, round(ov, 3) as overlap_m2, round(depth, 3) as depth_m
    from on_road where ov >= 4 and (ov / area > 0.35 or depth >= 1)""",
    on_road=f"""select b.id, max((b.x1 - b.x0) * (b.y1 - b.y0)) as area, sum({INTER.format('r')}) as ov,
    arg_max(least(least(b.x1, r.x1) - greatest(b.x0, r.x0), least(b.y1, r.y1) - greatest(b.y0, r.y0)), {INTER.format('r')}) as depth
    from buildings b join roads r on {MEET.format('r')} group by b.id""",
)
def road_encroachment(spark, sf_dir):
    out = siting.road_encroachment(x.buildings(spark, sf_dir), x.roads(spark, sf_dir))
    return out.select("id", "kind", F.round("overlap_m2", 3).alias("overlap_m2"), F.round("depth_m", 3).alias("depth_m"))


@query(
    f"""select b.id, case when g.id is not null then 'Government'
      when ov > 0.3 * area and not (label = 'Residential' and k.id is null) then label
      when ov > 0.3 * area or k.id is null then 'Vacant / Unclassified' else 'Residential' end as landuse
    from (select *, (x1 - x0) * (y1 - y0) as area from parcels) b
    left join (select b.id, arg_max(z.label, {INTER.format('z')} * 1e6 - z.id) as label, max({INTER.format('z')}) as ov from parcels b join zones z on {MEET.format('z')} group by b.id) z on b.id = z.id
    left join (select distinct b.id from parcels b join government g on b.x0 <= g.x1 and g.x0 <= b.x1 and b.y0 <= g.y1 and g.y0 <= b.y1) g on b.id = g.id
    left join (select distinct b.id from parcels b join buildings k on {MEET.format('k')}) k on b.id = k.id"""
)
def landuse_zone(spark, sf_dir):
    return siting.zoned_land_use(x.parcels(spark, sf_dir), x.zones(spark, sf_dir), x.government(spark, sf_dir), x.buildings(spark, sf_dir))


#: Record parcels may overlap, so tenths of a square metre are counted once; corners are tenths along x and whole along y.
UNRECORDED = f"""select id, n / 10 / area as share, round(n / 10 / area, 9) < 0.15 as unrecorded from (select b.id, (b.x1 - b.x0) * (b.y1 - b.y0) as area, coalesce(n, 0) as n from buildings b
    left join (select id, count(*) as n from (select distinct b.id, cx, cy from buildings b join records r on {MEET.format('r')},
      unnest(generate_series(round(10 * greatest(b.x0, r.x0))::bigint, round(10 * least(b.x1, r.x1))::bigint - 1)) as u(cx),
      unnest(generate_series(greatest(b.y0, r.y0)::bigint, least(b.y1, r.y1)::bigint - 1)) as v(cy)) group by id) i on b.id = i.id)"""


@query("select id, round(share, 4) as share, unrecorded from new_buildings", new_buildings=UNRECORDED)
def unrecorded_buildings(spark, sf_dir):
    return comparison.unrecorded(x.buildings(spark, sf_dir), x.records(spark, sf_dir)).select("id", F.round("share", 4).alias("share"), "unrecorded")


MOVED = "select id, x0 + 6 as x0, y0, x1 + 6 as x1, y1 from parcels"


@query(
    """select 'a' as source, id::varchar as id, (x1 - x0) * (y1 - y0) as area_m2 from parcels union all
    select 'b', id::varchar, count(*) / 4 from (select id, cx, cy from moved, unnest(generate_series((2 * x0)::bigint, (2 * x1)::bigint - 1)) as u(cx), unnest(generate_series((2 * y0)::bigint, (2 * y1)::bigint - 1)) as v(cy))
    anti join (select distinct cx, cy from parcels, unnest(generate_series((2 * x0)::bigint - 1, (2 * x1)::bigint)) as u(cx), unnest(generate_series((2 * y0)::bigint - 1, (2 * y1)::bigint)) as v(cy)) using (cx, cy)
    group by id having count(*) / 4 >= 12""",
    moved=MOVED,
)
def source_merge(spark, sf_dir):
    """Parcels, and what they leave of the same boxes six metres farther east."""
    p = x.parcels(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")
    return siting.merged_sources(p, p.withColumn("x0", F.col("x0") + 6).withColumn("x1", F.col("x1") + 6)).select("source", "id", "area_m2")


@query(
    """select g.id as hole_id, b.id from government g join buildings b on b.x0 >= g.x0 - 0.05 and b.y0 >= g.y0 - 0.05 and b.x1 <= g.x1 + 0.05 and b.y1 <= g.y1 + 0.05"""
)
def hole_containment(spark, sf_dir):
    return siting.hole_contents(x.buildings(spark, sf_dir), x.government(spark, sf_dir))


@query(
    f"""select b.id, arg_min(r.width_m, {BR} * 1e6 + r.id) as width_m, round(min({BR}), 3) as distance from buildings b join roads r on true group by b.id"""
)
def nearest_road_width(spark, sf_dir):
    out = siting.nearest_attribute(x.buildings(spark, sf_dir), x.roads(spark, sf_dir), "width_m")
    return out.select("id", "width_m", F.round("distance", 3).alias("distance"))


SEGMENTS = "select p_partkey as id, 1 + p_size % 10 as width_m, p_size as length_m from part"


@query(
    """select case when width_m < 3 then 'lane' when width_m < 8 then 'street' else 'main road' end as class, count(*) as roads, sum(length_m)::bigint as length_m, median(width_m) as median_width_m,
    sum(case when width_m < 3 then length_m else 0 end)::bigint as narrow_m from segments group by 1""",
    segments=SEGMENTS,
)
def road_length_by_class(spark, sf_dir):
    """Road segments by class of width, with the length of narrow lanes."""
    size = F.col("p_size")
    segments = x.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1 + size % 10).alias("width_m"), size.alias("length_m"))
    return siting.lengths_by_class(segments)


@query("select label, count(*) as zones, sum((x1 - x0) * (y1 - y0)) as area_m2 from zones group by label")
def land_use_mix(spark, sf_dir):
    """Counts over the whole domain of labels, zeros included."""
    zones = x.zones(spark, sf_dir).groupBy("label").agg(F.count("*").alias("zones"), F.sum(box_area()).alias("area_m2"))
    domain = x.zones(spark, sf_dir).select(F.explode(F.array(*map(F.lit, x.ZONES))).alias("label")).distinct()
    return domain.join(zones, "label", "left").fillna(0)
