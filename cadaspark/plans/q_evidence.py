"""Queries on the evidence, land use and attribute rows of parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.operators import evidence as e
from cadaspark.operators import logs, queues, report, saving, siting, topology
from cadaspark.plans import fixtures as x
from cadaspark.plans.q_rules import BR, INTER, MEET, PUBLIC, RULES
from cadaspark.plans.q_topology import KIND, PAIRS
from cadaspark.plans.q_zonal import SHARES, STATS, TOP
from cadaspark.plans.registry import query

SIZE = "(b.x1 - b.x0) * (b.y1 - b.y0)"
OWNED = f"select b.id, arg_min(p.id, (-round({INTER.format('p')}, 6), p.id)) as parcel, max({SIZE}) as size from buildings b join parcels p on {MEET.format('p')} group by b.id"
FRONT = f"select b.id, max(r.width_m) as width from parcels b join roads r on {BR} <= 1 group by b.id"
#: Square metres of a parcel under any building; corners of both layers are whole metres.
ROOFED = f"""select id, count(*)::double as roofed from (select distinct b.id, cx, cy from parcels b join buildings p on {MEET.format("p")},
  unnest(generate_series(greatest(b.x0, p.x0)::bigint, least(b.x1, p.x1)::bigint - 1)) as u(cx), unnest(generate_series(greatest(b.y0, p.y0)::bigint, least(b.y1, p.y1)::bigint - 1)) as v(cy)) group by id"""
KNOWN = """select p.id, (x1 - x0) * (y1 - y0) as area_m2, coalesce(n, 0) as buildings, coalesce(largest, 0) as largest_m2, coalesce(roofed, 0) / ((x1 - x0) * (y1 - y0)) as cover, coalesce(width, 0) as frontage_road_m, width is not null as road_frontage
  from parcels p left join (select parcel as id, count(*) as n, max(size) as largest from owned where size >= 20 group by parcel) using (id) left join roofed_parcels using (id) left join fronts using (id)"""
ON_ROAD = f"""select id, kind, ov from (select id, case when ov / size > 0.35 then 'road_conflict' when depth >= 1 then 'encroachment' end as kind, ov from (select b.id, max({SIZE}) as size, sum({INTER.format('r')}) as ov,
  arg_max(least(least(b.x1, r.x1) - greatest(b.x0, r.x0), least(b.y1, r.y1) - greatest(b.y0, r.y0)), {INTER.format('r')}) as depth from buildings b join roads r on {MEET.format('r')} group by b.id) where ov >= 4) where kind is not null"""
TAKEN = "select parcel as id, round(sum(ov), 1) as taken from on_road join owned using (id) where kind = 'encroachment' group by parcel"
USES = """select *, case when water >= 0.5 then 'Water body|water covers most of the plot' when buildings = 0 and green_share >= 0.5 then 'Open space / green|no building; ' || round_even(100 * green_share, 0)::bigint || '% trees, grass or farmland'
    when buildings = 0 then 'Vacant plot|no building on the plot' when largest_m2 >= 1500 then 'Institutional / large complex|a ' || round_even(largest_m2, 0)::bigint || ' m² building'
    when area_m2 >= 3000 then 'Institutional / large complex|a ' || round_even(area_m2, 0)::bigint || ' m² plot' when storeys >= 4 and largest_m2 >= 300 then 'Residential - apartments|' || storeys || ' storeys, ' || round_even(largest_m2, 0)::bigint || ' m² footprint'
    when frontage_road_m >= 12 and cover >= 0.7 then 'Commercial / mixed use|on a ' || round_even(frontage_road_m, 0)::bigint || ' m road, ' || built_over
    else 'Residential|' || buildings || ' house' || case when buildings > 1 then 's' else '' end || ', ' || built_over || case when storeys is not null then ', ' || storeys || ' storey' || case when storeys > 1 then 's' else '' end else '' end end as use_reason
  from (select *, round_even(100 * cover, 0)::bigint || '% built over' as built_over, case when height_m > 1.5 then round_even(height_m / 3, 0)::int end as storeys from known left join zstats s on s.zone = known.id
    left join (select zone, coalesce(sum(n / t) filter (where name = 'water'), 0) as water, coalesce(sum(n / t) filter (where name = 'tree'), 0) + coalesce(sum(n / t) filter (where name = 'grass / scrub'), 0) + coalesce(sum(n / t) filter (where name = 'agriculture'), 0) as green_share from shares group by zone) w on w.zone = known.id)"""
V = {"owned": OWNED, "fronts": FRONT, "roofed_parcels": ROOFED, "known": KNOWN, "zstats": STATS, "shares": SHARES, "top_cover": TOP, "on_road": ON_ROAD, "taken_land": TAKEN, "uses": USES}


@query("select id, area_m2, buildings, largest_m2, round(cover, 5) as cover, frontage_road_m, road_frontage from known", **V)
def parcel_evidence(spark, sf_dir):
    out = e.parcel_evidence(x.parcels(spark, sf_dir), x.buildings(spark, sf_dir), x.roads(spark, sf_dir))
    return out.withColumn("cover", F.round("cover", 5))


@query("select id, taken as encroachment_m2 from taken_land", **V)
def parcel_encroachment(spark, sf_dir):
    """What the buildings of a parcel take of roads."""
    return e.encroachment(x.parcels(spark, sf_dir), x.buildings(spark, sf_dir), x.roads(spark, sf_dir))


def _rows(spark, sf_dir):
    return e.attribute_rows(x.parcels(spark, sf_dir), x.buildings(spark, sf_dir), x.roads(spark, sf_dir), x.pixels(spark, sf_dir))


@query(
    """select u.id, round(u.area_m2, 1) as area_m2, round(100 * coalesce(built / cells, 0), 1) as built_pct, round(100 * coalesce(green_share, 0), 1) as veg_pct, road_frontage, buildings, round(100 * cover, 1) as building_cover_pct,
    round(frontage_road_m, 1) as frontage_road_m, case when storeys is not null then round(height_m, 1) end as height_m, coalesce(storeys, 0) as storeys, split_part(use_reason, '|', 1) as land_use, split_part(use_reason, '|', 2) as land_use_reason,
    case when coalesce(built / cells, 0) >= 0.35 then 'Built-up' when top is null or top_share < 0.2 then 'Open / vacant land' when top = 'bare land' then 'Barren land' when top in ('grass / scrub', 'tree', 'agriculture') then 'Vegetated open land'
      when top = 'water' then 'Water' else 'Paved / developed open land' end as landcover, taken as encroachment_m2, case when taken is not null then 'building extends ' || taken || ' m² onto the road (possible encroachment)' else '' end as notes
    from uses u left join top_cover c on c.zone = u.id left join taken_land using (id)""",
    **V,
)
def parcel_attributes(spark, sf_dir):
    """All attributes of a parcel: evidence, land use with its reason, land cover, encroachment and notes."""
    return _rows(spark, sf_dir).drop("land_cover_pct").withColumn("notes", F.array_join("notes", "; ")).withColumn("storeys", F.coalesce("storeys", F.lit(0)))


@query(
    """select (select count(*) from uses) as parcels, (select count(*) from buildings) as buildings, (select count(*) from on_road where kind = 'encroachment') as encroachments, (select count(*) from on_road where kind = 'road_conflict') as road_building_conflicts, """
    + ", ".join(f"(select count(*) from uses where split_part(use_reason, '|', 1) = '{u}') as u{i}" for i, u in enumerate(e.LAND_USES)),
    **V,
)
def survey_stats(spark, sf_dir):
    """Totals of a survey as one row, every land use with its count."""
    out = e.survey_stats(_rows(spark, sf_dir), x.buildings(spark, sf_dir), x.roads(spark, sf_dir))
    return out.select("parcels", "buildings", "encroachments", "road_building_conflicts", *[F.element_at("land_use_count", F.lit(u)).alias(f"u{i}") for i, u in enumerate(e.LAND_USES)])


def _alerts(spark, sf_dir):
    return siting.alerts(x.buildings(spark, sf_dir), x.setback_lines(spark, sf_dir), x.government(spark, sf_dir), x.roads(spark, sf_dir))


@query("select id, n, row_number() over (order by n desc, id) as rank from (select b.id, count(type) as n from buildings b left join rule_hits h on b.id = h.id group by b.id) order by n desc, id limit 8", on_public=PUBLIC, rule_hits=RULES)
def verification_queue(spark, sf_dir):
    """The buildings with the most alerts, a top-k report."""
    return queues.most_alerts(_alerts(spark, sf_dir)).select("id", F.size("alerts").cast("bigint").alias("n"), "rank")


@query("select b.id, count(type) as alerts, coalesce(string_agg(type, ',' order by case type when 'RAIL_BUFFER' then 1 when 'WATER_BUFFER' then 2 when 'GOVT_ENCROACH' then 3 else 4 end), '') as note_lines from buildings b left join rule_hits h on b.id = h.id group by b.id", on_public=PUBLIC, rule_hits=RULES)
def baked_alerts(spark, sf_dir):
    """Alerts and verification notes written into the rows of the building layer."""
    out = saving.baked(x.buildings(spark, sf_dir), _alerts(spark, sf_dir))
    kinds = F.array_join(F.transform(F.filter(F.split("note", "\n"), lambda v: v != ""), lambda v: F.regexp_extract(v, r"^\d+\. ([A-Z_]+):", 1)), ",")
    return out.select("id", F.size("alerts").cast("bigint").alias("alerts"), kinds.alias("note_lines"))


TOP_ROADS = "select id, round(ov, 1) as m2 from on_road where kind = 'encroachment' order by ov desc, id limit 12"
OVER = f"select a_id, b_id, {KIND} as type from pairs order by type, [a_id, b_id]::varchar limit 15"
CELLS = "select class::varchar as kind, count(*) / sum(count(*)) over ()::double as share from pixels group by class"


@query(
    """select (select count(*) from parcels) as parcels, (select count(*) from buildings) as buildings, (select round(sum(x1 - x0), 0) from roads) as road_m, (select round(sum((x1 - x0) * (y1 - y0)) / 1e6, 3) from parcels) as area_km2,
    (select count(*) from pairs) as topology_problems, (select count(*) from on_road where kind = 'encroachment') as encroachments, (select round(100.0 * count(*) filter (where status <> 'draft') / count(*), 0) from parcels) as reviewed_pct,
    (select string_agg(u || '=' || n, ';' order by k) from (select use_of as u, count(*) as n, min(k) as k from (select split_part(use_reason, '|', 1) as use_of from uses) join (select unnest({uses}) as use_of, unnest(generate_series(1, {n})) as k) using (use_of) group by use_of)) as land_use,
    (select string_agg(kind || '=' || round(share, 4), ';' order by share desc, kind) from cells_of where share >= 0.005) as land_cover,
    (select string_agg(c || '=' || round(coalesce(m, 0), 1), ';' order by k) from (select unnest(['lane', 'street', 'main road']) as c, unnest([1, 2, 3]) as k) left join (select case when width_m < 3 then 'lane' when width_m < 8 then 'street' else 'main road' end as c, sum(x1 - x0) as m from roads group by 1) using (c)) as roads,
    coalesce((select string_agg(id || '=' || m2, ';' order by m2 desc, id) from top_roads), '') as largest, coalesce((select string_agg(type || [a_id, b_id]::varchar, ';' order by type, [a_id, b_id]::varchar) from over_), '') as issues,
    (select string_agg(status || '=' || n, ';' order by status) from (select status, count(*) as n from parcels group by status)) as review""".replace("{uses}", repr(list(e.LAND_USES))).replace("{n}", str(len(e.LAND_USES))),
    **V,
    pairs=PAIRS.replace("dirty_all", "parcels"),
    top_roads=TOP_ROADS,
    over_=OVER,
    cells_of=CELLS,
)
def report_tables(spark, sf_dir):
    """A survey's report as one nested row, its tables shown as text."""
    parcels, buildings, roads = x.parcels(spark, sf_dir), x.buildings(spark, sf_dir), x.roads(spark, sf_dir)
    rows = _rows(spark, sf_dir).select("id", "area_m2", "land_use").join(parcels.select("id", "status"), "id")
    issues = topology.overlap_pairs(parcels).select("type", F.array("a_id", "b_id").alias("parcel_ids"))
    segments = roads.select("width_m", (F.col("x1") - F.col("x0")).alias("length_m"))
    out = report.survey_report(rows, buildings, siting.road_encroachment(buildings, roads), issues, segments, x.pixels(spark, sf_dir))
    text = lambda column, show: F.array_join(F.transform(column, show), ";")
    pair = lambda a, b: F.concat(a, F.lit("="), b.cast("string"))
    review = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"review.{s}").alias("n")) for s in sorted(logs.STATUSES)])
    return out.select(
        *[F.col(f"kpis.{k}").alias(k) for k in ("parcels", "buildings", "road_m", "area_km2", "topology_problems", "encroachments", "reviewed_pct")],
        text("land_use", lambda u: pair(u["use"], u["parcels"])).alias("land_use"), text("land_cover", lambda c: pair(c["kind"], F.round(c["share"], 4))).alias("land_cover"),
        text("roads", lambda r: pair(r["class"], r["length_m"])).alias("roads"), text("encroachments", lambda b: pair(b["id"].cast("string"), b["area_m2"])).alias("largest"),
        text("issues", lambda i: F.concat(i["type"], i["parcel_ids"].cast("string"))).alias("issues"), text(F.filter(review, lambda r: r["n"] > 0), lambda r: pair(r["s"], r["n"])).alias("review"),
    )


@query(
    """select (select count(*) from uses) as parcels, (select count(*) from on_road where kind = 'encroachment') as encroachments, (select sum(x1 - x0) from roads) as length_m, (select median(width_m) from roads) as median_width_m,
    (select coalesce(sum(x1 - x0) filter (where width_m < 3), 0) from roads) as narrow_m, (select string_agg(kind || '=' || round(share, 3), ';' order by kind) from cells_of) as class_fraction, 0.5::double as area_km2""",
    **V,
    cells_of=CELLS,
)
def survey_statistics(spark, sf_dir):
    """A survey's statistics with road lengths and shares of classes."""
    buildings, roads = x.buildings(spark, sf_dir), x.roads(spark, sf_dir)
    segments = roads.select("width_m", (F.col("x1") - F.col("x0")).alias("length_m"))
    out = report.survey_statistics(_rows(spark, sf_dir), buildings, siting.road_encroachment(buildings, roads), segments, x.pixels(spark, sf_dir), 500_000.0)
    shares = F.array_join(F.transform(F.array_sort(F.map_entries("class_fraction")), lambda f: F.concat(f["key"], F.lit("="), f["value"].cast("string"))), ";")
    return out.select("parcels", "encroachments", "length_m", "median_width_m", "narrow_m", shares.alias("class_fraction"), "area_km2")
