"""Queries on sources, sinks, identifiers and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaspark.functions import geometry as g
from cadaspark.functions import kernels
from cadaspark.functions import projection as p
from cadaspark.functions.rules import band
from cadaspark.operators import numbering, zonal
from cadaspark.plans import fixtures as x
from cadaspark.plans.registry import query
from cadaspark.sources import layers


@query("select id, row_number() over (order by -(y0 + y1) / 2, (x0 + x1) / 2, id) as number, 'S1-' || lpad(row_number() over (order by -(y0 + y1) / 2, (x0 + x1) / 2, id)::varchar, 4, '0') as pin from parcels")
def parcel_numbering(spark, sf_dir):
    """Numbers from north to south, then west to east, with provisional PINs."""
    df = x.parcels(spark, sf_dir).withColumn("survey_id", F.lit("s1")).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    out = numbering.ranked(df, "survey_id", [-F.col("cy"), F.col("cx"), F.col("id")], "number", -F.floor(F.col("cy") / 200))
    return out.select("id", "number", numbering.provisional_pin(F.col("survey_id"), F.col("number")).alias("pin"))


@query("select id, case when id % 3 = 0 then 'draft' else status end as status, case when id % 5 = 0 then 'manual' else source end as source from parcels")
def defaults_filled(spark, sf_dir):
    df = x.parcels(spark, sf_dir).withColumn("status", F.when(F.col("id") % 3 == 0, "odd").otherwise(F.col("status"))).withColumn("source", F.when(F.col("id") % 5 != 0, F.col("source")))
    return numbering.with_defaults(df, x.STATUSES).select("id", "status", "source")


@query("select case when id % 40 = 0 then (select max(id) from parcels) + row_number() over (partition by id % 40 = 0 order by id) else id end as new_id, confidence from parcels")
def new_ids(spark, sf_dir):
    out = numbering.with_new_ids(x.parcels(spark, sf_dir).select("id", "confidence"), "id % 40 = 0")
    return out.select(F.col("id").alias("new_id"), "confidence")


@query(
    """select id as parcel_id, status, source, confidence, round((x1 - x0) * (y1 - y0), 1) as area_m2, round(2 * (x1 - x0 + y1 - y0), 1) as perim_m, case when id % 2 = 0 then 'HOLE,OVERLAP' else '' end as issues,
    null::varchar as prov_pin, null::varchar as landcover, null::varchar as land_use, null::varchar as lu_reason, null::varchar as built_pct, null::varchar as road_front, null::varchar as front_road,
    null::varchar as n_bldg, null::varchar as storeys, null::varchar as encroach, null::varchar as rec_status, null::varchar as rec_iou, null::varchar as rec_ref, """
    + ", ".join(f"case when zone is not null then coalesce(c{k}, 0.0::double) end as {name}" for k, name in ((8, "lc_bldg"), (4, "lc_road"), (3, "lc_paved"), (5, "lc_tree"), (2, "lc_grass"), (7, "lc_farm"), (1, "lc_bare"), (6, "lc_water")))
    + " from parcels left join cover_pct on id = zone",
    cover_pct="select zone, " + ", ".join(f"case when round(100 * c{k} / n, 1) >= 1 then round(100 * c{k} / n, 1) end as c{k}" for k in range(1, 9)) + " from (select zone, count(*)::double as n, " + ", ".join(f"count(*) filter (where class = {k}) as c{k}" for k in range(1, 9)) + " from pixels group by zone)",
)
def export_schema(spark, sf_dir):
    """All parcels as an export gives them, with the shares of their land-cover classes."""
    df = x.geoms(x.parcels(spark, sf_dir)).join(zonal.cover_shares(x.pixels(spark, sf_dir)).select(F.col("zone").alias("id"), F.col("percent").alias("land_cover_pct")), "id", "left")
    df = df.withColumn("area_m2", F.round(g.area(F.col("geom")), 1)).withColumn("perimeter_m", F.round(g.perimeter(F.col("geom")), 1)).withColumn("issues", F.when(F.col("id") % 2 == 0, F.array(F.lit("HOLE"), F.lit("OVERLAP"))).otherwise(F.array().cast("array<string>")))
    return layers.export_columns(df).drop("geom")


@query("select id, (x1 - x0) * (y1 - y0) as area_m2, 4 as corners from parcels")
def geojson_round_trip(spark, sf_dir):
    """Features as GeoJSON text, parsed back."""
    df = x.geoms(x.parcels(spark, sf_dir))
    text = df.select(layers.to_feature(F.create_map(F.lit("id"), F.col("id").cast("string")), F.col("geom")).alias("json"))
    rows = text.select(F.from_json("json", "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>").alias("f")).select("f.*")
    out = layers.parsed(rows)
    return out.select(F.col("attrs")["id"].cast("bigint").alias("id"), g.area(F.col("geom")).alias("area_m2"), (F.size(F.flatten(F.flatten("geom"))) - 1).alias("corners"))


RECORDS = "select id, id % 7 = 0 as empty, id % 211 = 0 as bow, x0, y0, x1, y1 from parcels"


@query("select count(*) as read, count(*) filter (where not empty and x0 <= 500 and y0 <= 400 and y1 >= 0) as used, count(*) - count(*) filter (where not empty and x0 <= 500 and y0 <= 400 and y1 >= 0) as skipped from recs", recs=RECORDS)
def record_import_report(spark, sf_dir):
    """Records of boxes, bow-ties, multipolygons with a part far away and empty geometries."""
    i, corner = F.col("id"), lambda k: F.col("geom")[0][0][k]
    crossed = F.array(F.array(F.array(corner(0), corner(2), corner(1), corner(3))))
    far = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: g.point(v["x"] + 1e6, v["y"]))))
    shape = F.when(i % 7 == 0, None).when(i % 211 == 0, crossed).when(i % 13 == 0, F.concat("geom", far)).otherwise(F.col("geom"))
    df = x.geoms(x.parcels(spark, sf_dir)).select(i.alias("row"), F.create_map(F.lit("khasra"), i.cast("string")).alias("attrs"), shape.alias("geom"))
    return layers.import_report(df, layers.import_records(df, (0.0, 0.0, 500.0, 400.0), "khasra"))


@query(
    """select o_orderkey::varchar as point_id, lower(o_orderstatus) as type, 20 + o_custkey / 1000 as lat, 78 + o_orderkey / 10000 as lon, case when o_orderkey % 4 <> 0 then round(o_custkey % 7 / 2, 1) end as accuracy_m
    from orders where o_orderkey % 11 <> 0"""
)
def gnss_import(spark, sf_dir):
    """Points with free headers; rows without a readable position are skipped."""
    o = x.table(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("row"), F.col("o_orderkey").cast("string").alias("Point"), F.col("o_orderstatus").alias("Code"),
        F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise((20 + F.col("o_custkey") / 1000).cast("string")).alias("Latitude"), (78 + F.col("o_orderkey") / 10000).cast("string").alias("LNG"),
        F.when(F.col("o_orderkey") % 4 == 0, "?").otherwise((F.col("o_custkey") % 7 / 2).cast("string")).alias("Sigma"), F.lit("9").alias("pt_no"),
    )
    return layers.import_points(raw, "row")


@query(
    """select layer, shape, count(*) as elements, count(distinct n) as sizes, round(sum(x0), 3) as west from (select *, 78 + i % 50 * 20 / 1e5 as x0, case when closed and shape = 'polygon' then 4 when shape = 'point' then 1 when closed then 5 else 3 end as n from (
      select i, i % 3 <> 1 as closed, unnest([
        case when k = 0 and i % 3 <> 1 then 'buildings polygon' end, case when k in (0, 4) and i % 3 <> 1 then 'government polygon' end, case when k = 5 then 'government point' end,
        case when k = 1 then 'roads line' end, case when k = 2 then 'railway line' end, case when k = 3 then case when i % 3 <> 1 then 'waterway polygon' else 'waterway line' end end,
        case when k in (6, 7) and i % 3 <> 1 then 'landuse polygon' end]) as f, split_part(f, ' ', 1) as layer, split_part(f, ' ', 2) as shape
      from (select p_partkey as i, p_partkey % 9 as k from part)) where f is not null) group by layer, shape"""
)
def osm_layers(spark, sf_dir):
    """Map elements, one a part: closed ways round a parcel's place, open ones along two sides, and nodes."""
    i = F.col("p_partkey")
    tags = (
        {"building": "yes", "amenity": "school"}, {"highway": "residential"}, {"railway": "rail"}, {"natural": "water"}, {"amenity": "community_centre"},
        {"amenity": "townhall"}, {"landuse": "farmland"}, {"natural": "scrub"}, {"amenity": "hospital", "railway": "tram"},
    )
    tag = F.element_at(F.array(*[F.create_map(*[F.lit(v) for kv in t.items() for v in kv]) for t in tags]), (i % len(tags) + 1).cast("int"))
    x0, y0 = 78 + i % 50 * 20 / 1e5, 20 + F.floor(i / 50) * 20 / 1e5
    at = lambda a, b: F.struct((y0 + b * 12 / 1e5).cast("double").alias("lat"), (x0 + a * 12 / 1e5).cast("double").alias("lon"))
    node = i % 9 == 5
    ring = F.when(i % 3 != 1, F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))).otherwise(F.array(at(0, 0), at(1, 0), at(1, 1)))
    rows = x.table(spark, sf_dir, "part").select(F.when(node, "node").otherwise("way").alias("type"), i.alias("id"), tag.alias("tags"), F.when(~node, ring).alias("geometry"), F.when(node, y0.cast("double")).alias("lat"), F.when(node, x0.cast("double")).alias("lon"))
    out = layers.osm_layers(rows).withColumn("v", layers.element_shape())
    return out.groupBy("layer", "shape").agg(F.count("*").alias("elements"), F.countDistinct(F.size("v")).alias("sizes"), F.round(F.sum(F.array_min(F.transform("v", lambda v: v["x"]))), 3).alias("west"))


@query("select o_orderkey as id, (floor((lon + 180) / 6) + 1)::int as zone, (case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1)::int as epsg from places_", places_="select o_orderkey, o_custkey % 360 - 180 as lon, o_orderkey % 160 - 80 as lat from orders")
def utm_zone(spark, sf_dir):
    o = x.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 360 - 180).alias("lon"), (F.col("o_orderkey") % 160 - 80).alias("lat"))
    return o.select("id", p.utm_zone(F.col("lon")).alias("zone"), p.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


@query(
    """select o_orderkey as id, floor((lon + 180) / 360 * 65536)::int as tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536)::int as ty
    from (select o_orderkey, o_custkey % 360 - 180 + 0.123 as lon, o_orderkey % 160 - 80 + 0.377 as lat from orders)"""
)
def slippy_tile(spark, sf_dir):
    o = x.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 360 - 180 + 0.123).alias("lon"), (F.col("o_orderkey") % 160 - 80 + 0.377).alias("lat"))
    t = p.tile_of(F.col("lon"), F.col("lat"), 16)
    return o.select("id", t["x"].alias("tx"), t["y"].alias("ty"))


@query(
    """select o_orderkey as id, round(2 * 6371000 * asin(sqrt(sin(radians(lat - 20) / 2) ** 2 + cos(radians(20)) * cos(radians(lat)) * sin(radians(lon - 78) / 2) ** 2)), 2) as metres
    from (select o_orderkey, 78 + o_custkey % 100 / 1000 as lon, 20 + o_orderkey % 90 / 1000 as lat from orders)"""
)
def haversine(spark, sf_dir):
    o = x.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (78 + F.col("o_custkey") % 100 / 1000).alias("lon"), (20 + F.col("o_orderkey") % 90 / 1000).alias("lat"))
    return o.select("id", F.round(p.haversine(F.lit(20.0), F.lit(78.0), F.col("lat"), F.col("lon")), 2).alias("metres"))


@query("select id, round((x1 - x0) / 1e5 * ((y1 - y0) / 1e5) * 111320 * 110574 * cos(radians(20 + y0 / 1e5)), 3) as area_m2 from parcels")
def ring_area(spark, sf_dir):
    s = lambda c, o: o + F.col(c) / 1e5
    ring = F.array(g.point(s("x0", 78), s("y0", 20)), g.point(s("x1", 78), s("y0", 20)), g.point(s("x1", 78), s("y1", 20)), g.point(s("x0", 78), s("y1", 20)))
    return x.parcels(spark, sf_dir).select("id", F.round(p.lonlat_ring_area(ring), 3).alias("area_m2"))


@query("select id, round((x0 + x1) / 2, 2) as x, round((y0 + y1) / 2, 2) as y from parcels")
def utm_round_trip(spark, sf_dir):
    """Centroids through UTM and back stay within a millimetre."""
    shaped = x.geoms(x.parcels(spark, sf_dir)).withColumn("c", g.centroid(F.col("geom")))
    back = p.utm_inverse(500000 + F.col("c.x"), 2_200_000 + F.col("c.y"), F.lit(44), F.lit(True))
    there = p.utm_forward(F.col("b.lon"), F.col("b.lat"), F.lit(44))
    return shaped.withColumn("b", back).withColumn("u", there).select("id", F.round(F.col("u.x") - 500000, 2).alias("x"), F.round(F.col("u.y") - 2_200_000, 2).alias("y"))


@query("select id, round(least(x1 - x0, y1 - y0), 3) as short_m, round(greatest(x1 - x0, y1 - y0), 3) as long_m, 1.0::double as share from parcels")
def rotated_rectangles(spark, sf_dir):
    """Least rotated rectangles of parcels that were turned by 30 degrees."""
    turn = lambda v: g.point(v["x"] * 0.8660254037844387 - v["y"] * 0.5, v["x"] * 0.5 + v["y"] * 0.8660254037844387)
    turned = F.transform("geom", lambda q: F.transform(q, lambda r: F.transform(r, turn)))
    out = x.geoms(x.parcels(spark, sf_dir)).select("id", turned.alias("geom")).withColumn("r", kernels.rotated_rectangle("geom"))
    return out.select("id", F.round("r.short_m", 3).alias("short_m"), F.round("r.long_m", 3).alias("long_m"), F.round("r.share", 4).alias("share"))


@query("select id, round((x1 - x0) * (y1 - y0) * 0.7, 3) as larger_m2, round((x1 - x0) * (y1 - y0) * 0.3, 3) as smaller_m2 from parcels where (x1 - x0) * (y1 - y0) * 0.3 >= 12")
def split_parcels(spark, sf_dir):
    """Parcels cut by a vertical line; pieces under 12 square metres refuse the cut."""
    df = x.parcels(spark, sf_dir).withColumn("cut", F.col("x0") + 0.3 * (F.col("x1") - F.col("x0")))
    line = F.array(g.point(F.col("cut"), F.col("y0") - 5), g.point(F.col("cut"), F.col("y1") + 5))
    out = x.geoms(df.withColumn("line", line)).select("id", kernels.split_by_line("geom", "line").alias("p")).filter((F.size("p") == 2) & (F.element_at("p", 2)["area"] >= 12))
    return out.select("id", F.round(F.element_at("p", 1)["area"], 3).alias("larger_m2"), F.round(F.element_at("p", 2)["area"], 3).alias("smaller_m2"))


@query("select id, case when confidence < 0.15 then 'low' when confidence < 0.35 then 'middle' else 'high' end as band from parcels")
def confidence_bands(spark, sf_dir):
    return x.parcels(spark, sf_dir).select("id", band(F.col("confidence"), 0.15, 0.35).alias("band"))


@query("select (18 - k)::int as z, (x // (2 ** k)::int)::bigint as x, (y // (2 ** k)::int)::bigint as y, round(avg(value), 4) as value, count(*) as cells from grid, range(1, 7) r(k) group by all")
def tile_pyramid(spark, sf_dir):
    return layers.tile_pyramid(x.grid(spark, sf_dir), 18, 6).withColumn("value", F.round("value", 4))


@query(
    """select u.p as patch_x, v.p as patch_y, round(avg((value > 48)::int), 4) as share, avg((value > 48)::int) >= 0.005 or (u.p * 7919 + v.p * 104729) % 1000 < 150 as kept
    from grid, (select unnest([0, 6, 12, 18, 24, 30, 36, 42]) as p) u, (select distinct unnest(list_append(generate_series(0, greatest(h - 8, 0), 6), greatest(h - 8, 0))) as p from (select max(y) + 1 as h from grid)) v
    where x between u.p and u.p + 7 and y between v.p and v.p + 7 group by u.p, v.p"""
)
def patch_cutting(spark, sf_dir):
    """Patches of 8 cells on a grid of 6, the last ones flush with the edges; a few empty ones stay."""
    g = x.grid(spark, sf_dir).select("x", "y", (F.col("value") > 48).alias("mask"))
    height = g.agg(F.max("y") + 1).first()[0]
    return layers.patches(g, 50, height, 8, 6).withColumn("share", F.round("share", 4))


@query(
    """select o_orderkey::varchar as point_id, case when o_orderkey % 5 = 0 then 'corner' else lower(o_orderstatus) end as type, 20 + o_custkey / 1e5 as lat, 78 + o_orderkey % 1000 / 1e5 as lon, case when o_orderkey % 4 <> 0 then o_custkey % 7 / 2 end as accuracy_m
    from orders where o_orderkey % 3 <> 0 and 78 + o_orderkey % 1000 / 1e5 < 78.005 + 0.0005 and 20 + o_custkey / 1e5 > 20.0001 - 0.0005 and 20 + o_custkey / 1e5 < 20.02 + 0.0005"""
)
def point_feature_import(spark, sf_dir):
    """Points of a GeoJSON collection inside a survey's box and its margin."""
    k = F.col("o_orderkey")
    attrs = F.create_map(F.lit("id"), k.cast("string"), F.lit("type"), F.when(k % 5 != 0, F.concat(F.lit(" "), F.col("o_orderstatus"))), F.lit("accuracy"), F.when(k % 4 == 0, "?").otherwise((F.col("o_custkey") % 7 / 2).cast("string")))
    rows = x.table(spark, sf_dir, "orders").select(k.alias("row"), attrs.alias("attrs"), F.when(k % 3 == 0, "Polygon").otherwise("Point").alias("kind"), (78 + k % 1000 / 1e5).alias("lon"), (20 + F.col("o_custkey") / 1e5).alias("lat"))
    return layers.within_survey(layers.import_point_features(rows), (78.0, 20.0001, 78.005, 20.02))


@query(
    """select image_id, cx, cy, min(ann_id) as ann_id from (select (p_partkey % 10)::int as image_id, p_partkey as ann_id, p_partkey % 37 + i as cx, p_size % 29 + j as cy
    from part, range(0, 4) a(i), range(0, 3) b(j)) group by all"""
)
def annotation_labels(spark, sf_dir):
    k = F.col("p_partkey")
    boxes = x.table(spark, sf_dir, "part").select((k % 10).cast("int").alias("image_id"), k.alias("ann_id"), (k % 37).alias("x"), (F.col("p_size") % 29).cast("bigint").alias("y"), F.lit(4).alias("w"), F.lit(3).alias("h"))
    return layers.coco_labels(boxes)


@query("select id as bldg_id, round((x1 - x0) * (y1 - y0), 1) as area_m2, round(x0, 2) as x, round(y0, 2) as y, 2 as layers from buildings")
def exported_buildings(spark, sf_dir):
    """The building layer of an export in metres, from shapes in degrees; the empty road layer is left out."""
    def degrees(layer):
        back = lambda v: p.utm_inverse(500000 + v["x"], 2_200_000 + v["y"], F.lit(44), F.lit(True))
        move = lambda v: g.point(back(v)["lon"], back(v)["lat"])
        return layer.withColumn("geom", F.transform("geom", lambda q: F.transform(q, lambda r: F.transform(r, move))))

    buildings = degrees(x.geoms(x.buildings(spark, sf_dir).withColumn("area_m2", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 1))))
    out = layers.export_layers(degrees(x.geoms(x.parcels(spark, sf_dir)).select("id", "status", "geom")), buildings, buildings.filter("false"))
    first = F.col("geom")[0][0][0]
    return out["buildings"].select("bldg_id", "area_m2", F.round(first["x"] - 500000, 2).alias("x"), F.round(first["y"] - 2_200_000, 2).alias("y"), F.lit(len(out)).alias("layers"))
