"""Survey layers derived from the driver's tables, as DataFrames and as DuckDB views.

Layers are boxes with whole or tenth-of-a-metre coordinates, so both engines agree to the last digit
that is compared.  ``SQL`` holds the same recipes; :func:`sql` puts those that a text names in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.functions.geometry import box_geometry, point

STATUSES = ("draft", "approved", "rejected", "field_check")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_count(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Adds ``n_part``, the number of parcel places."""
    return df.crossJoin(F.broadcast(table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n_part"))))  # one row


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1, confidence, status, source."""
    p, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (p % 50 * 20).cast("double"), (F.floor(p / 50) * 20).cast("double")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (p % 4 + 1).cast("int"))
    source = F.when(p % 7 == 0, "manual").when(p % 7 == 1, "edited").otherwise("ai")
    return table(spark, sf_dir, "part").select(p.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 12 + size % 10).alias("x1"), (y0 + 12 + size * 7 % 10).alias("y1"), (size % 100 / 100).cast("double").alias("confidence"), status.alias("status"), source.alias("source"))


def parcels_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geom, confidence: with duplicates, bow-ties, thin, small and holed parcels.

    Bow-ties and holed parcels stand far from the rest.
    """
    base = parcels(spark, sf_dir)
    i = F.col("id")
    thin, tiny, bow, holed = i % 223 == 0, i % 227 == 0, i % 211 == 0, i % 229 == 0
    far = F.when(bow, 1e5).when(holed, 2e5).otherwise(0.0)
    x0, y0 = F.col("x0") + far, F.col("y0")
    x1 = F.when(thin & ~bow & ~holed, x0 + 1).when(tiny & ~bow & ~holed, x0 + 3).otherwise(F.col("x1") + far)
    y1 = F.when(thin & ~bow & ~holed, F.col("y1") + 20).when(tiny & ~bow & ~holed, y0 + 3).otherwise(F.col("y1"))
    plain = base.select("id", "confidence", "status", "source", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), bow.alias("bow"), holed.alias("holed"))
    both = plain.unionByName(plain.filter(i % 97 == 0).withColumn("id", i + 10_000_000))
    a, b, c, d = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    ring = F.array(point(a, b), point(c, b), point(c, d), point(a, d))
    crossed = F.array(point(a, b), point(c, d), point(c, b), point(a, d))
    hole = F.array(point(a + 4, b + 4), point(c - 4, b + 4), point(c - 4, d - 4), point(a + 4, d - 4))
    geom = F.when(F.col("bow"), F.array(F.array(crossed))).when(F.col("holed"), F.array(F.array(ring, hole))).otherwise(F.array(F.array(ring)))
    return both.select("id", "confidence", "status", "source", geom.alias("geom"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing record: ref_id, x0, y0, x1, y1."""
    i = F.col("id")
    base = parcels(spark, sf_dir).filter(i % 17 != 0)
    shift = F.when(i % 5 == 0, 5.0).otherwise(0.4)
    base = base.select("id", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")
    middle = (F.col("x0") + F.col("x1")) / 2
    name = F.concat(F.lit("R"), i.cast("string"))
    whole = base.filter(i % 11 != 0).select(name.alias("ref_id"), "x0", "y0", "x1", "y1")
    left = base.filter(i % 11 == 0).select(F.concat(name, F.lit("a")).alias("ref_id"), "x0", "y0", middle.alias("x1"), "y1")
    right = base.filter(i % 11 == 0).select(F.concat(name, F.lit("b")).alias("ref_id"), middle.alias("x0"), "y0", "x1", "y1")
    return whole.unionByName(left).unionByName(right)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1."""
    c = _with_count(spark, sf_dir, table(spark, sf_dir, "customer"))
    home = F.col("c_custkey") % F.col("n_part")
    x0 = (home % 50 * 20 + 3 + F.when(F.col("c_custkey") % 13 == 0, 9).otherwise(0)).cast("double")
    y0 = (F.floor(home / 50) * 20 + 3).cast("double")
    side = 4 + F.col("c_nationkey") % 8
    return c.select(F.col("c_custkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road surfaces: id, width_m, x0, y0, x1, y1."""
    k = F.col("n_nationkey")
    y, width = (k * 480 - 7).cast("double"), (6 + k % 9).cast("double")
    return table(spark, sf_dir, "nation").select(k.cast("bigint").alias("id"), width.alias("width_m"), F.lit(0.0).alias("x0"), (y - width / 2).alias("y0"), F.lit(1010.0).alias("x1"), (y + width / 2).alias("y1"))


def setback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rail and water lines: id, kind, x0, y0, x1, y1 (no width)."""
    k = F.col("r_regionkey")
    x = (k * 230).cast("double")
    return table(spark, sf_dir, "region").select(k.cast("bigint").alias("id"), F.when(k % 2 == 0, "rail").otherwise("water").alias("kind"), x.alias("x0"), F.lit(-1000.0).alias("y0"), x.alias("x1"), F.lit(1e6).alias("y1"))


def government(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_count(spark, sf_dir, table(spark, sf_dir, "supplier"))
    home = F.col("s_suppkey") * 19 % F.col("n_part")
    x0, y0 = (home % 50 * 20).cast("double"), (F.floor(home / 50) * 20).cast("double")
    return s.select(F.col("s_suppkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 30).alias("y1"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-use zones: id, label, x0, y0, x1, y1."""
    i = F.col("id")
    label = F.element_at(F.array(*map(F.lit, ZONES)), (i % 4 + 1).cast("int"))
    return government(spark, sf_dir).select(i, label.alias("label"), (F.col("x0") - 40).alias("x0"), (F.col("y0") - 40).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 20).alias("y1"))


ZONES = ("Residential", "Agricultural", "Industrial", "Forest")


def gnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveyed points: point_id, type, x, y."""
    return as_gnss(spark, sf_dir, table(spark, sf_dir, "orders"))


def as_gnss(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Surveyed points of a table or stream of orders."""
    o = _with_count(spark, sf_dir, orders).withColumn("id", F.col("o_orderkey") % F.col("n_part"))
    own = o.join(parcels(spark, sf_dir).select("id", "x0", "y0"), "id")
    off = (F.col("o_custkey") % 7 - 3) * 0.1
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "control").otherwise("corner")
    return own.select(F.col("o_orderkey").alias("point_id"), kind.alias("type"), (F.col("x0") + off).alias("x"), (F.col("y0") + off).alias("y"))


VERDICTS = {"purchase": "confirmed", "error": "boundary_wrong", "signup": "not_a_parcel", "click": "part_of_neighbour", "view": "could_not_access"}


def as_observations(events: DataFrame) -> DataFrame:
    """Field visits: obs_id, parcel_id, time, verdict, distance_m, on_site (batch and stream)."""
    verdict = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in VERDICTS.items()])
    return events.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("parcel_id"), F.col("ts").alias("time"), verdict.alias("verdict"), F.col("value").alias("distance_m"), (F.col("value") <= 30).alias("on_site"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_observations(table(spark, sf_dir, "events"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("edit_id"), F.col("ts").alias("t"), F.concat_ws(" ", "event_type", "props").alias("action"), F.col("user_id").alias("parcels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified cells: zone, class 1-8, prob, height_m."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("zone"), (1 + F.col("l_linenumber") % 8).alias("class"), (F.col("l_discount") * 10).alias("prob"), (F.col("l_quantity") / 2).alias("height_m"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster, one cell a part: x, y, label 0-4, mask."""
    p, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select((p % 50).cast("int").alias("x"), F.floor(p / 50).cast("int").alias("y"), (size % 5).alias("label"), (size > 10).alias("mask"), size.cast("double").alias("value"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predicted instance ids of cells (0: none): tile, x, y, truth, pred."""
    p, size = F.col("p_partkey"), F.col("p_size")
    x, y = (p % 50).cast("int"), F.floor(p / 50).cast("int")
    truth = F.when(size > 8, F.floor(x / 5) * 100 + F.floor(y / 4) % 100 + 1).otherwise(0)
    pred = F.when(size > 12, F.floor((x + size % 2) / 5) * 100 + F.floor(y / 4) % 100 + 1).otherwise(0)
    return table(spark, sf_dir, "part").select(F.floor(y / 400).cast("int").alias("tile"), x.alias("x"), y.alias("y"), truth.cast("bigint").alias("truth"), pred.cast("bigint").alias("pred"))


def geoms(df: DataFrame) -> DataFrame:
    """A box layer with ``geom`` in place of its corners."""
    return df.withColumn("geom", box_geometry(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).drop("x0", "y0", "x1", "y1")


SQL = {
    "parcels": """select p_partkey as id, (p_partkey % 50 * 20)::double as x0, (p_partkey // 50 * 20)::double as y0,
        (p_partkey % 50 * 20 + 12 + p_size % 10)::double as x1, (p_partkey // 50 * 20 + 12 + p_size * 7 % 10)::double as y1,
        (p_size % 100)::double / 100 as confidence, ['draft', 'approved', 'rejected', 'field_check'][p_partkey % 4 + 1] as status,
        case p_partkey % 7 when 0 then 'manual' when 1 then 'edited' else 'ai' end as source from part""",
    "dirty": """select id, confidence, x0 + far as x0, y0, case when thin then x0 + 1 when tiny then x0 + 3 else x1 + far end as x1,
        case when thin then y1 + 20 when tiny then y0 + 3 else y1 end as y1, bow, holed from (
        select *, id % 211 = 0 as bow, id % 229 = 0 as holed, id % 223 = 0 and id % 211 <> 0 and id % 229 <> 0 as thin,
          id % 227 = 0 and id % 211 <> 0 and id % 229 <> 0 and id % 223 <> 0 as tiny,
          case when id % 211 = 0 then 1e5 when id % 229 = 0 then 2e5 else 0 end as far from parcels)""",
    "dirty_all": "select * from dirty union all select * replace (id + 10000000 as id) from dirty where id % 97 = 0",
    "shifted": """select id, x0 + s as x0, y0, x1 + s as x1, y1 from (select *, case when id % 5 = 0 then 5.0::double else 0.4::double end as s
        from parcels where id % 17 <> 0)""",
    "records": """select 'R' || id as ref_id, x0, y0, x1, y1 from shifted where id % 11 <> 0
        union all select 'R' || id || 'a', x0, y0, (x0 + x1) / 2, y1 from shifted where id % 11 = 0
        union all select 'R' || id || 'b', (x0 + x1) / 2, y0, x1, y1 from shifted where id % 11 = 0""",
    "places": "select max(p_partkey) + 1 as n_part from part",
    "buildings": """select c_custkey as id, x0, y0, x0 + 4 + c_nationkey % 8 as x1, y0 + 4 + c_nationkey % 8 as y1 from (
        select *, (c_custkey % n_part % 50 * 20 + 3 + case when c_custkey % 13 = 0 then 9 else 0 end)::double as x0,
          (c_custkey % n_part // 50 * 20 + 3)::double as y0 from customer, places)""",
    "roads": """select n_nationkey::bigint as id, (6 + n_nationkey % 9)::double as width_m, 0::double as x0, n_nationkey * 480 - 7 - (6 + n_nationkey % 9) / 2 as y0,
        1010::double as x1, n_nationkey * 480 - 7 + (6 + n_nationkey % 9) / 2 as y1 from nation""",
    "setback_lines": """select r_regionkey::bigint as id, case when r_regionkey % 2 = 0 then 'rail' else 'water' end as kind, (r_regionkey * 230)::double as x0,
        -1000::double as y0, (r_regionkey * 230)::double as x1, 1e6 as y1 from region""",
    "government": """select s_suppkey as id, x0, y0, x0 + 30 as x1, y0 + 30 as y1 from (select *, (s_suppkey * 19 % n_part % 50 * 20)::double as x0,
        (s_suppkey * 19 % n_part // 50 * 20)::double as y0 from supplier, places)""",
    "zones": """select id, ['Residential', 'Agricultural', 'Industrial', 'Forest'][id % 4 + 1] as label, x0 - 40 as x0, y0 - 40 as y0, x1 + 20 as x1, y1 + 20 as y1
        from government""",
    "gnss": """select o_orderkey as point_id, case when o_orderpriority = '5-LOW' then 'control' else 'corner' end as type,
        x0 + (o_custkey % 7 - 3) * 0.1::double as x, y0 + (o_custkey % 7 - 3) * 0.1::double as y
        from orders, places, parcels where parcels.id = o_orderkey % n_part""",
    "observations": """select event_id as obs_id, user_id as parcel_id, ts as time, case event_type when 'purchase' then 'confirmed' when 'error' then 'boundary_wrong'
        when 'signup' then 'not_a_parcel' when 'click' then 'part_of_neighbour' when 'view' then 'could_not_access' end as verdict,
        value as distance_m, value <= 30 as on_site from events""",
    "edits": "select event_id as edit_id, ts as t, concat_ws(' ', event_type, props) as action, user_id as parcels from events",
    "pixels": "select l_partkey as zone, 1 + l_linenumber % 8 as class, l_discount * 10 as prob, l_quantity / 2 as height_m from lineitem",
    "grid": """select (p_partkey % 50)::int as x, (p_partkey // 50)::int as y, p_size % 5 as label, p_size > 10 as mask, p_size::double as value from part""",
    "instances": """select (y // 400)::int as tile, x, y, (case when p_size > 8 then x // 5 * 100 + y // 4 % 100 + 1 else 0 end)::bigint as truth,
        (case when p_size > 12 then (x + p_size % 2) // 5 * 100 + y // 4 % 100 + 1 else 0 end)::bigint as pred
        from (select *, (p_partkey % 50)::int as x, (p_partkey // 50)::int as y from part)""",
}


def sql(text: str, **own: str) -> str:
    """``text`` with the views that it names (and those that they name) as common table expressions.

    ``own`` views may be built on the recipes; they come in the order given.
    """
    views = SQL | own
    names: list[str] = []
    begun: set[str] = set()

    def need(body: str) -> None:
        for name in views:
            if name not in begun and re.search(rf"\b{name}\b", body):
                begun.add(name)
                need(views[name])
                names.append(name)

    need(text)
    return "with " + ",\n".join(f"{n} as ({views[n]})" for n in names) + "\n" + text.strip() if names else text.strip()
