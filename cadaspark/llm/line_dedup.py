"""Repeated multi-line passages by chunks with content-defined boundaries, in DataFrame functions only.

A text's lines are hashed; a rolling hash over the hashes of two neighbouring lines is divisible by
``DIVISOR`` at some lines, and a chunk ends at the first line of each run of such lines.  Boundaries
so depend on three lines alone and are found again when a passage stands elsewhere, and a chunk has
two lines or more, but for the last one of a text.  (A boundary in the first two lines of a passage
may hang on the lines before it.)  Chunks of two lines or more that occur more than
once, after a comparison of their bytes, stay at their first place and go elsewhere.  The chunks at
both ends of a passage also hold foreign lines, so a removed chunk grows, line by line, over the
lines around it that equal those around its first place.

A passage of a few lines may have no chunk of its own.  So in what the chunks leave, the least
chunks there can be, two lines that hold text and the blank ones between them, are compared in the
same way: all that is repeated in two lines or more goes, but for its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.llm.common import documents, joined_by_count, stored

DIVISOR = 3
#: What a line with text holds.
INK = r"[^\x20\x09-\x0D]"
#: Rows of at most 24 bytes that may be broadcast.
BROADCAST_ROWS = 500_000


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_ends(lines: Column) -> Column:
    """Number of the last line of each chunk, in order."""
    hashed = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"))

    def ends(h: Column) -> Column:
        hit = lambda i: (F.element_at(h, i) + 31 * F.element_at(h, F.greatest(i - 1, F.lit(1)))) % DIVISOR == 0
        before = lambda i: F.greatest(i - 1, F.lit(1))
        return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | ((i > 2) & hit(i) & ~hit(before(i))) | ((i == 2) & hit(i)))

    return F.element_at(F.transform(F.array(hashed), ends), 1)


def chunks_of(rows: DataFrame) -> DataFrame:
    """A row a chunk of ``__text``: ``chunk`` (its number), ``start`` (lines before it), ``end``, ``ends`` (all of them)."""
    marked = rows.withColumn("lines", split_lines(F.col("__text"))).withColumn("ends", chunk_ends(F.col("lines")))
    out = marked.select(*[c for c in marked.columns], F.posexplode("ends").alias("chunk", "end"))
    return out.withColumn("start", F.when(F.col("chunk") > 0, F.element_at("ends", F.greatest("chunk", F.lit(1)))).otherwise(0))


def lines_between(start: Column, end: Column) -> Column:
    return F.slice("lines", start + 1, end - start)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def alike(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # the shorter one is filled with nulls
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def later_places(places: DataFrame) -> DataFrame:
    """Places of repeated chunks but the first one of each, with ``first``: what stands there and around it."""
    order = F.struct("__id", "__row", "chunk", "before", "after")
    groups = places.groupBy("hash", "bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = joined_by_count(places, stored(groups, "line-groups"), ["hash", "bytes"], "n")
    place = lambda c: F.struct(*[F.col(f"{c}{k}").alias(k) for k in ("__id", "__row", "chunk")])
    return both.filter(~place("").eqNullSafe(place("first.")))


def places_of(wide: DataFrame, count_name: str) -> DataFrame:
    """Rows of ``wide`` (with ``bytes``) whose bytes' hash occurs more than once, with ``hash``."""
    hashed = wide.withColumn("hash", F.xxhash64("bytes"))
    twice = stored(hashed.select("hash").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), count_name)
    return hashed.join(small(twice), "hash", "left_semi")


def chunk_ranges(rows: DataFrame) -> DataFrame:
    """``__id``, ``__row``, ``a``, ``b``: lines after ``a`` up to ``b`` that repeated chunks take out of a text."""
    wide = chunks_of(rows).filter(F.col("end") - F.col("start") > 1)
    wide = wide.withColumn("bytes", F.array_join(lines_between(F.col("start"), F.col("end")), "\n"))
    end_before = F.when(F.col("chunk") > 2, F.element_at("ends", F.greatest(F.col("chunk") - 2, F.lit(1)))).otherwise(0)
    end_after = F.element_at("ends", F.least(F.col("chunk") + 2, F.size("ends")))
    around = [F.reverse(lines_between(end_before, F.col("start"))).alias("before"), lines_between(F.col("end"), end_after).alias("after")]
    places = places_of(wide, "line-hashes").select("__id", "__row", "chunk", "start", "end", "hash", "bytes", *around)
    later = later_places(stored(places, "line-chunks"))
    return later.select("__id", "__row", (F.col("start") - alike(F.col("before"), F.col("first.before"))).alias("a"), (F.col("end") + alike(F.col("after"), F.col("first.after"))).alias("b")).distinct()


def left_by(ranges: DataFrame) -> DataFrame:
    """``__id``, ``__row``, ``keep`` (ranges of lines that stay) and ``rest`` (lines from there on stay)."""
    row = W.partitionBy("__id", "__row").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)  # a row a removed range of one text
    gaps = ranges.withColumn("upto", F.coalesce(F.max("b").over(row), F.lit(0)))
    gap = F.when(F.col("a") > F.col("upto"), F.struct(F.col("upto").alias("a"), F.col("a").alias("b")))
    return gaps.groupBy("__id", "__row").agg(F.array_sort(F.collect_list(gap)).alias("keep"), F.max("b").alias("rest"))


def with_left(rows: DataFrame, left: DataFrame) -> DataFrame:
    """``rows`` with ``keep`` and ``rest``, null where nothing goes."""
    gone = small(left.withColumnsRenamed({"__id": "__id2", "__row": "__row2"}))
    return rows.join(gone, (rows["__row"] == gone["__row2"]) & rows["__id"].eqNullSafe(gone["__id2"]), "left").drop("__id2", "__row2")


def pair_ranges(rows: DataFrame, left: DataFrame) -> DataFrame:
    """``__id``, ``__row``, ``a``, ``b`` of repeated pairs of lines with text, the blank ones between them included, among lines that stay.

    A pair that overlaps its own first place (in a run of one line) stays.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (computed once a row)
    full = lambda x: F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.element_at(x, i).rlike(INK))
    pairs = lambda f: F.zip_with(F.slice(f, 1, F.greatest(F.size(f) - 1, F.lit(0))), F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda i, j: F.struct((i - 1).alias("a"), j.alias("b")))
    stays = lambda p: F.col("rest").isNull() | (p["a"] >= F.col("rest")) | F.exists("keep", lambda k: (k["a"] <= p["a"]) & (p["b"] <= k["b"]))
    shown = lambda x, p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_join(F.slice(x, p["a"] + 1, p["b"] - p["a"]), "\n").alias("bytes"))
    told = let(split_lines(F.col("__text")), lambda x: let(full(x), lambda f: F.transform(F.filter(pairs(f), stays), lambda p: shown(x, p))))
    wide = with_left(rows, left).select("__id", "__row", F.explode(told).alias("p")).select("__id", "__row", "p.*")
    places = stored(places_of(wide, "pair-hashes"), "line-pairs")
    groups = places.groupBy("hash", "bytes").agg(F.min(F.struct("__id", "__row", "a", "b")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = joined_by_count(places, stored(groups, "pair-groups"), ["hash", "bytes"], "n")
    own = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__row") == F.col("first.__row"))
    return both.filter(~own | (F.col("a") >= F.col("first.b"))).select("__id", "__row", "a", "b").distinct()


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated passages removed from ``text``; adds ``n_lines``, ``n_removed_lines``.

    Lines end at ``\\n``.  Of equal passages of two lines or more the one with the least doc_id (null
    first), then hash of id and text, then place stays, so rows with one id and different
    texts keep a passage once; repeated rows with one id and text are treated alike.  The others go,
    with lines around a repeated chunk that equal those around its first place, as far as the two
    chunks before and the chunk after reach.  Of a run of one and the same line the first two stay.
    Single repeated lines stay, as do blank ones by themselves.  Null and empty texts have
    one empty line and stay as they are; very long texts cost in proportion to their lines; an empty
    table gives an empty result; columns of ``df`` stay, whatever their names, and those named like a
    new one are replaced.
    """
    new = ("n_lines", "n_removed_lines")
    names = [c for c in df.columns if c not in new]
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    own = df.select(*[df[c].alias(i) for c, i in inner.items()])
    key, body = inner[doc_id], inner[text]
    own = own.withColumn("__id", F.col(key)).withColumn("__text", F.coalesce(body, F.lit("")))
    own = own.withColumn("__row", F.xxhash64("__id", "__text"))
    rows = own.select("__id", "__text", "__row")
    chunks = stored(chunk_ranges(rows), "line-gone")
    pairs = stored(pair_ranges(rows, stored(left_by(chunks), "line-left")), "pairs-gone")
    left = stored(left_by(chunks.unionByName(pairs)), "lines-left")
    joined = with_left(own, left)
    lines = split_lines(F.col("__text"))
    kept = lambda x: F.flatten(F.transform("keep", lambda k: F.slice(x, k["a"] + 1, k["b"] - k["a"])))
    stay = lambda x: F.concat(kept(x), F.slice(x, F.col("rest") + 1, F.greatest(F.size(x) - F.col("rest"), F.lit(0))))
    out = joined.withColumn("__left", F.when(F.col("rest").isNotNull(), F.element_at(F.transform(F.array(lines), stay), 1)))
    out = out.withColumn("__n", F.size(lines))
    shown = {c: F.col(i) for c, i in inner.items()} | {text: F.when(F.col("__left").isNull(), F.col(body)).otherwise(F.array_join("__left", "\n"))}
    removed = F.when(F.col("__left").isNull(), 0).otherwise(F.col("__n") - F.size("__left"))
    return out.select(*[v.alias(c) for c, v in shown.items()], F.col("__n").alias("n_lines"), removed.alias("n_removed_lines"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP9_SQL = f"""
with l as (
  select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line, len(string_split(coalesce(text, ''), chr(10))) as n
  from documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as u(i)),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from l),
t as (select *, coalesce((h + 31 * lag(h) over (partition by doc_id order by i)) % {DIVISOR} = 0, false) as hit from h),
e as (select *, i = n or (hit and not coalesce(lag(hit) over (partition by doc_id order by i), false)) as ends from t),
c as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from e),
k as (select doc_id, chunk, min(i) - 1 as a, max(i) as b, list(line order by i) as lines, string_agg(line, chr(10) order by i) as bytes from c group by doc_id, chunk),
p as (select *, list_concat(coalesce(list_reverse(lag(lines) over d), []), coalesce(list_reverse(lag(lines, 2) over d), [])) as before, coalesce(lead(lines) over d, []) as after from k window d as (partition by doc_id order by chunk)),
r as (select *, row_number() over w as place, first_value(before) over w as before_1, first_value(after) over w as after_1
  from p where b - a > 1 window w as (partition by bytes order by doc_id, chunk)),
g as (select doc_id, a - alike(before, before_1) as a, b + alike(after, after_1) as b from r where place > 1),
m as (select l.doc_id, l.i, l.line, exists (select 1 from g where g.doc_id = l.doc_id and l.i > g.a and l.i <= g.b) as gone from l),
f as (select *, lead(i) over (partition by doc_id order by i) as j from m where trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
w as (select f.doc_id, f.i, f.j, string_agg(m.line, chr(10) order by m.i) as bytes from f join m on m.doc_id = f.doc_id and m.i between f.i and f.j where f.j is not null group by all having not bool_or(m.gone)),
v as (select *, row_number() over d as place, first_value(doc_id) over d as doc_1, first_value(j) over d as j_1 from w window d as (partition by bytes order by doc_id, i)),
z as (select doc_id, i, j from v where place > 1 and (doc_id <> doc_1 or i > j_1)),
y as (select m.doc_id, m.i, m.line, m.gone or exists (select 1 from z where z.doc_id = m.doc_id and m.i between z.i and z.j) as gone from m)
select doc_id, count(*)::int as n_lines, count(*) filter (where gone)::int as n_removed_lines,
       md5(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as text_md5
from y group by doc_id
"""
for x in ("before", "after"):  # DuckDB has no functions within one statement
    OP9_SQL = OP9_SQL.replace(
        f"alike({x}, {x}_1)",
        f"coalesce(nullif(list_position(list_transform(range(1, least(len({x}), len({x}_1)) + 1), lambda j: {x}[j] = {x}_1[j]), false), 0) - 1, least(len({x}), len({x}_1)))",
    )
