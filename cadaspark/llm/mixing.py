"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents are dealt into blocks.  In a fluid mixture all sources flow at rates in
proportion to their real weights, and when one has run out the others keep their relative weights
(a new phase).  A block is released in the slot in which the flow reaches it and due when the flow
has passed it; in every slot the released block that is due first goes (earliest deadline first,
ties by source).  As the flow is a fractional schedule within the same windows, so no source is ever
a whole block ahead of or behind its share, over any number of slots, and every row appears exactly
once.  The schedule is a pure function of the sources' block counts and weights, computed by one SQL
expression over arrays in steps of ``PERIOD`` slots; nothing is rounded or carried from step to step
but the sources' blocks so far.  Each step needs the one before, but a source is never more than a
block off the flow, so what is done at a slot is known but for one block a source.  Frames of
``FRAME`` slots therefore run side by side, each from the state that the flow lets expect; a frame
whose state is not the one in which the frame before ended runs again from that one, until all
follow from one another.  The order is that of one run from the first slot to the last, whatever the
size of the table and of the frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.llm.common import documents, shared_dir, stored

#: Slots that are scheduled in one step.
PERIOD = 1000
#: Slots that are scheduled in a row by one task (or as many as there are sources, if they are more).
FRAME = 1 << 16
#: Rows of a block, and blocks of whole rows that a plan has at most where no number of rows is given.
BLOCK, MOST_BLOCKS = 16, 1 << 19
#: Weight of a source where none is given: its number of documents to this power.
TEMPER = 0.5
#: Rows, about, that the ranks of a bucket are counted over at once.
BUCKET = 5000
#: Rows of the plan (a row a block) that may be broadcast.
BROADCAST_ROWS = 200_000

#: Tasks that frames are dealt to at most.
MOST_TASKS = 512
#: Key of the metadata by which a mixture's source column names the table of the mixture's order.
ORDER = "mixture order"

#: A row a frame (steps ``first`` to ``last``) of ``s`` (unfinished sources with i, w, n blocks and d blocks done), ``seg``
#: (the flow's pieces: from slot t on the virtual time is v + (slot - t) / r, up to slot ``until``) and ``total`` slots, to
#: the sources after the frame and an array of steps of slots.
SCHEDULE = """
aggregate(sequence(first, last),
  named_struct('s', s, 'out', cast(array() as array<array<struct<i:int, block:bigint, phase:int>>>)),
  (e, k) -> element_at(transform(array(named_struct('a', k * {step}, 'b', least((k + 1) * {step}, total))), q ->
    element_at(transform(array(filter(seg, x -> x.until > q.a and x.t <= q.b)), near ->
      element_at(transform(array(named_struct('first', {first}, 'last', {last})), v ->
        -- blocks due after as many released ones as there are slots cannot go in this step
        element_at(transform(array(if(size(e.s) <= {step}, null, get(array_sort(transform(filter(e.s, x -> x.d < x.w * v.first * (1 - 1e-12d)), x -> (x.d + 1) / x.w)), {step} - 1))), most ->
          element_at(transform(array(
            aggregate(sequence(q.a, q.b - 1),
              named_struct('c', filter(e.s, x -> x.d < x.w * v.last * (1 + 1e-9d) and (most is null or (x.d + 1) / x.w <= most)), 'order', cast(array() as array<struct<i:int, block:bigint, phase:int>>)),
              (g, t) -> element_at(transform(array(named_struct('v', {here}, 'phase', element_at(filter(near, x -> x.t <= t), -1).phase)), h ->
                element_at(transform(array(array_min(transform(g.c, x -> if(x.d < x.n, named_struct('early', x.d >= x.w * h.v * (1 - 1e-12d), 'due', (x.d + 1) / x.w, 'i', x.i, 'd', x.d), null)))), pick ->
                  named_struct('c', transform(g.c, x -> if(x.i = pick.i, named_struct('i', x.i, 'w', x.w, 'n', x.n, 'd', x.d + 1), x)),
                    'order', concat(g.order, array(named_struct('i', pick.i, 'block', pick.d, 'phase', h.phase))))), 1)), 1))), g ->
            named_struct(
              's', concat(filter(e.s, x -> not (x.d < x.w * v.last * (1 + 1e-9d) and (most is null or (x.d + 1) / x.w <= most))), filter(g.c, x -> x.d < x.n)),
              'out', concat(e.out, array(g.order)))), 1)), 1)), 1)), 1)), 1),
  e -> named_struct('s', array_sort(e.s), 'out', e.out))
"""
#: The unfinished sources that the flow lets expect at slot ``at``: blocks due by then are done, and of those released by
#: then as many, due first, as make up the slots.
EXPECTED = """
element_at(transform(array(filter(seg, x -> x.t < at)), near ->
  element_at(transform(array({here}), v ->
    element_at(transform(array(transform(s, x -> named_struct('i', x.i, 'w', x.w, 'n', x.n, 'd', least(x.n, cast(floor(x.w * v * (1 + 1e-12d)) as bigint))))), due ->
      element_at(transform(array(array_sort(transform(filter(due, x -> x.d < x.n and x.d < x.w * v * (1 - 1e-12d)), x -> named_struct('due', (x.d + 1) / x.w, 'i', x.i)))), free ->
        element_at(transform(array(get(free, cast(at - aggregate(due, 0L, (n, x) -> n + x.d) as int) - 1)), most ->
          array_sort(filter(transform(due, x -> if(x.d < x.w * v * (1 - 1e-12d) and named_struct('due', (x.d + 1) / x.w, 'i', x.i) <= most, named_struct('i', x.i, 'w', x.w, 'n', x.n, 'd', x.d + 1), x)), x -> x.d < x.n))), 1)), 1)), 1)), 1)), 1)
"""
#: Virtual time at the end of a slot, by the last piece of the flow that begins before it.
AT = "element_at(transform(array(element_at(filter(near, x -> x.t < {end}), -1)), y -> y.v + ({end} - y.t) / y.r), 1)"


def schedule(sources: DataFrame, step: int = PERIOD) -> DataFrame:
    """A row a block: ``source``, ``block`` (of its source), ``slot`` and ``phase``.

    ``sources`` has ``source``, ``blocks`` and ``weight`` (all positive), a row a source.
    """
    whole = lambda *order: W.partitionBy(F.lit(0)).orderBy(*order)  # noqa: E731  (a row a source)
    ends = sources.withColumn("v", F.col("blocks") / F.col("weight")).withColumn("i", F.row_number().over(whole("source")))
    ends = stored(ends, "mix-sources")
    after = whole(F.desc("v"), F.desc("i"))
    ends = ends.withColumn("r", F.coalesce(F.sum("weight").over(after.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    # flow between the end of the source before and this one's
    flow = (F.col("v") - F.coalesce(F.lag("v").over(whole("v", "i")), F.lit(0.0))) * (F.col("r") + F.col("weight"))
    pieces = ends.withColumn("flow", flow).withColumn("t", F.sum("flow").over(whole("v", "i").rowsBetween(W.unboundedPreceding, 0))).filter("r > 0").select("t", "v", "r")
    start = ends.agg(F.lit(0.0).alias("t"), F.lit(0.0).alias("v"), F.sum("weight").alias("r")).filter("r is not null")
    pieces = start.unionByName(pieces).groupBy("v").agg(F.max("t").alias("t"), F.min("r").alias("r"))  # sources may end together
    pieces = pieces.withColumn("until", F.lead("t", 1, 1e300).over(whole("v"))).withColumn("phase", F.row_number().over(whole("v")) - 1)
    seg = pieces.agg(F.array_sort(F.collect_list(F.struct("t", "v", "r", "until", "phase"))).alias("seg"))
    one = ends.agg(F.array_sort(F.collect_list(F.struct("i", F.col("weight").alias("w"), F.col("blocks").alias("n"), F.lit(0).cast("bigint").alias("d")))).alias("s"), F.sum("blocks").alias("total"))
    size = one.select("total", F.size("s").alias("sources")).first()
    frame = max(1, max(FRAME, size["sources"]) // step)  # steps of a frame
    body, expected = SCHEDULE.replace("{step}", str(step)), EXPECTED.replace("{here}", AT.replace("{end}", "at"))
    for name, end in (("{first}", "(q.a + 1)"), ("{last}", "q.b"), ("{here}", "(t + 1)")):
        body = body.replace(name, AT.replace("{end}", end))
    one = stored(one.filter("total > 0").crossJoin(seg), "mix-one")  # one row each
    count = -(-(size["total"] or 0) // (frame * step))
    parts = max(1, min(count, MOST_TASKS))

    def run(states: DataFrame) -> DataFrame:
        """``frame``, ``s``, and what :data:`SCHEDULE` makes of it, for the frames with ``frame`` and ``s``."""
        rows = states.crossJoin(one.drop("s")).repartitionById(parts, (F.col("frame") % parts).cast("int"))
        rows = rows.withColumn("first", F.col("frame") * frame).withColumn("last", F.least(F.col("first") + frame - 1, F.expr(f"(total - 1) div {step}")))
        return stored(rows.select("frame", "s", F.expr(body).alias("x")).select("frame", "s", F.col("x.s").alias("end"), F.col("x.out").alias("out")), "mix-frames")

    at = one.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, count - 1)).cast("bigint")))).withColumn("at", F.col("frame") * frame * step)
    frames = run(at.select("frame", F.when(F.col("frame") > 0, F.expr(expected)).otherwise(F.col("s")).alias("s")))
    while count > 1:
        before = frames.select((F.col("frame") + 1).alias("frame"), F.col("end").alias("s"))
        wrong = stored(frames.select("frame", F.col("s").alias("expected")).join(before, "frame").filter("s <> expected").drop("expected"), "mix-wrong")
        if wrong.isEmpty():
            break
        frames = stored(frames.join(wrong.select("frame"), "frame", "left_anti").unionByName(run(wrong)), "mix-frames")
    steps = frames.select("frame", F.posexplode("out").alias("k", "order"))
    blocks = steps.select("frame", "k", F.posexplode("order").alias("p", "x"))
    blocks = blocks.select(((F.col("frame") * frame + F.col("k")) * step + F.col("p")).alias("slot"), F.col("x.i").alias("i"), F.col("x.block").alias("block"), F.col("x.phase").alias("phase"))
    return blocks.join(ends.select("i", "source"), "i").select("source", "block", "slot", "phase")


def arranged(df: DataFrame, source: str, weights: DataFrame | None, block: int | None, period: int | None, digest: str | None) -> tuple[DataFrame, int]:
    """What :func:`mixed` returns, and the number of slots."""
    own = ("__slot", "__phase", "__block", "__place")  # and __size
    inner = [f"c{i}" for i in range(len(df.columns))]
    column = dict(zip(df.columns, inner, strict=True))
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    keyed = df.toDF(*inner).withColumn("__source", key(column[source]))
    keyed = keyed.withColumn("__hash", F.col(column[digest]) if digest else F.xxhash64(*inner))
    counts = stored(keyed.groupBy("__source").agg(F.count("*").alias("rows")), "mix-counts")
    n = counts.agg(F.count("*").alias("sources"), F.max("rows").alias("most"), F.coalesce(F.sum("rows"), F.lit(0)).alias("all")).first()
    block = block or max(BLOCK, -(-n["all"] // MOST_BLOCKS))
    if period is not None and n["sources"] > period:
        raise ValueError(f"{n['sources']} sources are more than the given period's {period} slots")
    # ranks within a source are those of the hashes, whatever the number of buckets: rows are bucketed by ranges of
    # hashes, counted by bucket, and ranked within buckets
    bits = ((n["most"] or 0) // BUCKET).bit_length()
    keyed = keyed.withColumn("__bucket", F.shiftright("__hash", 64 - bits) if bits else F.lit(0).cast("bigint"))
    sizes = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__source", "__bucket", before.alias("__before"))
    ranked = keyed.withColumn("__n", F.row_number().over(W.partitionBy("__source", "__bucket").orderBy("__hash")))
    ranked = ranked.join(sizes, ["__source", "__bucket"])
    rank = F.col("__before") + F.col("__n") - 1
    ranked = ranked.withColumn("__block", F.floor(rank / block)).withColumn("__place", (rank % block).cast("int"))

    given = counts.select(F.col("__source").alias("source"), F.ceil(F.col("rows") / block).alias("blocks"), F.pow(F.col("rows").cast("double"), F.lit(TEMPER)).alias("own"))
    if weights is not None:
        named = weights.select(key("source").alias("source"), F.col("weight").cast("double").alias("weight")).filter("weight > 0")
        given = given.join(named, "source", "left").withColumn("weight", F.coalesce("weight", "own"))
    else:
        given = given.withColumn("weight", F.col("own"))
    plan = stored(schedule(given.select("source", "blocks", "weight"), period or PERIOD).withColumnRenamed("source", "__source"), "mix-plan")
    plan, slots = plan.select("__source", F.col("block").alias("__block"), F.col("slot").alias("__slot"), F.col("phase").alias("__phase")), plan.count()
    plan = F.broadcast(plan) if slots <= BROADCAST_ROWS else plan
    return ranked.join(plan, ["__source", "__block"]).select(*[F.col(i).alias(c) for c, i in column.items() if c not in (*own, "__size")], *own, F.lit(block).alias("__size")), slots


def mixed(df: DataFrame, source: str = "source", weights: DataFrame | None = None, block: int | None = None, period: int | None = None, digest: str | None = None) -> DataFrame:
    """``df`` with ``__slot``, ``__phase``, ``__block``, ``__place`` (in the block) and ``__size`` (rows of a full block).

    ``weights`` (columns ``source``, ``weight``) may give target weights; sources without a positive
    one, and all if there is none, weigh their number of rows to the power ``TEMPER``.  Any number of
    sources can be mixed.  ``period`` may give the slots of a step; it does not alter the order, and
    one with fewer slots than there are sources raises an error.  A null source is a source like
    others, named by an empty key of its own.  Rows of a source follow one another by a hash of the
    whole row (``digest`` may name a column that has it); equal rows are ranked in any order.  Every
    row appears exactly once; an empty table gives an empty result.  ``block`` gives the rows of
    a block, for tables of any size; without it blocks have ``BLOCK`` rows, and more where a table has
    more than ``MOST_BLOCKS`` of them.  Columns of ``df`` may have any names; those named like one of the five new ones are replaced.
    """
    return arranged(df, source, weights, block, period, digest)[0]


def mixture(df: DataFrame, source: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """The rows of ``df``, with its columns, in the mixture's order: partitions are ranges of slots.

    Slots have no gaps, so the ranges follow from their number and no sample of the rows is drawn.
    Files do not keep an order when they are read, so the order is written beside the rows, and the
    metadata of the source column name its table: :func:`order_of` finds it, also after the rows
    were written and read again.  Blocks have ``BLOCK`` rows.  Nulls, repeated rows, clashing names and empty tables are treated as :func:`mixed` says.
    """
    inner = [f"d{i}" for i in range(len(df.columns))]
    column = dict(zip(df.columns, inner, strict=True))
    marked = df.toDF(*inner).withColumn("digest", F.xxhash64(*inner))
    placed, slots = arranged(marked, column[source], weights, BLOCK, None, "digest")
    order = shared_dir(df.sparkSession, "mixture-order")
    placed.select("digest", "__slot", "__place").write.parquet(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("__slot") * parts / F.lit(max(1, slots))).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("__slot", "__place").select(*inner).toDF(*df.columns).withMetadata(source, {**df.schema[source].metadata, ORDER: order})


def order_of(df: DataFrame) -> DataFrame | None:
    """``digest`` (of all columns), ``__slot`` and ``__place`` of the rows of the :func:`mixture` that ``df`` is or was; else None."""
    paths = [f.metadata[ORDER] for f in df.schema.fields if ORDER in f.metadata]
    return df.sparkSession.read.parquet(paths[-1]) if paths else None


def in_order(df: DataFrame, order: DataFrame, digest: str) -> DataFrame:
    """``df`` with ``__slot`` and ``__place`` of :func:`order_of`, by the column that has the digests.

    Equal rows take the places of such rows in any order; rows that the mixture did not have stay,
    with nulls.
    """
    nth = lambda *by: F.row_number().over(W.partitionBy("digest").orderBy(*by))
    places = order.withColumn("__nth", nth("__slot", "__place"))
    rows = df.withColumnRenamed(digest, "digest").withColumn("__nth", nth("digest"))
    return rows.join(places, ["digest", "__nth"], "left").drop("__nth").withColumnRenamed("digest", digest)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, source, phase, slot (of its block), block (of its source), position.

    ``position`` orders the documents; it has gaps where a source's last block is not full.
    """
    docs = documents(spark, sf_dir).select("doc_id", "source")
    out = mixed(docs, block=BLOCK)
    return out.select("doc_id", "source", F.col("__phase").alias("phase"), F.col("__slot").alias("slot"), F.col("__block").cast("bigint").alias("block"), (F.col("__slot") * F.col("__size") + F.col("__place")).alias("position"))
