"""Exact dedup through counting quotient filters.

Each partition puts the 64-bit fingerprints of its normalised texts in a counting quotient filter:
the high bits (the quotient) choose a slot's run, the low bits (the remainder) are kept sorted in
the run, with a counter each.  A filter loses nothing of its fingerprints, so filters merge exactly:
runs are joined by sorted remainder and counters add up.  Partitions cut their filters by ranges of
quotients and the pieces of a range are merged in one task, so nothing is gathered whole anywhere.
Fingerprints with a merged count of one belong to unique texts; documents with any other go to byte
verification, where they are grouped by the normalised text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.llm.common import BLANKS, documents, freed, joined_by_count, stored

#: Low bits of a fingerprint that a run keeps.
REMAINDER_BITS = 44
#: Repeated fingerprints or ids (at most 48 bytes each) that may be broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
#: Stands for a null id in comparisons.
NULL_ID = -(1 << 62)
#: Rows a range of quotients is made for; repeated fingerprints are merged before they get there.
RANGE_ROWS = 2_000_000


class CountingQuotientFilter:
    """Sorted runs of remainders with counters; ``quotients`` and ``ends`` delimit the runs."""

    def __init__(self, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.ends, self.remainders, self.counts = quotients, ends, remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From unsigned 64-bit fingerprints in any order (with counts, where given)."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.intp)
        kept = prints[first]
        quotients, begins = np.unique(kept >> np.uint64(REMAINDER_BITS), return_index=True)
        remainders = kept & np.uint64((1 << REMAINDER_BITS) - 1)
        return cls(quotients.astype(np.uint32), np.append(begins[1:], len(kept)).astype(np.uint32) if len(kept) else np.zeros(0, np.uint32), remainders, np.add.reduceat(counts, first) if len(kept) else counts)

    def prints(self) -> np.ndarray:
        """The fingerprints, in order: the quotient of each run with its remainders."""
        runs = np.diff(self.ends.astype(np.int64), prepend=0)
        return np.repeat(self.quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS), runs) | self.remainders

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return CountingQuotientFilter.build(np.concatenate([f.prints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def dump(self) -> bytes:
        sizes = np.array([len(self.quotients), len(self.remainders)], np.uint32)
        return b"".join(x.tobytes() for x in (sizes, self.quotients, self.ends, self.remainders, self.counts))

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        q, n = map(int, np.frombuffer(data, np.uint32, 2))
        at, parts = 8, []
        for size, kind in ((q, np.uint32), (q, np.uint32), (n, np.uint64), (n, np.int64)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(*parts)


def fingerprints(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__norm`` (text without blanks), ``__sha`` (its SHA-256) and ``__print``."""
    norm = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")
    out = df.withColumn("__norm", norm).withColumn("__sha", F.unhex(F.sha2(F.col("__norm"), 256)))
    return out.withColumn("__print", F.conv(F.hex(F.substring("__sha", 1, 8)), 16, -10).cast("bigint"))


def repeated_prints(prints: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints (column ``__print``, signed) that occur more than once, with their counts."""
    bits = max(1, int(ranges - 1).bit_length())

    @freed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[CountingQuotientFilter] = []
        for batch in batches:
            held.append(CountingQuotientFilter.build(batch.column("__print").to_numpy().view(np.uint64)))
            if len(held) >= 64:
                held = [CountingQuotientFilter.merge(held)]
        if held:
            whole = CountingQuotientFilter.merge(held)
            own = whole.prints()
            cuts = np.searchsorted(own >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([CountingQuotientFilter.build(own[a:b], whole.counts[a:b]).dump()])], names=["range", "filter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.load(x) for x in table.column("filter").to_pylist()])
        many = whole.counts > 1
        return pa.table({"__print": pa.array(whole.prints()[many].view(np.int64)), "__count": pa.array(whole.counts[many])})

    return prints.select("__print").mapInArrow(build, "range int, filter binary").groupBy("range").applyInArrow(merge, "__print bigint, __count bigint")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are one group.  The row with the most code points in the original
    text stays, then the smallest ``doc_id`` (a null id sorts first).  Repeated rows with the same
    id are counted in ``group_size`` and are kept or dropped together.  An empty table gives an
    empty result.  Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    slim = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    prints = fingerprints(slim, "text").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("length"), "__sha", "__print")
    light = stored(prints, "exact-prints")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), light.count() // RANGE_ROWS)
    repeated = stored(repeated_prints(light, ranges), "exact-repeated")

    # byte verification: only documents whose fingerprint repeats carry their text into the shuffle,
    # and equal texts meet within each map task first, so a large group costs a row a task
    routed = fingerprints(slim, "text").join(small(repeated), "__print", "left_semi")
    first = F.max(F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("length"), (-F.coalesce(F.col("doc_id"), F.lit(NULL_ID))).alias("minus_id")))
    verified = routed.groupBy("__print", "__sha", "__norm").agg(first.alias("best"), F.count("*").alias("group_size"))
    verified = verified.select("__print", "__sha", F.col("best.minus_id").alias("minus_id"), "group_size")
    verified = stored(verified.filter("group_size > 1"), "exact-groups")

    keep = -F.col("minus_id")
    joined = joined_by_count(light, verified.withColumn("copies", F.col("group_size")), ["__print", "__sha"], "copies", "left")
    keep_id = F.when(F.col("minus_id").isNull(), F.col("doc_id")).when(keep == NULL_ID, F.lit(None)).otherwise(keep)
    return joined.select(
        "doc_id",
        keep_id.cast("bigint").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``df`` (see :func:`exact_groups`).

    Of rows that share both id and text the least in the order of all columns stays, so repeated rows
    leave one.  Null texts are equal to empty ones.  Columns may have any names; an empty table
    gives an empty result.
    """
    rows = stored(exact_groups(df, doc_id, text).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept", "group_size"), "exact-rows")
    gone = rows.filter("not kept").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__key")).distinct()
    twins = rows.filter("kept and group_size > 1").groupBy(F.col("doc_id").alias("__id"), F.col("sha").alias("__key")).count().filter("count > 1").drop("count")
    gone, twins = small(gone), small(stored(twins, "exact-twins"))
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    same = lambda left, right: left[inner[doc_id]].eqNullSafe(right["__id"]) & (left["__sha"] == right["__key"])
    named = fingerprints(df.toDF(*inner.values()), inner[text]).drop("__norm", "__print")
    stay = named.join(gone, same(named, gone), "left_anti")
    if twins.isEmpty():
        return stay.select(*inner.values()).toDF(*df.columns)
    single = stay.join(twins, same(stay, twins), "left_anti").select(*inner.values())
    least = stay.join(twins, same(stay, twins), "left_semi").groupBy(inner[doc_id], "__sha").agg(F.min(F.struct(*inner.values())).alias("row"))
    return single.unionByName(least.select("row.*")).toDF(*df.columns)


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows (ids and fingerprints) and shuffled if not."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP1_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by len desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by len desc, doc_id rows between unbounded preceding and unbounded following) as kept,
       text_sha256
from n
"""
