"""Best-fit packing into sequences of several permitted lengths.

Pieces of documents are packed in windows of bounded size, where they lie: no shuffle and no group.
Where an order is given (the slots of a mixture), rows are dealt by ranges of it, windows are filled
in it and bins are numbered by it: by the first of their pieces.  In a window, pieces go longest first to the open bin
that they fill best; a piece that fits in none opens a bin of the length with the least cost for
each token that it can be expected to hold.  All permitted lengths take part in one choice, against
the plans that prefer one length throughout, and the plan of least cost wins; at the end every bin
shrinks to the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.llm.common import clear_text, documents, freed, stored
from cadaspark.llm.mixing import in_order, order_of
from cadaspark.llm.token_counts import token_counts

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that are packed together.
WINDOW = 16384
#: A sequence's fixed cost in tokens, and the length at which attention doubles a token's cost.
FIXED, DOUBLE = 64, 16384


def cost(length: int) -> float:
    return FIXED + length + length * length / DOUBLE


def pack(sizes: np.ndarray, lengths: tuple[int, ...], prefer: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Bin and offset of each piece, each bin's final length, and the whole cost."""
    order = np.argsort(-sizes, kind="stable")
    rest = int(sizes.sum())
    free: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    used: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order:
        size = int(sizes[i])
        rest -= size
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            fits = [c for c in lengths if c >= size]
            if prefer is None:
                room = min(fits, key=lambda c: (cost(c) / max(1, min(c, size + rest)), c))
            else:
                room = max(fits[0], prefer) if prefer >= size else fits[0]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(free, (room - size, b))
    final = np.array([next(c for c in lengths if c >= u) for u in used], np.int64)
    return bins, offsets, final, float(sum(map(cost, final.tolist())))


def best_plan(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return min((pack(sizes, lengths, p) for p in (None, *lengths)), key=lambda plan: plan[3])


def best_fit(df: DataFrame, size: str, key: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, window: int = WINDOW, order: tuple[str, ...] = ()) -> DataFrame:
    """A row a piece: key, piece, start (in the document), length, bin_id, offset, capacity.

    ``size`` names the column with a row's tokens; null and negative sizes count as 0, and a row of
    size 0 is one piece of length 0.  Rows longer than the greatest permitted length are cut into
    pieces of that length and a rest.  Every row is packed once, repeated rows as often as they
    occur; null keys are keys like others; an empty table gives an empty result; other columns are
    not read.  Bins are full sequences of the window's partition; ``bin_id`` is unique.

    ``order`` names columns to pack by: windows follow it, and bins ascend with the first row in them.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = df.select(F.col(key).alias("key"), n.alias("n")).select("key", "n", F.explode(F.sequence(F.lit(0), F.greatest((F.col("n") - 1) / most, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * most
    pieces = pieces.select("key", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(most)).cast("bigint").alias("length"), F.spark_partition_id().alias("part"))

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, made = [], 0, 0

        def flush(data: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            bins, offsets, final, _ = best_plan(data["length"].to_numpy(np.int64), lengths)
            if order:  # number bins by their first piece
                firsts, where = np.unique(bins, return_index=True)
                rank = np.empty(len(firsts), np.int64)
                rank[firsts[np.argsort(where)]] = np.arange(len(firsts))
                bins, final = rank[bins], final[np.argsort(rank)]
            ids = (data["part"].to_numpy(np.int64) << 40) + made + bins
            made += len(final)
            return data[["key", "piece", "start", "length"]].assign(bin_id=ids, offset=offsets, capacity=final[bins])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= window:
                data = pd.concat(held, ignore_index=True)
                yield flush(data[:window])
                held, count = [data[window:]], count - window
        if count:
            yield flush(pd.concat(held, ignore_index=True))

    kind = pieces.schema["key"].dataType.simpleString()
    out = pieces.mapInPandas(run, f"key {kind}, piece int, start bigint, length bigint, bin_id bigint, offset bigint, capacity bigint")
    return out.withColumnRenamed("key", key)


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents packed by their tokens and one end token each.

    Where ``docs`` come from a mixture (:func:`cadaspark.llm.mixing.mixture`), windows and bins
    follow the order that it wrote, however the files of ``docs`` are read; else rows are packed
    where they lie.  The sizes are written between counting and packing, so that a
    task has one Python worker at a time and only as many workers as cores hold a tokenizer's tables.
    Null texts count as empty; repeated rows are packed as often as they occur; very long texts are
    cut into pieces; an empty table gives an empty result; other columns are not read but to find a
    row in the mixture's order.
    """
    order = order_of(docs)
    texts = docs.select("doc_id", *([] if order is None else [F.xxhash64(*docs.columns).alias("__digest")]), clear_text().alias("text"))
    counted = token_counts(texts, tokenizer)
    sizes = stored(counted.select(*[c for c in texts.columns if c != "text"], (F.col("n_tokens") + 1).alias("size")), "sizes")
    if order is None:
        return best_fit(sizes, "size")
    slots = stored(in_order(sizes, order, "__digest").select("doc_id", "size", "__slot", "__place"), "slots")
    return best_fit(slots, "size", order=("__slot", "__place"))


def op5(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), tokenizer)
