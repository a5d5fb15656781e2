"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.operators.graph import shared_folder

#: Characters that count as white space in texts: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: UTF-8 bytes that a task handles at once (a longer text makes a group of its own).
GROUP_BYTES = 1 << 20
ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: A key that occurs so often is common: at least this often, and more often than one in ``SHARE`` of all rows,
#: so there are fewer than ``SHARE`` common keys in any table.
OFTEN, SHARE = 1000, 2000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return shared_folder(spark, name)


def small_batches(spark: SparkSession) -> None:
    """Lets the session send at most ``ARROW_ROWS`` rows to a Python worker at once.

    Executors and workers hold whole Arrow batches, and rows of texts are long.
    """
    if int(spark.conf.get(ARROW_BATCH)) > ARROW_ROWS:
        spark.conf.set(ARROW_BATCH, str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clear_text(text: str = "text") -> F.Column:
    """The text with nulls as empty strings."""
    return F.coalesce(F.col(text), F.lit(""))


def id_remainder(doc_id: str, modulus: int) -> F.Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def groups(batch: pa.RecordBatch, text: str = "text", most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``most`` bytes together (one row at least)."""
    sizes = batch.column(text).combine_chunks() if isinstance(batch.column(text), pa.ChunkedArray) else batch.column(text)
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at its end the worker gives its free memory back to the system.

    Workers wait for their next task for a while, beside executors that need the memory by then.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def joined_by_count(left: DataFrame, right: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` (a stored table) with the rows of ``right``, which has a row a key and the key's ``count`` in ``left``.

    ``how`` is inner or left; key columns have no nulls.

    The common keys, fewer than ``SHARE``, are joined by broadcast, so no task gets all rows of one;
    the others are shuffled.
    """
    common = F.col(count) > F.lit(max(OFTEN, left.count() // SHARE))
    often, rare = right.filter(common).drop(count), right.filter(~common).drop(count)
    rest = left.join(F.broadcast(often.select(*key)), key, "left_anti")
    return left.join(F.broadcast(often), key).unionByName(rest.join(rare, key, how))
