"""Token ids in Arrow files with fixed-size-list batches.

A shard holds the ids of a range of documents as one stream, cut into sequences of equal length:

* ``<shard>.arrow``: Arrow file format, columns ``ids`` (fixed-size list of unsigned 16- or 32-bit
  integers) and ``mask`` (fixed-size list of booleans, false in the padding of a shard's last row).
  Row ``i`` of a batch is at a fixed place, so readers that map the file get any sequence without
  copying or decoding;
* ``<shard>.docs.arrow``: ``doc_id``, ``start`` (place in the shard's stream) and ``n_tokens``.

Files carry the attempt's own random name; only those that the manifest (a Parquet table with a row
a shard, committed by Spark) names belong to the data set, so lost executors and repeated tasks
leave stray files at worst, never a wrong set.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadaspark.llm import pretokens
from cadaspark.llm.common import clear_text, documents, freed, groups, shared_dir, small_batches
from cadaspark.llm.token_counts import byte_letters

SEQUENCE = 1024
BATCH_ROWS = 1024
END_ID = 0
#: Pre-tokens that a worker remembers at most.
KEPT = 800_000


class Encoder:
    """Ids by the tokenizers library; each distinct pre-token is encoded once and remembered.

    Byte-level BPE never joins over the borders of pre-tokens, so a text's ids are those of its
    pre-tokens one after another; the library's model encodes them, without the steps around it.
    """

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        self.model = library.model
        self.letters = {b: letter for letter, b in byte_letters().items()}
        added = library.get_added_tokens_decoder()
        self.special = tuple(t.content for t in added.values())
        self.own = {t.content.encode(): np.array([i], np.uint32).tobytes() for i, t in added.items()}
        self.known = dict(self.own)

    def encode_word(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]).tobytes()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as unsigned 32-bit integers."""
        if len(self.known) > KEPT:
            self.known = dict(self.own)
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by ``end_id``, and the texts' counts."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words, first = pretokens.split(texts, self.special)
        coded = words.dictionary_encode()
        distinct = self.ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(distinct), np.uint32)
        index = coded.indices.to_numpy()
        # the pre-token that leads each text turns into the end id of the text before it
        flat, begins, sizes = np.append(flat, np.uint32(end_id)), np.append(begins, len(flat)), np.append(sizes, 1)
        order = np.append(index, len(distinct))
        order[first] = len(distinct)
        order = order[1:]
        take = sizes[order]
        ends = np.cumsum(take)
        ids = flat[np.repeat(begins[order] - (ends - take), take) + np.arange(ends[-1])]
        upto = ends[np.append(first[1:] - 1, len(order) - 1)]
        return ids, np.diff(upto, prepend=0)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class ShardWriter:
    """Writes one shard: a stream of ids as rows of equal length."""

    def __init__(self, folder: str, id_type: pa.DataType, sequence: int):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path)
        self.name, self.sequence, self.id_type = uuid.uuid4().hex, sequence, id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.store.open_output_stream(f"{path}/{self.name}{end}") for end in (".arrow", ".docs.arrow")]
        self.ids, self.index = ipc.new_file(self.sinks[0], self.schema), ipc.new_file(self.sinks[1], self.index_schema)
        self.rest, self.total = np.zeros(0, id_type.to_pandas_dtype()), 0

    def put(self, values: np.ndarray, used: int) -> None:
        mask = np.arange(len(values)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.sequence) for x, t in ((values, self.id_type), (mask, pa.bool_()))]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.index_schema))
        self.total += int(sizes.sum())
        self.rest = np.concatenate([self.rest, ids.astype(self.rest.dtype)])
        step = self.sequence * BATCH_ROWS
        while len(self.rest) >= step:
            self.put(self.rest[:step], step)
            self.rest = self.rest[step:]

    def close(self) -> None:
        if used := len(self.rest):
            self.put(np.append(self.rest, np.zeros(-used % self.sequence, self.rest.dtype)), used)
        for x in (self.ids, self.index, *self.sinks):
            x.close()


def write_token_files(df: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Encode ``df`` and write shards in ascending ``doc_id`` order; returns the manifest.

    The manifest has a row a shard: ``shard`` (its place in the order), ``name`` and ``n_tokens``.
    Rows are dealt out by ranges of ``doc_id`` (null first, ties by text), so a shard is one range
    and shards follow one another; no task sees more than its range.  Null texts count as empty and
    give the end id alone; repeated rows are encoded as often as they occur; an empty table gives an
    empty manifest.  Columns other than the id and the text are not read.
    """
    small = Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16
    id_type = pa.uint16() if small else pa.uint32()
    rows = df.select(df[doc_id].cast("bigint").alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    small_batches(df.sparkSession)
    runs = pretokens.kind_runs()

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens.give(runs)
        writer, shard = None, 0
        for batch in batches:
            for part in groups(batch):
                if writer is None:
                    writer, shard = ShardWriter(f"{folder}/shards", id_type, sequence), part.column("shard")[0].as_py()
                writer.add(part.column("doc_id"), *encoder(tokenizer).encode(part.column("text").to_pylist(), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": writer.name, "n_tokens": writer.total}], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_tokens", pa.int64())]))

    rows.mapInArrow(run, "shard int, name string, n_tokens bigint").write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def opened(folder: str, name: str) -> ipc.RecordBatchFileReader:
    """The file, mapped into memory where the store is a file system."""
    store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    return ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def sequence_at(folder: str, name: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a shard, as views of the mapped file."""
    batch = opened(f"{folder}/shards", f"{name}.arrow").get_batch(row // BATCH_ROWS)
    size = batch.column(0).type.list_size
    i = row % BATCH_ROWS * size
    return batch.column(0).flatten()[i : i + size].to_numpy(), batch.column(1).flatten()[i : i + size].to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row a document, from the files: doc_id, start in the whole data set, n_tokens, ids_crc32.

    Repeated rows of the written table are rows of their own, null ids stay null; an empty data set
    gives an empty result.  Only the manifest's shards are read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    placed = manifest.select("name", before.alias("before"), "n_tokens").repartition(spark.sparkContext.defaultParallelism * 4, "name")

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                file = opened(f"{folder}/shards", f"{shard['name']}.arrow")
                views = [file.get_batch(i).column(0).flatten().to_numpy() for i in range(file.num_record_batches)]
                cuts = np.cumsum([0, *map(len, views)])
                index = opened(f"{folder}/shards", f"{shard['name']}.docs.arrow")
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    sums = []
                    for first, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                        k, crc = int(np.searchsorted(cuts, first, "right")) - 1, 0
                        while n > 0:
                            ids = views[k][first - cuts[k] : first - cuts[k] + n]
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            first, n, k = first + len(ids), n - len(ids), k + 1
                        sums.append(crc)
                    start = pa.array(part.column("start").to_numpy() + shard["before"], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), start, part.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    write_token_files(documents(spark, sf_dir).select("doc_id", clear_text().alias("text")), tokenizer, folder)
    return read_token_files(spark, folder)
