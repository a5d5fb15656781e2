"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task turns to stars at once.
EDGES_A_TASK = 200_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a session on this machine alone takes a temporary folder; a
    session on a cluster gets an error, as executors could not read one another's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write as Parquet below the shared folder and read back, which cuts the lineage; with the folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that no plan reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: each node but a component's least, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, p, q)
        np.minimum.at(root, q, p)
        while (root[root] != root).any():
            root = root[root]
    points = root != np.arange(len(nodes))
    return nodes[points], nodes[root[points]]


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges that connect the same nodes: in ``tasks`` tasks, groups of a bounded number of edges become stars."""
    most = EDGES_A_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            ends = [np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in stars(*ends)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield flush()
        if held:
            yield flush()

    return edges.coalesce(tasks).mapInArrow(run, "a bigint, b bigint")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node reachable over ``links`` (``a``, ``b``).

    Each task contracts its own edges to stars; edges that fill one task alone are done then, those of
    several go on by large and small stars, so the number of rounds does not grow with a component's width.
    """
    spark = nodes.sparkSession
    ends = lambda f: f(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    plain, folder = write_table(links.filter("a <> b").select(ends(F.greatest).alias("a"), ends(F.least).alias("b")).distinct(), "ways")
    tasks = 1 + plain.count() // EDGES_A_TASK
    edges, now = write_table(contracted(plain, tasks), "stars")
    removed(spark, folder)
    seen, folder = None, now
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.toDF("a", "b"))
        edges, now = write_table(contracted(small.filter("a <> b").distinct(), tasks), "stars")
        removed(spark, folder)
        folder = now
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    named = nodes.select("node").join(edges.toDF("node", "root"), "node", "left")
    return written(named.select("node", F.coalesce(F.col("root").cast(dict(nodes.dtypes)["node"]), "node").alias("component")), "labels")
