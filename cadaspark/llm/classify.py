"""What the two text classifiers share: the training sample, the training task and scoring.

A model is fitted in one task on a sample of labelled rows whose size is bounded by a parameter
(``most`` rows of each class, those with the least hash of the id); it is a few megabytes of weights
whatever the size of the corpus.  Scoring reads every row and whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.common import clear_text, freed, groups, id_remainder, stored


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """``text`` and ``label`` of at most ``most`` rows of each class, none of them held out.

    Rows whose label is not 0 or 1 and ids that have both labels are left out.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & (id_remainder("doc_id", modulus) != held) & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("high")).filter("label = high").drop("high")
    parts = [one.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]), "train-ids")
    rows = docs.select(F.col("doc_id").alias("doc_id"), clear_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label")


def fitted(rows: DataFrame, fit: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights that ``fit`` makes of the sample, in one task; the result has a fixed size."""

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "label": []})]).sort_values("doc_id")
        weights = fit(data["text"].tolist(), data["label"].to_numpy(np.int64))
        yield pd.DataFrame({"weights": [np.asarray(weights, np.float32).tobytes()]})

    model = stored(rows.repartition(1).mapInPandas(run, "weights binary"), "model")
    row = model.first()
    return fit([], np.zeros(0, np.int64)).astype(np.float32) if row is None else np.frombuffer(row["weights"], np.float32)


def scored(docs: DataFrame, weights: np.ndarray, score: Callable[[list[str], np.ndarray], np.ndarray], modulus: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_remainder("doc_id", modulus) == held).alias("held_out"), clear_text().alias("text"))

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                s = score(part.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
