"""What both text classifiers share: the bounded training sample and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import small_batches

#: Rows of features that the JVM and a task exchange at once; a row may have as many buckets as its text has characters.
BATCH = 256


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``rows`` labelled texts, those whose id hashes lowest; ``learn`` says by id which may be used.

    Rows without id or label are left out; of several labels for one id the largest counts. The list of ids is at most ``rows`` long and
    so may be broadcast. Result: ``text``, ``label`` (0 or 1).
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull())
        .withColumn(id_col, F.col("_id")).where(learn)
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "_id").select("_id", "text", "label")


def fitted(rows: DataFrame, features: Callable, fit: Callable, size: int) -> np.ndarray:
    """Features are made where the rows are; ``fit(list of index arrays, labels)`` runs over the bounded sample in one task and gives ``size`` weights.

    Of rows that repeat an id one is learnt from, the one with the smallest features.
    """

    def indices(batches):
        for b in batches:
            ids, texts, marks = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([features(t).astype(np.uint32).tobytes() for t in texts], pa.binary()), pa.array(marks, pa.int32())],
                ["id", "x", "label"],
            )

    def train(batches):
        got = sorted((len(i), i, x, y) for b in batches for i, x, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        w = fit([np.frombuffer(x, np.uint32) for _, _, x, _ in got], np.array([y for *_, y in got], float))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(w, np.float32).tobytes()], pa.binary())], ["w"])

    packed = rows.select(F.col("_id").cast("string"), "text", "label").mapInArrow(indices, "id string, x binary, label int")
    packed = packed.groupBy("id").agg(F.min("x").alias("x"), F.first("label").alias("label"))
    with small_batches(rows.sparkSession, BATCH):
        out = packed.repartition(1).mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(out[0][0]), np.float32) if out else np.zeros(size, np.float32)


def probability(z: float) -> float:
    """The logistic function; the clip keeps results strictly inside 0 and 1."""
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scored(docs: DataFrame, margin: Callable, id_col: str, text_col: str, key: Column) -> DataFrame:
    """``id_col``, ``key`` (a boolean of the row), ``score`` and ``predicted`` for every row."""

    def run(batches):
        for b in batches:
            s = np.array([probability(margin(t)) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["i", "k", "s", "p"])

    rows = docs.select(F.col(id_col).alias("i"), key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, k boolean, s double, p int")


def kept_rows(docs: DataFrame, wanted: Callable, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``wanted(text)`` accepts."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([bool(wanted(t or "")) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
