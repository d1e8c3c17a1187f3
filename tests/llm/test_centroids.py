"""Clustering against the plain algorithm."""

import hashlib
import os

import numpy as np
import pytest
from cases import clashing
from compare import compare, connection
from pyspark.sql import functions as F
from wireloom.llm import centroids as C
from wireloom.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=3, rounds=4, dim=4):
    """rows: (id, list). Returns {(id, cluster, distance)} as a sorted list, and the centroids."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), cents


def run(spark, rows, k=3, rounds=4, dim=4):
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got, cents = C.clustered(df, k, rounds, dim)
    return sorted((r["id"], r["cluster"], r["distance"]) for r in got.collect()), cents.tolist()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [nan, 0.0, 0.0, 0.0]), (105, [inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(40)] + [(7, rows[7][1]), (7, [0.0] * 4)]  # a third alike, repeated ids
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.0] * 4)], [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(9)], [(None, None)]])
def test_few_or_equal(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(0, 3, 4) / 1024 + rng.integers(0, 3)).tolist()) for i in range(500)]  # many ties
    assert run(spark, rows, 8, 10) == plain(rows, 8, 10)


def test_too_large(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(1, [1e9, 0.0, 0.0, 0.0])])


def test_bounds_save_scans(spark, sf):
    """Later rounds look at few of the vectors again."""
    df = spark.read.parquet(os.path.join(sf, "embeddings.parquet"))
    packed = df.select("vec_id", "embedding").mapInArrow(C._packed(64, 8), "block long, ids binary, vectors binary, seeds array<struct<h string, v array<long>>>")
    blocks = C._Bucketed(packed, 2)
    start = np.array([s["v"] for s in blocks.df().select(F.explode("seeds").alias("s")).select("s.*").orderBy("h").limit(8).collect()])
    scanned = [state.df().agg(F.sum("scanned")).first()[0] for _, state in C.rounds(blocks, 2, start, 10)]
    n = df.count()
    assert scanned[0] == n and min(scanned[1:]) < n


def test_no_exchange_between_rounds(spark, sf):
    df = spark.read.parquet(os.path.join(sf, "embeddings.parquet"))
    got, _ = C.clustered(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_query(spark, sf):
    n, error = compare(spark, connection(sf), "op11", Q.QUERIES["op11_centroids"], Q.ORACLES["op11_centroids"], sf)
    assert error is None and n > 0
