"""Exact k-means over integer vectors; a vector is looked at again only when its bounds no longer prove where it belongs.

Vectors are packed into blocks. In every block each cluster has a heap of its members, ordered by the gap between the lower bound of the
distance to any other centroid and the upper bound of the distance to the own one. Moving centroids shrink all gaps of a cluster by the same
drift, so a heap stores gap + drift at the time of entry and is not touched by later moves: members whose key is not above the drift
summed so far are popped, scanned exactly against all centroids and pushed into the heap of the nearest one.

Blocks are a table bucketed by block number, and so are the heaps between two rounds: a round joins both without a shuffle, writes the new
heaps and sends on only what the sums of the clusters changed by.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm.store import remove, shared_folder

SCALE = 1024
LARGEST = 2**26  # components in size: squared distances of a few thousand of them stay within 64 bits
BLOCK = 4096
SEED = "3:"


def whole_vectors(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as floor(1024 * x)) of a list column: exactly ``dim`` components, none null or non-finite."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    right = np.flatnonzero(lengths == dim)
    if not len(right):
        return right, np.empty((0, dim), np.int64)
    x = vectors.take(pa.array(right)).flatten().cast(pa.float64())
    x = x.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    fine = np.isfinite(x).all(axis=1)
    scaled = np.floor(SCALE * x[fine])
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"vector components beyond {LARGEST // SCALE} in size: their squared distances do not fit a long")
    return right[fine], scaled.astype(np.int64)


def _packed(dim: int, clusters: int):
    """(id, vector) rows -> blocks: number, ids, components, and the block's candidates for the first centroids."""

    def block(at: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        names = [hashlib.sha256(f"{SEED}{i}".encode()).hexdigest() for i in ids.tolist()]
        first = sorted(zip(names, x.tolist(), strict=True))[:clusters]
        seeds = [[{"h": h, "v": v} for h, v in first]]
        kind = pa.list_(pa.struct([("h", pa.string()), ("v", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array(seeds, kind)],
            ["block", "ids", "vectors", "seeds"],
        )

    def run(batches):
        at, held_ids, held, rows = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            keep, x = whole_vectors(b.column(1), dim)
            ids = b.column(0).take(pa.array(keep))
            known = np.asarray(ids.is_valid())
            held_ids.append(np.asarray(ids.fill_null(0), dtype=np.int64)[known])
            held.append(x[known])
            rows += int(known.sum())
            while rows >= BLOCK:
                ids, x = np.concatenate(held_ids), np.concatenate(held)
                yield block(at, ids[:BLOCK], x[:BLOCK])
                at, held_ids, held, rows = at + 1, [ids[BLOCK:]], [x[BLOCK:]], rows - BLOCK
        if rows:
            yield block(at, np.concatenate(held_ids), np.concatenate(held))

    return run


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact in 64 bits."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Heaps:
    """One heap of (gap + drift, member) for each cluster of a block."""

    def __init__(self, clusters: int, assigned: np.ndarray):
        self.assigned, self.heaps = assigned, [[] for _ in range(clusters)]

    @classmethod
    def load(cls, clusters: int, assigned: bytes, keys: bytes, members: bytes, sizes: bytes) -> Heaps:
        out, at = cls(clusters, np.frombuffer(assigned, np.int32).copy()), 0
        keys, members = np.frombuffer(keys, np.float64).tolist(), np.frombuffer(members, np.int32).tolist()
        for j, n in enumerate(np.frombuffer(sizes, np.int32).tolist()):
            out.heaps[j] = list(zip(keys[at : at + n], members[at : at + n], strict=True))  # stored in heap order
            at += n
        return out

    def dump(self) -> list[bytes]:
        keys, members = (np.array([e[k] for h in self.heaps for e in h], t) for k, t in ((0, np.float64), (1, np.int32)))
        return [self.assigned.tobytes(), keys.tobytes(), members.tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes()]

    def expired(self, drift: list[float]) -> np.ndarray:
        """Pops the members whose gap may be used up. A gap of exactly nothing counts: on a tie the smaller cluster number wins."""
        out = []
        for heap, moved in zip(self.heaps, drift, strict=True):
            while heap and heap[0][0] <= moved:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def place(self, members: np.ndarray, d: np.ndarray, drift: list[float]) -> None:
        """Pushes members with squared distances ``d`` to all centroids into the heap of the nearest."""
        nearest = d.argmin(axis=1)
        own = np.sqrt(d[np.arange(len(d)), nearest].astype(float))
        rest = d.astype(float)
        rest[np.arange(len(d)), nearest] = np.inf
        other = np.sqrt(rest.min(axis=1))
        gap = np.where(np.isinf(other), np.inf, other - own - 1e-6 - 1e-12 * (np.where(np.isinf(other), 0, other) + own))  # roots and sums are rounded
        self.assigned[members] = nearest
        for m, j, g in zip(members.tolist(), nearest.tolist(), gap.tolist(), strict=True):
            heapq.heappush(self.heaps[j], (g + drift[j], m))


_STATE = "block long, assigned binary, keys binary, members binary, sizes binary, delta array<long>, scanned long"


def _round(dim: int, centroids: np.ndarray, drift: list[float], first: bool):
    """One assignment of all blocks; ``delta`` is what sums (cluster by cluster) and counts change by."""
    k = len(centroids)

    def step(vectors: bytes, state: tuple | None) -> list:
        packed = np.frombuffer(vectors, np.int32).reshape(-1, dim)
        heaps = Heaps(k, np.full(len(packed), -1, np.int32)) if state is None else Heaps.load(k, *state)
        again = np.arange(len(packed)) if state is None else heaps.expired(drift)
        x = packed[again].astype(np.int64)
        before = heaps.assigned[again].copy()
        if len(again):
            heaps.place(again, distances(x, centroids), drift)
        after = heaps.assigned[again]
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        moved = before != after
        for rows, sign in ((moved, 1), (moved & (before >= 0), -1)):
            to = (after if sign > 0 else before)[rows]
            np.add.at(sums, to, sign * x[rows])
            np.add.at(counts, to, sign)
        return [*heaps.dump(), np.concatenate([sums.ravel(), counts]).tolist(), len(again)]

    def run(batches):
        kinds = [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.int64()]
        for b in batches:
            for i in range(len(b)):
                got = [b.column(c)[i].as_py() for c in range(b.num_columns)]
                out = step(got[1], None if first else tuple(got[2:6]))
                yield pa.RecordBatch.from_arrays([pa.array([got[0]], pa.int64()), *(pa.array([v], t) for v, t in zip(out, kinds, strict=True))], ["block", "assigned", "keys", "members", "sizes", "delta", "scanned"])

    return run


def _members(dim: int, centroids: np.ndarray):
    """Blocks with their assignment -> one row per vector, with the exact distance to its centroid."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                ids = np.frombuffer(b.column(0)[i].as_py(), np.int64)
                own = np.frombuffer(b.column(2)[i].as_py(), np.int32)
                d = np.frombuffer(b.column(1)[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64) - centroids[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(np.einsum("ij,ij->i", d, d))], ["id", "cluster", "distance"])

    return run


class _Bucketed:
    """A table in the shared folder, bucketed by ``block``; gone after ``drop``."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"centroids_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        df.write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(self.name)

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def _total(delta: DataFrame, column: str) -> dict[int, int]:
    """Sums of an array column by place, exact; as many rows as a block's array has places."""
    rows = delta.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {r["at"]: int(r["v"]) for r in rows.collect()}


def rounds(blocks: _Bucketed, buckets: int, start: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, _Bucketed]]:
    """(centroids, assignment to them) before each of ``n`` updates and after the last one. An earlier state is gone once the next is asked for."""
    k, dim = start.shape
    centroids, drift, state = start, [0.0] * k, None
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    for number in range(n + 1):
        rows = blocks.df().select("block", "vectors")
        if state is not None:
            rows = rows.join(state.df().select("block", "assigned", "keys", "members", "sizes").hint("merge"), "block")
        new = _Bucketed(rows.mapInArrow(_round(dim, centroids, drift, state is None), _STATE), buckets)
        if state is not None:
            state.drop()
        state = new
        yield centroids, state
        if number == n:
            return
        change = _total(state.df(), "delta")
        for j in range(k):
            sums[j] = [s + change.get(j * dim + i, 0) for i, s in enumerate(sums[j])]
            counts[j] += change.get(k * dim + j, 0)
        moved = np.array([[s // counts[j] for s in sums[j]] if counts[j] else centroids[j].tolist() for j in range(k)], np.int64)
        step = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(centroids.tolist(), moved.tolist(), strict=True)]
        for j in range(k):
            others = max((s for i, s in enumerate(step) if i != j), default=0.0)
            drift[j] += (step[j] + others) * (1 + 1e-12)
        centroids = moved


def clustered(embeddings: DataFrame, clusters: int = 8, n_rounds: int = 10, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, final centroids) after ``n_rounds`` updates and a last assignment.

    Kept are rows with an id and exactly ``dim`` components, none null or non-finite; each component becomes floor(1024 * x), and one beyond
    65,536 in size is an error. The first centroids are the vectors with the smallest sha256 of ``3:<id>`` (of equal ids, the smaller
    vector first); with fewer vectors than ``clusters`` there are as many clusters as vectors. Repeated rows are separate vectors. Ties go
    to the smaller cluster number, an empty cluster keeps its centroid. Other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    packed = rows.mapInArrow(_packed(dim, clusters), "block long, ids binary, vectors binary, seeds array<struct<h string, v array<long>>>")
    # one block is about a megabyte: some 16 to a bucket, and at least as many buckets as cores while blocks are few
    buckets = max(spark.sparkContext.defaultParallelism, rows.count() // (16 * BLOCK))
    blocks = _Bucketed(packed.repartition(buckets, "block"), buckets)
    seeds = blocks.df().select(F.explode("seeds").alias("s")).select("s.*").orderBy("h", "v").limit(clusters).collect()
    start = np.array([s["v"] for s in seeds], np.int64).reshape(-1, dim)
    if not len(start):
        blocks.drop()
        return spark.createDataFrame([], "id long, cluster int, distance long"), start
    for centroids, state in rounds(blocks, buckets, start, n_rounds):
        pass
    final = blocks.df().select("block", "ids", "vectors").join(state.df().select("block", "assigned").hint("merge"), "block")
    return final.select("ids", "vectors", "assigned").mapInArrow(_members(dim, centroids), "id long, cluster int, distance long"), centroids


def clusters(embeddings: DataFrame, n_clusters: int = 8, n_rounds: int = 10, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector (see ``clustered``): id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = clustered(embeddings, n_clusters, n_rounds, dim, id_col, vec_col)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), "cluster", "distance", *(F.lit(None).cast("long").alias(c) for c in ("cluster_inertia", "inertia")), F.lit(None).cast("string").alias("centroid_sha256"))
    spent = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(j, spent.get(j, 0), sum(spent.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    table = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # as many rows as clusters
    return rows.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
