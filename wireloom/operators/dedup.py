"""Exact duplicate removal: first occurrence per capture wins, identity is the packet bytes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.ratios import percent

PCAP_RECORD_HEADER = 16  # fixed value of the capture file format


def digest(raw: str | Column = "raw", algorithm: str = "sha256") -> Column:
    raw = raw if isinstance(raw, Column) else F.col(raw)
    if algorithm == "md5":
        return F.md5(raw)
    if algorithm == "sha1":
        return F.sha1(raw)
    if algorithm == "sha256":
        return F.sha2(raw, 256)
    raise ValueError(f"unknown digest: {algorithm}")


def first_copies(packets: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``(capture_id, frame_no)`` of the packets to keep, with copy counts.

    Only digests are shuffled and they are pre-aggregated map-side, so a packet repeated a billion times costs one row per map task.
    A packet without bytes has no digest and is kept as unique.
    """
    key = F.coalesce(digest("raw", algorithm), F.concat(F.lit("#"), F.col("frame_no")))
    return (
        packets.select("capture_id", "frame_no", key.alias("digest"))
        .groupBy("capture_id", "digest")
        .agg(F.min("frame_no").alias("frame_no"), F.count("*").alias("copies"))
    )


def remove_duplicates(packets: DataFrame, algorithm: str = "sha256") -> DataFrame:
    winners = first_copies(packets, algorithm).select("capture_id", "frame_no")
    return packets.join(winners, ["capture_id", "frame_no"], "left_semi")


def dedup_stats(packets: DataFrame, algorithm: str = "sha256") -> DataFrame:
    per_digest = first_copies(packets, algorithm)
    totals = per_digest.groupBy("capture_id").agg(
        F.sum("copies").alias("total_packets"), F.count("*").alias("unique_packets")
    )
    removed = F.col("total_packets") - F.col("unique_packets")
    return totals.withColumn("removed_packets", removed).withColumn(
        "dedup_rate", percent(F.col("removed_packets"), F.col("total_packets"))
    )


def space_saved(packets: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Bytes before/after: equal bytes have equal length, so sizes come from the digest groups without a join."""
    size = F.length("raw") + PCAP_RECORD_HEADER
    groups = (
        packets.select("capture_id", digest("raw", algorithm).alias("digest"), size.cast("bigint").alias("size"))
        .groupBy("capture_id", "digest")
        .agg(F.sum("size").alias("bytes_in"), F.max("size").alias("bytes_out"))
    )
    out = groups.groupBy("capture_id").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    out = out.withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_out"))
    return out.withColumn("saved_rate", percent(F.col("bytes_saved"), F.col("bytes_in")))


def top_duplicates(packets: DataFrame, k: int = 10, algorithm: str = "sha256") -> DataFrame:
    return (
        packets.select(digest("raw", algorithm).alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
        .orderBy(F.desc("copies"), "digest")
        .limit(k)
    )
