"""Flow keys, directions, stream numbers and flow summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.scan import running_count
from wireloom.operators.skew import lookup

FLOW = ["capture_id", "tuple_key"]


def _forward() -> Column:
    """Lower endpoint is the source: addresses compare as text, ports as numbers."""
    return (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("sport") < F.col("dport")))


def tuple_key() -> Column:
    a = F.concat(F.col("src_ip"), F.lit(":"), F.col("sport"))
    b = F.concat(F.col("dst_ip"), F.lit(":"), F.col("dport"))
    return F.when(_forward(), F.concat(a, F.lit("-"), b)).otherwise(F.concat(b, F.lit("-"), a))


def with_flow_keys(packets: DataFrame) -> DataFrame:
    return packets.withColumns(
        {"tuple_key": tuple_key(), "direction": F.when(_forward(), F.lit("forward")).otherwise(F.lit("reverse"))}
    )


def stream_ordinals(packets: DataFrame) -> DataFrame:
    """Dense stream number by first appearance in the capture (text, from 0). Expects flow keys."""
    first = packets.groupBy(*FLOW).agg(F.min("frame_no").alias("first_frame"))
    numbered = running_count(first, ["capture_id"], "first_frame", "stream_no")
    return numbered.select(*FLOW, "first_frame", F.col("stream_no").cast("string").alias("stream_id"))


def first_packet_direction(packets: DataFrame) -> DataFrame:
    """Alternative orientation per flow: forward starts at the endpoint that sent the first packet."""
    client = F.concat(F.col("src_ip"), F.lit(":"), F.col("sport"))
    server = F.concat(F.col("dst_ip"), F.lit(":"), F.col("dport"))
    return packets.groupBy(*FLOW).agg(F.min_by(client, "frame_no").alias("client"), F.min_by(server, "frame_no").alias("server"))


def flow_summary(packets: DataFrame) -> DataFrame:
    """Packets, payload bytes and first/last time per flow and direction; one partially aggregated shuffle."""
    return packets.groupBy(*FLOW, "direction").agg(
        F.min("src_ip").alias("src_ip"),
        F.min("sport").alias("src_port"),
        F.min("dst_ip").alias("dst_ip"),
        F.min("dport").alias("dst_port"),
        F.count("*").alias("packet_count"),
        F.sum("len").cast("bigint").alias("byte_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def select_streams(packets: DataFrame, predicate: Column) -> DataFrame:
    """All packets of the flows in which at least one packet satisfies ``predicate`` (one semi join instead of a scan per stream).

    The flow list is joined per frame block, so the packets of a hot flow are spread over many tasks.
    """
    wanted = packets.where(predicate).select(*FLOW).distinct()
    return lookup(packets, wanted, FLOW, how="left_semi")
