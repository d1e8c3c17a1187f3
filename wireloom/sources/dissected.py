"""Frame exports of a dissector (JSON lists of ``_source.layers`` maps) as frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exported field names.
FIELDS = (
    "frame.number", "frame.protocols", "frame.time_relative", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst", "tcp.srcport", "tcp.dstport", "tcp.stream",
    "tcp.seq", "tcp.seq_raw", "tcp.len", "tcp.payload", "tls.record.content_type", "tls.record.opaque_type", "tls.record.length",
    "tls.record.version", "tls.app_data", "tls.segment.data",
)


def read_frames(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per exported frame, ready for the frame operators.

    Values come as a string or a list of strings; both are read as text and normalised to arrays.  Exports written as JSON lines
    (``multi_line=False``) split at any line and should be preferred for large inputs.
    """
    layers = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
    schema = T.StructType([T.StructField("_source", T.StructType([T.StructField("layers", layers)]))])
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    raw = raw.withColumn("capture_id", F.col("_metadata.file_name"))
    return project_frames(raw.select("capture_id", F.col("_source.layers").alias("layers")).where("layers IS NOT NULL"))


def as_list(text: Column) -> Column:
    """Scalar or JSON list text to ARRAY<STRING>; missing becomes empty."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.startswith(text, F.lit("[")), listed).otherwise(F.array(text))


def project_frames(exported: DataFrame) -> DataFrame:
    field = lambda n: as_list(F.col("layers").getField(n))
    first = lambda n: F.try_element_at(field(n), F.lit(1))
    num = lambda n: first(n).try_cast("bigint")
    return exported.select(
        "capture_id", num("frame.number").alias("frame_no"), first("frame.protocols").alias("protocols"), first("frame.time_relative").try_cast("double").alias("time_relative"),
        F.coalesce(first("ip.src"), first("ipv6.src")).alias("src_ip"), F.coalesce(first("ip.dst"), first("ipv6.dst")).alias("dst_ip"),
        num("tcp.srcport").alias("sport"), num("tcp.dstport").alias("dport"), F.coalesce(first("tcp.stream"), F.lit("unknown")).alias("stream_id"),
        F.coalesce(num("tcp.seq_raw"), num("tcp.seq"), F.lit(0)).alias("seq_raw"), F.coalesce(num("tcp.len"), F.lit(0)).alias("len"),
        F.try_to_binary(F.regexp_replace(first("tcp.payload"), "[: ]", ""), F.lit("hex")).alias("payload"),
        field("tls.record.content_type").alias("content_types"), field("tls.record.opaque_type").alias("opaque_types"), field("tls.record.length").alias("lengths"),
        field("tls.record.version").alias("versions"), field("tls.app_data").alias("app_data"), field("tls.segment.data").alias("segment_data"))
