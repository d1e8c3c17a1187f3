"""The row-wise and keyed operators on a stream of landed packet tables.

These are the batch operators with a watermark, for packets that keep arriving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.operators.anonymise import anonymise_packets
from wireloom.operators.dedup import digest
from wireloom.operators.flows import FLOW, with_flow_keys


def read_landed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def remove_duplicates(packets: DataFrame, delay: str = "10 minutes", algorithm: str = "sha256") -> DataFrame:
    """First copy within the watermark wins; state is one digest per packet and expires with the watermark."""
    keyed = packets.withColumn("digest", digest("raw", algorithm)).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["capture_id", "digest"]).drop("digest")


def anonymise(packets: DataFrame, key: str) -> DataFrame:
    """Stateless: the keyed map needs no memory of earlier addresses."""
    return anonymise_packets(packets, key)


def flow_sessions(packets: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Packets and bytes per flow-direction and activity session."""
    keyed = with_flow_keys(packets).withWatermark("ts", delay)
    s = keyed.groupBy(*FLOW, "direction", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))
    return s.select(*FLOW, "direction", F.col("session.start").alias("first_seen"), F.col("session.end").alias("closes"), "packets", "bytes")
