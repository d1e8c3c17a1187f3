"""How often masking runs the plan of its packets, and how many pairs the joins of ranges form."""

from pyspark.sql import functions as F
from wireloom.operators import mask as mk
from wireloom.operators import reassembly as ra

N = 2000


def _packets(spark):
    return spark.range(0, N, 1, 2).select(
        F.lit("c").alias("capture_id"), F.lit("t").alias("tuple_key"), F.lit("forward").alias("direction"), F.col("id").alias("frame_no"), (F.col("id") * 10).alias("seq"),
        F.lit(10).cast("bigint").alias("len"), F.lit(b"abcdefghij").alias("payload"), F.lit("tcp").alias("proto"))


def test_masking_runs_the_plan_of_its_packets_twice(spark):
    seen, packets = spark.sparkContext.accumulator(0), _packets(spark)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rules = packets.select(*ra.KEY, F.col("seq").alias("seq_start"), (F.col("seq") + 4).alias("seq_end"))
    out = mk.mask_payloads(packets.mapInArrow(count, packets.schema), rules).agg(F.sum("kept_bytes"), F.count_if("payload_modified"), F.count("*")).first()
    assert tuple(out) == (4 * N, N, N)
    assert seen.value <= 2 * N


def test_offsets_in_small_buckets(spark):
    off = ra.concat_offsets(_packets(spark)).localCheckpoint()
    points = off.select(*ra.KEY, (F.col("stream_off") + 3 + F.when(F.col("frame_no") % 50 == 0, 10**7).otherwise(0)).alias("off"))
    found = {r["off"]: r["seq"] for r in ra.offset_to_sequence(points, off).collect()}
    assert found == {i * 10 + 3 + (10**7 if i % 50 == 0 else 0): 0 if i % 50 == 0 else i * 10 + 3 for i in range(N)}
