"""TCP stream reassembly as running aggregates over segments ``(capture_id, tuple_key, direction, frame_no, seq, len[, payload])``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.operators.scan import running
from wireloom.operators.skew import explode_buckets, lookup
from wireloom.operators.stage import materialise

KEY = ["capture_id", "tuple_key", "direction"]
BUCKET = 16384
NEAR = 2048  # bucket of a join in which every point meets every segment of its bucket
WRAP = 1 << 32


def unwrap_sequence(segments: DataFrame) -> DataFrame:
    """64-bit sequence numbers: each backward jump of more than 2^31 in capture order starts a new epoch.

    Jumps are found between neighbouring blocks of frames through their last value, so a hot flow is not one window.
    """
    blk = F.floor(F.col("frame_no") / 65536)
    base = segments.withColumn("__blk", blk)
    last = base.groupBy(*KEY, "__blk").agg(F.max_by("seq", "frame_no").alias("__last"))
    before = last.withColumn("__prev_block", F.lag("__last").over(Window.partitionBy(*KEY).orderBy("__blk"))).drop("__last")
    inside = Window.partitionBy(*KEY, "__blk").orderBy("frame_no")
    prev = F.coalesce(F.lag("seq").over(inside), F.col("__prev_block"))
    stepped = base.join(before, [*KEY, "__blk"]).withColumn("__prev", prev)
    step = F.when(F.col("__prev") - F.col("seq") > WRAP // 2, 1).when(F.col("seq") - F.col("__prev") > WRAP // 2, -1).otherwise(0).cast("bigint")
    counted = running(stepped.withColumn("__step", step), KEY, "frame_no", F.col("__step"), "__epoch", "sum", inclusive=True)
    return counted.withColumn("seq", F.col("seq") + F.col("__epoch") * WRAP).drop("__blk", "__prev_block", "__prev", "__step", "__epoch")


def concat_offsets(segments: DataFrame) -> DataFrame:
    """Stream offsets when segments are simply concatenated in (seq, frame) order; copies count again, gaps close.

    Bytes before a segment = bytes at smaller sequence numbers (over pre-aggregated numbers) + earlier copies at the same number.
    """
    slim = segments.where("len > 0")
    per_seq = slim.groupBy(*KEY, "seq").agg(F.sum("len").alias("__n"))
    below = running(per_seq, KEY, "seq", F.col("__n"), "__below").drop("__n")
    same = running(slim, [*KEY, "seq"], "frame_no", F.col("len"), "__same")
    out = lookup(same, below, [*KEY, "seq"])
    return out.withColumn("stream_off", (F.col("__below") + F.col("__same")).cast("bigint")).drop("__below", "__same")


def trimmed_segments(segments: DataFrame) -> DataFrame:
    """First writer wins: bytes already filled by a lower (seq, frame) are cut off, empty remainders dropped.

    Adds ``start``/``end`` (sequence range that this frame contributes), ``gap`` (bytes missing before it) and ``island`` (start of
    its contiguous stretch).  Only the first copy of an equal (seq, len) can contribute, so copies collapse before any sorting.  The
    result carries no payload and is read by several later steps, so it is written once.
    """
    slim = segments.where("len > 0").groupBy(*KEY, "seq", "len").agg(F.min("frame_no").alias("frame_no"))
    seen = running(slim, KEY, "seq", F.col("seq") + F.col("len"), "__prev", "max", tie_break=["frame_no", "len"])
    ranged = seen.withColumns({"start": F.greatest("seq", "__prev"), "end": F.col("seq") + F.col("len")}).where("start < `end`")
    ranged = ranged.withColumn("gap", F.coalesce(F.col("seq") > F.col("__prev"), F.lit(False)))
    first = F.when(F.col("__prev").isNull() | F.col("gap"), F.col("start"))
    out = running(ranged, KEY, "start", first, "island", "max", inclusive=True)
    return materialise(out.drop("__prev"))


def with_payload(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach the contributed bytes; the join key is unique per row, so payloads are spread evenly."""
    bytes_ = segments.select("capture_id", "frame_no", "payload")
    cut = F.expr("substring(payload, cast(start - seq + 1 AS int), cast(`end` - start AS int))")
    return pieces.join(bytes_, ["capture_id", "frame_no"]).withColumn("payload", cut)


def offset_to_sequence(points: DataFrame, segments_with_offsets: DataFrame) -> DataFrame:
    """Sequence number for stream offsets ``(key, off)``: bucketed range join; 0 when no segment holds the offset."""
    seg = segments_with_offsets.select(*KEY, F.col("seq").alias("__seq"), F.col("stream_off").alias("__a"), (F.col("stream_off") + F.col("len")).alias("__b"))
    seg = explode_buckets(seg, "__a", "__b", NEAR)
    pts = points.withColumn("__bucket", F.floor(F.col("off") / NEAR))
    hit = pts.join(seg, [*KEY, "__bucket"], "left").where("__a IS NULL OR (off >= __a AND off < __b)")
    found = materialise(hit.where("__a IS NOT NULL").select(*points.columns, (F.col("__seq") + F.col("off") - F.col("__a")).alias("seq")))
    missing = points.join(found.select(*KEY, "off"), [*KEY, "off"], "left_anti").withColumn("seq", F.lit(0).cast("bigint"))
    return found.unionByName(missing)
