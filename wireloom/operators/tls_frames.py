"""TLS analytics over dissected frames. Everything about one frame is computed inside its row, without shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions import tls as T
from wireloom.functions.octets import clean_hex

FRAME = ["capture_id", "frame_no"]


def merge_scans(records: DataFrame, segments: DataFrame, copy_segment: bool = True) -> DataFrame:
    """Frames with record headers win; frames that only carry segments are added; optionally the segment field is filled in."""
    seg = segments.select(*FRAME, F.col("segment_data").alias("__seg"), *[F.col(c).alias(f"__{c}") for c in segments.columns if c not in (*FRAME, "segment_data")])
    joined = records.withColumn("__rec", F.lit(True)).join(seg, FRAME, "full_outer")
    from_record = F.coalesce("__rec", F.lit(False))
    cols = []
    for c in records.columns:
        if c in FRAME:
            cols.append(F.col(c))
        elif c == "segment_data":
            own = F.coalesce(F.col("__seg"), F.col(c)) if copy_segment else F.col(c)
            cols.append(F.when(from_record, own).otherwise(F.col("__seg")).alias(c))
        elif c in segments.columns:
            cols.append(F.when(from_record, F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols, F.when(from_record, "record").otherwise("segment").alias("found_by"))


def _messages() -> Column:
    """Array of the complete records of one frame with their offsets in the TCP payload."""
    n_len, n_ver = F.size("lengths"), F.size("versions")

    def one(t: Column, i: Column) -> Column:
        text = F.when(i < n_len, F.try_element_at("lengths", i + 1))
        length = F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint")).otherwise(F.when(text.rlike(r"^\d{1,9}$"), text.cast("bigint")))
        vtext = F.when(i < n_ver, F.try_element_at("versions", i + 1))
        vint = F.when(vtext.isNull() | ~vtext.rlike("^(0x)?[0-9a-fA-F]{1,4}$"), F.lit(0x0303)).otherwise(
            F.conv(F.regexp_replace(vtext, "^0x", ""), 16, 10).cast("int")
        )
        return F.struct(t.alias("content_type"), length.alias("length"), vint.alias("version"))

    kept = F.filter(F.transform(T.all_types(), one), lambda m: m["content_type"].isNotNull() & m["length"].isNotNull())
    return kept


def frame_messages(frames: DataFrame) -> DataFrame:
    """One row per record listed in a frame; offsets add up 5 + length over the records before it."""
    base = frames.withColumn("__m", _messages())
    with_offset = F.transform(
        F.col("__m"),
        lambda m, i: F.struct(
            i.alias("pos"), m["content_type"].alias("content_type"), m["length"].alias("length"), m["version"].alias("version"),
            F.aggregate(F.slice("__m", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + T.HEADER + x["length"]).alias("offset"),
        ),
    )
    m = base.select(*FRAME, "stream_id", "seq_raw", F.explode(with_offset).alias("m"))
    off, length = F.col("m.offset"), F.col("m.length")
    start = F.col("seq_raw") + off
    return m.select(
        *FRAME, "stream_id", F.lit("single_packet").alias("direction"), F.col("m.pos").cast("int").alias("pos"), F.col("m.content_type").alias("content_type"),
        T.type_name(F.col("m.content_type")).alias("content_type_name"),
        F.shiftright("m.version", 8).alias("version_major"), (F.col("m.version") % 256).alias("version_minor"),
        length.alias("length"), length.alias("declared_length"), length.alias("actual_length"),
        off.alias("header_start"), (off + 5).alias("header_end"), (off + 5).alias("payload_start"), (off + 5 + length).alias("payload_end"),
        start.alias("tls_header_seq_start"), (start + 5).alias("tls_header_seq_end"), (start + 5).alias("tls_payload_seq_start"), (start + 5 + length).alias("tls_payload_seq_end"),
        F.lit(True).alias("is_complete"), F.lit(False).alias("is_cross_segment"), T.strategy(F.col("m.content_type")).alias("processing_strategy"),
    )


def prefer_reassembled(reassembled: DataFrame, single: DataFrame) -> DataFrame:
    """Per capture: reassembled records when there are any, else the single-frame ones."""
    have = reassembled.select("capture_id").distinct()
    return reassembled.unionByName(single.join(have, "capture_id", "left_anti"), allowMissingColumns=True)


def type_statistics(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """Frames (each type once per frame) and records per content type."""
    per_frame = frames.select("capture_id", F.explode(F.array_distinct(T.frame_types())).alias("content_type")).groupBy("capture_id", "content_type").agg(F.count("*").alias("frames"))
    per_record = messages.groupBy("capture_id", "content_type").agg(F.count("*").alias("records"))
    both = per_frame.join(per_record, ["capture_id", "content_type"], "full_outer")
    return both.select("capture_id", "content_type", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("records", F.lit(0)).alias("records"))


def frame_details(frames: DataFrame) -> DataFrame:
    seg = F.try_element_at("segment_data", F.lit(1))
    types = T.frame_types()
    guessed = T.segment_type(seg)
    return frames.select(
        *FRAME, "stream_id", "seq_raw", F.array_join(T.clean_path(F.col("protocols")), ":").alias("path"),
        F.when(F.size(types) > 0, types).when(guessed.isNotNull(), F.array(guessed)).otherwise(F.array().cast("array<int>")).alias("types"),
        T.has_segment().alias("is_segment"), F.coalesce(F.length(clean_hex(seg)), F.lit(0)).alias("segment_len"),
    )


def filter_types(details: DataFrame, wanted) -> DataFrame:
    """Frames with any wanted type, their type lists reduced to the wanted ones."""
    return details.withColumn("types", F.filter("types", lambda t: t.isin(*wanted))).where(F.size("types") > 0)


def _type_fields() -> Column:
    return F.concat("content_types", F.filter("opaque_types", lambda v: ~F.array_contains(F.col("content_types"), v)))


def type_hits(frames: DataFrame, wanted=tuple(T.TYPE_NAMES)) -> DataFrame:
    """Per frame: the records of the wanted types with lengths (-1 when missing), strategies and zero bytes of their app data."""
    def record(v: Column, i: Column) -> Column:
        kind = F.when(F.trim(v) == "17", F.lit(23)).otherwise(T.to_int(v))
        text = F.when(i < F.size("lengths"), F.try_element_at("lengths", i + 1))
        return F.struct(kind.alias("t"), F.coalesce(F.when(text.rlike(r"^-?\d{1,9}$"), text.cast("int")), F.lit(-1)).alias("len"))

    h = frames.withColumn("__h", F.filter(F.transform(_type_fields(), record), lambda r: r["t"].isin(*wanted))).where(F.size("__h") > 0)
    types = F.transform("__h", lambda r: r["t"])
    return h.select(
        *FRAME, "stream_id", F.col("protocols").alias("path"), types.alias("types"), F.transform("__h", lambda r: r["len"]).alias("lengths"),
        F.transform(types, T.strategy).alias("strategies"), F.size("__h").alias("num_records"),
        T.app_data_zero_bytes(F.size(F.filter(types, lambda t: t == T.APP_DATA))).alias("zero_bytes"),
    )


def app_data_hits(frames: DataFrame) -> DataFrame:
    return type_hits(frames, (T.APP_DATA,)).drop("types", "strategies")


def merge_hits(direct: DataFrame, from_streams: DataFrame) -> DataFrame:
    """Direct hits plus frames found only through stream records ``(capture_id, frame_no, records)``."""
    j = direct.join(from_streams, FRAME, "full_outer")
    return j.select(
        *FRAME, F.coalesce("path", F.lit("eth:ip:tcp:tls")).alias("path"),
        F.coalesce(F.col("num_records").cast("bigint"), F.col("records"), F.lit(1)).alias("num_records"),
        F.coalesce("zero_bytes", F.lit(0)).alias("zero_bytes"), F.when(F.col("path").isNull(), "stream").otherwise("direct").alias("found_by"),
    )


def path_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("frames"), F.sum("num_records").cast("bigint").alias("records")).orderBy(F.desc("records"), "path")


def type_totals(hits: DataFrame) -> DataFrame:
    return hits.select(F.explode("types").alias("content_type")).groupBy("content_type").agg(F.count("*").alias("records"))


def capture_summary(frames: DataFrame, messages: DataFrame) -> DataFrame:
    f = frames.where(T.has_tls_content()).groupBy("capture_id").agg(F.count("*").alias("frames"), F.count_distinct("stream_id").alias("streams"))
    m = messages.groupBy("capture_id").agg(F.count("*").alias("records"))
    return f.join(m, "capture_id", "full_outer").select(
        "capture_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frames", "records", "streams")])


def rollup_types(stats: DataFrame) -> DataFrame:
    """Per capture and type, per capture, and over everything (NULL marks a total)."""
    return stats.rollup("capture_id", "content_type").agg(F.sum("frames").alias("frames"), F.sum("records").alias("records"))


def message_table(records: DataFrame) -> DataFrame:
    return records.withColumn("version", T.version_name(F.col("version_major"), F.col("version_minor")))


def cross_segment(records: DataFrame) -> DataFrame:
    return records.where("is_cross_segment")
