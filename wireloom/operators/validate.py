"""Before/after checks on TLS hit tables ``(capture_id, frame_no, path, types, lengths, zero_bytes)`` and on outputs.

Every check yields one row per capture ``(capture_id, check, total, passed, rate, status)``; frames join one to one on
``(capture_id, frame_no)``, so no check ever gathers the frames of a capture or stream in one place. Where both sides have a ``payload``,
its bytes are checked too; only digests and verdicts of payloads move, never the payloads of frames that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions import http as H
from wireloom.functions import tls as T
from wireloom.functions.octets import all_zero, latin1
from wireloom.functions.ratios import percent
from wireloom.operators.stage import materialise

FRAME = ["capture_id", "frame_no"]
KEEP_TYPES = (20, 21, 22, 24)
ALL_TYPES = (20, 21, 22, 23, 24)


def _digest(df: DataFrame) -> Column:
    """Of the payload; null where there is none, which differs from no other."""
    return F.when(F.length("payload") > 0, F.md5("payload")) if "payload" in df.columns else F.lit(None).cast("string")


def _side_by_side(original: DataFrame, masked: DataFrame) -> DataFrame:
    looks = looks_masked(F.hex("payload")) if "payload" in masked.columns else F.lit(None).cast("boolean")
    m = masked.select(
        *FRAME, *[F.col(c).alias(f"m_{c}") for c in ("path", "types", "lengths", "zero_bytes")], _digest(masked).alias("m_digest"), looks.alias("m_looks"), F.lit(True).alias("present"))
    return original.withColumn("digest", _digest(original)).drop("payload").join(m, FRAME, "left")


def _verdict(per_frame: DataFrame, check: str, threshold: float) -> DataFrame:
    """``per_frame`` has ``ok`` BOOLEAN; rates are percentages."""
    out = per_frame.groupBy("capture_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
    return _finish(out, check, threshold)


def _finish(out: DataFrame, check: str, threshold: float) -> DataFrame:
    out = out.withColumn("rate", percent(F.col("passed"), F.col("total")))
    return out.select("capture_id", F.lit(check).alias("check"), "total", "passed", "rate", F.when(F.col("rate") >= threshold, "pass").otherwise("fail").alias("status"))


def app_data_masked(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Are all application-data frames of the output zeroed: counts before and after, zeroed and failed frames, verdict."""
    before = original.groupBy("capture_id").agg(F.count("*").alias("records_before"))
    ok = T.zeroed(F.col("lengths"), F.col("zero_bytes"))
    after = masked.groupBy("capture_id").agg(F.count("*").alias("records_after"), F.count_if(ok).alias("masked_records"), F.count_if(~ok).alias("unmasked_records"))
    out = before.join(after, "capture_id", "full_outer").fillna(0)
    return out.withColumn("status", F.when(F.col("unmasked_records") == 0, "pass").otherwise("fail"))


def app_data_frames(masked: DataFrame) -> DataFrame:
    """The frames behind the counts above."""
    return masked.select(*FRAME, F.when(T.zeroed(F.col("lengths"), F.col("zero_bytes")), "masked").otherwise("failed").alias("outcome"))


def preservation_frames(original: DataFrame, masked: DataFrame, types=KEEP_TYPES) -> DataFrame:
    both = _side_by_side(original.where(F.exists("types", lambda t: t.isin(*types))), masked)
    same = (F.col("types") == F.col("m_types")) & (F.col("lengths") == F.col("m_lengths")) & F.coalesce(F.col("digest") == F.col("m_digest"), F.lit(True))
    return both.select(*FRAME, F.when(F.col("present").isNull(), "missing").when(same, "preserved").otherwise("modified").alias("outcome"))


def complete_preservation(original: DataFrame, masked: DataFrame, types=KEEP_TYPES) -> DataFrame:
    f = preservation_frames(original, masked, types)
    return _verdict(f.withColumn("ok", F.col("outcome") == "preserved"), "complete_preservation", 95.0)


def smart_masking(original: DataFrame, masked: DataFrame, target: int = T.APP_DATA, header: int = T.HEADER) -> DataFrame:
    """Output frames keep about ``header`` bytes of their target records and zero the rest (tolerance 5).

    A frame without zero counts or lengths is judged by its payload's share of zeros, if it has one (``looks_masked``).
    """
    both = smart_masking_frames(original, masked, target, header)
    return _verdict(both.withColumn("ok", F.col("outcome") == "correctly_masked"), "smart_masking", 95.0)


def smart_masking_frames(original: DataFrame, masked: DataFrame, target: int = T.APP_DATA, header: int = T.HEADER) -> DataFrame:
    """The frames behind that check."""
    both = _side_by_side(original.where(F.array_contains("types", target)), masked)
    total = F.aggregate("m_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    counted = (F.size("m_lengths") > 0) & F.col("m_zero_bytes").isNotNull()
    ok = F.when(counted, F.abs(F.col("m_zero_bytes") - (total - header)) <= 5).otherwise(F.col("m_looks"))
    return both.select(*FRAME, F.when(F.col("present").isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "correctly_masked").otherwise("incorrectly_masked").alias("outcome"))


def changed_payloads(original: DataFrame, masked: DataFrame, width: int = 4096, piece: int = 64) -> DataFrame:
    """Frames ``(capture_id, frame_no, payload)`` that differ: ``outcome`` (missing, added, length, bytes), first changed byte and their number.

    Compared from the top down: digests of blocks of ``width`` frame numbers (partial sums, no payload moves), then the frames of blocks
    that differ, then pieces of a payload, then bytes. ``first_changed`` and ``changed_bytes`` are null unless the lengths agree. A null
    payload counts as empty; a frame is expected once on each side.
    """
    def side(df):
        return df.select(*FRAME, F.coalesce("payload", F.unhex(F.lit(""))).alias("payload"), F.floor(F.col("frame_no") / width).alias("blk"))

    def digests(df, p):
        return side(df).groupBy("capture_id", "blk").agg(
            F.count("*").alias(f"{p}n"), F.bit_xor(F.xxhash64("frame_no", "payload")).alias(f"{p}x"), F.bit_xor(F.xxhash64(F.lit(1), "payload", "frame_no")).alias(f"{p}y"))

    both = digests(original, "a").join(digests(masked, "b"), ["capture_id", "blk"], "full_outer")
    odd = materialise(both.where("NOT (an <=> bn AND ax <=> bx AND ay <=> by)").select("capture_id", "blk"))
    of = lambda df, name: side(df).join(odd, ["capture_id", "blk"], "left_semi").select(*FRAME, F.col("payload").alias(name))
    pairs = of(original, "a").join(of(masked, "b"), FRAME, "full_outer").where("NOT (a <=> b)")
    at = f"""CASE WHEN length(a) = length(b) THEN flatten(transform(
        filter(sequence(0, (length(a) - 1) div {piece}), c -> substring(a, cast(c * {piece} + 1 AS int), {piece}) <> substring(b, cast(c * {piece} + 1 AS int), {piece})),
        c -> filter(sequence(c * {piece}, least(c * {piece} + {piece - 1}, length(a) - 1)), i -> substring(a, cast(i + 1 AS int), 1) <> substring(b, cast(i + 1 AS int), 1)))) END"""
    outcome = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.length("a") != F.length("b"), "length").otherwise("bytes")
    out = pairs.select(*FRAME, outcome.alias("outcome"), F.expr(at).alias("at"))
    return out.select(*FRAME, "outcome", F.get("at", F.lit(0)).cast("bigint").alias("first_changed"), F.when(F.col("at").isNotNull(), F.size("at")).cast("bigint").alias("changed_bytes"))


def looks_masked(payload: Column, header: int = T.HEADER) -> Column:
    """Fallback on payload hex: header not all zero and more than 80 % of the remaining hex digits zero."""
    text = F.regexp_replace(payload, "[: ]", "")
    head, rest = F.substring(text, 1, 2 * header), F.substring(text, F.lit(2 * header + 1), F.length(text))
    digits = F.length(rest) - F.length(F.replace(rest, F.lit("0")))
    return (F.length(text) >= 2 * header) & ~head.rlike("^0+$") & ((F.length(rest) == 0) | (digits / F.length(rest) > 0.8))


def _stream() -> Column:
    return F.when(F.contains(F.lower("path"), F.lit("tcp")), "tcp_stream").otherwise("unknown_stream")


def stream_consistency(original: DataFrame, masked: DataFrame) -> DataFrame:
    """A stream is consistent when both sides list the same frames: counted through an outer join, no frame lists are built."""
    a = original.select(*FRAME, _stream().alias("stream"), F.lit(1).alias("in_a"))
    b = masked.select(*FRAME, _stream().alias("stream"), F.lit(1).alias("in_b"))
    j = a.join(b, [*FRAME, "stream"], "full_outer")
    per_stream = j.groupBy("capture_id", "stream").agg(F.count("in_a").alias("a"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("odd")).where("a > 0")
    return _verdict(per_stream.withColumn("ok", F.col("odd") == 0), "stream_consistency", 90.0)


def type_detection(original: DataFrame, types=ALL_TYPES) -> DataFrame:
    seen = original.select("capture_id", F.explode("types").alias("t")).where(F.col("t").isin(*types))
    out = original.groupBy("capture_id").agg(F.lit(len(types)).cast("bigint").alias("total")).join(
        seen.groupBy("capture_id").agg(F.count_distinct("t").alias("passed")), "capture_id", "left").fillna(0, ["passed"])
    return _finish(out, "type_detection", 80.0)


def missing_types(original: DataFrame, types=ALL_TYPES) -> DataFrame:
    seen = original.select("capture_id", F.explode("types").alias("content_type")).distinct()
    every = original.select("capture_id").distinct().withColumn("content_type", F.explode(F.array(*[F.lit(t) for t in types])))
    return every.join(seen, ["capture_id", "content_type"], "left_anti")


def boundary_frames(original: DataFrame, masked: DataFrame) -> DataFrame:
    both = _side_by_side(original, masked)
    issue = (
        F.when(F.col("present").isNull(), "frame_missing").when(F.size("lengths") != F.size("m_lengths"), "length_mismatch")
        .when(F.col("lengths") != F.col("m_lengths"), "length_change").when(F.col("m_zero_bytes") < F.col("zero_bytes"), "zero_bytes_decrease").otherwise("safe")
    )
    return both.select(*FRAME, issue.alias("outcome"))


def boundary_safety(original: DataFrame, masked: DataFrame) -> DataFrame:
    return _verdict(boundary_frames(original, masked).withColumn("ok", F.col("outcome") == "safe"), "boundary_safety", 95.0)


def all_checks(original: DataFrame, masked: DataFrame) -> DataFrame:
    out = complete_preservation(original, masked)
    for other in (smart_masking(original, masked), stream_consistency(original, masked), type_detection(original), boundary_safety(original, masked)):
        out = out.unionByName(other)
    return out


def overall(checks: DataFrame, tests: int = 5) -> DataFrame:
    """Score per capture: a passed check counts 100; ``score`` gives failed ones their rate, ``strict_score`` gives them 0.

    A check that found nothing to test counts as failed with rate 0.
    """
    points = F.when(F.col("status") == "pass", 100.0)
    out = checks.groupBy("capture_id").agg(
        (F.sum(F.coalesce(points, F.col("rate"))) / tests).alias("score"), (F.sum(F.coalesce(points, F.lit(0.0))) / tests).alias("strict_score"),
        F.count_if(F.col("status") == "pass").alias("passed_tests"))
    return out.withColumn("status", F.when(F.col("strict_score") >= 80, "pass").otherwise("fail"))


def batch_pass_rate(results: DataFrame) -> DataFrame:
    out = results.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "pass").alias("passed"))
    return out.withColumn("pass_rate", percent(F.col("passed"), F.col("files")))


def _http_bodies(segments: DataFrame) -> DataFrame:
    text = latin1(F.col("payload"))
    at = F.instr(text, "\r\n\r\n")
    body = F.substring("payload", at + 4, F.length("payload"))
    checked = H.has_http_token() & (at > 0) & (F.length(body) > 0)
    return segments.where("len > 0").select("capture_id", "frame_no", checked.alias("checked"), (checked & ~all_zero(body)).alias("violated"), body.alias("body"))


def http_zero_body(segments: DataFrame) -> DataFrame:
    return _http_bodies(segments).groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.count_if("checked").alias("checked"), F.count_if("violated").alias("violations"))


def http_body_examples(segments: DataFrame, k: int = 5) -> DataFrame:
    """The first violations of each capture; the rank filter is pushed below the shuffle, so at most k rows per task move."""
    first = F.row_number().over(Window.partitionBy("capture_id").orderBy("frame_no"))
    bad = _http_bodies(segments).where("violated").select("capture_id", "frame_no", F.lower(F.hex(F.substring("body", 1, 32))).alias("body_sample"))
    return bad.withColumn("n", first).where(F.col("n") <= k)


def processing_state(stats: DataFrame) -> DataFrame:
    """``(.., processed, modified, errors)`` rows with validity and warnings."""
    error_rate = F.col("errors") / F.greatest("processed", F.lit(1))
    mod_rate = F.when(F.col("processed") > 0, F.col("modified") / F.col("processed"))
    valid = (F.col("processed") >= 0) & (F.col("modified") >= 0) & (F.col("modified") <= F.col("processed"))
    return stats.withColumns({
        "is_valid": valid,
        "error_warning": F.when(~valid, "").when(error_rate > 0.1, "high").when(error_rate > 0.05, "elevated").otherwise(""),
        "modification_warning": F.when(~valid, "").when(mod_rate == 0, "none").when(mod_rate > 0.8, "high").otherwise(""),
    })


def packet_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    a = expected.groupBy("capture_id").agg(F.count("*").alias("expected"))
    b = actual.groupBy("capture_id").agg(F.count("*").alias("actual"))
    out = a.join(b, "capture_id", "full_outer").fillna(0)
    return out.withColumn("matches", F.col("expected") == F.col("actual"))


def compare_files(left: DataFrame, right: DataFrame, name: Column | None = None) -> DataFrame:
    """Same MD5 and size by file name, over two ``binaryFile`` reads."""
    key = name if name is not None else F.element_at(F.split("path", "/"), -1)
    side = lambda df, p: df.select(key.alias("file"), F.md5("content").alias(f"{p}_md5"), F.col("length").alias(f"{p}_size"))
    j = side(left, "left").join(side(right, "right"), "file", "full_outer")
    return j.withColumn("same", F.coalesce((F.col("left_md5") == F.col("right_md5")) & (F.col("left_size") == F.col("right_size")), F.lit(False)))
