"""Queries over byte streams: reassembly, TLS records, HTTP headers, keep rules, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import tls as T
from wireloom.functions.octets import be_int
from wireloom.operators import http_headers as hh
from wireloom.operators import mask as mk
from wireloom.operators import reassembly as ra
from wireloom.operators import rules as ru
from wireloom.operators import tls_frames as tf
from wireloom.operators import tls_records as tr
from wireloom.operators.stage import materialise
from wireloom.plans.carriers import carrier

KEY = ra.KEY


def segments(spark, sf, name="segments"):
    return carrier(spark, sf, name).withColumn("payload", F.unhex("payload_hex")).drop("payload_hex")


def pieces(spark, sf, name="segments"):
    s = segments(spark, sf, name)
    return ra.with_payload(ra.trimmed_segments(s), s)


def records(spark, sf, **kw):
    s = segments(spark, sf, "tls_segments")
    return tr.tls_records(ra.trimmed_segments(s), s, **kw)


def t3_record_frames(spark, sf):
    s = segments(spark, sf, "tls_segments")
    p = ra.trimmed_segments(s)
    return tr.record_frames(tr.tls_records(p, s), p)


def _rec_out(df):
    return df.select(*KEY, "content_type", "content_type_name", "version_major", "version_minor", "declared_length", "actual_length", "header_start",
                     "tls_header_seq_start", "tls_payload_seq_end", F.col("is_complete").cast("int").alias("is_complete"), "processing_strategy")


def headers(spark, sf, name="http_segments", **kw):
    return hh.message_headers(segments(spark, sf, name), **kw)


def _head_out(df):
    return df.select(*KEY, "frame_no", "start_seq", F.hex("header").alias("header_hex"), F.col("complete").cast("int").alias("complete"))


def tls_frames(spark, sf):
    """Frames for the fallback rules: typed when they begin with a record header, fragments otherwise."""
    s = segments(spark, sf, "tls_segments")
    kind = be_int(F.col("payload"), 0, 1)
    start = T.is_record_start(F.col("payload"))
    no = F.array().cast("array<string>")
    return s.withColumns({"content_types": F.when(start, F.array(kind.cast("string"))).otherwise(no), "opaque_types": no,
                          "segment_data": F.when(start, no).otherwise(F.array(F.hex("payload")))})


def fallback(spark, sf):
    rules = ru.tls_rules(records(spark, sf)).where("rule_type = 'tls_handshake'")
    return ru.fallback_rules(tls_frames(spark, sf), rules)


def sample_rules(spark, sf):
    """Overlapping rules over the document streams: 40 bytes at each multiple of 90, some as headers."""
    s = segments(spark, sf)
    at = s.where("len > 0").select(*KEY, (F.floor(F.col("seq") / 90) * 90).cast("bigint").alias("seq_start"))
    return at.select(*KEY, "seq_start", (F.col("seq_start") + F.when(F.col("seq_start") % 270 == 0, 100).otherwise(40)).alias("seq_end"),
                     F.lit("sample").alias("rule_type"), F.when(F.col("seq_start") % 180 == 0, "header_only").otherwise("full_message").alias("strategy"))


def masked(spark, sf):
    return mk.mask_payloads(segments(spark, sf).withColumn("proto", F.lit("tcp")), sample_rules(spark, sf))


def tls_masked(spark, sf):
    s = segments(spark, sf, "tls_segments").withColumn("proto", F.lit("tcp"))
    return mk.mask_payloads(s, ru.tls_rules(records(spark, sf)))


def http_masked(spark, sf):
    s = segments(spark, sf, "http_segments").withColumn("proto", F.lit("tcp"))
    return mk.mask_payloads(s, hh.header_rules(headers(spark, sf)))


def w10(spark, sf):
    # written once, without payload: the offsets read the segments in several branches, points and ranges read the offsets
    off = materialise(ra.concat_offsets(materialise(segments(spark, sf).drop("payload"))))
    points = off.select(*KEY, (F.col("stream_off") + F.floor(F.col("len") / 2) + F.when(F.col("frame_no") % 50 == 0, 10000000).otherwise(0)).cast("bigint").alias("off"))
    return ra.offset_to_sequence(points, off)


QUERIES = {
    "w8_concat_offsets": lambda s, d: ra.concat_offsets(segments(s, d)).select(*KEY, "frame_no", "seq", "stream_off"),
    "w9_trimmed_segments": lambda s, d: pieces(s, d).select(*KEY, "frame_no", "start", "end", "island", F.col("gap").cast("int").alias("gap"), F.hex("payload").alias("payload_hex")),
    "w9_gapped_segments": lambda s, d: pieces(s, d, "gapped_segments").select(*KEY, "frame_no", "start", "end", "island", F.col("gap").cast("int").alias("gap"), F.hex("payload").alias("payload_hex")),
    "w10_offset_to_seq": w10,
    "t2_records": lambda s, d: _rec_out(records(s, d)),
    "t2_records_small_blocks": lambda s, d: _rec_out(records(s, d, block=96, fan=4)),
    "t3_record_frames": lambda s, d: t3_record_frames(s, d),
    "t7_messages": lambda s, d: tf.message_table(records(s, d)).select(*KEY, "content_type_name", "version", "tls_header_seq_end", "tls_payload_seq_start", "payload_end"),
    "t8_cross_segment": lambda s, d: tf.cross_segment(records(s, d)).select(*KEY, "content_type", "declared_length", "actual_length", "tls_header_seq_start"),
    "f4_record_starts": lambda s, d: segments(s, d, "tls_segments").select("capture_id", "frame_no", T.is_record_start(F.col("payload")).cast("int").alias("is_start"),
        T.type_matches_payload(F.col("payload"), F.lit(22)).cast("int").alias("is_handshake")),
    "h1_headers": lambda s, d: _head_out(headers(s, d)),
    "h1_headers_small_blocks": lambda s, d: _head_out(headers(s, d, block=512, fan=4)),
    "h1_long_headers": lambda s, d: _head_out(headers(s, d, "long_http_segments")),
    "h2_start_lines": lambda s, d: _head_out(headers(s, d, "long_http_segments", block=4096, fan=8).where("NOT complete")),
    "h3_keep_ranges": lambda s, d: hh.header_rules(headers(s, d)).groupBy(*KEY).agg(F.count("*").alias("ranges"), F.sum(F.col("seq_end") - F.col("seq_start")).alias("kept")),
    "h5_stats": lambda s, d: hh.scan_stats(segments(s, d, "http_segments"), headers(s, d), hh.header_rules(headers(s, d))),
    "k1_tls_rules": lambda s, d: ru.tls_rules(records(s, d)),
    "k2_fallback_rules": fallback,
    "k4_union": lambda s, d: ru.combine(ru.tls_rules(records(s, d)), hh.header_rules(headers(s, d))).groupBy("rule_type", "strategy").agg(F.count("*").alias("rules")),
    "k5_merged": lambda s, d: ru.merged_rules(sample_rules(s, d)),
    "k9_masked_payload": lambda s, d: masked(s, d).select(*KEY, "frame_no", F.hex("payload").alias("payload_hex"), "kept_bytes", "masked_bytes", F.col("payload_modified").cast("int").alias("payload_modified")),
    "k12_bytes": lambda s, d: mk.masking_stats(masked(s, d)),
    "k14_merged_stats": lambda s, d: mk.merge_stats(mk.masking_stats(masked(s, d)).select(
        "processed", "modified", "masked_bytes", "kept_bytes", F.col("processed").alias("duration_us"), (F.col("modified") > 0).alias("success"))).withColumn("success", F.col("success").cast("int")),
    "k13_rule_stats": lambda s, d: ru.rule_statistics(ru.tls_rules(records(s, d))),
    "f11_orphaned_rules": lambda s, d: ru.orphaned(ru.valid(sample_rules(s, d)), segments(s, d).where("frame_no % 200000 < 100000")).groupBy(*KEY).agg(F.count("*").alias("rules")),
}

_SEGB = """SELECT *, coalesce(max(seq + len) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM {SRC}"""
_TRIM = f"""(SELECT capture_id, tuple_key, direction, frame_no, greatest(seq, prev) AS start, seq + len AS "end", CASE WHEN prev <> -1 AND seq > prev THEN 1 ELSE 0 END AS gap,
   max(CASE WHEN prev = -1 OR seq > prev THEN seq END) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq, frame_no) AS island,
   substr(payload_hex, cast(2 * (greatest(seq, prev) - seq) + 1 AS int), cast(2 * (seq + len - greatest(seq, prev)) AS int)) AS payload_hex
   FROM ({_SEGB}) WHERE seq + len > greatest(seq, prev))"""
# Independent record walk: one recursive step per record or skipped byte, over the unsplit stream of each turn.
_WALK = """
 WITH RECURSIVE w AS (
   SELECT capture_id, tuple_key, direction, base_seq, stream_hex AS h, length(stream_hex) // 2 AS n, 0::BIGINT AS cur, false AS rec, 0::BIGINT AS ct, 0::BIGINT AS maj, 0::BIGINT AS mi, 0::BIGINT AS decl, 0::BIGINT AS pos FROM {tls_streams}
   UNION ALL
   SELECT capture_id, tuple_key, direction, base_seq, h, n,
          CASE WHEN NOT ok THEN cur + 1 WHEN cur + 5 + d > n AND NOT part_ok THEN cur + 1 ELSE cur + 5 + d END, ok AND (cur + 5 + d <= n OR part_ok), c, ma, mn, d, cur
   FROM (SELECT *, c BETWEEN 20 AND 24 AS ok, ma = 3 AND mn <= 4 AND d <= 18432 AS part_ok
         FROM (SELECT capture_id, tuple_key, direction, base_seq, h, n, cur, ('0x' || substr(h, 2 * cur + 1, 2))::BIGINT AS c, ('0x' || substr(h, 2 * cur + 3, 2))::BIGINT AS ma,
                      ('0x' || substr(h, 2 * cur + 5, 2))::BIGINT AS mn, ('0x' || substr(h, 2 * cur + 7, 4))::BIGINT AS d FROM w WHERE cur + 5 <= n)))
 , recs AS (SELECT capture_id, tuple_key, direction, ct AS content_type, CASE ct WHEN 20 THEN 'ChangeCipherSpec' WHEN 21 THEN 'Alert' WHEN 22 THEN 'Handshake' WHEN 23 THEN 'ApplicationData' ELSE 'Heartbeat' END AS content_type_name,
     maj AS version_major, mi AS version_minor, decl AS declared_length, least(decl, n - pos - 5) AS actual_length, pos AS header_start, base_seq + pos AS tls_header_seq_start,
     base_seq + pos + 5 + least(decl, n - pos - 5) AS tls_payload_seq_end, CASE WHEN pos + 5 + decl <= n THEN 1 ELSE 0 END AS is_complete,
     CASE ct WHEN 23 THEN 'mask_payload' ELSE 'keep_all' END AS processing_strategy FROM w WHERE rec)
"""
_RULES = """, rules AS (SELECT * FROM (SELECT capture_id, tuple_key, direction, content_type, actual_length, is_complete, tls_header_seq_start AS seq_start,
     CASE content_type WHEN 23 THEN tls_header_seq_start + 5 ELSE tls_payload_seq_end END AS seq_end,
     CASE content_type WHEN 23 THEN 'tls_applicationdata_header' ELSE 'tls_' || lower(content_type_name) END AS rule_type, CASE content_type WHEN 23 THEN 'header_only' ELSE 'full_message' END AS strategy FROM recs))
"""
_COLS = "capture_id, tuple_key, direction"
_HDR = "SELECT capture_id, tuple_key, direction, page_id * 1000000 AS frame_no, 5000 + (page_id % 100000) * 40000 AS start_seq, header_hex, 1 AS complete FROM {http_streams}"
_LONG_HDR = "SELECT capture_id, tuple_key, direction, doc_id * 1000000 AS frame_no, doc_id * 4000000 AS start_seq, header_hex, complete FROM {long_http_streams}"
_HKEEP = """SELECT capture_id, tuple_key, direction, page_id, ranges, length(header_hex) // 2 - hidden AS kept FROM (
   SELECT *, 2 * (CASE WHEN page_id % 2 = 0 THEN 7 ELSE 6 END) - 2 AS ranges,
     length('id=' || page_id) + length(' folded=' || page_id * 7) + CASE WHEN page_id % 2 = 0 THEN (SELECT octet_length(encode(url)) FROM pages pg WHERE pg.page_id = hs.page_id) ELSE 0 END AS hidden FROM {http_streams} hs)"""
_SAMPLE = """(SELECT capture_id, tuple_key, direction, a0 AS seq_start, a0 + CASE WHEN a0 % 270 = 0 THEN 100 ELSE 40 END AS seq_end, CASE WHEN a0 % 180 = 0 THEN 'header_only' ELSE 'full_preserve' END AS strategy
   FROM (SELECT DISTINCT capture_id, tuple_key, direction, seq // 90 * 90 AS a0 FROM {segments}))"""
_MERGE = """SELECT capture_id, tuple_key, direction, min(seq_start) AS seq_start, max(seq_end) AS seq_end FROM (
   SELECT *, sum(CASE WHEN pe IS NULL OR seq_start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq_start, seq_end) AS isl FROM (
     SELECT *, max(seq_end) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq_start, seq_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM IN_)) GROUP BY capture_id, tuple_key, direction, isl"""
# Masking byte by byte: at % 270 = 0 keeps 100 bytes, other starts keep 40; a byte stays when some rule start that occurs covers it.
_BYTES = f"""WITH smp AS (SELECT * FROM {_SAMPLE}), cov AS ({_MERGE.replace('IN_', 'smp')}),
   seg AS (SELECT capture_id, tuple_key, direction, frame_no, seq, len, payload_hex FROM {{segments}}),
   hit AS (SELECT frame_no, greatest(seq, seq_start) - seq AS a, least(seq + len, seq_end) - seq AS b FROM seg JOIN cov USING (capture_id, tuple_key, direction) WHERE seq_start < seq + len AND seq_end > seq),
   lst AS (SELECT frame_no, list(struct_pack(a := a, b := b)) AS rs, sum(b - a)::BIGINT AS kept FROM hit GROUP BY 1),
   res AS (SELECT capture_id, tuple_key, direction, frame_no, payload_hex AS orig, len, coalesce(kept, 0) AS kept_bytes,
      array_to_string(list_transform(range(0, len), lambda i: CASE WHEN len(list_filter(coalesce(rs, []), lambda r: r.a <= i AND i < r.b)) > 0 THEN substr(payload_hex, 2 * i + 1, 2) ELSE '00' END), '') AS payload_hex
      FROM seg LEFT JOIN lst USING (frame_no))"""

ORACLES = {
    "w8_concat_offsets": """SELECT capture_id, tuple_key, direction, frame_no, seq, coalesce(sum(len) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_off FROM {segments}""",
    "w9_trimmed_segments": f"""SELECT {_COLS}, frame_no, start, "end", island, gap, payload_hex FROM {_TRIM}""".replace("{SRC}", "{segments}"),
    "w9_gapped_segments": f"""SELECT {_COLS}, frame_no, start, "end", island, gap, payload_hex FROM {_TRIM}""".replace("{SRC}", "{gapped_segments}"),
    "w10_offset_to_seq": """SELECT capture_id, tuple_key, direction, so + len // 2 + CASE WHEN frame_no % 50 = 0 THEN 10000000 ELSE 0 END AS off, CASE WHEN frame_no % 50 = 0 THEN 0 ELSE seq + len // 2 END AS seq
        FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY capture_id, tuple_key, direction ORDER BY seq, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so FROM {segments})""",
    "t2_records": f"{_WALK} SELECT * FROM recs",
    "t2_records_small_blocks": f"{_WALK} SELECT * FROM recs",
    "t3_record_frames": f"""{_WALK} SELECT s.capture_id, s.frame_no, count(*) AS records FROM {{tls_segments}} s JOIN recs r ON s.capture_id = r.capture_id AND s.tuple_key = r.tuple_key AND s.direction = r.direction
        AND r.content_type = 23 AND r.is_complete = 1 AND r.tls_header_seq_start < s.seq + s.len AND s.seq < r.tls_payload_seq_end GROUP BY 1, 2""",
    "t7_messages": f"""{_WALK} SELECT {_COLS}, content_type_name, CASE WHEN version_major = 3 AND version_minor = 3 THEN 'TLS 1.2' ELSE 'other' END AS version, tls_header_seq_start + 5 AS tls_header_seq_end,
        tls_header_seq_start + 5 AS tls_payload_seq_start, header_start + 5 + actual_length AS payload_end FROM recs""",
    "t8_cross_segment": f"{_WALK} SELECT {_COLS}, content_type, declared_length, actual_length, tls_header_seq_start FROM recs WHERE is_complete = 0",
    "f4_record_starts": """SELECT capture_id, frame_no, CASE WHEN len >= 5 AND substr(payload_hex, 1, 2) IN ('14', '15', '16', '17', '18') AND substr(payload_hex, 3, 4) IN ('0300', '0301', '0302', '0303')
        AND ('0x' || substr(payload_hex, 7, 4))::BIGINT BETWEEN 1 AND 16384 THEN 1 ELSE 0 END AS is_start, CASE WHEN substr(payload_hex, 1, 2) = '16' THEN 1 ELSE 0 END AS is_handshake FROM {tls_segments}""",
    "h1_headers": _HDR,
    "h1_headers_small_blocks": _HDR,
    "h1_long_headers": _LONG_HDR,
    "h2_start_lines": _LONG_HDR + " WHERE complete = 0",
    "h3_keep_ranges": f"SELECT {_COLS}, ranges::BIGINT AS ranges, kept FROM ({_HKEEP})",
    "h5_stats": f"""SELECT a.capture_id, n AS tcp_packets, n AS with_payload, n AS candidates, headers, rules FROM (SELECT capture_id, count(*) AS n FROM {{http_segments}} GROUP BY 1) a
        JOIN (SELECT capture_id, count(*) AS headers, sum(ranges)::BIGINT AS rules FROM ({_HKEEP}) GROUP BY 1) b USING (capture_id)""",
    "k1_tls_rules": f"{_WALK} {_RULES} SELECT {_COLS}, seq_start, seq_end, rule_type, strategy FROM rules",
    "k2_fallback_rules": f"""{_WALK} {_RULES}, hs AS (SELECT * FROM rules WHERE rule_type = 'tls_handshake'),
        op AS (SELECT * FROM {{tls_segments}} s WHERE NOT EXISTS (SELECT 1 FROM hs WHERE hs.capture_id = s.capture_id AND hs.tuple_key = s.tuple_key AND hs.direction = s.direction AND hs.seq_start <= s.seq AND s.seq < hs.seq_end))
        SELECT * FROM (SELECT {_COLS}, seq AS seq_start, seq + CASE substr(payload_hex, 1, 2) WHEN '17' THEN 5 ELSE len END AS seq_end,
          CASE substr(payload_hex, 1, 2) WHEN '14' THEN 'tls_changecipherspec' WHEN '15' THEN 'tls_alert' WHEN '16' THEN 'tls_handshake' WHEN '17' THEN 'tls_applicationdata_header' ELSE 'tls_heartbeat' END AS rule_type,
          CASE substr(payload_hex, 1, 2) WHEN '17' THEN 'header_only' ELSE 'full_message' END AS strategy FROM op
          WHERE len >= 5 AND substr(payload_hex, 1, 2) IN ('14', '15', '16', '17', '18') AND substr(payload_hex, 3, 4) IN ('0300', '0301', '0302', '0303') AND ('0x' || substr(payload_hex, 7, 4))::BIGINT BETWEEN 1 AND 16384)""",
    "k4_union": f"""{_WALK} {_RULES} SELECT rule_type, strategy, count(*) AS rules FROM rules GROUP BY 1, 2 UNION ALL SELECT 'http_header', 'header_only', sum(ranges)::BIGINT FROM ({_HKEEP})""",
    "k5_merged": f"""SELECT {_COLS}, seq_start, seq_end, strategy FROM {_SAMPLE} WHERE strategy = 'header_only' UNION ALL
        SELECT *, 'full_preserve' FROM ({_MERGE.replace('IN_', f"(SELECT * FROM {_SAMPLE} WHERE strategy = 'full_preserve')")})""",
    "k9_masked_payload": f"{_BYTES} SELECT {_COLS}, frame_no, payload_hex, kept_bytes, len - kept_bytes AS masked_bytes, CASE WHEN payload_hex <> orig THEN 1 ELSE 0 END AS payload_modified FROM res",
    "k12_bytes": f"""{_BYTES}, t AS (SELECT capture_id, count(*) AS processed, count(*) FILTER (WHERE payload_hex <> orig) AS modified, sum(len - kept_bytes)::BIGINT AS masked_bytes, sum(kept_bytes)::BIGINT AS kept_bytes FROM res GROUP BY 1)
        SELECT *, masked_bytes / (masked_bytes + kept_bytes) AS masked_ratio, kept_bytes / (masked_bytes + kept_bytes) AS kept_ratio, modified / processed AS modified_ratio FROM t""",
    "k14_merged_stats": f"""{_BYTES}, t AS (SELECT capture_id, count(*) AS p, count(*) FILTER (WHERE payload_hex <> orig) AS m, sum(len - kept_bytes) AS mb, sum(kept_bytes) AS kb FROM res GROUP BY 1)
        SELECT sum(p)::BIGINT AS processed, sum(m)::BIGINT AS modified, sum(mb)::BIGINT AS masked_bytes, sum(kb)::BIGINT AS kept_bytes, max(p) AS duration_us, CASE WHEN bool_and(m > 0) THEN 1 ELSE 0 END AS success FROM t""",
    "k13_rule_stats": f"{_WALK} {_RULES} SELECT rule_type, strategy, count(*) AS rules, sum(seq_end - seq_start)::BIGINT AS preserved_bytes, count(DISTINCT (capture_id, tuple_key)) AS flows FROM rules GROUP BY 1, 2",
    "f11_orphaned_rules": f"""SELECT {_COLS}, count(*) AS rules FROM (SELECT capture_id, tuple_key, direction, seq // 90 * 90 AS at FROM {{segments}})
        WHERE (capture_id, tuple_key) NOT IN (SELECT (capture_id, tuple_key) FROM {{segments}} WHERE frame_no % 200000 < 100000) GROUP BY {_COLS}""",
}
