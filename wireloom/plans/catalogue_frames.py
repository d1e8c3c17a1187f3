"""Queries over dissected frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import tls as T
from wireloom.operators import tls_frames as tf
from wireloom.plans.carriers import carrier


def _list(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "").alias(c.replace("_csv", ""))


def frames(spark, sf):
    f = carrier(spark, sf, "frames")
    return f.select(
        "capture_id", "frame_no", "stream_id", "seq_raw", "protocols", "nt",
        _list("types_csv").alias("content_types"), _list("opaque_csv").alias("opaque_types"), _list("lengths_csv").alias("lengths"),
        _list("versions_csv").alias("versions"), _list("segment_csv").alias("segment_data"), F.array("app_hex").alias("app_data"))


def _joined(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


def t1_merge_scans(spark, sf):
    f = frames(spark, sf)
    a = f.where(T.has_tls_record(decimal_only=True)).select("capture_id", "frame_no", "content_types", "protocols", F.array().cast("array<string>").alias("segment_data"))
    b = f.where(T.has_segment()).select("capture_id", "frame_no", "protocols", "segment_data")
    return _joined(tf.merge_scans(a, b), "content_types", "segment_data")


def f1_predicates(spark, sf):
    f = frames(spark, sf)
    return f.select(
        "capture_id", "frame_no", T.has_tls_record().cast("int").alias("tls"), T.has_tls_record(True).cast("int").alias("tls_decimal"),
        T.has_tls_content().cast("int").alias("content"), T.has_segment().cast("int").alias("segment"),
        T.is_app_data_fragment().cast("int").alias("app_fragment"), T.segment_type(F.lit("17:03")).alias("seg_type"))


def t11_merged_hits(spark, sf):
    f = frames(spark, sf)
    streams = f.where("frame_no % 3 = 0").groupBy("capture_id", "frame_no").agg(F.count("*").alias("records"))
    return tf.merge_hits(tf.app_data_hits(f), streams)


def t5_prefer(spark, sf):
    m = tf.frame_messages(frames(spark, sf))
    re = m.where("cast(capture_id AS int) % 2 = 0 AND content_type <> 23")
    return tf.prefer_reassembled(re, m).groupBy("capture_id", "content_type").agg(F.count("*").alias("records"))


def t4_frame_messages(spark, sf):
    return tf.frame_messages(frames(spark, sf)).select(
        "capture_id", "frame_no", "pos", "content_type", "content_type_name", "version_major", "version_minor", "length", "header_start", "payload_end",
        "tls_header_seq_start", "tls_payload_seq_end", "processing_strategy")


def _stats(spark, sf):
    f = frames(spark, sf)
    return tf.type_statistics(f, tf.frame_messages(f))


QUERIES = {
    "f1_predicates": f1_predicates,
    "p15_paths": lambda s, d: frames(s, d).select("capture_id", "frame_no", F.array_join(T.clean_path(F.col("protocols")), ":").alias("path")),
    "p16_frames": lambda s, d: _joined(tf.frame_details(frames(s, d)), "types").withColumn("is_segment", F.col("is_segment").cast("int")),
    "p17_labels": lambda s, d: tf.frame_messages(frames(s, d)).groupBy("content_type", "version_major", "version_minor").agg(F.count("*").alias("n")).select(
        "content_type", T.type_name(F.col("content_type")).alias("name"), T.strategy(F.col("content_type")).alias("strategy"),
        T.version_name(F.col("version_major"), F.col("version_minor")).alias("version"), "n"),
    "f8_type_filter": lambda s, d: _joined(tf.filter_types(tf.frame_details(frames(s, d)), (22, 23)), "types").select("capture_id", "frame_no", "types"),
    "t1_merge_scans": t1_merge_scans,
    "t4_frame_messages": t4_frame_messages,
    "t5_prefer_reassembled": t5_prefer,
    "t6_type_stats": _stats,
    "t9_appdata_hits": lambda s, d: _joined(tf.app_data_hits(frames(s, d)), "lengths"),
    "t11_merged_hits": t11_merged_hits,
    "t12_path_summary": lambda s, d: tf.path_summary(tf.app_data_hits(frames(s, d))),
    "t13_type_hits": lambda s, d: _joined(tf.type_hits(frames(s, d), (20, 22, 23, 24)), "types", "lengths", "strategies"),
    "t13_type_totals": lambda s, d: tf.type_totals(tf.type_hits(frames(s, d))),
    "t14_summary": lambda s, d: tf.capture_summary(frames(s, d), tf.frame_messages(frames(s, d))),
    "t15_rollup": lambda s, d: tf.rollup_types(_stats(s, d)),
}

_INT = "CASE WHEN t LIKE '0x%' THEN t::BIGINT ELSE try_cast(t AS BIGINT) END"
# every (frame, position, type) of content then opaque types
_POS = f"""
 (SELECT *, CASE WHEN n BETWEEN 20 AND 24 THEN n END AS ct FROM (SELECT *, {_INT} AS n FROM (
   SELECT capture_id, frame_no, unnest(tl) AS t, unnest(range(len(tl))) AS i, lens, vers, seq_raw, app_hex, protocols FROM (
     SELECT capture_id, frame_no, seq_raw, app_hex, protocols, string_split(types_csv, ',') || CASE WHEN opaque_csv = '' THEN [] ELSE string_split(opaque_csv, ',') END AS tl,
            string_split(lengths_csv, ',') AS lens, string_split(versions_csv, ',') AS vers FROM {{frames}}))))"""
_MSG = f"""
 (SELECT *, sum(5 + length) OVER (PARTITION BY capture_id, frame_no ORDER BY i) - 5 - length AS off, row_number() OVER (PARTITION BY capture_id, frame_no ORDER BY i) - 1 AS pos
  FROM (SELECT capture_id, frame_no, i, ct, seq_raw, coalesce(lens[i + 1]::BIGINT, 0) AS length, coalesce(vers[i + 1]::BIGINT, 771) AS ver FROM {_POS} WHERE ct IS NOT NULL))"""
_NAME = "CASE ct WHEN 20 THEN 'ChangeCipherSpec' WHEN 21 THEN 'Alert' WHEN 22 THEN 'Handshake' WHEN 23 THEN 'ApplicationData' ELSE 'Heartbeat' END"
_PATH = """CASE protocols WHEN 'eth:ethertype:ip:tcp:tls:x509sat:x509sat:x509af:x509sat:pkcs1:pkcs1:a1:b2:c3:d4' THEN 'eth:ethertype:ip:tcp:tls:x509sat:x509af:pkcs1:a1:b2:c3:d4'
   WHEN 'eth:ethertype:ipv6:tcp:tls:x509sat:x509SAT:data' THEN 'eth:ethertype:ipv6:tcp:tls:x509sat:data' ELSE protocols END"""
_TYPES = f"SELECT capture_id, frame_no, list(ct ORDER BY i) FILTER (WHERE ct IS NOT NULL) AS types FROM {_POS} GROUP BY 1, 2"
# hit positions: an opaque type equal to a content type is not listed twice (does not occur in this data), '17' is not used here
_ZERO = "(length(regexp_replace(app_hex, '(..)', '\\1,', 'g')) - length(replace(regexp_replace(app_hex, '(..)', '\\1,', 'g'), '00,', ''))) // 3"
_HIT = f"""(SELECT capture_id, frame_no, any_value(protocols) AS path, list(n ORDER BY i) AS types, list(coalesce(lens[i + 1]::INT, -1) ORDER BY i) AS lengths, count(*) AS num_records,
    CASE WHEN count(*) FILTER (WHERE n = 23) > 0 THEN any_value({_ZERO}) ELSE 0 END AS zero_bytes FROM {_POS} WHERE n IN (WANTED) GROUP BY 1, 2)"""
_HIT23 = _HIT.replace("WANTED", "23")
_STATS = f"""(SELECT capture_id, ct AS content_type, count(DISTINCT frame_no) AS frames, count(*) AS records FROM {_POS} WHERE ct IS NOT NULL GROUP BY 1, 2)"""


ORACLES = {
    "f1_predicates": """SELECT capture_id, frame_no, 1 AS tls, CASE WHEN types_csv = '0x17' THEN 0 ELSE 1 END AS tls_decimal, 1 AS content, CASE WHEN segment_csv <> '' THEN 1 ELSE 0 END AS segment,
        CASE WHEN list_contains(string_split(types_csv, ','), '23') THEN 1 ELSE 0 END AS app_fragment, 23 AS seg_type FROM {frames}""",
    "p15_paths": f"SELECT capture_id, frame_no, {_PATH} AS path FROM {{frames}}",
    "p16_frames": f"""SELECT f.capture_id, f.frame_no, stream_id, seq_raw, {_PATH} AS path, array_to_string(types, ',') AS types, CASE WHEN segment_csv <> '' THEN 1 ELSE 0 END AS is_segment,
        CASE WHEN segment_csv <> '' THEN 2 ELSE 0 END AS segment_len FROM {{frames}} f JOIN ({_TYPES}) t USING (capture_id, frame_no)""",
    "p17_labels": f"""SELECT ct AS content_type, {_NAME} AS name, CASE ct WHEN 23 THEN 'mask_payload' ELSE 'keep_all' END AS strategy,
        CASE ver WHEN 769 THEN 'TLS 1.0' WHEN 771 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS version, count(*) AS n FROM {_MSG} GROUP BY ALL""",
    "f8_type_filter": f"SELECT capture_id, frame_no, array_to_string(list(ct ORDER BY i), ',') AS types FROM {_POS} WHERE ct IN (22, 23) GROUP BY 1, 2",
    "t1_merge_scans": """WITH a AS (SELECT * FROM {frames} WHERE types_csv <> '0x17'), b AS (SELECT * FROM {frames} WHERE segment_csv <> '')
        SELECT coalesce(a.capture_id, b.capture_id) AS capture_id, coalesce(a.frame_no, b.frame_no) AS frame_no, a.types_csv AS content_types, coalesce(a.protocols, b.protocols) AS protocols,
               coalesce(b.segment_csv, '') AS segment_data, CASE WHEN a.frame_no IS NULL THEN 'segment' ELSE 'record' END AS found_by
        FROM a FULL JOIN b ON a.capture_id = b.capture_id AND a.frame_no = b.frame_no""",
    "t4_frame_messages": f"""SELECT capture_id, frame_no, pos, ct AS content_type, {_NAME} AS content_type_name, ver // 256 AS version_major, ver % 256 AS version_minor, length, off AS header_start,
        off + 5 + length AS payload_end, seq_raw + off AS tls_header_seq_start, seq_raw + off + 5 + length AS tls_payload_seq_end, CASE ct WHEN 23 THEN 'mask_payload' ELSE 'keep_all' END AS processing_strategy FROM {_MSG}""",
    "t5_prefer_reassembled": f"""WITH m AS (SELECT * FROM {_MSG}), r AS (SELECT * FROM m WHERE capture_id::INT % 2 = 0 AND ct <> 23)
        SELECT capture_id, ct AS content_type, count(*) AS records FROM (SELECT * FROM r UNION ALL SELECT * FROM m WHERE capture_id NOT IN (SELECT capture_id FROM r)) GROUP BY 1, 2""",
    "t6_type_stats": f"SELECT * FROM {_STATS}",
    "t9_appdata_hits": f"SELECT capture_id, frame_no, stream_id, path, array_to_string(lengths, ',') AS lengths, num_records, zero_bytes FROM {_HIT23} JOIN (SELECT capture_id, frame_no, stream_id FROM {{frames}}) USING (capture_id, frame_no)",
    "t11_merged_hits": f"""WITH h AS (SELECT * FROM {_HIT23}), s AS (SELECT capture_id, frame_no FROM {{frames}} WHERE frame_no % 3 = 0)
        SELECT capture_id, frame_no, coalesce(path, 'eth:ip:tcp:tls') AS path, coalesce(num_records, 1) AS num_records, coalesce(zero_bytes, 0) AS zero_bytes,
               CASE WHEN path IS NULL THEN 'stream' ELSE 'direct' END AS found_by FROM h FULL JOIN s USING (capture_id, frame_no)""",
    "t12_path_summary": f"SELECT path, count(*) AS frames, sum(num_records)::BIGINT AS records FROM {_HIT23} GROUP BY 1",
    "t13_type_hits": f"""SELECT capture_id, frame_no, stream_id, path, array_to_string(types, ',') AS types, array_to_string(lengths, ',') AS lengths,
        array_to_string(list_transform(types, lambda x: CASE WHEN x = 23 THEN 'mask_payload' ELSE 'keep_all' END), ',') AS strategies, num_records, zero_bytes
        FROM {_HIT.replace('WANTED', '20, 22, 23, 24')} JOIN (SELECT capture_id, frame_no, stream_id FROM {{frames}}) USING (capture_id, frame_no)""",
    "t13_type_totals": f"SELECT n AS content_type, count(*) AS records FROM {_POS} WHERE ct IS NOT NULL GROUP BY 1",
    "t14_summary": f"""SELECT capture_id, frames, records, streams FROM (SELECT capture_id, count(*) AS frames, count(DISTINCT stream_id) AS streams FROM {{frames}} GROUP BY 1)
        JOIN (SELECT capture_id, count(*) AS records FROM {_MSG} GROUP BY 1) USING (capture_id)""",
    "t15_rollup": f"SELECT capture_id, content_type, sum(frames)::BIGINT AS frames, sum(records)::BIGINT AS records FROM {_STATS} GROUP BY ROLLUP (capture_id, content_type)",
}
