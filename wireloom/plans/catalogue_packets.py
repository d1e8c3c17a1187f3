"""Queries over packets: duplicates, addresses, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions import addresses as A
from wireloom.functions import http as H
from wireloom.operators import anonymise as an
from wireloom.operators import dedup as dd
from wireloom.operators import flows as fl
from wireloom.plans.carriers import KEY, carrier


def packets(spark: SparkSession, sf: str) -> DataFrame:
    p = carrier(spark, sf, "packets")
    return p.withColumn("len", F.col("payload_len").cast("bigint"))


def flow_packets(spark: SparkSession, sf: str) -> DataFrame:
    return fl.with_flow_keys(packets(spark, sf))


def wire(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "wire").withColumn("raw", F.unhex("raw_hex"))


def doc_packets(spark: SparkSession, sf: str) -> DataFrame:
    return carrier(spark, sf, "doc_packets").withColumn("raw", F.unhex("raw_hex"))


def _micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def d1_dedup(spark, sf):
    return dd.remove_duplicates(wire(spark, sf)).select("capture_id", "frame_no", "raw_hex", dd.digest().alias("digest"))


def d1_dedup_documents(spark, sf):
    return dd.remove_duplicates(doc_packets(spark, sf), "md5").select("capture_id", "frame_no", dd.digest("raw", "md5").alias("digest"))


def w7_flows(spark, sf):
    out = fl.flow_summary(flow_packets(spark, sf).where("proto = 'tcp'"))
    return out.withColumns({"first_seen": _micros("first_seen"), "last_seen": _micros("last_seen")})


def w6_selected_streams(spark, sf):
    hit = F.col("payload_hex").startswith("474554202F7632")
    return fl.select_streams(flow_packets(spark, sf).where("proto = 'tcp'"), hit).groupBy("capture_id", "tuple_key").agg(
        F.count("*").alias("packets"), F.sum("len").alias("bytes"))


def a8_user_map(spark, sf):
    p = packets(spark, sf)
    mapping = an.ip_map(p.where("sno = 1"), KEY)
    return an.apply_ip_map(p.select("capture_id", "frame_no", "src_ip", "dst_ip"), mapping)


def a15_global_map(spark, sf):
    p = packets(spark, sf)
    rows = p.groupBy("capture_id", F.col("src_ip").alias("orig")).agg(F.lit(1).alias("one"))
    rows = rows.select("orig", F.concat(F.lit("x-"), "capture_id", F.lit("-"), "orig").alias("anon"), F.col("capture_id").alias("load_order"))
    return an.global_map(rows)


def f7_http_likely(spark, sf):
    p = packets(spark, sf).where("proto = 'tcp'").withColumn("payload", F.unhex("payload_hex"))
    return p.select("capture_id", "frame_no", H.likely_http().cast("int").alias("likely"), H.starts_like_http().cast("int").alias("is_start"))


QUERIES = {
    "d1_dedup": d1_dedup,
    "d1_dedup_documents": d1_dedup_documents,
    "d2_dedup_stats": lambda s, d: dd.dedup_stats(wire(s, d)),
    "d3_space_saved": lambda s, d: dd.space_saved(wire(s, d)),
    "d4_top_duplicates": lambda s, d: dd.top_duplicates(wire(s, d), 10),
    "a1_addresses": lambda s, d: an.address_occurrences(packets(s, d)).groupBy("capture_id", "ip").agg(F.count("*").alias("n")),
    "a2_prefix_freq": lambda s, d: an.prefix_frequencies(packets(s, d)),
    "a3_unique_sorted": lambda s, d: an.unique_addresses(packets(s, d)),
    "a7_ip_map": lambda s, d: an.ip_map(packets(s, d), KEY),
    "a8_anonymised": lambda s, d: an.anonymise_packets(packets(s, d), KEY).select(
        "capture_id", "frame_no", "src_ip", "dst_ip", F.col("ip_modified").cast("int").alias("ip_modified")),
    "a8_user_map": lambda s, d: a8_user_map(s, d).withColumn("ip_modified", F.col("ip_modified").cast("int")),
    "a10_consistency": lambda s, d: an.consistency_check(an.ip_map(packets(s, d), KEY)),
    "a11_injective": lambda s, d: an.injectivity_check(an.ip_map(packets(s, d), KEY)),
    "a12_versions": lambda s, d: an.version_distribution(packets(s, d)),
    "a13_top_prefixes": lambda s, d: an.top_prefixes(packets(s, d), 1).unionByName(an.top_prefixes(packets(s, d), 2)),
    "a15_global_map": a15_global_map,
    "a16_stats": lambda s, d: an.anonymise_stats(packets(s, d), KEY),
    "r10_first_mappings": lambda s, d: an.first_mappings(packets(s, d), KEY),
    "r11_ip_listing": lambda s, d: an.mapping_listing(an.ip_map(packets(s, d), KEY)),
    "w1_flow_keys": lambda s, d: flow_packets(s, d).select("capture_id", "frame_no", "tuple_key", "direction"),
    "w2_streams": lambda s, d: fl.stream_ordinals(flow_packets(s, d)),
    "w4_first_packet_direction": lambda s, d: fl.first_packet_direction(flow_packets(s, d)),
    "w6_selected_streams": w6_selected_streams,
    "w7_flows": w7_flows,
    "f7_http_likely": f7_http_likely,
}

_V4 = r"regexp_matches(ip, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$')"


def _h32(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT)"


def _o(i: int, c: str) -> str:
    return f"cast(split_part({c}, '.', {i}) AS BIGINT)"


def anon_sql(c: str) -> str:
    """The keyed rotation in plain SQL, for the independent check."""
    g = lambda i: f"split_part({c}, ':', {i})"
    gi = lambda i: f"(('0x' || {g(i)})::BIGINT)"
    v4 = (
        f"(CASE WHEN {_o(1, c)} = 0 THEN 0 ELSE 1 + ({_o(1, c)} - 1 + 1 + {_h32(repr(KEY + '|1'))} % 254) % 255 END) || '.' || "
        f"(({_o(2, c)} + 1 + {_h32(repr(KEY + '|2|') + ' || split_part(' + c + ', chr(46), 1)')} % 255) % 256) || '.' || "
        f"(({_o(3, c)} + 1 + {_h32(repr(KEY + '|3|') + ' || split_part(' + c + ', chr(46), 1) || chr(46) || split_part(' + c + ', chr(46), 2)')} % 255) % 256) || '.' || "
        f"split_part({c}, '.', 4)"
    )
    parts = []
    for i in range(1, 8):
        parent = " || ':' || ".join(g(j) for j in range(1, i)) or "''"
        text = f"'{KEY}|6|{i - 1}|' || {parent}"
        parts.append(f"lower(hex(({gi(i)} + 1 + {_h32(text)} % 65535) % 65536))")
    v6 = " || ':' || ".join([*parts, g(8)])
    return f"(CASE WHEN {c} LIKE '%:%' THEN {v6} ELSE {v4} END)"


_FLOWKEY = """
  SELECT *, CASE WHEN fwd THEN src_ip || ':' || sport || '-' || dst_ip || ':' || dport ELSE dst_ip || ':' || dport || '-' || src_ip || ':' || sport END AS tuple_key,
         CASE WHEN fwd THEN 'forward' ELSE 'reverse' END AS direction, src_ip || ':' || sport AS src_end, dst_ip || ':' || dport AS dst_end
  FROM (SELECT *, (src_ip < dst_ip) OR (src_ip = dst_ip AND sport < dport) AS fwd FROM {packets})"""
_IPS = "SELECT capture_id, src_ip AS ip FROM {packets} UNION ALL SELECT capture_id, dst_ip FROM {packets}"
_PREFIXES = f"""
  SELECT 4 AS version, 1 AS level, split_part(ip, '.', 1) AS prefix FROM ips WHERE NOT contains(ip, ':')
  UNION ALL SELECT 4, 2, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) FROM ips WHERE NOT contains(ip, ':')
  UNION ALL SELECT 4, 3, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) FROM ips WHERE NOT contains(ip, ':')
  UNION ALL SELECT 6, lv, array_to_string(string_split(ip, ':')[1:lv], ':') FROM ips, (SELECT unnest(generate_series(1, 7)) AS lv) WHERE contains(ip, ':')"""
_METHODS = ["GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "PATCH ", "TRACE ", "CONNECT "]
_TEXT = "decode(unhex(payload_hex))"
_START = " OR ".join(f"starts_with({_TEXT}, '{m}')" for m in ["HTTP/1.", *_METHODS])
_ANY = " OR ".join(f"contains({_TEXT}, '{m}')" for m in ["HTTP/1.", *_METHODS])
_MAP = f"SELECT ip AS orig, {anon_sql('ip')} AS anon, CASE WHEN contains(ip, ':') THEN 6 ELSE 4 END AS version FROM (SELECT DISTINCT ip FROM ips)"

ORACLES = {
    "d1_dedup": "SELECT capture_id, min(frame_no) AS frame_no, raw_hex, sha256(unhex(raw_hex)) AS digest FROM {wire} GROUP BY capture_id, raw_hex",
    "d1_dedup_documents": "SELECT capture_id, min(frame_no) AS frame_no, md5(unhex(raw_hex)) AS digest FROM {doc_packets} GROUP BY capture_id, raw_hex",
    "d2_dedup_stats": """SELECT *, 100.0::DOUBLE * removed_packets / total_packets AS dedup_rate FROM (SELECT capture_id, count(*) AS total_packets, count(DISTINCT raw_hex) AS unique_packets,
        count(*) - count(DISTINCT raw_hex) AS removed_packets FROM {wire} GROUP BY capture_id)""",
    "d3_space_saved": """WITH w AS (SELECT capture_id, raw_hex, length(raw_hex) // 2 + 16 AS sz FROM {wire}),
        a AS (SELECT capture_id, sum(sz)::BIGINT AS bytes_in FROM w GROUP BY 1), b AS (SELECT capture_id, sum(sz)::BIGINT AS bytes_out FROM (SELECT DISTINCT * FROM w) GROUP BY 1)
        SELECT capture_id, bytes_in, bytes_out, bytes_in - bytes_out AS bytes_saved, 100.0::DOUBLE * (bytes_in - bytes_out) / bytes_in AS saved_rate FROM a JOIN b USING (capture_id)""",
    "d4_top_duplicates": """SELECT sha256(unhex(raw_hex)) AS digest, count(*) AS copies FROM {wire} GROUP BY raw_hex HAVING count(*) > 1 ORDER BY copies DESC, digest LIMIT 10""",
    "a1_addresses": f"SELECT capture_id, ip, count(*) AS n FROM ({_IPS}) GROUP BY 1, 2",
    "a2_prefix_freq": f"WITH ips AS ({_IPS}) SELECT version, level, prefix, count(*) AS n FROM ({_PREFIXES}) GROUP BY 1, 2, 3",
    "a3_unique_sorted": f"""WITH ips AS ({_IPS}) SELECT ip, CASE WHEN contains(ip, ':') THEN 6 ELSE 4 END AS version,
        CASE WHEN contains(ip, ':') THEN '6' || array_to_string(list_transform(string_split(upper(ip), ':'), lambda g: lpad(g, 4, '0')), '')
             ELSE '4' || array_to_string(list_transform(string_split(ip, '.'), lambda g: lpad(g, 3, '0')), '') END AS sort_key
        FROM (SELECT DISTINCT ip FROM ips) ORDER BY sort_key""",
    "a7_ip_map": f"WITH ips AS ({_IPS}) {_MAP}",
    "a8_anonymised": f"""SELECT capture_id, frame_no, {anon_sql('src_ip')} AS src_ip, {anon_sql('dst_ip')} AS dst_ip, 1 AS ip_modified FROM {{packets}}""",
    "a8_user_map": f"""WITH ips AS (SELECT src_ip AS ip FROM {{packets}} WHERE sno = 1 UNION ALL SELECT dst_ip FROM {{packets}} WHERE sno = 1), m AS ({_MAP})
        SELECT capture_id, frame_no, coalesce(a.anon, src_ip) AS src_ip, coalesce(b.anon, dst_ip) AS dst_ip,
               CASE WHEN a.anon IS NOT NULL OR b.anon IS NOT NULL THEN 1 ELSE 0 END AS ip_modified
        FROM {{packets}} p LEFT JOIN m a ON a.orig = src_ip LEFT JOIN m b ON b.orig = dst_ip""",
    "a10_consistency": f"""WITH ips AS ({_IPS}), m AS (SELECT * FROM ({_MAP}) WHERE version = 4), r AS (
        SELECT lv AS level, array_to_string(string_split(orig, '.')[1:lv], '.') AS prefix, array_to_string(string_split(anon, '.')[1:lv], '.') AS target
        FROM m, (SELECT unnest([2, 3]) AS lv)), g AS (SELECT level, prefix, count(DISTINCT target) AS t FROM r GROUP BY 1, 2)
        SELECT level, count(*) AS prefixes, count(*) FILTER (WHERE t > 1) AS conflicts FROM g GROUP BY 1""",
    "a11_injective": f"""WITH ips AS ({_IPS}), m AS ({_MAP}) SELECT count(*) AS originals, count(DISTINCT anon) AS targets, count(*) - count(DISTINCT anon) AS collisions FROM m""",
    "a12_versions": """SELECT *, v4_packets / packets AS v4_ratio, v6_packets / packets AS v6_ratio, 0.0::DOUBLE AS both_ratio FROM (
        SELECT capture_id, count(*) AS packets, count(*) FILTER (WHERE ip_version = 4) AS v4_packets, count(*) FILTER (WHERE ip_version = 6) AS v6_packets, 0::BIGINT AS both_packets
        FROM {packets} GROUP BY capture_id)""",
    "a13_top_prefixes": f"""WITH ips AS ({_IPS}), f AS (SELECT version, level, prefix, count(*) AS n FROM ({_PREFIXES}) GROUP BY 1, 2, 3)
        (SELECT * FROM f WHERE version = 4 AND level = 1 ORDER BY n DESC, prefix LIMIT 5) UNION ALL (SELECT * FROM f WHERE version = 4 AND level = 2 ORDER BY n DESC, prefix LIMIT 5)""",
    "a15_global_map": "SELECT src_ip AS orig, 'x-' || max(capture_id) || '-' || src_ip AS anon FROM {packets} GROUP BY src_ip",
    "a16_stats": f"""WITH ips AS ({_IPS}) SELECT a.capture_id, packets, packets AS modified_packets, original_ips, original_ips AS anonymised_ips, 100.0::DOUBLE AS anonymised_rate
        FROM (SELECT capture_id, count(*) AS packets FROM {{packets}} GROUP BY 1) a JOIN (SELECT capture_id, count(DISTINCT ip) AS original_ips FROM ips GROUP BY 1) b USING (capture_id)""",
    "r10_first_mappings": f"""WITH ips AS ({_IPS}), r AS (SELECT capture_id, orig, row_number() OVER (PARTITION BY capture_id ORDER BY orig) AS n FROM (SELECT DISTINCT capture_id, ip AS orig FROM ips))
        SELECT capture_id, n, orig, {anon_sql('orig')} AS anon FROM r WHERE n <= 5""",
    "r11_ip_listing": f"WITH ips AS ({_IPS}), m AS ({_MAP}) SELECT orig, anon FROM m ORDER BY orig",
    "w1_flow_keys": f"SELECT capture_id, frame_no, tuple_key, direction FROM ({_FLOWKEY})",
    "w2_streams": f"""SELECT capture_id, tuple_key, first_frame, cast(row_number() OVER (PARTITION BY capture_id ORDER BY first_frame) - 1 AS VARCHAR) AS stream_id
        FROM (SELECT capture_id, tuple_key, min(frame_no) AS first_frame FROM ({_FLOWKEY}) GROUP BY 1, 2)""",
    "w4_first_packet_direction": f"""SELECT capture_id, tuple_key, src_end AS client, dst_end AS server FROM ({_FLOWKEY}) QUALIFY row_number() OVER (PARTITION BY capture_id, tuple_key ORDER BY frame_no) = 1""",
    "w6_selected_streams": f"""WITH f AS (SELECT * FROM ({_FLOWKEY}) WHERE proto = 'tcp') SELECT capture_id, tuple_key, count(*) AS packets, sum(payload_len)::BIGINT AS bytes FROM f
        WHERE (capture_id, tuple_key) IN (SELECT (capture_id, tuple_key) FROM f WHERE starts_with(payload_hex, '474554202F7632')) GROUP BY 1, 2""",
    "w7_flows": f"""SELECT capture_id, tuple_key, direction, min(src_ip) AS src_ip, min(sport) AS src_port, min(dst_ip) AS dst_ip, min(dport) AS dst_port, count(*) AS packet_count,
        sum(payload_len)::BIGINT AS byte_count, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen FROM ({_FLOWKEY}) WHERE proto = 'tcp' GROUP BY 1, 2, 3""",
    "f7_http_likely": f"""SELECT capture_id, frame_no, CASE WHEN sport IN (80, 8080, 8000, 8888) OR dport IN (80, 8080, 8000, 8888) OR {_ANY} THEN 1 ELSE 0 END AS likely,
        CASE WHEN {_START} THEN 1 ELSE 0 END AS is_start FROM {{packets}} WHERE proto = 'tcp'""",
}
