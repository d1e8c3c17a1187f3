"""Packet-like inputs derived from the plain business tables.

There are no capture files in the test data, so packets, segments, TLS streams, HTTP messages and run logs are *derived* from whole
tables.  Each definition is one SQL text that both Spark and an independent SQL engine can run; only row generators differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "loom-key"

_SERVERS4 = "CASE sno WHEN 1 THEN '172.16.1.10' WHEN 2 THEN '172.16.2.20' WHEN 3 THEN '192.168.7.30' WHEN 4 THEN '10.9.8.7' ELSE '8.8.8.8' END"
_SERVERS4_HEX = "CASE sno WHEN 1 THEN 'AC10010A' WHEN 2 THEN 'AC100214' WHEN 3 THEN 'C0A8071E' WHEN 4 THEN '0A090807' ELSE '08080808' END"

PACKETS = f"""
SELECT capture_id, frame_no, ts, event_type, user_id, vb, enc, reply, ip_version, proto, sno,
       CASE WHEN reply THEN srv ELSE cli END AS src_ip, CASE WHEN reply THEN cli ELSE srv END AS dst_ip,
       CASE WHEN reply THEN srv_hex ELSE cli_hex END AS src_hex, CASE WHEN reply THEN cli_hex ELSE srv_hex END AS dst_hex,
       CASE WHEN reply THEN srv_port ELSE cli_port END AS sport, CASE WHEN reply THEN cli_port ELSE srv_port END AS dport,
       CASE WHEN proto = 'tcp' THEN 1000 + (user_id * 7919) % 1000000 + vb * 64 END AS seq,
       hex(payload_text) AS payload_hex, length(payload_text) AS payload_len
FROM (
  SELECT capture_id, frame_no, ts, event_type, user_id, vb, enc, reply, ip_version, sno,
         CASE WHEN sno = 5 THEN 'udp' ELSE 'tcp' END AS proto,
         CASE WHEN ip_version = 6 THEN 'fd00:ffff:0:0:0:0:0:' || cast(sno AS string) ELSE {_SERVERS4} END AS srv,
         CASE WHEN ip_version = 6 THEN 'FD00FFFF00000000000000000000000' || cast(sno AS string) ELSE {_SERVERS4_HEX} END AS srv_hex,
         CASE WHEN ip_version = 6
              THEN 'fd00:' || lower(hex(user_id % 7)) || ':0:1:2:3:' || lower(hex(user_id % 16)) || ':' || lower(hex(user_id % 250 + 1))
              ELSE '10.' || cast(user_id % 4 AS string) || '.' || cast(user_id % 16 AS string) || '.' || cast(user_id % 250 + 1 AS string)
         END AS cli,
         CASE WHEN ip_version = 6
              THEN 'FD00' || lpad(hex(user_id % 7), 4, '0') || '0000000100020003' || lpad(hex(user_id % 16), 4, '0') || lpad(hex(user_id % 250 + 1), 4, '0')
              ELSE '0A' || lpad(hex(user_id % 4), 2, '0') || lpad(hex(user_id % 16), 2, '0') || lpad(hex(user_id % 250 + 1), 2, '0')
         END AS cli_hex,
         CASE sno WHEN 2 THEN 80 WHEN 4 THEN 8080 WHEN 5 THEN 53 ELSE 443 END AS srv_port,
         cast(1024 + user_id % 60000 AS bigint) AS cli_port,
         CASE WHEN sno = 2 THEN 'GET /v' || cast(vb AS string) || ' HTTP/1.1' ELSE event_type || ':' || cast(vb AS string) || ':' END
           || repeat('x', cast(user_id % 7 AS int)) AS payload_text
  FROM (
    SELECT cast(cast(ts AS date) AS string) AS capture_id, event_id AS frame_no, ts, event_type, user_id, vb,
           user_id % 8 AS enc, (user_id + vb) % 3 = 0 AS reply, CASE WHEN user_id % 8 = 6 THEN 6 ELSE 4 END AS ip_version,
           CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS sno
    FROM (SELECT event_id, ts, event_type, user_id, cast(floor(value / 50) AS bigint) AS vb FROM {{events}}) e0
  ) e1
) e2
"""

# Ethernet frames around the packets; user_id % 8 picks the encapsulation.
WIRE = f"""
SELECT *, eth || tags || outer_l3 || inner_l3 || l4 || payload_hex AS raw_hex
FROM (
  SELECT *,
    '0200' || lpad(hex(sno), 8, '0') || '0200' || lpad(hex(user_id % 65536), 8, '0') AS eth,
    CASE enc WHEN 1 THEN '8100' || lpad(hex(8192 + user_id % 4000), 4, '0') || '0800'
             WHEN 2 THEN '88A8' || lpad(hex(100 + user_id % 100), 4, '0') || '8100' || lpad(hex(12288 + user_id % 4000), 4, '0') || '0800'
             WHEN 3 THEN '8847' || lpad(hex((16 + user_id % 1000) * 4096 + 320), 8, '0')
             WHEN 6 THEN '86DD' ELSE '0800' END AS tags,
    CASE enc WHEN 4 THEN '45000000000140004011' || '0000' || 'C0000201C0000202' || '30D412B500000000' || '08000000'
                         || lpad(hex(5000 + user_id % 50), 6, '0') || '00' || '0A00000000010A0000000002' || '0800'
             WHEN 5 THEN '4500000000014000402F' || '0000' || 'C0000201C0000202' || '00000800'
             ELSE '' END AS outer_l3,
    CASE WHEN ip_version = 6
         THEN '60000000' || lpad(hex(l4_len + payload_len), 4, '0') || (CASE WHEN proto = 'tcp' THEN '06' ELSE '11' END) || '40' || src_hex || dst_hex
         ELSE '4500' || lpad(hex(20 + l4_len + payload_len), 4, '0') || '00014000' || '40' || (CASE WHEN proto = 'tcp' THEN '06' ELSE '11' END) || '0000' || src_hex || dst_hex
    END AS inner_l3,
    CASE WHEN proto = 'tcp'
         THEN lpad(hex(sport), 4, '0') || lpad(hex(dport), 4, '0') || lpad(hex(seq), 8, '0') || '00000000' || '5018' || '2000' || '00000000'
         ELSE lpad(hex(sport), 4, '0') || lpad(hex(dport), 4, '0') || lpad(hex(8 + payload_len), 4, '0') || '0000' END AS l4
  FROM (SELECT *, CASE WHEN proto = 'tcp' THEN 20 ELSE 8 END AS l4_len FROM ({PACKETS}) p0) p1
) p2
"""

# Exact copies in free text: a document is a packet, its source the capture.
DOC_PACKETS = """
SELECT source AS capture_id, doc_id AS frame_no, hex(text) AS raw_hex FROM {documents}
"""

# One flow-direction per document: 100-byte chunks; each 5th chunk is sent again later with other bytes, each 7th starts 10 bytes early.
SEGMENTS = """
SELECT capture_id, tuple_key, direction, frame_no, seq, payload_hex, cast(length(payload_hex) / 2 AS bigint) AS len
FROM (
  SELECT source AS capture_id, '10.0.0.1:' || cast(doc_id AS string) || '-10.0.0.2:443' AS tuple_key, 'forward' AS direction,
         doc_id * 100000 + ci * 2 + again AS frame_no,
         1000 + (doc_id % 500000) * 4000 + ci * 100 - early AS seq,
         CASE WHEN again = 1 THEN repeat('58', cast(length(body) / 2 AS int)) ELSE body END AS payload_hex
  FROM (
    SELECT doc_id, source, ci, again, early, {body} AS body
    FROM (
      SELECT doc_id, source, h, ci, again, CASE WHEN ci % 7 = 6 AND again = 0 THEN 10 ELSE 0 END AS early
      FROM ({chunks}) c0 CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) r
      WHERE again = 0 OR ci % 5 = 4
    ) c1
  ) c2
) c3
WHERE length(payload_hex) > 0
"""
# The same with each 11th chunk lost, for what happens at gaps.
GAPPED_SEGMENTS = SEGMENTS.replace("WHERE again = 0 OR ci % 5 = 4", "WHERE ci % 11 <> 10 AND (again = 0 OR ci % 5 = 4)")
# The chunking engine side works on bytes (constant-time substring), the other one on hex text.
_CHUNKS = {
    "spark": """SELECT doc_id, source, h, ci FROM (SELECT doc_id, source, cast(text AS binary) AS h FROM {documents}) d
                LATERAL VIEW explode(sequence(0L, cast(floor((length(h) - 1) / 100) AS bigint))) x AS ci WHERE length(h) > 0""",
    "duck": """SELECT doc_id, source, h, unnest(generate_series(0, cast(floor((length(h) - 1) / 200) AS bigint))) AS ci
               FROM (SELECT doc_id, source, hex(text) AS h FROM {documents}) d WHERE length(h) > 0""",
}
_BODY = {
    "spark": "hex(substr(h, cast(ci * 100 - early + 1 AS int), cast(100 + early AS int)))",
    "duck": "substr(h, cast(ci * 200 - early * 2 + 1 AS int), cast(200 + early * 2 AS int))",
}
_PACKET = {"spark": "hex(substr(h, cast(ci * 100 + 1 AS int), 100))", "duck": "substr(h, cast(ci * 200 + 1 AS int), 200)"}

# Each turn is one contiguous stretch of TLS records of at most 16,000 bytes (handshake, CCS, app data, sometimes a cut-off alert;
# sometimes junk first).
TLS_STREAMS = """
SELECT *, junk || {handshakes} || '140303000101' || {app_data} || tail AS stream_hex
FROM (
  SELECT conv_id, turn, role, ha, hb, cast(length(ha) / 2 AS bigint) AS na, cast(length(hb) / 2 AS bigint) AS nb,
         CASE WHEN turn % 4 = 3 THEN 'AABB' ELSE '' END AS junk,
         CASE WHEN turn % 3 = 2 THEN '150303000201' ELSE '' END AS tail,
         cast(conv_id % 50 AS string) AS capture_id,
         CASE WHEN conv_id % 2 = 0 THEN '10.1.0.1:' || cast(40000 + conv_id % 20000 AS string) || '-10.1.0.2:443'
              ELSE '10.1.0.2:443-10.2.0.9:' || cast(40000 + conv_id % 20000 AS string) END AS tuple_key,
         CASE WHEN role = 'user' THEN 'forward' ELSE 'reverse' END AS direction,
         1000 + conv_id * 16 + turn * 1048576 AS base_seq
  FROM (
    SELECT conv_id, turn, role, substr(h, 1, cast(2 * floor(length(h) / 6) AS int)) AS ha,
           substr(h, cast(2 * floor(length(h) / 6) AS int) + 1) AS hb
    FROM (SELECT conv_id, turn, role, hex(text) AS h FROM {conversations}) t0
  ) t1
) t2
"""
# Segments of the streams above (150 bytes each), in capture order.
TLS_SEGMENTS = f"""
SELECT capture_id, tuple_key, direction, conv_id, turn, conv_id * 1000000 + turn * 10000 + ci AS frame_no,
       base_seq + ci * 150 AS seq, payload_hex, {{tls_len}} AS len
FROM (SELECT *, {{tls_piece}} AS payload_hex FROM ({{tls_chunks}}) s0) s1
"""
_RECORDS = {
    "spark": """array_join(transform(sequence(0, cast(greatest(ceil({n} / 16000), 1) AS int) - 1), i -> '{kind}0303' || lpad(hex(least({n} - i * 16000, 16000)), 4, '0') || substr({h}, i * 32000 + 1, 32000)), '')""",
    "duck": """array_to_string(list_transform(range(0, cast(greatest(ceil({n} / 16000), 1) AS int)), lambda i: '{kind}0303' || lpad(hex(cast(least({n} - i * 16000, 16000) AS bigint)), 4, '0') || substr({h}, i * 32000 + 1, 32000)), '')""",
}
_HANDSHAKES, _APP_DATA = ({d: t.format(n=n, h=h, kind=kind) for d, t in _RECORDS.items()} for n, h, kind in (("na", "ha", "16"), ("nb", "hb", "17")))
_TLS_CHUNKS = {
    "spark": f"SELECT * FROM (SELECT *, unhex(stream_hex) AS bytes FROM ({TLS_STREAMS}) ts) tb LATERAL VIEW explode(sequence(0L, cast(floor((length(bytes) - 1) / 150) AS bigint))) x AS ci",
    "duck": f"""SELECT *, unnest(generate_series(0, cast(floor((length(stream_hex) - 1) / 300) AS bigint))) AS ci FROM ({TLS_STREAMS}) ts""",
}
# Lengths are told from the place of a segment, so that readers of lengths alone build no segment.
_LEN = {n: {"spark": f"least({n}L, length(bytes) - ci * {n})", "duck": "cast(length(payload_hex) / 2 AS bigint)"} for n in (150, 256, 512)}
_TLS_PIECE = {"spark": "hex(substr(bytes, cast(ci * 150 + 1 AS int), 150))", "duck": "substr(stream_hex, cast(ci * 300 + 1 AS int), 300)"}

# Dissected frames with up to three records; list-valued fields travel as comma lists and are split by each engine.
FRAMES = """
SELECT cast(conv_id % 50 AS string) AS capture_id, conv_id * 100 + turn AS frame_no, cast(conv_id AS string) AS stream_id,
       CASE WHEN turn = 0 THEN '22' WHEN turn % 4 = 1 THEN '22,20,22' WHEN turn % 4 = 2 THEN '23' WHEN turn % 4 = 3 THEN '23,23' ELSE '0x17' END AS types_csv,
       CASE WHEN turn % 5 = 4 THEN '0x18' WHEN turn % 7 = 6 THEN '99' ELSE '' END AS opaque_csv,
       CASE WHEN turn % 4 = 1 THEN cast(nt AS string) || ',1,' || cast(nt + 3 AS string)
            WHEN turn % 4 = 3 THEN cast(nt AS string) ELSE cast(nt AS string) || ',7' END AS lengths_csv,
       CASE WHEN turn % 2 = 0 THEN '0x0303,0x0304' ELSE '0x0301' END AS versions_csv,
       CASE WHEN turn % 6 = 5 THEN 'aa:bb' ELSE '' END AS segment_csv,
       CASE WHEN turn % 3 = 0 THEN 'eth:ethertype:ip:tcp:tls:x509sat:x509sat:x509af:x509sat:pkcs1:pkcs1:a1:b2:c3:d4'
            WHEN turn % 3 = 1 THEN 'eth:ethertype:ip:tcp:tls' ELSE 'eth:ethertype:ipv6:tcp:tls:x509sat:x509SAT:data' END AS protocols,
       1000 + conv_id * 65536 + turn * 4096 AS seq_raw, nt, hex(text) || '0000' AS app_hex, text
FROM (SELECT conv_id, turn, role, text, cast(length(text) AS bigint) AS nt FROM {conversations}) f0
"""

# A request per page, header first, then the markup; 256-byte segments in capture order.
HTTP_STREAMS = """
SELECT page_id, cast(page_id % 20 AS string) AS capture_id,
       '10.3.0.1:' || cast(20000 + page_id % 40000 AS string) || '-10.3.0.2:80' AS tuple_key, 'forward' AS direction,
       hex(CASE WHEN page_id % 3 = 0 THEN 'HTTP/1.1 200 OK' ELSE 'GET /p/' || cast(page_id AS string) || ' HTTP/1.1' END || chr(13) || chr(10)
           || 'Host: h' || cast(page_id % 9 AS string) || '.example' || chr(13) || chr(10)
           || 'Cookie: id=' || cast(page_id AS string) || chr(13) || chr(10) || ' folded=' || cast(page_id * 7 AS string) || chr(13) || chr(10)
           || 'Accept: */*' || chr(13) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'Referer:  ' || url || chr(13) || chr(10) ELSE '' END
           || chr(13) || chr(10)) AS header_hex,
       hex(replace(html, chr(13), ' ')) AS body_hex
FROM {pages}
"""
HTTP_SEGMENTS = """
SELECT capture_id, tuple_key, direction, page_id, page_id * 1000000 + ci AS frame_no,
       5000 + (page_id % 100000) * 40000 + ci * 256 AS seq, payload_hex, {http_len} AS len,
       cast(20000 + page_id % 40000 AS bigint) AS sport, 80 AS dport
FROM (SELECT *, {http_piece} AS payload_hex FROM ({http_chunks}) h0) h1
"""
_HTTP_CHUNKS = {
    "spark": f"SELECT * FROM (SELECT *, unhex(header_hex || body_hex) AS bytes FROM ({HTTP_STREAMS}) hs) hb LATERAL VIEW explode(sequence(0L, cast(floor((length(bytes) - 1) / 256) AS bigint))) x AS ci",
    "duck": f"""SELECT *, unnest(generate_series(0, cast(floor((length(header_hex) + length(body_hex) - 1) / 512) AS bigint))) AS ci FROM ({HTTP_STREAMS}) hs""",
}
_HTTP_PIECE = {"spark": "hex(substr(bytes, cast(ci * 256 + 1 AS int), 256))", "duck": "substr(header_hex || body_hex, cast(ci * 512 + 1 AS int), 512)"}

# One request per document, many to a flow: its whole text is a folded field; each third header breaks off at a line that is no field.
LONG_HTTP_STREAMS = """
SELECT doc_id, capture_id, tuple_key, direction, complete, start_hex, start_hex || rest_hex AS stream_hex,
       start_hex || CASE WHEN complete = 1 THEN substr(rest_hex, 1, length(rest_hex) - 8) ELSE '' END AS header_hex
FROM (
  SELECT doc_id, source AS capture_id, '10.4.0.1:20000-10.4.0.2:8080' AS tuple_key, 'forward' AS direction, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS complete,
         hex('POST /d/' || cast(doc_id AS string) || ' HTTP/1.1' || chr(13) || chr(10)) AS start_hex,
         hex('X-Text: ' || replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), chr(13) || chr(10) || ' ') || chr(13) || chr(10)
             || CASE WHEN doc_id % 3 = 0 THEN 'no field' || chr(13) || chr(10) ELSE '' END || chr(13) || chr(10) || 'done') AS rest_hex
  FROM {documents}
) d0
"""
LONG_HTTP_SEGMENTS = """
SELECT capture_id, tuple_key, direction, doc_id * 1000000 + ci AS frame_no, doc_id * 4000000 + ci * 512 AS seq, payload_hex, {long_len} AS len,
       cast(20000 AS bigint) AS sport, cast(8080 AS bigint) AS dport
FROM (SELECT *, {long_piece} AS payload_hex FROM ({long_http_chunks}) h0) h1
"""
_LONG_HTTP_CHUNKS = {
    "spark": f"SELECT * FROM (SELECT *, unhex(stream_hex) AS bytes FROM ({LONG_HTTP_STREAMS}) hs) hb LATERAL VIEW explode(sequence(0L, cast(floor((length(bytes) - 1) / 512) AS bigint))) x AS ci",
    "duck": f"SELECT *, unnest(generate_series(0, cast(floor((length(stream_hex) - 1) / 1024) AS bigint))) AS ci FROM ({LONG_HTTP_STREAMS}) hs",
}

_LONG_PIECE = {"spark": "hex(substr(bytes, cast(ci * 512 + 1 AS int), 512))", "duck": "substr(stream_hex, cast(ci * 1024 + 1 AS int), 1024)"}

# Ethernet frames around the TLS and HTTP segments.
_FRAME = """
SELECT capture_id, tuple_key, direction, frame_no, seq, payload_hex, len,
       '02000000000102000000000208004500' || lpad(hex(40 + len), 4, '0') || '0001400040060000' || src_hex || dst_hex || lpad(hex(sport), 4, '0') || lpad(hex(dport), 4, '0')
       || lpad(hex(seq % 4294967296), 8, '0') || '000000005018200000000000' || payload_hex AS raw_hex
FROM (
  SELECT prefix || capture_id AS capture_id, tuple_key, direction, frame_no, seq, payload_hex, len,
         CASE WHEN direction = 'forward' THEN a_hex ELSE b_hex END AS src_hex, CASE WHEN direction = 'forward' THEN b_hex ELSE a_hex END AS dst_hex,
         CASE WHEN direction = 'forward' THEN a_port ELSE b_port END AS sport, CASE WHEN direction = 'forward' THEN b_port ELSE a_port END AS dport
  FROM (INNER_) i0
) i1
"""
TLS_WIRE = _FRAME.replace("INNER_", f"""
SELECT *, 't' AS prefix, CASE WHEN conv_id % 2 = 0 THEN '0A010001' ELSE '0A010002' END AS a_hex, CASE WHEN conv_id % 2 = 0 THEN '0A010002' ELSE '0A020009' END AS b_hex,
       cast(CASE WHEN conv_id % 2 = 0 THEN 40000 + conv_id % 20000 ELSE 443 END AS bigint) AS a_port, cast(CASE WHEN conv_id % 2 = 0 THEN 443 ELSE 40000 + conv_id % 20000 END AS bigint) AS b_port
FROM ({TLS_SEGMENTS}) t0""")
HTTP_WIRE = _FRAME.replace("INNER_", f"""
SELECT *, 'h' AS prefix, '0A030001' AS a_hex, '0A030002' AS b_hex, cast(20000 + page_id % 40000 AS bigint) AS a_port, cast(80 AS bigint) AS b_port FROM ({HTTP_SEGMENTS}) h0""")

# Each document as a little-endian capture file: 100-byte packets, one per second.
DOC_CAPTURES = """
SELECT cast(doc_id AS string) AS capture_id, ci + 1 AS frame_no, 1000000 * (ci % 65536) + 7 AS ts_us, {packet} AS raw_hex,
       lpad(hex(ci % 256), 2, '0') || lpad(hex(cast(floor(ci / 256) AS bigint) % 256), 2, '0') || '000007000000' AS stamp_hex
FROM ({chunks}) c0
"""

# Stage log: one capture per order, steps by return flag.
STAGE_RUNS = """
SELECT cast(o_orderkey AS string) AS capture_id, o_orderpriority AS batch,
       CASE l_returnflag WHEN 'A' THEN 'remove_dupes' WHEN 'N' THEN 'anonymize_ips' ELSE 'mask_payloads' END AS step,
       cast(l_quantity AS bigint) AS processed, cast(floor(l_quantity * l_discount * 5) AS bigint) AS modified,
       cast(round(l_extendedprice * 100) AS bigint) AS duration_us, cast(round(l_tax * 100) AS bigint) AS errors,
       CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_tax < 0.02 THEN 'failed' WHEN l_tax > 0.07 THEN 'skipped' ELSE 'completed' END AS status,
       cast(l_quantity AS bigint) * 1500 AS bytes_in, cast(l_quantity AS bigint) * 1500 - cast(round(l_discount * 1000) AS bigint) AS bytes_out,
       cast(l_shipdate AS date) AS run_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Error log.
ERRORS = """
SELECT event_id AS error_id, ts, capture_id, error_type, severity, component, operation, recovered FROM (
  SELECT event_id, ts, cast(cast(ts AS date) AS string) AS capture_id, event_type,
       CASE user_id % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'io' WHEN 2 THEN 'validation' ELSE 'memory' END AS error_type,
       CASE WHEN user_id % 10 = 0 THEN 'critical' WHEN user_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity,
       CASE WHEN user_id % 2 = 0 THEN 'masker' ELSE 'marker' END AS component,
       CASE WHEN user_id % 5 < 2 THEN 'read' ELSE 'write' END AS operation, value < 10 AS recovered
  FROM {events}) q
"""

VIEWS = {
    "packets": PACKETS,
    "wire": WIRE,
    "doc_packets": DOC_PACKETS,
    "segments": SEGMENTS,
    "gapped_segments": GAPPED_SEGMENTS,
    "tls_streams": TLS_STREAMS,
    "tls_segments": TLS_SEGMENTS,
    "frames": FRAMES,
    "doc_captures": DOC_CAPTURES,
    "http_streams": HTTP_STREAMS,
    "http_segments": HTTP_SEGMENTS,
    "long_http_streams": LONG_HTTP_STREAMS,
    "long_http_segments": LONG_HTTP_SEGMENTS,
    "tls_wire": TLS_WIRE,
    "http_wire": HTTP_WIRE,
    "stage_runs": STAGE_RUNS,
    "errors": ERRORS,
}
_TABLES = ("events", "documents", "conversations", "pages", "orders", "lineitem")


def carrier_sql(name: str, dialect: str) -> str:
    """SQL text of a carrier for ``spark`` (tables stay ``{name}`` placeholders) or ``duck`` (tables are registered views)."""
    text = VIEWS[name]
    for token, options in (("{chunks}", _CHUNKS), ("{tls_chunks}", _TLS_CHUNKS), ("{tls_piece}", _TLS_PIECE), ("{http_chunks}", _HTTP_CHUNKS), ("{http_piece}", _HTTP_PIECE), ("{long_http_chunks}", _LONG_HTTP_CHUNKS), ("{long_piece}", _LONG_PIECE), ("{tls_len}", _LEN[150]), ("{http_len}", _LEN[256]), ("{long_len}", _LEN[512]), ("{handshakes}", _HANDSHAKES), ("{app_data}", _APP_DATA), ("{body}", _BODY), ("{packet}", _PACKET)):
        text = text.replace(token, options[dialect])
    if dialect == "duck":
        for table in _TABLES:
            text = text.replace("{%s}" % table, table)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. A file too small to be split is spread over the cores; real inputs have more splits than cores and stay as read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = carrier_sql(name, "spark")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{%s}" % t in text})
