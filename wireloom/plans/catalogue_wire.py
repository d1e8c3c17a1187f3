"""Queries over raw frames: layer decoding and the sanitising flow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wireloom.functions import layers as L
from wireloom.functions import tls as T
from wireloom.functions.octets import be_int
from wireloom.operators import dissect as di
from wireloom.operators import validate as va
from wireloom.operators.scan import running_count
from wireloom.operators.stage import materialise, shared_folder
from wireloom.plans.carriers import KEY, carrier, table
from wireloom.plans.catalogue_packets import anon_sql, wire
from wireloom.plans.catalogue_streams import _MERGE, _RULES, _WALK
from wireloom.plans.sanitise import sanitise
from wireloom.sources.captures import check_header, read_captures, split_content
from wireloom.sources.sinks import processed_name, write_captures


def raw_frames(spark, sf):
    return wire(spark, sf).select("capture_id", "frame_no", "raw")


def _fields(spark, sf, name, maker, which=-1):
    d = di.with_layers(raw_frames(spark, sf)).withColumn("l", F.explode(F.slice(L.named(F.col("layers"), name), which, 1)))
    out = d.select("capture_id", "frame_no", maker(F.col("raw"), F.col("l.off")).alias("f")).select("capture_id", "frame_no", "f.*")
    for f in out.schema.fields:
        if f.dataType.typeName() == "boolean":
            out = out.withColumn(f.name, F.col(f.name).cast("int"))
    return out


def p1_layers(spark, sf):
    d = di.dissect(raw_frames(spark, sf))
    return d.select(
        "capture_id", "frame_no", F.array_join(F.col("layers.name"), "/").alias("layers"), F.col("parse_ok").cast("int").alias("parse_ok"), "encap", "depth",
        F.size("ip_layers").alias("n_ips"), di.is_encapsulated().cast("int").alias("encapsulated"), di.has_vlan().cast("int").alias("vlan"),
        di.has_multiple_ips().cast("int").alias("multi_ip"))


def p3_vlans(spark, sf):
    d = di.dissect(raw_frames(spark, sf)).select("capture_id", "frame_no", F.posexplode("vlans").alias("n", "v")).select("capture_id", "frame_no", "n", "v.*")
    return d.withColumns({"dei": F.col("dei").cast("int"), "is_outer": F.col("is_outer").cast("int")})


def p12_payload(spark, sf):
    return di.dissect(raw_frames(spark, sf)).select(
        "capture_id", "frame_no", "proto", "src_ip", "dst_ip", "sport", "dport", "seq", F.hex("payload").alias("payload_hex"), F.col("is_encrypted").cast("int").alias("is_encrypted"))


def p11_outermost(spark, sf):
    d = di.dissect(raw_frames(spark, sf))
    o, i = di.outermost_ip(), di.innermost_ip()
    return d.select("capture_id", "frame_no", o["src"].alias("outer_src"), o["dst"].alias("outer_dst"), i["src"].alias("inner_src"), i["depth"].alias("inner_depth"))


def sanitise_flagship(spark, sf):
    """Dedup, anonymise and mask real frames, then summarise per capture."""
    out = sanitise(raw_frames(spark, sf), KEY, protocol="none")
    return out.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.count_if("ip_modified").alias("ip_modified"), F.count_if("payload_modified").alias("payload_modified"),
        F.sum("masked_bytes").cast("bigint").alias("masked_bytes"), F.count_distinct("src_ip").alias("sources"))


def sanitise_packets(spark, sf):
    out = sanitise(raw_frames(spark, sf), KEY, protocol="none")
    return out.select("capture_id", "frame_no", "tuple_key", "src_ip", "dst_ip", F.hex("payload").alias("payload_hex"))


def protocol_frames(spark, sf, *names):
    out = None
    for name in names:
        part = carrier(spark, sf, name).select("capture_id", "frame_no", F.unhex("raw_hex").alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out


def sanitised(spark, sf, protocol, *names):
    """Real frames of whole texts through the whole flow: dedup, anonymise, find rules, mask."""
    out = sanitise(protocol_frames(spark, sf, *names), KEY, protocol=protocol)
    return out.select("capture_id", "frame_no", "direction", F.col("ip_modified").cast("int").alias("ip_modified"), F.hex("payload").alias("payload_hex"), "kept_bytes", "masked_bytes")


def masked_pair(spark, sf):
    """TLS frames before and after the whole flow: the record type each begins with, its length, its payload."""
    def side(rows):
        payload, none = F.col("payload"), F.array()
        start = T.is_record_start(payload)
        return rows.select(
            "capture_id", "frame_no", "payload", F.lit("tcp").alias("path"), F.when(start, F.array(be_int(payload, 0, 1))).otherwise(none.cast("array<bigint>")).alias("types"),
            F.array(F.length(payload).cast("bigint")).alias("lengths"), F.lit(None).cast("bigint").alias("zero_bytes"))

    out = materialise(sanitise(protocol_frames(spark, sf, "tls_wire"), KEY, protocol="tls").select("capture_id", "frame_no", "payload"))
    source = carrier(spark, sf, "tls_segments").select(F.concat(F.lit("t"), "capture_id").alias("capture_id"), "frame_no", F.unhex("payload_hex").alias("payload"))
    return side(source), side(out)


def s2_packets(spark, sf):
    """Capture bytes made from whole documents, then read back record by record."""
    rows = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("capture_id"), F.col("text").cast("binary").alias("b"))
    byte = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")

    def record(ci):
        body = F.substring("b", (ci * 100 + 1).cast("int"), F.lit(100))
        size = F.concat(byte(F.length(body)), F.lit("000000"))
        return F.concat(byte(ci % 256), byte(F.floor(ci / 256) % 256), F.lit("0000"), F.lit("07000000"), size, size, F.hex(body))

    records = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 100).cast("int")), record), "")
    content = F.unhex(F.concat(F.lit("D4C3B2A1020004000000000000000000FFFF000001000000"), records))
    out = split_content(rows.select("capture_id", content.alias("content")))
    return out.select("capture_id", "frame_no", "ts_us", "wire_len", "linktype", F.hex("raw").alias("raw_hex"))


def s2_ranged(spark, sf):
    """One capture file per source, a whole document in each record, written and read back in byte ranges."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("capture_id"), F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit(""))).alias("raw"))
    ids = running_count(docs.select("capture_id", "doc_id"), ["capture_id"], "doc_id", "before").select("doc_id", (F.col("before") + 1).alias("frame_no"))
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    write_captures(docs.join(ids, "doc_id").select("capture_id", "frame_no", F.col("doc_id").alias("ts_us"), "raw"), folder)
    name = F.regexp_extract("capture_id", r"([^/]+)_processed[^/]*$", 1)
    return read_captures(spark, folder, range_bytes=1 << 18).select(name.alias("capture_id"), "frame_no", "ts_us", "wire_len", "linktype", F.hex("raw").alias("raw_hex"))


def s9_header_check(spark, sf):
    docs = table(spark, sf, "documents")
    magic = F.when(F.col("doc_id") % 3 == 0, "A1B2C3D4").when(F.col("doc_id") % 3 == 1, "0A0D0D0A").otherwise("00000000")
    content = F.unhex(F.concat(magic, F.lit("00020004000000000000000000000FFF"), F.lpad(F.hex(F.col("doc_id") % 200), 8, "0"), F.hex("text")))
    return docs.withColumn("content", content).select("doc_id", check_header().alias("h")).select(
        "doc_id", F.col("h.is_valid").cast("int").alias("is_valid"), "h.format", "h.version", "h.linktype", "h.problem")


def a9_checksums(spark, sf):
    """Checksums of rewritten frames: the deepest IPv4 header and the transport layer over it."""
    d = di.with_layers(raw_frames(spark, sf))
    d = d.withColumn("raw", di.fix_checksums("raw", F.col("layers.name"), F.col("layers.off"), F.col("layers.len")))
    ip, t = F.element_at(L.named(F.col("layers"), "IP", "IPv6"), -1), F.element_at(L.named(F.col("layers"), "TCP", "UDP"), -1)
    return d.select(
        "capture_id", "frame_no", F.when(ip["name"] == "IP", be_int(F.col("raw"), ip["off"] + 10, 2)).alias("ip_sum"),
        F.when(t["name"] == "TCP", be_int(F.col("raw"), t["off"] + 16, 2)).otherwise(be_int(F.col("raw"), t["off"] + 6, 2)).alias("l4_sum"))


def s10_names(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("/in/"), "source", F.lit("/f"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".pcap").otherwise(".pcapng"))
    return docs.select("doc_id", processed_name(path).alias("out_path"))


QUERIES = {
    "s2_packets": s2_packets,
    "s2_ranged": s2_ranged,
    "s9_header_check": s9_header_check,
    "s10_output_names": s10_names,
    "a9_checksums": a9_checksums,
    "sanitise_flagship": sanitise_flagship,
    "sanitise_packets": sanitise_packets,
    "sanitise_tls": lambda s, d: sanitised(s, d, "tls", "tls_wire"),
    "sanitise_http": lambda s, d: sanitised(s, d, "http", "http_wire"),
    "sanitise_auto": lambda s, d: sanitised(s, d, "auto", "tls_wire", "http_wire"),
    "v2_payloads": lambda s, d: va.preservation_frames(*masked_pair(s, d)),
    "v3_payloads": lambda s, d: va.smart_masking_frames(*masked_pair(s, d)),
    "v6_changed_bytes": lambda s, d: va.changed_payloads(*masked_pair(s, d)),
    "p1_layers": p1_layers,
    "p2_ethernet": lambda s, d: _fields(s, d, "Ethernet", L.ethernet_fields, 1),
    "p3_vlans": p3_vlans,
    "p4_mpls": lambda s, d: _fields(s, d, "MPLS", L.mpls_fields),
    "p5_vxlan": lambda s, d: _fields(s, d, "VXLAN", L.vxlan_fields),
    "p6_gre": lambda s, d: _fields(s, d, "GRE", L.gre_fields),
    "p7_ipv4": lambda s, d: _fields(s, d, "IP", L.ipv4_fields),
    "p8_ipv6": lambda s, d: _fields(s, d, "IPv6", L.ipv6_fields),
    "p9_tcp": lambda s, d: _fields(s, d, "TCP", L.tcp_fields),
    "p10_udp": lambda s, d: _fields(s, d, "UDP", L.udp_fields),
    "p11_ip_layers": p11_outermost,
    "p12_payload": p12_payload,
}

_L3 = "CASE WHEN ip_version = 6 THEN 'IPv6' ELSE 'IP' END"
_MID = "CASE enc WHEN 1 THEN 'Dot1Q/' WHEN 2 THEN 'Dot1AD/Dot1Q/' WHEN 3 THEN 'MPLS/' WHEN 4 THEN 'IP/UDP/VXLAN/Ethernet/' WHEN 5 THEN 'IP/GRE/' ELSE '' END"
_MAC = lambda c, o: " || ':' || ".join(f"lower(substr({c}, {o + 2 * i}, 2))" for i in range(6))
_KEPT = "SELECT * FROM {wire} QUALIFY row_number() OVER (PARTITION BY capture_id, raw_hex ORDER BY frame_no) = 1"

def _word_sum(h: str) -> str:
    return f"list_sum(list_transform(range(0, length({h}) // 4), lambda i: ('0x' || substr({h}, 4 * i + 1, 4))::BIGINT))"


def _fold(s: str) -> str:
    return f"(65535 - ((({s}) % 65536 + ({s}) // 65536) % 65536 + (({s}) % 65536 + ({s}) // 65536) // 65536))"


_FLOW = "capture_id, tuple_key, direction"
# Frames whose first byte lies in no rule and that begin with a record header, with the rule that each adds.
_ALONE = f"""(SELECT {_FLOW}, seq AS seq_start, seq + CASE substr(payload_hex, 1, 2) WHEN '17' THEN 5 ELSE len END AS seq_end FROM {{tls_segments}} s
   WHERE len >= 5 AND substr(payload_hex, 1, 2) IN ('14', '15', '16', '17', '18') AND substr(payload_hex, 3, 4) IN ('0300', '0301', '0302', '0303') AND ('0x' || substr(payload_hex, 7, 4))::BIGINT BETWEEN 1 AND 16384
   AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.capture_id = s.capture_id AND r.tuple_key = s.tuple_key AND r.direction = s.direction AND r.seq_start <= s.seq AND s.seq < r.seq_end))"""
_TLS_MASKED = f""", own AS (SELECT {_FLOW}, seq_start, seq_end FROM rules WHERE seq_start < seq_end UNION SELECT * FROM {_ALONE}),
   both_ways AS (SELECT * FROM own UNION SELECT capture_id, tuple_key, CASE direction WHEN 'forward' THEN 'reverse' ELSE 'forward' END, seq_start, seq_end FROM own
     WHERE (capture_id, tuple_key) IN (SELECT (capture_id, tuple_key) FROM own GROUP BY capture_id, tuple_key HAVING count(DISTINCT direction) = 1)),
   spans AS ({_MERGE.replace('IN_', 'both_ways')}),
   hit AS (SELECT s.capture_id, s.frame_no, list(struct_pack(a := greatest(s.seq, c.seq_start) - s.seq, b := least(s.seq + s.len, c.seq_end) - s.seq)) AS rs
     FROM {{tls_segments}} s JOIN spans c ON c.capture_id = s.capture_id AND c.tuple_key = s.tuple_key AND c.direction = s.direction AND c.seq_start < s.seq + s.len AND c.seq_end > s.seq GROUP BY 1, 2),
   tls_out AS (SELECT 't' || s.capture_id AS capture_id, s.frame_no, s.direction, 1 AS ip_modified,
     array_to_string(list_transform(range(0, len), lambda i: CASE WHEN len(list_filter(coalesce(rs, []), lambda r: r.a <= i AND i < r.b)) > 0 THEN substr(payload_hex, 2 * i + 1, 2) ELSE '00' END), '') AS payload_hex,
     coalesce(list_sum(list_transform(rs, lambda r: r.b - r.a)), 0)::BIGINT AS kept_bytes, len - coalesce(list_sum(list_transform(rs, lambda r: r.b - r.a)), 0)::BIGINT AS masked_bytes
     FROM {{tls_segments}} s LEFT JOIN hit USING (capture_id, frame_no))"""
# What may stay of each request or response: all of the header but the values of Cookie and Referer; made from the same parts as the header.
_CRLF = "'0D0A'"
_SHOWN = f"""(SELECT page_id, hex(CASE WHEN page_id % 3 = 0 THEN 'HTTP/1.1 200 OK' ELSE 'GET /p/' || page_id || ' HTTP/1.1' END) || {_CRLF} || hex('Host: h' || page_id % 9 || '.example') || {_CRLF}
     || hex('Cookie: ') || repeat('00', length('id=' || page_id)) || {_CRLF} || repeat('00', length(' folded=' || page_id * 7)) || {_CRLF} || hex('Accept: */*') || {_CRLF}
     || CASE WHEN page_id % 2 = 0 THEN hex('Referer:  ') || repeat('00', octet_length(encode(url))) || {_CRLF} ELSE '' END || {_CRLF} AS shown,
     hex(CASE WHEN page_id % 3 = 0 THEN 'HTTP/1.1 200 OK' ELSE 'GET /p/' || page_id || ' HTTP/1.1' END) || {_CRLF} || hex('Host: h' || page_id % 9 || '.example') || {_CRLF}
     || hex('Cookie: ') || repeat('FF', length('id=' || page_id)) || {_CRLF} || repeat('FF', length(' folded=' || page_id * 7)) || {_CRLF} || hex('Accept: */*') || {_CRLF}
     || CASE WHEN page_id % 2 = 0 THEN hex('Referer:  ') || repeat('FF', octet_length(encode(url))) || {_CRLF} ELSE '' END || {_CRLF} AS marked FROM pages)"""
_HTTP_OUT = f"""(SELECT capture_id, frame_no, direction, ip_modified, rpad(part, 2 * len::INT, '0') AS payload_hex, kept AS kept_bytes, len - kept AS masked_bytes FROM (
     SELECT 'h' || s.capture_id AS capture_id, frame_no, direction, 1 AS ip_modified, len, substr(shown, (512 * (frame_no % 1000000) + 1)::INT, 512) AS part,
       (SELECT count(*) FROM range(0, 256) t(i) WHERE substr(marked, (512 * (frame_no % 1000000) + 2 * i + 1)::INT, 2) NOT IN ('FF', ''))::BIGINT AS kept
     FROM {{http_segments}} s JOIN {_SHOWN} h USING (page_id)))"""

_START = lambda h, n: f"(CASE WHEN {n} >= 5 AND substr({h}, 1, 2) IN ('14', '15', '16', '17', '18') AND substr({h}, 3, 4) IN ('0300', '0301', '0302', '0303') AND ('0x' || substr({h}, 7, 4))::BIGINT BETWEEN 1 AND 16384 THEN substr({h}, 1, 2) ELSE '' END)"
_SIDES = f"""{_TLS_MASKED}, sides AS (SELECT o.capture_id, o.frame_no, s.len, s.payload_hex AS a, o.payload_hex AS b, {_START('s.payload_hex', 's.len')} AS ta, {_START('o.payload_hex', 's.len')} AS tb
     FROM tls_out o JOIN {{tls_segments}} s ON o.capture_id = 't' || s.capture_id AND o.frame_no = s.frame_no)"""

ORACLES = {
    "v2_payloads": f"{_WALK} {_RULES} {_SIDES} SELECT capture_id, frame_no, CASE WHEN ta = tb AND a = b THEN 'preserved' ELSE 'modified' END AS outcome FROM sides WHERE ta IN ('14', '15', '16', '18')",
    "v3_payloads": f"""{_WALK} {_RULES} {_SIDES} SELECT capture_id, frame_no, CASE WHEN NOT regexp_full_match(substr(b, 1, 10), '0*') AND (len = 5 OR
        length(substr(b, 11)) - length(replace(substr(b, 11), '0', '')) > 0.8 * length(substr(b, 11))) THEN 'correctly_masked' ELSE 'incorrectly_masked' END AS outcome FROM sides WHERE ta = '17'""",
    "v6_changed_bytes": f"""{_WALK} {_RULES} {_SIDES} SELECT capture_id, frame_no, 'bytes' AS outcome, d[1] AS first_changed, len(d)::BIGINT AS changed_bytes
        FROM (SELECT *, list_filter(range(0, len), lambda i: substr(a, 2 * i + 1, 2) <> substr(b, 2 * i + 1, 2)) AS d FROM sides WHERE a <> b)""",
    "s2_ranged": """SELECT coalesce(source, 'none') AS capture_id, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS frame_no, doc_id AS ts_us,
        octet_length(encode(coalesce(text, ''))) AS wire_len, 1 AS linktype, hex(coalesce(text, '')) AS raw_hex FROM documents""",
    "sanitise_tls": f"{_WALK} {_RULES} {_TLS_MASKED} SELECT * FROM tls_out",
    "sanitise_http": f"SELECT * FROM {_HTTP_OUT}",
    "sanitise_auto": f"{_WALK} {_RULES} {_TLS_MASKED} SELECT * FROM tls_out UNION ALL SELECT * FROM {_HTTP_OUT}",
    "s2_packets": "SELECT capture_id, frame_no, ts_us, length(raw_hex) // 2 AS wire_len, 1 AS linktype, raw_hex FROM {doc_captures}",
    "s9_header_check": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 WHEN doc_id % 3 = 0 AND octet_length(encode(text)) < 16 THEN 0 ELSE 1 END AS is_valid, CASE doc_id % 3 WHEN 0 THEN 'pcap' WHEN 1 THEN 'pcapng' END AS format,
        CASE WHEN doc_id % 3 = 0 THEN '2.4' END AS version, CASE WHEN doc_id % 3 = 0 THEN doc_id % 200 END AS linktype,
        CASE WHEN doc_id % 3 = 2 THEN 'unknown magic' WHEN doc_id % 3 = 0 AND octet_length(encode(text)) < 16 THEN 'no packets' END AS problem FROM documents""",
    "s10_output_names": "SELECT doc_id, '/in/' || source || '/f' || doc_id || '_processed' || CASE WHEN doc_id % 2 = 0 THEN '.pcap' ELSE '.pcapng' END AS out_path FROM documents",
    "a9_checksums": f"""SELECT capture_id, frame_no, CASE WHEN ip_version = 4 THEN {_fold('s3')} END AS ip_sum, CASE WHEN proto = 'udp' THEN 0 ELSE {_fold('s4')} END AS l4_sum FROM (
        SELECT capture_id, frame_no, ip_version, proto, {_word_sum('inner_l3')} AS s3, {_word_sum('body')} + 6 + 20 + payload_len AS s4
        FROM (SELECT *, src_hex || dst_hex || l4 || payload_hex || CASE WHEN payload_len % 2 = 1 THEN '00' ELSE '' END AS body FROM {{wire}}))""",
    "sanitise_flagship": f"""SELECT capture_id, count(*) AS packets, count(*) AS ip_modified, count(*) FILTER (WHERE proto = 'tcp') AS payload_modified,
        coalesce(sum(payload_len) FILTER (WHERE proto = 'tcp'), 0)::BIGINT AS masked_bytes, count(DISTINCT {anon_sql('src_ip')}) AS sources FROM ({_KEPT}) GROUP BY 1""",
    "sanitise_packets": f"""SELECT capture_id, frame_no, CASE WHEN (src_ip < dst_ip) OR (src_ip = dst_ip AND sport < dport) THEN src_ip || ':' || sport || '-' || dst_ip || ':' || dport ELSE dst_ip || ':' || dport || '-' || src_ip || ':' || sport END AS tuple_key,
        src_ip, dst_ip, CASE WHEN proto = 'tcp' THEN repeat('00', payload_len) ELSE payload_hex END AS payload_hex
        FROM (SELECT capture_id, frame_no, {anon_sql('src_ip')} AS src_ip, {anon_sql('dst_ip')} AS dst_ip, sport, dport, proto, payload_hex, payload_len FROM ({_KEPT}))""",
    "p1_layers": f"""SELECT capture_id, frame_no, 'Ethernet/' || {_MID} || {_L3} || '/' || upper(proto) AS layers, 1 AS parse_ok,
        CASE enc WHEN 1 THEN 'vlan' WHEN 2 THEN 'double_vlan' WHEN 3 THEN 'mpls' WHEN 4 THEN 'vxlan' WHEN 5 THEN 'gre' ELSE 'plain' END AS encap,
        CASE WHEN enc = 2 THEN 2 WHEN enc IN (1, 3, 4, 5) THEN 1 ELSE 0 END AS depth, CASE WHEN enc IN (4, 5) THEN 2 ELSE 1 END AS n_ips, CASE WHEN enc BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS encapsulated,
        CASE WHEN enc IN (1, 2) THEN 1 ELSE 0 END AS vlan, CASE WHEN enc IN (4, 5) THEN 1 ELSE 0 END AS multi_ip FROM {{wire}}""",
    "p2_ethernet": f"""SELECT capture_id, frame_no, {_MAC('raw_hex', 1)} AS dst, {_MAC('raw_hex', 13)} AS src, CASE enc WHEN 1 THEN '0x8100' WHEN 2 THEN '0x88a8' WHEN 3 THEN '0x8847' WHEN 6 THEN '0x86dd' ELSE '0x0800' END AS type FROM {{wire}}""",
    "p3_vlans": """SELECT capture_id, frame_no, 0 AS n, user_id % 4000 AS id, 1 AS priority, 0 AS dei, 33024 AS tpid, 0 AS is_outer FROM {wire} WHERE enc = 1 AND (8192 + user_id % 4000) < 12288
        UNION ALL SELECT capture_id, frame_no, 0, 100 + user_id % 100, 0, 0, 34984, 1 FROM {wire} WHERE enc = 2
        UNION ALL SELECT capture_id, frame_no, 1, user_id % 4000, 1, 1, 33024, 0 FROM {wire} WHERE enc = 2""",
    "p4_mpls": "SELECT capture_id, frame_no, 16 + user_id % 1000 AS label, 0 AS cos, 1 AS bottom, 64 AS ttl FROM {wire} WHERE enc = 3",
    "p5_vxlan": "SELECT capture_id, frame_no, 5000 + user_id % 50 AS vni, 8 AS flags, 0 AS reserved FROM {wire} WHERE enc = 4",
    "p6_gre": "SELECT capture_id, frame_no, '0x0800' AS proto, 0 AS checksum, 0 AS has_key, 0 AS has_seq, NULL AS key FROM {wire} WHERE enc = 5",
    "p7_ipv4": """SELECT capture_id, frame_no, src_ip AS src, dst_ip AS dst, 4 AS version, 5 AS ihl, 0 AS tos, 20 + l4_len + payload_len AS len, 1 AS id, 2 AS flags, 0 AS frag, 64 AS ttl, CASE proto WHEN 'tcp' THEN 6 ELSE 17 END AS proto
        FROM {wire} WHERE ip_version = 4""",
    "p8_ipv6": "SELECT capture_id, frame_no, src_ip AS src, dst_ip AS dst, 6 AS version, 0 AS tc, 0 AS fl, l4_len + payload_len AS plen, CASE proto WHEN 'tcp' THEN 6 ELSE 17 END AS nh, 64 AS hlim FROM {wire} WHERE ip_version = 6",
    "p9_tcp": "SELECT capture_id, frame_no, sport, dport, seq, 0 AS ack, 5 AS dataofs, 24 AS flags, 8192 AS \"window\", 0 AS chksum, 0 AS urgptr FROM {wire} WHERE proto = 'tcp'",
    "p10_udp": "SELECT capture_id, frame_no, CASE WHEN proto = 'udp' THEN sport ELSE 12500 END AS sport, CASE WHEN proto = 'udp' THEN dport ELSE 4789 END AS dport, CASE WHEN proto = 'udp' THEN 8 + payload_len ELSE 0 END AS len, 0 AS chksum FROM {wire} WHERE proto = 'udp' OR enc = 4",
    "p11_ip_layers": "SELECT capture_id, frame_no, CASE WHEN enc IN (4, 5) THEN '192.0.2.1' ELSE src_ip END AS outer_src, CASE WHEN enc IN (4, 5) THEN '192.0.2.2' ELSE dst_ip END AS outer_dst, src_ip AS inner_src, CASE enc WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 1 END AS inner_depth FROM {wire}",
    "p12_payload": "SELECT capture_id, frame_no, proto, src_ip, dst_ip, sport, dport, seq, payload_hex, 0 AS is_encrypted FROM {wire}",
}
