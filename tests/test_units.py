"""Hand-made cases and brute-force checks of single operators."""

import ipaddress
import os
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F
from wireloom.functions import addresses as A
from wireloom.functions import tls as T
from wireloom.operators import http_headers as hh
from wireloom.operators import mask as mk
from wireloom.operators import reassembly as ra
from wireloom.operators import rules as ru
from wireloom.operators import tls_frames as tf
from wireloom.operators import tls_records as tr
from wireloom.operators import validate as va
from wireloom.operators.scan import merge_intervals, running, trailing

SEG = "capture_id string, tuple_key string, direction string, frame_no bigint, seq bigint, len bigint, payload binary, sport bigint, dport bigint"
FRAME = (
    "capture_id string, frame_no bigint, stream_id string, seq_raw bigint, protocols string, content_types array<string>, opaque_types array<string>, "
    "lengths array<string>, versions array<string>, segment_data array<string>, app_data array<string>"
)


def segments(spark, parts, seq0=1000, key="a:1-b:2", dport=80):
    rows, seq = [], seq0
    for n, p in enumerate(parts, 1):
        rows.append(("c", key, "forward", n, seq, len(p), p, 5000, dport))
        seq += len(p)
    return spark.createDataFrame(rows, SEG)


def frames(spark, types, lengths=None, opaque=(), versions=(), first=1):
    rows = [("c", n, "0", 1000, "eth:ip:tcp:tls", [str(t) for t in ts], list(opaque), [str(x) for x in (lengths or [])], list(versions), [], []) for n, ts in types.items()]
    return spark.createDataFrame(rows, FRAME)


def test_addresses(spark):
    texts = ["::", "::1", "1::", "fe80::1:2", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2::8", "1:2:3:4:5:6:7::", "1:2:3", "1::2::3", "g::1", "1.2.3.4", "256.1.1.1", "12345::", "x"]
    for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", A.v6_groups("ip").alias("g"), A.ip_version("ip").alias("v")).collect():
        try:
            want = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.v is None
            continue
        assert r.v == want.version
        if want.version == 6:
            assert bytes(b for g in r.g for b in g.to_bytes(2, "big")) == want.packed


def test_anonymisation_properties(spark):
    rng = random.Random(5)
    ips = sorted({f"{rng.choice([0, 10, 10, 172, 255])}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(3000)})
    out = {r.ip: r.a for r in spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", A.anonymise("ip", "k").alias("a")).collect()}
    assert len(set(out.values())) == len(out)
    for n in (1, 2, 3):
        pairs = {(tuple(i.split(".")[:n]), tuple(a.split(".")[:n])) for i, a in out.items()}
        assert len(pairs) == len({p for p, _ in pairs}) == len({a for _, a in pairs})
    assert all(i.split(".")[3] == a.split(".")[3] and i.split(".")[1] != a.split(".")[1] for i, a in out.items())


def test_running_over_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 9}", i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    for levels in (1, 2):
        got = {r.pos: (r.s, r.m) for r in running(running(df, ["k"], "pos", F.col("v"), "s", width=16, levels=levels), ["k"], "pos", F.col("v"), "m", "max", width=16, inclusive=True, levels=levels).collect()}
        total, high = {}, {}
        for k, pos, v in rows:
            high[k] = max(high.get(k, -1), v)
            assert got[pos] == (total.get(k, 0), high[k])
            total[k] = total.get(k, 0) + v


def test_trailing_windows(spark):
    df = spark.range(500).select(F.lit("x").alias("k"), F.col("id").alias("idx"), (F.col("id") * 7 % 31).alias("v"))
    got = {r.idx: r.s for r in trailing(df, ["k"], "idx", 5, {"s": F.sum("v")}, width=8).collect()}
    assert got == {i: sum(j * 7 % 31 for j in range(max(0, i - 4), i + 1)) for i in range(500)}


def test_merge_intervals_keeps_coverage(spark):
    rng = random.Random(2)
    rows = [("k", a, a + rng.randrange(1, 40)) for a in (rng.randrange(4000) for _ in range(400))]
    out = merge_intervals(spark.createDataFrame(rows, "k string, a bigint, b bigint"), ["k"], "a", "b", width=64).orderBy("a").collect()
    assert {x for _, a, b in rows for x in range(a, b)} == {x for r in out for x in range(r.a, r.b)}
    assert all(p.b < q.a for p, q in zip(out, out[1:]))


def _serial_records(data, check_partial):
    at, out = 0, []
    while at + 5 <= len(data):
        kind, size = data[at], data[at + 3] * 256 + data[at + 4]
        if not 20 <= kind <= 24:
            at += 1
            continue
        if at + 5 + size > len(data):
            if check_partial and not (data[at + 1] == 3 and data[at + 2] <= 4 and size <= 18432):
                at += 1
                continue
            out.append((at, kind, size))
            break
        out.append((at, kind, size))
        at += 5 + size
    return out


@pytest.mark.parametrize("check_partial", [True, False])
@pytest.mark.parametrize("block", [64, 1 << 17])
def test_record_walk_equals_serial_walk(spark, check_partial, block):
    rng = random.Random(block)
    data = bytearray()
    while len(data) < 6000:
        data += bytes([rng.choice([20, 21, 22, 23, 24, 7, 0])]) + b"\x03\x03" + struct.pack(">H", rng.choice([0, 1, 30, 90, 300]))
        data += bytes(rng.choice([20, 22, 23, 0, 1, 255]) for _ in range(rng.randrange(0, 120)))
    data = bytes(data)
    parts, at = [], 0
    while at < len(data):
        n = rng.randrange(1, 200)
        parts.append(data[at : at + n])
        at += n
    s = segments(spark, parts)
    got = tr.tls_records(ra.trimmed_segments(s), s, check_partial=check_partial, block=block, fan=3).collect()
    assert sorted((r.header_start, r.content_type, r.declared_length) for r in got) == _serial_records(data, check_partial)


def test_reassembly_trims_copies_and_overlaps(spark):
    rows = [("c", "k", "forward", 1, 100, 5, b"AAAAA", 1, 2), ("c", "k", "forward", 2, 100, 5, b"XXXXX", 1, 2), ("c", "k", "forward", 3, 103, 5, b"yyBBB", 1, 2), ("c", "k", "forward", 4, 120, 2, b"CC", 1, 2)]
    s = spark.createDataFrame(rows, SEG)
    got = ra.with_payload(ra.trimmed_segments(s), s).orderBy("start").collect()
    assert [(r.frame_no, r.start, r.end, r.island, r.gap, bytes(r.payload)) for r in got] == [(1, 100, 105, 100, False, b"AAAAA"), (3, 105, 108, 100, False, b"BBB"), (4, 120, 122, 120, True, b"CC")]


def test_sequence_wrap(spark):
    rows = [("c", "k", "forward", n, seq, 10, b"0" * 10, 1, 2) for n, seq in enumerate([4294967280, 4294967290, 4, 4294967285, 14], 1)]
    got = [r.seq for r in ra.unwrap_sequence(spark.createDataFrame(rows, SEG)).orderBy("frame_no").collect()]
    assert got == [4294967280, 4294967290, 4294967300, 4294967285, 4294967310]


def _serial_headers(parts):
    """One buffer per direction, exactly in capture order."""
    tokens = [b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"TRACE ", b"CONNECT "]
    out, buf, start, seq = [], None, None, 1000
    for p in parts:
        at, body = seq, p
        seq += len(p)
        if buf is None:
            if not (p.startswith(b"HTTP/1.") or any(p.startswith(t) for t in tokens)):
                i = p.find(b"HTTP/1.")
                if i < 0:
                    hits = [p.find(t) for t in tokens if p.find(t) >= 0]
                    i = min(hits) if hits else -1
                if i < 0:
                    continue
                at, body = at + i, p[i:]
            buf, start = b"", at
        buf += body[: max(0, 16384 - len(buf))]
        i = buf.find(b"\r\n\r\n")
        if i >= 0:
            out.append((start, buf[: i + 4], True))
            buf = None
        elif len(buf) >= 1024 and b"\r\n" in buf:
            out.append((start, buf[: buf.find(b"\r\n") + 2], False))
            buf = None
    return out


@pytest.mark.parametrize("block", [256, 1 << 17])
def test_header_walk_equals_serial_scan(spark, block):
    rng = random.Random(3)
    pieces = [b"GET /a HTTP/1.1\r\nHost: x\r\n", b"\r\n", b"\r", b"\n", b"body text ", b"HTTP/1.1 200 OK\r\n", b"POST /", b"Cookie: secret\r\n", b"z" * 90, b"more GET /b"]
    parts = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    got = hh.message_headers(segments(spark, parts), block=block, fan=3, limits=hh.BUFFER_LIMITS).collect()
    assert sorted((r.start_seq, bytes(r.header), r.complete) for r in got) == sorted(_serial_headers(parts))


def test_sensitive_header_values_are_dropped(spark):
    head = b"GET / HTTP/1.1\r\nCookie:  a=1\r\n b=2\r\nHost: h\r\nAUTHORIZATION: x\r\nReferer: r\r\n\r\n"
    rules = hh.header_rules(hh.message_headers(segments(spark, [head]))).collect()
    kept = b"".join(head[r.seq_start - 1000 : r.seq_end - 1000] for r in sorted(rules, key=lambda r: r.seq_start))
    assert kept == b"GET / HTTP/1.1\r\nCookie:  \r\n\r\nHost: h\r\nAUTHORIZATION: \r\nReferer: \r\n\r\n"


def test_frames_per_type_golden(spark):
    f = frames(spark, {4: [22], 7: [22], 9: [22, 20, 22], 10: [20], 12: [22], 14: [23, 23], 15: [23], 16: [21], 19: [21]})
    stats = tf.type_statistics(f, tf.frame_messages(f)).collect()
    assert {r.content_type: r.frames for r in stats} == {22: 4, 23: 2, 20: 2, 21: 2}


def test_type_filter_and_predicates(spark):
    f = frames(spark, {1: [22, 23], 2: [20], 3: [22]})
    out = tf.filter_types(tf.frame_details(f), (22, 23)).orderBy("frame_no").collect()
    assert [(r.frame_no, r.types) for r in out] == [(1, [22, 23]), (3, [22])]
    got = frames(spark, {1: [22, 23], 2: [99], 3: []}).select("frame_no", T.has_tls_record().alias("x")).collect()
    assert {r.frame_no: r.x for r in got} == {1: True, 2: False, 3: False}


def test_version_names(spark):
    rows = spark.createDataFrame([(3, i) for i in range(5)] + [(4, 0)], "a int, b int").select(T.version_name(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in rows] == ["SSL 3.0", "TLS 1.0", "TLS 1.1", "TLS 1.2", "TLS 1.3", "TLS 4.0"]


def test_app_data_masking_golden(spark):
    # twelve application-data frames, all zeroed after masking
    lengths = {11: 969, 16: 435, 98: 863, **{n: 8208 for n in (25, 34, 43, 52, 61, 70, 79, 88, 97)}}
    schema = "capture_id string, frame_no bigint, path string, types array<int>, lengths array<int>, zero_bytes bigint"
    before = spark.createDataFrame([("c", n, "eth:ip:tcp:tls", [23], [x], 3) for n, x in lengths.items()], schema)
    after = spark.createDataFrame([("c", n, "eth:ip:tcp:tls", [23], [x], x) for n, x in lengths.items()], schema)
    r = va.app_data_masked(before, after).first()
    assert (r.records_before, r.records_after, r.masked_records, r.unmasked_records, r.status) == (12, 12, 12, 0, "pass")


def test_masking_denies_by_default_and_is_idempotent(spark):
    s = segments(spark, [b"abcdefghij", b"klmnop"]).withColumn("proto", F.lit("tcp"))
    other = segments(spark, [b"secret"], key="z:1-z:2").withColumn("proto", F.lit("tcp")).withColumn("frame_no", F.lit(9).cast("bigint"))
    rules = spark.createDataFrame([("c", "a:1-b:2", "forward", 1002, 1004, "r", "header_only"), ("c", "a:1-b:2", "forward", 1008, 1012, "r", "full_message")],
                                  "capture_id string, tuple_key string, direction string, seq_start bigint, seq_end bigint, rule_type string, strategy string")
    once = mk.mask_payloads(s.unionByName(other), rules)
    got = {r.frame_no: (bytes(r.payload), r.kept_bytes, r.payload_modified) for r in once.collect()}
    assert got == {1: (b"\0\0cd\0\0\0\0ij", 4, True), 2: (b"kl\0\0\0\0", 2, True), 9: (b"\0" * 6, 0, True)}
    again = mk.mask_payloads(once.select(s.columns), rules)
    assert {r.frame_no: bytes(r.payload) for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_one_sided_rules_serve_both_directions(spark):
    rules = spark.createDataFrame([("c", "f", "forward", 1, 5, "r", "full_message"), ("c", "g", "forward", 1, 5, "r", "x"), ("c", "g", "reverse", 7, 9, "r", "x")],
                                  "capture_id string, tuple_key string, direction string, seq_start bigint, seq_end bigint, rule_type string, strategy string")
    got = {(r.tuple_key, r.direction, r.seq_start) for r in ru.both_directions(rules).collect()}
    assert got == {("f", "forward", 1), ("f", "reverse", 1), ("g", "forward", 1), ("g", "reverse", 7)}


def test_preserve_options():
    assert ru.policy({"preserve_application_data": True, "alert": False}) == {20: True, 21: False, 22: True, 23: True, 24: True}
    with pytest.raises(ValueError):
        ru.policy({"nonsense": True})


def _pcap(packets, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, raw in enumerate(packets):
        out += struct.pack(order + "IIII", 1000 + i, i, len(raw), len(raw)) + raw
    return out


def test_captures_whole_ranged_and_written_back(spark):
    from wireloom.sources import captures as C
    from wireloom.sources import sinks as K

    rng = random.Random(4)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    packets = [bytes(rng.choice([0, 1, 255]) for _ in range(rng.randrange(60))) * rng.randrange(1, 20) for _ in range(2500)]
    for name, body in (("le.pcap", _pcap(packets)), ("be.cap", _pcap(packets[:99], ">")), ("empty.pcap", _pcap([]))):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body)
    for size in (8 << 20, 262_165, 4_000):
        rows = C.read_captures(spark, folder, range_bytes=size).collect()
        for name, want in (("le.pcap", packets), ("be.cap", packets[:99])):
            got = sorted((r.frame_no, bytes(r.raw)) for r in rows if r.capture_id.endswith(name))
            assert got == [(i, p) for i, p in enumerate(want, 1)]
    out = os.path.join(folder, "out")
    K.write_captures(C.read_captures(spark, folder), out, C.list_captures(spark, folder).select(F.col("path").alias("capture_id")))
    assert open(os.path.join(out, "le_processed.pcap"), "rb").read() == _pcap(packets).replace(struct.pack("<I", 65535), struct.pack("<I", 262144), 1)
    assert os.path.getsize(os.path.join(out, "empty_processed.pcap")) == 24
    files = spark.read.format("binaryFile").load(folder + "/*.*ap")
    assert va.compare_files(files, files).where("same").count() == 3


def test_sanitise_writes_valid_frames_back(spark, sf):
    from wireloom.operators import dissect as di
    from wireloom.plans.catalogue_wire import raw_frames
    from wireloom.plans.sanitise import sanitise, stage_results

    raw = raw_frames(spark, sf)
    done = sanitise(raw, "k", protocol="auto")
    back = di.dissect(di.rebuild(done).select("capture_id", "frame_no", "raw"))
    j = back.alias("b").join(done.alias("a"), ["capture_id", "frame_no"])
    assert j.where("a.src_ip <> b.src_ip OR a.dst_ip <> b.dst_ip OR a.payload <> b.payload OR a.caplen <> b.caplen").count() == 0
    outer = done.where("size(ip_layers) = 2 AND new_ips[0].src = ip_layers[0].src").count()
    assert outer == 0  # addresses of tunnels are rewritten too
    steps = {r.step: r.m for r in stage_results(done, raw).groupBy("step").agg(F.sum("modified").alias("m")).collect()}
    assert steps["remove_dupes"] == raw.count() - raw.select("capture_id", "raw").distinct().count()


def test_truncated_frames_are_kept(spark):
    from wireloom.operators import dissect as di

    whole = bytes.fromhex("020000000001020000000002" + "0800" + "4500001c00014000401100000a0000010a000002" + "0035003500080000")
    df = spark.createDataFrame([("c", i, whole[:n]) for i, n in enumerate((42, 30, 5))], "capture_id string, frame_no bigint, raw binary")
    got = {r.frame_no: (r.parse_ok, r.parse_error) for r in di.dissect(df).collect()}
    assert got == {0: (True, None), 1: (False, "truncated IP"), 2: (False, "truncated Ethernet")}
    from wireloom.plans.sanitise import sanitise

    masked = {r.frame_no: bytes(r.raw) for r in sanitise(df, "k", protocol="none").collect()}
    assert masked == {0: whole, 1: whole[:14] + b"\0" * 16, 2: b"\0" * 5}


def test_exported_frames(spark):
    from wireloom.sources.dissected import read_frames

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/f.json"
    with open(path, "w") as f:
        f.write('[{"_source": {"layers": {"frame.number": ["1"], "frame.protocols": "eth:ethertype:ip:tcp:tls", "tls.record.content_type": ["22", "23"], "tls.record.length": "5", "tcp.payload": "16:03"}}},'
                '{"_source": {"layers": {"frame.number": "2", "frame.protocols": ["eth:ip:tcp"], "tcp.payload": ["aa"]}}}]')
    got = {r.frame_no: r for r in read_frames(spark, path).withColumn("tls", T.has_tls_record()).collect()}
    assert got[1].content_types == ["22", "23"] and got[1].lengths == ["5"] and bytes(got[1].payload) == b"\x16\x03" and got[1].tls
    assert got[2].content_types == [] and not got[2].tls


def test_streams(spark, sf):
    from wireloom.plans.catalogue_wire import wire
    from wireloom.streaming import live

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    landed = wire(spark, sf).select("capture_id", "frame_no", F.col("ts").cast("timestamp").alias("ts"), "raw", "src_ip", "dst_ip", F.col("sport"), F.col("dport"), F.col("payload_len").cast("bigint").alias("len"))
    landed.coalesce(1).write.parquet(folder + "/in")
    stream = live.read_landed(spark, folder + "/in", landed.schema)
    for name, df, mode in (("dedup", live.remove_duplicates(stream, "40 days"), "append"), ("anon", live.anonymise(stream, "k"), "append"), ("sess", live.flow_sessions(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("dedup").count() == landed.select("capture_id", "raw").distinct().count()
    assert spark.table("anon").where("ip_modified").count() == landed.count()
    assert spark.table("sess").count() > 0


def test_plans_stay_in_the_jvm(spark, sf):
    """No Python in dedup, anonymisation and masking; parquet scans read only what they need."""
    from wireloom.plans import catalogue

    for name in ("d1_dedup", "a8_anonymised", "w7_flows", "k9_masked_payload"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan, name
    plan = catalogue.queries()["r4_status"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
