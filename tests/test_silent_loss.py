"""No packet may be lost and no payload may pass in clear without a word."""

import struct

from pyspark.sql import functions as F

from wireloom.operators.dissect import dissect
from wireloom.sources.captures import list_captures, read_captures
from wireloom.sources.sinks import write_captures

IP4 = bytes.fromhex("4500002900010000400600000a0000010a000002") + bytes.fromhex("04d2005000000001000000005010000000000000") + b"S"


def _file(path, records, link=1):
    out = bytearray(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, link))
    for sec, frac, wire, raw in records:
        out += struct.pack("<IIII", sec, frac, len(raw), wire) + raw
    path.write_bytes(bytes(out))


def test_link_types(spark):
    rows = [
        (1, b"\0" * 12 + b"\x08\0" + IP4), (101, IP4), (113, b"\0" * 14 + b"\x08\0" + IP4), (276, b"\x08\0" + b"\0" * 18 + IP4), (0, b"\2\0\0\0" + IP4),
        (108, b"\0\0\0\2" + IP4), (228, IP4), (147, IP4),
    ]
    got = dissect(spark.createDataFrame(rows, "linktype int, raw binary")).select("linktype", "parse_ok", "src_ip", "payload").collect()
    for r in got:
        if r.linktype == 147:
            assert not r.parse_ok
        else:
            assert (r.parse_ok, r.src_ip, bytes(r.payload)) == (True, "10.0.0.1", b"S"), r


def test_more_layers_than_are_read_is_an_error(spark):
    tags = b"".join(b"\0\1\x81\0" for _ in range(24))
    raw = b"\0" * 12 + b"\x81\0" + tags[:-2] + b"\x08\0" + IP4
    assert not dissect(spark.createDataFrame([(raw,)], "raw binary")).select("parse_ok").first()[0]


def test_odd_records_are_read_alike_small_and_ranged(spark, tmp_path):
    records = [(i, 2_000_000 if i % 7 == 0 else i, 10 if i % 5 == 0 else 2000, bytes([i % 251]) * 1000 if i % 3 else b"\0" * 900) for i in range(900)]
    _file(tmp_path / "a.pcap", records)
    whole = read_captures(spark, str(tmp_path)).select("frame_no", F.md5("raw")).collect()
    ranged = read_captures(spark, str(tmp_path), range_bytes=262_160).select("frame_no", F.md5("raw")).collect()
    assert len(whole) == 900 and sorted(whole) == sorted(ranged)


def test_equal_names_stay_apart(spark, tmp_path):
    rows = [("/a/x.pcap", 1, b"one"), ("/b/x.pcap", 1, b"two"), ("/b/x.pcapng", 1, b"three"), ("/b/y.pcap", 1, b"four")]
    write_captures(spark.createDataFrame(rows, "capture_id string, frame_no long, raw binary"), str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").glob("*.pcap"))
    assert len(names) == 4 and "y_processed.pcap" in names and sum(n.startswith("x-") for n in names) == 3


def test_suffixes_in_either_case_are_read(spark, tmp_path):
    for name in ("a.PCAP", "b.Cap", "c.pcap"):
        _file(tmp_path / name, [(1, 4, 4, b"data")])
    assert list_captures(spark, str(tmp_path)).count() == 3 and read_captures(spark, str(tmp_path)).count() == 3
