"""Masking by buckets against byte by byte, and how many rows it moves besides the packets."""

import random

from pyspark.sql import functions as F
from wireloom.operators import mask as mk
from wireloom.operators import reassembly as ra

PACKET = "capture_id string, tuple_key string, direction string, frame_no bigint, seq bigint, len bigint, payload binary, proto string"
RULE = "capture_id string, tuple_key string, direction string, seq_start bigint, seq_end bigint"


def brute(packets, rules):
    valid = {r for r in rules if None not in r[:3] and r[1] and r[2] in ("forward", "reverse") and None not in r[3:] and 0 <= r[3] < r[4]}
    out = []
    for c, t, d, no, seq, n, raw, proto in packets:
        if proto != "tcp" or not n:
            out.append((no, seq, raw, n, 0, False))
            continue
        found = [r for r in valid if r[:2] == (c, t)]
        mine = [r for r in found if r[2] == d] or [r for r in found if d in ("forward", "reverse") and r[2] != d]
        mine = [] if None in (no, seq) else mine
        stay = [any(a <= seq + i < b for *_, a, b in mine) for i in range(n)]
        new = bytes(x if keep else 0 for x, keep in zip(raw, stay, strict=True))
        out.append((no, seq, new, sum(stay), n - sum(stay), new != raw or not mine))
    return sorted(out, key=str)


def test_equals_byte_by_byte(spark):
    rnd = random.Random(8)
    flows = [("c", f"f{i}", d) for i in range(4) for d in ("forward", "reverse")] + [("c", "f0", "sideways"), (None, "f1", "forward"), ("c", None, "forward"), ("c", "", "forward")]
    packets, rules = [], []
    for no in range(700):
        n = rnd.choice([0, 1, 60, 110, 110, 1400, 5000]) if no % 9 else 110
        proto = "tcp" if no % 13 else rnd.choice(["udp", None])
        seq = rnd.randrange(12_000) if proto == "tcp" or no % 2 else None
        packets.append((*rnd.choice(flows), no * 900, seq, n, bytes(rnd.randrange(3) for _ in range(n)), proto))
    packets += packets[:40]  # copies
    packets += [("c", "f0", "forward", None, 5, 3, b"abc", "tcp"), ("c", "f0", "forward", 7, None, 3, b"abc", "tcp"), ("c", "f0", "forward", 8, 4096, 3, b"\0\0\0", "tcp"), ("c", "f3", "forward", 9, 100, 3, b"\0\0\0", "tcp")]
    for c, t, d in flows:
        if t == "f3" or (t == "f1" and d == "reverse"):  # no rules at all; borrowed rules
            continue
        for _ in range(12):
            a = rnd.choice([rnd.randrange(13_000), 2048 * rnd.randrange(6)])
            rules.append((c, t, d, a, a + rnd.choice([-5, 0, 1, 40, 90, 300, 600, 2500])))
    rules += [("c", "f2", "forward", -7, 90), ("c", "f2", "forward", 1000, 10**9), ("c", "f2", "forward", None, 5), ("c", "f1", "forward", 2048, 4096), ("c", "f1", "forward", 4096, 4100)]
    out = mk.mask_payloads(spark.createDataFrame(packets, PACKET), spark.createDataFrame(rules + rules[:20], RULE))
    got = sorted(((r.frame_no, r.seq, bytes(r.payload), r.kept_bytes, r.masked_bytes, r.payload_modified) for r in out.collect()), key=str)
    want = brute(packets, rules)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []
    assert sum(0 < g[3] < g[3] + g[4] for g in got) > 40


def test_ranges_of_segments(spark):
    segments = spark.createDataFrame([("c", "f", "forward", s, n) for s, n in ((0, 10), (0, 10), (2040, 100), (9000, 5), (20, 0))], "capture_id string, tuple_key string, direction string, seq bigint, len bigint")
    rules = spark.createDataFrame([("c", "f", "forward", a, b) for a, b in ((2, 4), (3, 6), (6, 7), (2045, 2050), (2100, 9000))], RULE)
    got = {(r.seq, r.len): (r.ranges and [tuple(x) for x in r.ranges], r.has_rules) for r in mk.kept_ranges(segments, rules).collect()}
    assert got == {(0, 10): ([(2, 7)], True), (2040, 100): ([(5, 10), (60, 100)], True), (9000, 5): (None, True)}


def test_udp_on_request(spark):
    rows = [("c", "f", "forward", no, seq, 4, b"abcd", proto) for no, seq, proto in ((1, 100, "tcp"), (70_000, 100, "udp"), (3, 102, "udp"), (4, None, "udp"), (5, 100, None))]
    rules = spark.createDataFrame([("c", "f", "forward", 101, 104)], RULE)
    got = lambda **k: {r.frame_no: bytes(r.payload) for r in mk.mask_payloads(spark.createDataFrame(rows, PACKET), rules, **k).collect()}
    assert got() == {1: b"\0bcd", 70_000: b"abcd", 3: b"abcd", 4: b"abcd", 5: b"abcd"}
    assert got(mask_udp=True) == {1: b"\0bcd", 70_000: b"\0bcd", 3: b"\0" * 4, 4: b"\0" * 4, 5: b"abcd"}


def test_one_row_is_written_for_each_bucket(spark, monkeypatch):
    """Before, each segment and each rule was a row of its own in some ten tables and shuffles."""
    n, made, write = 4000, [], mk.materialise
    monkeypatch.setattr(mk, "materialise", lambda df: (made.append(write(df)), made[-1])[1])
    packets = spark.range(0, n, 1, 2).select(
        F.lit("c").alias("capture_id"), F.lit("t").alias("tuple_key"), F.lit("forward").alias("direction"), F.col("id").alias("frame_no"), (F.col("id") * 100).alias("seq"),
        F.lit(100).cast("bigint").alias("len"), F.lit(b"x" * 100).alias("payload"), F.lit("tcp").alias("proto"))
    rules = packets.select(*ra.KEY, F.col("seq").alias("seq_start"), (F.col("seq") + 40).alias("seq_end"))
    out = mk.mask_payloads(packets, rules).agg(F.sum("kept_bytes"), F.count_if("payload_modified"), F.count("*")).first()
    assert tuple(out) == (40 * n, n, n)
    assert made and max(t.count() for t in made) < n / 10
