"""Payload bytes before and after masking."""

import pytest
from wireloom.operators import validate as va

FRAMES = "capture_id string, frame_no bigint, payload binary"
HITS = FRAMES + ", path string, types array<bigint>, lengths array<bigint>, zero_bytes bigint"


def _changed(spark, a, b, **kw):
    rows = va.changed_payloads(spark.createDataFrame(a, FRAMES), spark.createDataFrame(b, FRAMES), **kw).collect()
    return sorted((r.capture_id, r.frame_no, r.outcome, r.first_changed, r.changed_bytes) for r in rows)


@pytest.mark.parametrize("width, piece", [(4096, 64), (3, 7)])
def test_one_changed_byte_is_found(spark, width, piece):
    a = [("c", n, bytes([n % 251] * (n % 300))) for n in range(1, 400)] + [("d", 1, None), ("d", 2, b"")]
    b = dict(((c, n), p) for c, n, p in a)
    b[("c", 250)] = b[("c", 250)][:199] + b"\xff" + b[("c", 250)][200:]
    b[("c", 20)] = b"\0" * 20
    b[("c", 30)] = b"x"
    del b[("c", 40)]
    b[("e", 7)] = b"new"
    want = [("c", 20, "bytes", 0, 20), ("c", 30, "length", None, None), ("c", 40, "missing", None, None), ("c", 250, "bytes", 199, 1), ("e", 7, "added", None, None)]
    assert _changed(spark, a, [(*k, p) for k, p in b.items()], width=width, piece=piece) == want


def test_equal_and_empty_sides(spark):
    a = [("c", 1, b"a"), ("c", 2, None)]
    assert _changed(spark, a, a) == [] and _changed(spark, [], []) == []


def test_preserved_frames_compare_bytes(spark):
    one = lambda n, p, types=(22,): ("c", n, p, "tcp", list(types), [4], 0)
    a = spark.createDataFrame([one(1, b"abcd"), one(2, b"abcd"), one(3, None), one(4, b"abcd"), one(5, b"abcd", (23,))], HITS)
    b = spark.createDataFrame([one(1, b"abcd"), one(2, b"abcX"), one(3, b"abcd"), one(5, b"", (23,))], HITS)
    got = {r.frame_no: r.outcome for r in va.preservation_frames(a, b).collect()}
    assert got == {1: "preserved", 2: "modified", 3: "preserved", 4: "missing"}


def test_share_of_zeros_where_nothing_was_counted(spark):
    one = lambda n, p, lengths, zeros: ("c", n, p, "tcp", [23], lengths, zeros)
    head = b"\x17\x03\x03\x00\x20"
    a = spark.createDataFrame([one(n, head + b"z" * 32, [37], 0) for n in range(1, 7)], HITS)
    b = spark.createDataFrame([
        one(1, head + b"\0" * 32, [37], None), one(2, head + b"z" * 32, [37], None), one(3, b"\0" * 37, [], None), one(4, head, None, 9),
        one(5, head + b"z" * 32, [37], 32), one(6, None, [37], None)], HITS)
    got = {r.frame_no: r.outcome for r in va.smart_masking_frames(a, b).collect()}
    assert got == {1: "correctly_masked", 2: "incorrectly_masked", 3: "incorrectly_masked", 4: "correctly_masked", 5: "correctly_masked", 6: "incorrectly_masked"}
