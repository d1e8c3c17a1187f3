"""HTTP headers without a size limit, against a reader that goes through the segments one after the other."""

import random
import re

import pytest

from wireloom.operators import http_headers as hh
from tests.test_units import segments

TOKENS = [b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"TRACE ", b"CONNECT "]


def _start(p):
    if p.startswith((b"HTTP/1.", *TOKENS)):
        return 0
    i = p.find(b"HTTP/1.")
    return i if i >= 0 else min((p.find(t) for t in TOKENS if t in p), default=-1)


def _outcome(buf):
    """None while the header is open, else (kept bytes, complete)."""
    lines = buf.split(b"\r\n")[:-1]
    at = 0
    for n, line in enumerate(lines):
        at += len(line) + 2
        if n and not line:
            return buf[:at], True
        if n and not re.match(rb"[ \t]|[!#$%&'*+\-.^_`|~0-9A-Za-z]+:", line):
            return lines[0] + b"\r\n", False
    return None


def _serial(parts):
    out, buf, start, seq = [], None, 0, 1000
    for p in parts:
        if buf is None:
            at = _start(p)
            if at >= 0:
                buf, start = p[at:], seq + at
        else:
            buf += p
        seq += len(p)
        if buf is not None and (found := _outcome(buf)):
            out.append((start, *found))
            buf = None
    if buf is not None and b"\r\n" in buf:
        out.append((start, buf[: buf.find(b"\r\n") + 2], False))
    return sorted(out)


def _found(spark, parts, **kw):
    rows = hh.message_headers(segments(spark, parts), **kw).collect()
    return sorted((r.start_seq, bytes(r.header), r.complete) for r in rows)


@pytest.mark.parametrize("block, seed", [(32, 1), (300, 2), (1 << 17, 3)])
def test_headers_equal_serial_reading(spark, block, seed):
    rng = random.Random(seed)
    pieces = [b"GET /a HTTP/1.1\r\n", b"Host: x\r\n", b"\r\n", b"\r", b"\n", b"Na", b"me", b": v", b" folded", b"bad line\r\n", b"HTTP/1.1 200 OK\r\n", b"POST /", b"z" * 90, b"\xc3\xa9"]
    parts = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    want = _serial(parts)
    assert {c for _, _, c in want} == {True, False}
    assert _found(spark, parts, block=block, fan=3) == want


@pytest.mark.parametrize("size", [2_000, 40_000, 300_000])
def test_headers_of_any_size(spark, size):
    rng = random.Random(size)
    head = b"GET / HTTP/1.1\r\nHost: h\r\nX-Long: " + bytes(rng.choice(b"abc GET ") for _ in range(size)) + b"\r\n\r\n"
    cut = b"POST /b HTTP/1.1\r\n" + b"A: b\r\n" * (size // 6) + b"no field\r\n\r\n"
    data = head + b"body" + b"." * 1400
    parts = [data[i : i + 1400] for i in range(0, len(data), 1400)] + [cut[i : i + 1400] for i in range(0, len(cut), 1400)]
    want = _serial(parts)
    assert want[0] == (1000, head, True) and want[1][1:] == (b"POST /b HTTP/1.1\r\n", False)
    assert _found(spark, parts, block=1 << 14, fan=2) == want


def test_end_of_stream_leaves_the_start_line(spark):
    assert _found(spark, [b"GET / HTTP/1.1\r\nHost: h\r\n", b"A: b\r\n"]) == [(1000, b"GET / HTTP/1.1\r\n", False)]
    assert _found(spark, [b"GET / HTTP", b"/1.1"]) == []
