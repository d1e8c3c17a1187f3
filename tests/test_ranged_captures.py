"""Captures cut into byte ranges give what a front-to-back read gives."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from wireloom.sources import framing as fr
from wireloom.sources.captures import read_captures


def pcap(records, order="<", ticks=10**6):
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4 if ticks == 10**6 else 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)]
    for sec, frac, wire, raw in records:
        out.append(struct.pack(order + "IIII", sec, frac, len(raw), wire) + raw)
    return b"".join(out)


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def face(order, link, digits=6):
    return block(order, 1, struct.pack(order + "HHI", link, 0, 65535) + struct.pack(order + "HHBxxx", 9, 1, digits) + struct.pack(order + "HH", 0, 0))


def packet(order, which, ts, raw):
    return block(order, 6, struct.pack(order + "IIIII", which, ts >> 32, ts & 0xFFFFFFFF, len(raw), len(raw)) + raw)


def read(spark, folder, size):
    rows = read_captures(spark, str(folder), range_bytes=size)
    return sorted(tuple(r) for r in rows.select(F.element_at(F.split("capture_id", "/"), -1), "frame_no", "ts_us", "wire_len", "linktype", F.md5("raw")).collect())


def some_pcapng(rng):
    out = []
    for order in "<><":
        out += [section(order), face(order, 1), block(order, 0xBAD, b"odd"), face(order, 101, 9)]
        for k in range(150):
            raw = rng.choice([bytes(rng.randrange(2000)), rng.randbytes(rng.randrange(300)), struct.pack(order + "II", 6, 32) * 8])
            out.append(packet(order, rng.randrange(3), k * 10**9, raw))
            if k == 70:
                out += [face(order, 113), block(order, 3, struct.pack(order + "I", len(raw)) + raw), block(order, 4, b"names")]
        out.append(packet(order, 2, 5, bytes(300_000)))
    return b"".join(out)


def test_any_range_gives_the_same_packets(spark, tmp_path):
    rng = random.Random(5)
    plain = [(k, k, 2000, rng.choice([bytes(900), rng.randbytes(500), struct.pack("<IIII", 1, 1, 60, 60) * 20])) for k in range(400)]
    plain[100] = (1, 2, 300_000, rng.randbytes(300_000))
    plain[200] = (1, 2, 2_000_000, bytes(2_000_000))
    plain[201] = (1, 9_000_000, 3, b"")  # an odd fraction, a short wire length, no bytes
    plain[202] = (1, 9_000_000, 3, b"torn wire length")
    files = {
        "a.pcap": pcap(plain), "b.pcap": pcap(plain[:90] + plain[101:180], ">", 10**9), "c.pcap": pcap(plain[:300])[:-7], "d.pcapng": some_pcapng(rng), "e.pcapng": some_pcapng(rng)[:-50],
        "f.pcapng": some_pcapng(rng)[:4000] + b"\xff" * 5000, "g.pcap": pcap([])[:24] + b"\xff" * 3000, "h.cap": b"neither", "i.pcap": pcap([(0, 0, 0, b"")] * 3000),
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    whole = read(spark, tmp_path, 1 << 30)
    names = [r[0] for r in whole]
    assert names.count("a.pcap") == 400 and names.count("c.pcap") == 299 and names.count("d.pcapng") == 456 and names.count("i.pcap") == 3000
    for size in (100_000, 3_000):
        assert read(spark, tmp_path, size) == whole


def test_wrong_guesses_are_read_again(spark, tmp_path, monkeypatch):
    """A guess that looks right in every range but is not: records that hold captures themselves."""
    inner = pcap([(k, 1, 100, bytes([k % 256]) * 100) for k in range(300)])[24:]
    (tmp_path / "a.pcap").write_bytes(pcap([(k, 1, len(inner), inner) for k in range(20)]))
    whole = read(spark, tmp_path, 1 << 30)
    assert len(whole) == 20 and read(spark, tmp_path, 10_000) == whole


@pytest.mark.parametrize("order", "<>")
def test_longest_chain_is_guessed(order):
    rng = np.random.default_rng(3)
    records = [(k, k, 900, rng.integers(0, 256, int(rng.integers(1, 800)), dtype=np.uint8).tobytes()) for k in range(300)]
    data = pcap(records, order)
    starts, at = [], 24
    for r in records:
        starts.append(at)
        at += 16 + len(r[3])
    for base in (5_000, 40_001, 77_777):
        got = fr.pcap_guess(data[base : base + 20_015], base, base + 20_000, len(data), order, 10**6)
        assert got == min(s for s in starts if s >= base)
