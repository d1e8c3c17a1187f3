"""Capture record framing: header readers and block scans for pcap and pcapng bytes (used inside tasks)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the file formats: magic (as read big-endian) -> (byte order, ticks per second).
PCAP_MAGIC = {0xD4C3B2A1: ("<", 10**6), 0xA1B2C3D4: (">", 10**6), 0x4D3CB2A1: ("<", 10**9), 0xA1B23C4D: (">", 10**9)}
PCAPNG_MAGIC = 0x0A0D0D0A
FILE_HEADER = 24
RECORD_HEADER = 16
NEVER = 1 << 62  # where a chain goes on that ended in a torn record
BLOCK_KINDS = (1, 2, 3, 4, 5, 6, 10, 0xBAD, 0x40000BAD, PCAPNG_MAGIC)


def pcap_header(head: bytes):
    """(byte order, ticks, link type, snap length) of a pcap file, or None."""
    if len(head) < FILE_HEADER:
        return None
    known = PCAP_MAGIC.get(int.from_bytes(head[:4], "big"))
    if known is None:
        return None
    order, ticks = known
    snap, link = struct.unpack(order + "II", head[16:24])
    return order, ticks, link & 0x0FFFFFFF, snap


def is_pcapng(head: bytes) -> bool:
    return int.from_bytes(head[:4], "big") == PCAPNG_MAGIC


def _u32(data: bytes, shift: int, count: int, stride: int, order: str) -> np.ndarray:
    """The 32-bit numbers at ``shift``, ``shift + stride``, .. of a buffer."""
    b = np.frombuffer(data, dtype=np.uint8)
    parts = [b[shift + i : shift + i + count * stride : stride][:count].astype(np.int64) for i in range(4)]
    if order == "<":
        parts.reverse()
    return (parts[0] << 24) | (parts[1] << 16) | (parts[2] << 8) | parts[3]


def _longest_chain(pos: np.ndarray, nxt: np.ndarray, limit: int) -> int | None:
    """The first position of the chain with most records among those that get from record to record up to ``limit``."""
    n = len(pos)
    if not n:
        return None
    at = np.minimum(np.searchsorted(pos, nxt), n - 1)
    done, dead = n, n + 1
    jump = np.concatenate([np.where(nxt >= limit, done, np.where(pos[at] == nxt, at, dead)), [done, dead]])
    count = np.concatenate([np.ones(n, np.int64), [0, 0]])
    while (jump[:n] < n).any():  # pointer doubling
        count, jump = count + count[jump], jump[jump]
    count[:n][jump[:n] == dead] = 0
    best = int(count[:n].argmax())
    return int(pos[best]) if count[best] else None


def pcap_guess(data: bytes, base: int, limit: int, total: int, order: str, ticks: int) -> int | None:
    """Where the first record of a range most likely begins. A wrong guess costs a second read of the range, nothing else."""
    count = max(0, min(limit - base, len(data) - RECORD_HEADER + 1))
    frac, captured, wire = (_u32(data, k, count, 1, order) for k in (4, 8, 12))
    good = np.flatnonzero((captured > 0) & (captured <= wire) & (frac < ticks))
    nxt = base + good + RECORD_HEADER + captured[good]
    whole = nxt <= total
    return _longest_chain(good[whole] + base, nxt[whole], limit)


def pcap_follow(data: bytes, base: int, entry: int, limit: int, total: int, order: str) -> tuple[int, int]:
    """(first record position at or behind ``limit``, records before it) of the chain that begins at ``entry``."""
    at, n, size = entry, 0, struct.Struct(order + "I")
    while at < limit:
        if at + RECORD_HEADER > total:
            return NEVER, n
        nxt = at + RECORD_HEADER + size.unpack_from(data, at - base + 8)[0]
        if nxt > total:
            return NEVER, n
        at, n = nxt, n + 1
    return at, n


def pcapng_guess(data: bytes, base: int, limit: int, total: int, order: str) -> int | None:
    """As ``pcap_guess``, for blocks, which begin at multiples of four and repeat their length at their end."""
    first = -base % 4
    count = max(0, (min(limit - base, len(data) - 11) - first + 3) // 4)
    kind, size = (_u32(data, first + k, count, 4, order) for k in (0, 4))
    at = first + 4 * np.arange(count, dtype=np.int64)
    known = np.isin(kind, BLOCK_KINDS) & (size >= 12) & (size % 4 == 0) & (base + at + size <= total)
    at, size = at[known], size[known]
    words = _u32(data, first, (len(data) - first) // 4, 4, order)
    last = (at - first + size) // 4 - 1
    same = (last >= len(words)) | (words[np.minimum(last, len(words) - 1)] == size)
    return _longest_chain(base + at[same], base + at[same] + size[same], limit)


def pcapng_follow(data: bytes, base: int, entry: int, limit: int, total: int, order: str, read) -> tuple[int, int, bytes]:
    """As ``pcap_follow``, with the section and interface blocks on the way; ``read(at, n)`` gets bytes of the file."""
    at, n, changes = entry, 0, []
    while at < limit:
        if at + 12 > total:
            return NEVER, n, b"".join(changes)
        o = at - base
        section = int.from_bytes(data[o : o + 4], "big") == PCAPNG_MAGIC
        if section:
            order = ">" if data[o + 8 : o + 12] == b"\x1a\x2b\x3c\x4d" else "<"
        kind, size = struct.unpack_from(order + "II", data, o)
        if size < (28 if section else 12) or (size % 4 and not section) or at + size > total:
            return NEVER, n, b"".join(changes)
        if section or kind == 1:
            changes.append(read(at, size))
        elif (kind in (2, 6) and size >= 32) or kind == 3:
            n += 1
        at += size
    return at, n, b"".join(changes)


def current_section(blocks: bytes) -> bytes:
    """Section and interface blocks from the last section header on."""
    at, order, start = 0, "<", 0
    while at + 8 <= len(blocks):
        if int.from_bytes(blocks[at : at + 4], "big") == PCAPNG_MAGIC:
            order, start = section_order(blocks[at:]), at
        at += struct.unpack_from(order + "I", blocks, at + 4)[0]
    return blocks[start:]


def section_order(blocks: bytes) -> str:
    return ">" if blocks[8:12] == b"\x1a\x2b\x3c\x4d" else "<"


def pcap_record(data: bytes, at: int, order: str, ticks: int):
    """(timestamp in microseconds, wire length, packet bytes) of the record at ``at``."""
    sec, frac, captured, wire = struct.unpack_from(order + "IIII", data, at)
    return sec * 10**6 + frac * 10**6 // ticks, wire, data[at + RECORD_HEADER : at + RECORD_HEADER + captured]


def pcapng_records(read, more=lambda: True) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(link type, microseconds or None, wire length, packet) from a pcapng stream; ``read(n)`` returns up to n bytes.

    Understands section headers, interface descriptions, enhanced, simple and old packet blocks; stops at the first torn block, or before
    a block when there is no ``more()``.
    """
    order, faces = "<", []
    while more():
        head = read(8)
        if len(head) < 8:
            return
        raw_kind = head[:4]
        if int.from_bytes(raw_kind, "big") == PCAPNG_MAGIC:
            magic = read(4)
            order = ">" if magic == b"\x1a\x2b\x3c\x4d" else "<"
            size = struct.unpack(order + "I", head[4:])[0]
            if size < 28 or len(read(size - 12)) < size - 12:
                return
            faces = []
            continue
        kind, size = struct.unpack(order + "II", head)
        if size < 12 or size % 4:
            return
        body = read(size - 8)
        if len(body) < size - 8:
            return
        if kind == 1:
            link, snap = struct.unpack_from(order + "HxxI", body)
            faces.append((link, snap, _ticks(body[8:-4], order)))
        elif kind in (6, 2) and len(body) >= 24:
            if kind == 6:
                face, hi, lo, captured, wire = struct.unpack_from(order + "IIIII", body)
            else:
                face, _drops, hi, lo, captured, wire = struct.unpack_from(order + "HHIIII", body)
            link, _snap, ticks = faces[face] if face < len(faces) else (1, 0, 10**6)
            yield link, ((hi << 32) | lo) * 10**6 // ticks, wire, body[20 : 20 + captured]
        elif kind == 3:
            wire = struct.unpack_from(order + "I", body)[0]
            link, snap, _t = faces[0] if faces else (1, 0, 10**6)
            captured = min(wire, snap or wire, len(body) - 8)
            yield link, None, wire, body[4 : 4 + captured]


def _ticks(options: bytes, order: str) -> int:
    """Timestamp resolution option (code 9); microseconds by default."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            v = options[at + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + (size + 3) // 4 * 4
    return 10**6
