"""HTTP message headers per flow-direction, in capture order, and the ranges of them that may be kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from wireloom.functions import http as H
from wireloom.functions.octets import latin1
from wireloom.operators.http_lines import headers_of
from wireloom.operators.reassembly import KEY
from wireloom.operators.scan import running
from wireloom.operators.walk import NEVER, follow, walk

#: Optional buffer limits of a reader that gives up: bytes without a blank line after which only the start line counts, and bytes buffered at most.
BUFFER_LIMITS = (1024, 16384)
BLOCK = 1 << 17

_ITEM = ST.StructType([
    ST.StructField("pos", ST.LongType()), ST.StructField("nxt", ST.LongType()), ST.StructField("frame_no", ST.LongType()),
    ST.StructField("start_seq", ST.LongType()), ST.StructField("header", ST.BinaryType()), ST.StructField("complete", ST.BooleanType()),
])
_ARROW_ITEM = pa.list_(pa.struct([
    ("pos", pa.int64()), ("nxt", pa.int64()), ("frame_no", pa.int64()), ("start_seq", pa.int64()), ("header", pa.binary()), ("complete", pa.bool_())]))
_METHOD = re.compile(b"|".join(re.escape(m.encode()) for m in H.METHODS))
_PREFIX = tuple(t.encode() for t in (H.RESPONSE, *H.METHODS))


def _start_in(payload: bytes, strict: bool) -> int:
    """Offset of the start token in a segment: prefix, else (lenient) first response token, else earliest method; -1 without one."""
    if payload.startswith(_PREFIX):
        return 0
    if strict:
        return -1
    at = payload.find(H.RESPONSE.encode())
    if at >= 0:
        return at
    m = _METHOD.search(payload)
    return m.start() if m else -1


def _block_items(segments: list[tuple[int, int, int, bytes]], limit: int, strict: bool, limits: tuple[int, int]) -> list[tuple]:
    """Outcome of starting a message in each segment of a block; ``segments`` (offset, frame, seq, payload) include the look-ahead."""
    base = segments[0][0]
    data = b"".join(s[3] for s in segments)
    ends = np.cumsum([len(s[3]) for s in segments]) + base
    out = []
    for off, frame, seq, payload in segments:
        if off >= limit:
            break
        at = _start_in(payload, strict)
        if at < 0:
            continue
        p = off + at - base
        stop = min(p + limits[1], len(data))
        blank, line = data.find(b"\r\n\r\n", p, stop), data.find(b"\r\n", p, stop)
        # segment after which the blank line is visible / after which the lower limit is buffered and a first line is complete
        full = int(np.searchsorted(ends, base + blank + 4)) if blank >= 0 else len(ends)
        half = int(np.searchsorted(ends, base + max(line + 2, p + limits[0]))) if line >= 0 else len(ends)
        if blank >= 0 and full <= half:
            out.append((off, int(ends[full]), frame, seq + at, data[p : blank + 4], True))
        elif line >= 0 and half < len(ends):
            out.append((off, int(ends[half]), frame, seq + at, data[p : line + 2], False))
        else:
            out.append((off, NEVER, frame, seq + at, None, False))
    return out


def _scan(block: int, strict: bool, limits: tuple[int, int], schema: pa.Schema):
    def flush(key, segments):
        blk = key[-1]
        items = _block_items(segments, (blk + 1) * block, strict, limits)
        if blk == 0 and items:
            pos, nxt = np.array([i[0] for i in items]), np.array([i[1] for i in items])
            items = [items[i] for i in follow(pos, nxt, 0)]
        return (*key, [dict(zip(_ITEM.names, i)) for i in items])

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segments, done = None, [], []
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in (*KEY, "blk")])
            rows = zip(*[batch.column(n).to_pylist() for n in ("off", "frame_no", "seq", "payload")])
            for k, row in zip(keys, rows):
                if k != key:
                    if key is not None:
                        done.append(flush(key, segments))
                    key, segments = k, []
                    if len(done) >= 1024:
                        yield to_batch(done)
                        done = []
                segments.append(row)
        if key is not None:
            done.append(flush(key, segments))
        if done:
            yield to_batch(done)

    return run


def message_headers(segments: DataFrame, ports=H.PORTS, strict_start: bool = False, block: int = BLOCK, fan: int = 512, levels: int = 2, limits: tuple[int, int] | None = None) -> DataFrame:
    """Headers (start line to blank line) found in TCP segments ``(key, frame_no, seq, len, payload, sport, dport)``.

    A message starts at a token and is read line by line, over as many segments as it takes, until a blank line (``complete``), until a line
    that is neither a field nor a folded one, or until the stream ends; in the last two cases only the start line is reported. The segment in
    which it ends is used up. ``strict_start`` accepts tokens only at a segment start. ``limits`` (see ``BUFFER_LIMITS``) gives up by size
    instead: lines are not looked at, and a header without a blank line within the limits is its start line.
    """
    likely = segments.where((F.col("len") > 0) & H.likely_http(ports))
    placed = running(likely, KEY, "frame_no", F.col("len"), "off")
    if limits is None:
        return headers_of(placed, partial(_start_in, strict=strict_start), block, fan, levels)
    return _buffered(placed, strict_start, block, fan, levels, limits)


def _buffered(placed: DataFrame, strict: bool, block: int, fan: int, levels: int, limits: tuple[int, int]) -> DataFrame:
    jump = limits[1] + 65535
    # A segment belongs to the block it begins in, and is look-ahead for the messages of the block(s) before it: a message that
    # starts in the last segment of a block may need the upper limit and the one segment that follow it.
    first = F.floor(F.greatest(F.col("off") - jump, F.lit(0)) / block)
    last = F.floor(F.col("off") / block)
    ready = (
        placed.select(*KEY, "frame_no", "seq", F.col("off").cast("bigint").alias("off"), "payload", F.explode(F.sequence(first, last)).alias("blk"))
        .repartition(*KEY, "blk")
        .sortWithinPartitions(*KEY, "blk", "off")
    )
    schema = ST.StructType([*[ready.schema[c] for c in KEY], ST.StructField("blk", ST.LongType()), ST.StructField("items", ST.ArrayType(_ITEM))])
    arrow = pa.schema([*[pa.field(c, pa.string()) for c in KEY], pa.field("blk", pa.int64()), pa.field("items", _ARROW_ITEM)])
    found = ready.mapInArrow(_scan(block, strict, limits, arrow), schema)
    rows = walk(found, KEY, "items", block, jump, fan, levels)
    return rows.where("__item.header IS NOT NULL").select(
        *KEY, F.col("__item.frame_no").alias("frame_no"), F.col("__item.start_seq").alias("start_seq"), F.col("__item.header").alias("header"), F.col("__item.complete").alias("complete"))


def _ranges(header: Column, sensitive=H.SENSITIVE) -> Column:
    """Kept byte ranges of a header: every line and line end, except the values of sensitive fields and their continuation lines."""
    lines = F.split(latin1(header), "\r\n", -1)
    state0 = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("hidden"), F.lit(0).alias("i"),
        F.array().cast("array<struct<a:int,b:int>>").alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        n = F.length(line)
        colon = F.instr(line, ":")
        name = F.lower(F.regexp_replace(F.substring(line, F.lit(1), F.greatest(colon - 1, F.lit(0))), r"^[ \t\x0b\f\r\n]+|[ \t\x0b\f\r\n]+$", ""))
        folded = line.startswith(" ") | line.startswith("\t")
        named = (colon > 0) & name.isin(*sensitive)
        hidden = F.when(n == 0, False).when(folded, acc["hidden"]).otherwise(named)
        kept = F.when(folded, F.when(acc["hidden"], 0).otherwise(n)).when(
            named, colon + F.length(F.regexp_extract(F.substring(line, colon + 1, n), r"^[ \t]*", 0))
        ).otherwise(n)
        last = acc["i"] == F.size(lines) - 1
        pos, eol = acc["pos"], acc["pos"] + n
        pair = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
        new = F.concat(acc["out"], pair(pos, pos + kept), F.when(last, F.array().cast("array<struct<a:int,b:int>>")).otherwise(pair(eol, eol + 2)))
        return F.struct((eol + 2).cast("int").alias("pos"), hidden.alias("hidden"), (acc["i"] + 1).cast("int").alias("i"), new.alias("out"))

    return F.filter(F.aggregate(lines, state0, step, lambda s: s["out"]), lambda r: r["a"] < r["b"])


def header_rules(headers: DataFrame, sensitive=H.SENSITIVE) -> DataFrame:
    """Keep rules ``http_header`` / ``header_only`` for the allowed ranges of each header."""
    r = headers.select(*KEY, "start_seq", F.explode(_ranges(F.col("header"), sensitive)).alias("r"))
    return r.select(
        *KEY, (F.col("start_seq") + F.col("r.a")).alias("seq_start"), (F.col("start_seq") + F.col("r.b")).alias("seq_end"),
        F.lit("http_header").alias("rule_type"), F.lit("header_only").alias("strategy"))


def scan_stats(segments: DataFrame, headers: DataFrame, rules: DataFrame, ports=H.PORTS) -> DataFrame:
    s = segments.groupBy("capture_id").agg(
        F.count("*").alias("tcp_packets"), F.count_if(F.col("len") > 0).alias("with_payload"), F.count_if((F.col("len") > 0) & H.likely_http(ports)).alias("candidates"))
    h = headers.groupBy("capture_id").agg(F.count("*").alias("headers"))
    r = rules.groupBy("capture_id").agg(F.count("*").alias("rules"))
    return s.join(h, "capture_id", "left").join(r, "capture_id", "left").fillna(0, ["headers", "rules"])
