"""TLS records from reassembled streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from wireloom.functions import tls as T
from wireloom.operators.reassembly import BUCKET, KEY, with_payload
from wireloom.operators.skew import explode_buckets, lookup
from wireloom.operators.walk import NEVER, follow, walk

ISLAND = [*KEY, "island"]
BLOCK = 1 << 17
MAX_JUMP = 5 + 65535

_ITEM = ST.StructType([
    ST.StructField("pos", ST.LongType()), ST.StructField("nxt", ST.LongType()), ST.StructField("content_type", ST.IntegerType()),
    ST.StructField("version", ST.IntegerType()), ST.StructField("declared", ST.LongType()),
])


def _candidates(data: np.ndarray, base: int, block: int, island_len: int, strict: bool, check_partial: bool, limits: bool):
    """All positions of one block at which a record could start, with the jump each of them means."""
    limit = max(0, min(block, len(data) - 4))
    p = np.flatnonzero((data[:limit] >= 20) & (data[:limit] <= 24))
    if strict:
        p = p[(data[p + 1] == 3) & (data[p + 2] <= 4)]
    declared = data[p + 3].astype(np.int64) * 256 + data[p + 4]
    kind = data[p]
    nxt = base + p + 5 + declared
    cut = nxt > island_len
    if cut.any():
        if check_partial:
            good = ~cut | ((data[p + 1] == 3) & (data[p + 2] <= 4) & (declared <= T.MAX_WIRE))
            if limits:
                actual = island_len - (base + p) - 5
                good &= ~cut | ((declared <= T.MAX_RECORD) & ((kind > 21) | (declared <= 10)) & (actual * 10 >= declared))
            p, declared, kind, nxt, cut = p[good], declared[good], kind[good], nxt[good], cut[good]
        nxt = np.where(cut, NEVER, nxt)
    version = data[p + 1].astype(np.int32) * 256 + data[p + 2]
    return p + base, nxt, kind.astype(np.int32), version, declared


def _scan(block: int, strict: bool, check_partial: bool, limits: bool, out_schema: pa.Schema):
    """Partition kernel: slices arrive sorted by stretch, block and offset; one block is held at a time."""
    item = out_schema.field("items").type

    def flush(key, parts):
        *island_key, blk, island_len = key
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        cols = _candidates(data, blk * block, block, island_len, strict, check_partial, limits)
        if blk == 0:
            i = np.asarray(follow(cols[0], cols[1], 0), dtype=np.int64)
            cols = tuple(c[i] for c in cols)
        return (*island_key, blk, island_len, cols)

    def to_batch(rows):
        names = out_schema.names[:-1]
        arrays = [pa.array([r[i] for r in rows], type=out_schema.field(n).type) for i, n in enumerate(names)]
        offsets = np.cumsum([0] + [len(r[-1][0]) for r in rows]).astype(np.int32)
        fields = [pa.array(np.concatenate([r[-1][j] for r in rows]), type=item.value_type.field(j).type) for j in range(5)]
        struct = pa.StructArray.from_arrays(fields, fields=list(item.value_type))
        return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), struct, type=item)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, done, held = None, [], [], 0
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in (*ISLAND, "blk", "island_len")]
            for k, body in zip(zip(*cols), batch.column("body").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append(flush(key, parts))
                        held += len(done[-1][-1][0])
                    key, parts = k, []
                    if len(done) >= 4096 or held >= 200_000:
                        yield to_batch(done)
                        done, held = [], 0
                parts.append(body)
        if key is not None:
            done.append(flush(key, parts))
        if done:
            yield to_batch(done)

    return run


def tls_records(
    pieces: DataFrame, segments: DataFrame, strict_version: bool = False, check_partial: bool = True, partial_limits: bool = False, block: int = BLOCK, fan: int = 512,
    levels: int = 2,
) -> DataFrame:
    """Records of every contiguous stretch of stream bytes.

    ``pieces`` comes from ``trimmed_segments(segments)``.  Unknown types advance one byte; a record that runs past the stretch is
    reported as cross-segment and ends it.  ``check_partial`` asks such a record for a version (3, 0..4) and a length that the protocol
    allows, whatever share of it is there; ``partial_limits`` adds limits by type and share.  ``check_partial=False`` reports every such
    record; ``strict_version`` requires versions (3, 0..4) of all.

    Payloads move twice: to their piece, and to their block of the stream.
    """
    lengths = pieces.groupBy(*ISLAND).agg((F.max("end") - F.col("island")).alias("island_len"))
    sized = lookup(pieces, lengths, ISLAND, by="start", width=1 << 20)
    off, stop = F.col("start") - F.col("island"), F.col("end") - F.col("island")
    sliced = with_payload(sized, segments).select(
        *ISLAND, "island_len", off.alias("off"), stop.alias("stop"), "payload",
        F.explode(F.sequence(F.floor(F.greatest(off - 4, F.lit(0)) / block), F.floor((stop - 1) / block))).alias("blk"),
    )
    lo, hi = F.greatest(F.col("off"), F.col("blk") * block), F.least(F.col("stop"), (F.col("blk") + 1) * block + 4)
    body = F.substring("payload", (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int"))
    ready = (
        sliced.select(*ISLAND, "blk", "island_len", lo.alias("at"), body.alias("body"))
        .repartition(*ISLAND, "blk")
        .sortWithinPartitions(*ISLAND, "blk", "at")
    )
    schema = ST.StructType([*[ready.schema[c] for c in ISLAND], ST.StructField("blk", ST.LongType()), ST.StructField("island_len", ST.LongType()), ST.StructField("items", ST.ArrayType(_ITEM))])
    arrow = pa.schema([
        *[pa.field(c, pa.string()) for c in KEY], pa.field("island", pa.int64()), pa.field("blk", pa.int64()), pa.field("island_len", pa.int64()),
        pa.field("items", pa.list_(pa.struct([("pos", pa.int64()), ("nxt", pa.int64()), ("content_type", pa.int32()), ("version", pa.int32()), ("declared", pa.int64())]))),
    ])
    found = ready.mapInArrow(_scan(block, strict_version, check_partial, partial_limits, arrow), schema)
    rows = walk(found, [*ISLAND], "items", block, MAX_JUMP, fan, levels)
    pos, declared = F.col("__item.pos"), F.col("__item.declared")
    actual = F.least(declared, F.col("island_len") - pos - 5)
    seq = F.col("island") + pos
    kind = F.col("__item.content_type")
    return rows.select(
        *ISLAND, kind.alias("content_type"), T.type_name(kind).alias("content_type_name"),
        F.shiftright("__item.version", 8).alias("version_major"), (F.col("__item.version") % 256).alias("version_minor"),
        declared.alias("declared_length"), actual.alias("actual_length"), pos.alias("header_start"), (pos + 5 + actual).alias("payload_end"),
        seq.alias("tls_header_seq_start"), (seq + 5).alias("tls_header_seq_end"), (seq + 5).alias("tls_payload_seq_start"), (seq + 5 + actual).alias("tls_payload_seq_end"),
        (actual == declared).alias("is_complete"), (actual < declared).alias("is_cross_segment"), T.strategy(kind).alias("processing_strategy"),
    )


def record_frames(records: DataFrame, pieces: DataFrame) -> DataFrame:
    """Frames that hold bytes of complete application-data records, with the number of such records per frame."""
    rec = records.where((F.col("content_type") == T.APP_DATA) & F.col("is_complete")).select(
        *KEY, F.col("tls_header_seq_start").alias("__a"), F.col("tls_payload_seq_end").alias("__b"))
    rec = explode_buckets(rec, "__a", "__b", BUCKET)
    seg = explode_buckets(pieces.select(*KEY, "frame_no", "start", "end"), "start", "end", BUCKET)
    # a pair that meets in several buckets is counted in the first one only
    first = F.floor(F.greatest("__a", "start") / BUCKET) == F.col("__bucket")
    pairs = seg.join(rec, [*KEY, "__bucket"]).where((F.col("__a") < F.col("end")) & (F.col("start") < F.col("__b")) & first)
    return pairs.groupBy("capture_id", "frame_no").agg(F.count("*").alias("records"))
