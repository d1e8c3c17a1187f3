"""Capture files as DataFrames: listing, inventory, header checks, and packets."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.functions.octets import be_int
from wireloom.operators.stage import materialise
from wireloom.sources import framing as fr

EXTENSIONS = ("pcap", "pcapng", "cap")
RANGE = 8 << 20  # bytes of a large capture read by one task

_PACKET = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("frame_no", T.LongType()), T.StructField("ts_us", T.LongType()),
    T.StructField("wire_len", T.LongType()), T.StructField("linktype", T.IntegerType()), T.StructField("raw", T.BinaryType())])
_PACKET_ARROW = pa.schema([("capture_id", pa.string()), ("frame_no", pa.int64()), ("ts_us", pa.int64()), ("wire_len", pa.int64()), ("linktype", pa.int32()), ("raw", pa.binary())])
_FACT = "path string, size long, blk long, guess boolean, entry long, leave long, n long, changes binary"
_STEP = "path string, size long, blk long, entry long, first long, state binary, missing boolean"
SMALL_TASK = 64 << 20  # bytes of small captures for one task


def _files(spark: SparkSession, path: str, recursive: bool, extensions=EXTENSIONS) -> DataFrame:
    # suffixes in either case
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(either))
        .option("recursiveFileLookup", str(recursive).lower()).load(path)
    )


def list_captures(spark: SparkSession, path: str, recursive: bool = True, extensions=EXTENSIONS) -> DataFrame:
    """Capture files by name; contents are not read."""
    return _files(spark, path, recursive, extensions).select("path", "length", "modificationTime").distinct().orderBy("path")


def inventory(captures: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return captures.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.array_sort(F.collect_set(ext)).alias("extensions"))


def check_header(content: str = "content"):
    """STRUCT<is_valid, format, version, linktype, problem> from the first bytes of a file. pcapng is accepted."""
    c = F.col(content)
    magic = be_int(c, 0, 4)
    little = magic.isin(*[m for m, (o, _t) in fr.PCAP_MAGIC.items() if o == "<"])
    is_pcap, is_ng = magic.isin(*fr.PCAP_MAGIC), magic == fr.PCAPNG_MAGIC
    le = lambda o, n: sum((be_int(c, o + i, 1) * (256 ** i) for i in range(1, n)), be_int(c, o, 1))
    field = lambda o, n: F.when(little, le(o, n)).otherwise(be_int(c, o, n))
    problem = (
        F.when(F.length(c) < fr.FILE_HEADER, "file too short").when(~F.coalesce(is_pcap | is_ng, F.lit(False)), "unknown magic")
        .when(is_pcap & (F.length(c) < fr.FILE_HEADER + fr.RECORD_HEADER), "no packets").otherwise("")
    )
    return F.struct(
        (problem == "").alias("is_valid"), F.when(is_pcap, "pcap").when(is_ng, "pcapng").alias("format"),
        F.when(is_pcap, F.concat_ws(".", field(4, 2), field(6, 2))).alias("version"), F.when(is_pcap, field(20, 4)).alias("linktype"), F.nullif(problem, F.lit("")).alias("problem"))


def _emit(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_PACKET_ARROW)], schema=_PACKET_ARROW)


def _whole(stream, name: str) -> Iterator[tuple]:
    """Packets of one capture read front to back in constant memory."""
    head = stream.read(fr.FILE_HEADER)
    known = fr.pcap_header(head)
    if known:
        order, ticks, link, _snap = known
        n = 0
        while True:
            h = stream.read(fr.RECORD_HEADER)
            if len(h) < fr.RECORD_HEADER:
                return
            size = int.from_bytes(h[8:12], "little" if order == "<" else "big")
            body = stream.read(size)
            if len(body) < size:
                return
            n += 1
            ts, wire, raw = fr.pcap_record(h + body, 0, order, ticks)
            yield name, n, ts, wire, link, raw
    elif fr.is_pcapng(head):
        rest = io.BytesIO(head)

        def read(k: int) -> bytes:
            got = rest.read(k)
            return got if len(got) == k else got + stream.read(k - len(got))

        for n, (link, ts, wire, raw) in enumerate(fr.pcapng_records(read), 1):
            yield name, n, ts, wire, link, raw


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[-1])
        if size > 4 << 20 or len(out) >= 10000:
            yield _emit(out)
            out, size = [], 0
    if out:
        yield _emit(out)


def split_content(captures: DataFrame) -> DataFrame:
    """Packets of captures whose bytes are in a column ``(capture_id, content)``."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column("capture_id").to_pylist(), b.column("content").to_pylist()):
                yield from _batched(_whole(io.BytesIO(content), name))

    return captures.select("capture_id", "content").mapInArrow(run, _PACKET)


def _open(uri: str):
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _read_range(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def _head(f) -> bytes:
    return _read_range(f, 0, fr.FILE_HEADER)


def _range_fact(f, size: int, blk: int, range_bytes: int, entry: int | None, state: bytes) -> tuple:
    """(entry, next entry, packets, interface changes) of one byte range; without ``entry`` a guess is made, which may be None."""
    head, base = _head(f), blk * range_bytes
    limit = min(base + range_bytes, size)
    data = _read_range(f, base, limit - base + fr.RECORD_HEADER - 1)
    known = fr.pcap_header(head)
    if known:
        order, ticks = known[:2]
        if entry is None:
            entry = fr.FILE_HEADER if blk == 0 else fr.pcap_guess(data, base, limit, size, order, ticks)
        return (None, None, 0, b"") if entry is None else (entry, *fr.pcap_follow(data, base, entry, limit, size, order), b"")
    order = fr.section_order(state or head)
    if entry is None:
        entry = 0 if blk == 0 else fr.pcapng_guess(data, base, limit, size, order)
    return (None, None, 0, b"") if entry is None else (entry, *fr.pcapng_follow(data, base, entry, limit, size, order, lambda at, n: _read_range(f, at, n)))


def _placed_ranges(range_bytes: int):
    """Facts of one capture's ranges -> where each range is truly entered, its first frame and interface blocks; ``missing`` where no fact tells how it is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, size = pdf["path"].iloc[0], int(pdf["size"].iloc[0])
        guess, facts = {}, {}
        for blk, guessed, entry, leave, n, changes in zip(pdf["blk"], pdf["guess"], pdf["entry"], pdf["leave"], pdf["n"], pdf["changes"]):
            if not pd.isna(entry):
                facts[blk, int(entry)] = int(leave), int(n), changes
                if guessed:
                    guess[blk] = int(entry)
        at, frame, state, out = guess.get(0, 0), 0, b"", []
        for blk in range(int(pdf["blk"].max()) + 1):
            if at is None:
                at = guess.get(blk)  # behind a range that has to be read again: taken on trust until the next pass
            if at is None or at >= (blk + 1) * range_bytes:
                continue
            known = facts.get((blk, at))
            out.append((path, size, blk, at, frame, state, known is None))
            at = None
            if known:
                at, n, changes = known
                frame += n
                state = fr.current_section(state + changes) if changes else state
        return pd.DataFrame(out, columns=["path", "size", "blk", "entry", "first", "state", "missing"])

    return run


def _packets_between(f, name: str, entry: int, stop: int, first: int, state: bytes) -> Iterator[tuple]:
    """Packets of the records that begin in [entry, stop), in constant memory however long they are."""
    known = fr.pcap_header(_head(f))
    f.seek(entry)
    stream = io.BufferedReader(f, 1 << 20)
    at, n = entry, first

    def read(k: int) -> bytes:
        nonlocal at
        got = before.read(k)
        if len(got) < k:
            more = stream.read(k - len(got))
            at += len(more)
            got += more
        return got

    before = io.BytesIO(state)
    if known:
        order, ticks, link, _snap = known
        while at < stop:
            h = read(fr.RECORD_HEADER)
            size = int.from_bytes(h[8:12], "little" if order == "<" else "big")
            if len(h) < fr.RECORD_HEADER or len(body := read(size)) < size:
                return
            n += 1
            ts, wire, raw = fr.pcap_record(h + body, 0, order, ticks)
            yield name, n, ts, wire, link, raw
    else:
        for n, (link, ts, wire, raw) in enumerate(fr.pcapng_records(read, lambda: at < stop), first + 1):
            yield name, n, ts, wire, link, raw


def read_captures(spark: SparkSession, path: str, recursive: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Packets ``(capture_id, frame_no, ts_us, wire_len, linktype, raw)`` of all captures below ``path``.

    Files up to one range are read by one task each.  Larger files, pcap or pcapng, are cut into byte ranges that are read in parallel:
    every range guesses where its first record begins and follows the chain from there; a pass over these facts, a few bytes a range,
    finds where each range is truly entered, which interfaces are known there and which frame comes first.  Ranges guessed wrongly are
    followed again from their true entry until all are known, so the result is that of a front-to-back read, whatever the records' size.
    No task reads a file as a whole and no packet is shuffled.
    """
    files = _files(spark, path, recursive).select("path", "length")
    total = files.agg(F.sum(F.least("length", F.lit(range_bytes)))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, int(total) // SMALL_TASK)

    def split(batches):
        for b in batches:
            kinds = []
            for name, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                with _open(name) as f:
                    head = _head(f)
                    kinds.append(size > range_bytes and (fr.pcap_header(head) is not None or fr.is_pcapng(head)))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(kinds, pa.bool_())], ["path", "length", "ranged"])

    # the first bytes say what a file is, not its name
    files = files.repartition(n, "path").mapInArrow(split, "path string, length long, ranged boolean")
    small = files.where("not ranged")

    def whole(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                with _open(name) as f:
                    yield from _batched(_whole(f, name))

    out = small.select("path").mapInArrow(whole, _PACKET)
    large = files.where("ranged").select("path", "length")
    if large.isEmpty():
        return out
    last = F.floor((F.col("length") - 1) / range_bytes)
    ranges = large.select("path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("blk")).repartition("path", "blk")

    def facts(guessing: bool):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    with _open(row["path"]) as f:
                        got = _range_fact(f, row["size"], row["blk"], range_bytes, None if guessing else row["entry"], b"" if guessing else row["state"])
                    cols = [row["path"], row["size"], row["blk"], guessing, *got]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, kinds)], [c.split()[0] for c in _FACT.split(", ")])

        return run

    known = materialise(ranges.mapInArrow(facts(True), _FACT))
    while True:
        plan = materialise(known.groupBy("path").applyInPandas(_placed_ranges(range_bytes), _STEP))
        again = plan.where("missing")
        if again.isEmpty():
            break
        known = known.unionByName(materialise(again.repartition("path", "blk").mapInArrow(facts(False), _FACT)))

    def cut(batches):
        def rows():
            for b in batches:
                for row in b.to_pylist():
                    with _open(row["path"]) as f:
                        yield from _packets_between(f, row["path"], row["entry"], min((row["blk"] + 1) * range_bytes, row["size"]), row["first"], row["state"])

        yield from _batched(rows())

    return out.unionByName(plan.repartition("path", "blk").mapInArrow(cut, _PACKET))
