"""Result sinks: captures, JSON, TSV, packet tables."""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FRAMES_PER_FILE = 1 << 20


def processed_name(path: Column) -> Column:
    """``name.ext`` to ``name_processed.ext``."""
    return F.regexp_replace(path, r"(\.[^./]+)$", "_processed$1")


def write_packets(packets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packet table, one folder per capture. Blocks of frames are spread, so a huge capture becomes many files."""
    block = F.floor(F.col("frame_no") / FRAMES_PER_FILE)
    packets.repartition("capture_id", block).sortWithinPartitions("capture_id", "frame_no").write.mode(mode).partitionBy("capture_id").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_ip_map(mapping: DataFrame, path: str, mode: str = "overwrite") -> None:
    mapping.select("orig", "anon", "version").write.mode(mode).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated with header; list values joined with commas."""
    cols = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _PcapWriter(DataSourceArrowWriter):
    """Each task writes its files under a private name; only the commit gives them their final names, so retried tasks leave no trace."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _fs(self):
        uri = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        return pafs.FileSystem.from_uri(uri)

    def write(self, iterator):
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        token, moves, out, current = uuid.uuid4().hex, [], None, None
        for batch in iterator:
            names, links, stamps, wires, raws = (batch.column(c).to_pylist() for c in ("file", "linktype", "ts_us", "wire_len", "raw"))
            for name, link, ts, wire, raw in zip(names, links, stamps, wires, raws):
                if name != current:
                    if out is not None:
                        out.close()
                    current = name
                    temp = f"{root}/.{token}-{len(moves)}"
                    moves.append((temp, f"{root}/{name}"))
                    out = fs.open_output_stream(temp)
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, link if link is not None else 1))
                ts = ts or 0
                if raw is not None:
                    out.write(struct.pack("<IIII", ts // 10**6, ts % 10**6, len(raw), max(wire or 0, len(raw))))
                    out.write(raw)
        if out is not None:
            out.close()
        return _Written(moves)

    def commit(self, messages):
        fs, _root = self._fs()
        for m in messages:
            for temp, final in m.moves if m else ():
                fs.move(temp, final)

    def abort(self, messages):
        fs, _root = self._fs()
        for m in messages:
            for temp, _final in m.moves if m else ():
                fs.delete_file(temp)


class PcapSink(DataSource):
    """Write format ``pcap_files``: rows ``(file, linktype, ts_us, wire_len, raw)`` sorted by file and frame."""

    @classmethod
    def name(cls):
        return "pcap_files"

    def writer(self, schema, overwrite):
        return _PcapWriter(self.options["path"])


def write_captures(packets: DataFrame, folder: str, captures: DataFrame | None = None, frames_per_file: int = FRAMES_PER_FILE) -> None:
    """One ``<stem>_processed.pcap`` per capture, packets in frame order; a capture beyond ``frames_per_file`` frames continues in
    ``<stem>_processed.partN.pcap`` so that no task writes an unbounded file.  ``captures (capture_id)`` lists captures that must exist
    even when no packet is left of them.
    """
    packets.sparkSession.dataSource.register(PcapSink)
    part = F.floor((F.col("frame_no") - 1) / frames_per_file)
    plain = F.regexp_replace(F.element_at(F.split("capture_id", "/"), -1), r"(?i)\.(pcap|pcapng|cap)$", "")
    # captures of one name in several folders, or with several suffixes, are told apart by a digest of their full path
    known = packets.select("capture_id").distinct()
    if captures is not None:
        known = known.union(captures.select("capture_id")).distinct()
    clash = known.groupBy(plain.alias("plain")).agg(F.count("*").alias("n"), F.collect_list("capture_id").alias("ids")).where("n > 1").select(F.explode("ids").alias("capture_id"), F.lit(True).alias("__clash"))
    stem = F.when(F.col("__clash"), F.concat(plain, F.lit("-"), F.substring(F.md5(F.col("capture_id").cast("binary")), 1, 8))).otherwise(plain)
    packets = packets.join(clash, "capture_id", "left")
    have = {f.name for f in packets.schema.fields}
    opt = lambda c, t: F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c)
    rows = packets.select(
        F.concat(stem, F.lit("_processed"), F.when(part > 0, F.concat(F.lit(".part"), part)).otherwise(""), F.lit(".pcap")).alias("file"),
        "frame_no", opt("linktype", "int"), opt("ts_us", "bigint"), opt("wire_len", "bigint"), "raw")
    if captures is not None:
        empty = captures.select("capture_id").distinct().join(packets.select("capture_id").distinct(), "capture_id", "left_anti").join(clash, "capture_id", "left")
        rows = rows.unionByName(empty.select(F.concat(stem, F.lit("_processed.pcap")).alias("file")), allowMissingColumns=True)
    ready = rows.repartition("file").sortWithinPartitions("file", "frame_no").drop("frame_no")
    ready.write.format("pcap_files").mode("append").option("path", folder).save()
