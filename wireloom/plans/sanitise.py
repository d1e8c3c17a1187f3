"""End-to-end flows over dissected packets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import addresses as A
from wireloom.functions import http as H
from wireloom.functions import tls as T
from wireloom.functions.octets import be_int, filler
from wireloom.operators import dedup as dd
from wireloom.operators import flows as fl
from wireloom.operators import http_headers as hh
from wireloom.operators import mask as mk
from wireloom.operators import reassembly as ra
from wireloom.operators import rules as ru
from wireloom.operators import tls_records as tr
from wireloom.operators.dissect import dissect
from wireloom.operators.stage import materialise

SEGMENT = [*ra.KEY, "frame_no", "seq", "len", "payload", "sport", "dport"]


def record_start_frames(segments: DataFrame) -> DataFrame:
    """Segments as the frames that ``fallback_rules`` reads: one that begins with a record header has that type, others have none."""
    none, payload = F.array().cast("array<string>"), F.col("payload")
    kind = F.when(T.is_record_start(payload), F.array(be_int(payload, 0, 1).cast("string"))).otherwise(none)
    return segments.withColumns({"content_types": kind, "segment_data": none})


def keep_rules(
    segments: DataFrame, protocol: str = "auto", preserve: Mapping[str, bool] | None = None, http_ports=H.PORTS, strict_version: bool = False, fallback: bool = True
) -> DataFrame | None:
    """Rules of the chosen protocol over TCP segments; None when nothing is to be kept (``none``).

    TLS rules come from the reassembled records; with ``fallback``, segments that begin with a record header but lie in no rule (behind a
    gap, or where the reader lost its place) add one of their own. ``auto`` takes TLS and HTTP rules together.
    """
    if protocol not in ("tls", "http", "auto", "none"):
        raise ValueError(f"unknown protocol: {protocol}")
    parts = []
    if protocol in ("tls", "auto"):
        pieces = ra.trimmed_segments(segments)
        records = ru.tls_rules(tr.tls_records(pieces, segments, strict_version=strict_version), preserve)
        if fallback:
            records = materialise(records)
            parts.append(ru.fallback_rules(record_start_frames(segments), records, preserve))
        parts.append(records)
    if protocol in ("http", "auto"):
        parts.append(hh.header_rules(hh.message_headers(segments, http_ports)))
    return ru.combine(*parts) if parts else None


def sanitise(
    packets: DataFrame,
    key: str = "",
    dedup: bool = True,
    anonymise: bool = True,
    mask: bool = True,
    protocol: str = "auto",
    digest: str = "sha256",
    rotate_host: bool = False,
    preserve: Mapping[str, bool] | None = None,
    http_ports=H.PORTS,
    mask_byte: int = 0,
    mask_udp: bool = False,
) -> DataFrame:
    """Remove duplicates, anonymise addresses, mask payloads; each stage optional, at least one needed.

    ``packets`` are raw frames ``(capture_id, frame_no, raw, ..)`` or already dissected ones.  Raw frames are decoded after duplicate
    removal, so only their bytes take part in that join.

    Adds ``new_ips`` (all IP layers, for writing raw frames back), ``ip_modified``, ``payload_modified``, ``kept_bytes`` and
    ``masked_bytes``.  Frames that could not be decoded (``parse_ok`` false) lose every byte of ``raw`` behind the last layer read.
    """
    if not (dedup or anonymise or mask):
        raise ValueError("choose at least one of dedup, anonymise, mask")
    out = dd.remove_duplicates(packets, digest) if dedup else packets
    if "layers" not in out.columns:
        out = dissect(out)
    image = (lambda ip: A.anonymise(ip, key, rotate_host)) if anonymise else (lambda ip: ip)
    out = out.withColumn("new_ips", F.transform("ip_layers", lambda i: F.struct(image(i["src"]).alias("src"), image(i["dst"]).alias("dst"))))
    changed = F.exists(F.zip_with("ip_layers", "new_ips", lambda i, n: (i["src"] != n["src"]) | (i["dst"] != n["dst"])), lambda x: x)
    out = out.withColumn("ip_modified", F.coalesce(changed, F.lit(False)))
    if anonymise:
        own = F.when(F.col("ip_index") > 0, F.get("new_ips", F.col("ip_index") - 1))
        out = out.withColumns({"src_ip": own["src"], "dst_ip": own["dst"]})
    out = fl.with_flow_keys(out)
    if not mask:
        return out.withColumns({"payload_modified": F.lit(False), "kept_bytes": F.col("len"), "masked_bytes": F.lit(0).cast("bigint")})
    # what could not be decoded might be anything: blank it from where reading stopped
    tail = filler(F.length("raw") - F.col("parsed_until"), mask_byte)
    out = out.withColumn("raw", F.when(F.col("parse_ok"), F.col("raw")).otherwise(F.concat(F.substring("raw", F.lit(1), F.col("parsed_until")), tail)))
    if protocol == "none":
        return mk.mask_all(out, mask_byte, mask_udp)
    # Rule finding reads the packets many times: write the cleaned packets once, then every branch only reads the columns it needs.
    out = materialise(out)
    out, segments = _placed(out)
    rules = keep_rules(segments, protocol, preserve, http_ports)
    return mk.mask_payloads(out, rules, mask_byte, mask_udp).withColumn("seq", F.col("__raw_seq")).drop("__raw_seq")


def _placed(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets with unwrapped ``seq`` (the original in ``__raw_seq``) and their TCP segments; a join happens only if a stream wrapped."""
    out = packets.withColumn("__raw_seq", F.col("seq"))
    tcp = F.expr("proto = 'tcp' AND len > 0 AND tuple_key IS NOT NULL AND seq IS NOT NULL")
    slim = packets.where(tcp).select(*ra.KEY, "frame_no", "seq", F.col("seq").alias("__raw"))
    moved = materialise(ra.unwrap_sequence(slim).where("seq <> __raw").select("capture_id", "frame_no", F.col("seq").alias("__seq")))
    if not moved.isEmpty():
        out = out.join(moved, ["capture_id", "frame_no"], "left").withColumn("seq", F.coalesce("__seq", "seq")).drop("__seq")
    return out, out.where(tcp).select(*SEGMENT)


def stage_results(sanitised: DataFrame, original: DataFrame) -> DataFrame:
    """Per capture and step: packets seen and changed."""
    before = original.groupBy("capture_id").agg(F.count("*").alias("n_in"))
    after = sanitised.groupBy("capture_id").agg(
        F.count("*").alias("n_out"), F.count_if("ip_modified").alias("ips"), F.count_if("payload_modified").alias("masked"))
    j = before.join(after, "capture_id", "left").fillna(0)
    row = lambda step, processed, modified: F.struct(F.lit(step).alias("step"), processed.alias("processed"), modified.alias("modified"))
    steps = F.array(
        row("remove_dupes", F.col("n_in"), F.col("n_in") - F.col("n_out")), row("anonymize_ips", F.col("n_out"), F.col("ips")), row("mask_payloads", F.col("n_out"), F.col("masked")))
    return j.select("capture_id", F.explode(steps).alias("s")).select("capture_id", "s.*")
