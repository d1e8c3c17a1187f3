"""Raw frames to packet columns, and edited packet columns back to raw frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.functions import layers as L
from wireloom.functions.addresses import to_binary
from wireloom.functions.layer_walk import walk_layers
from wireloom.functions.octets import be_int


def with_layers(packets: DataFrame) -> DataFrame:
    """Adds ``layers`` (name, depth, offset, header length), ``stop`` (end of the innermost datagram), ``parse_ok``, ``parse_error``, ``parsed_until``."""
    first = L.first_layer(F.col("raw"), F.col("linktype").cast("int")) if "linktype" in packets.columns else F.lit("Ethernet")
    w = packets.withColumn("__w", walk_layers(F.col("raw"), first))
    return w.withColumns({
        "layers": F.col("__w.layers"), "stop": F.col("__w.stop"), "parse_ok": F.col("__w.error") == "", "parse_error": F.nullif(F.col("__w.error"), F.lit("")),
        "parsed_until": F.col("__w.at")}).drop("__w")


def dissect(packets: DataFrame) -> DataFrame:
    """Packet table from ``raw``: encapsulation, IP layers, VLANs, the deepest TCP/UDP layer with its enclosing addresses and payload.

    ``ip_index`` is the 1-based position of the enclosing layer in ``ip_layers`` (0 without one).

    A frame that cannot be read keeps its row with ``parse_ok`` false.
    """
    d = with_layers(packets)
    raw, layers = F.col("raw"), F.col("layers")
    d = d.withColumns({"encap": L.encapsulation(layers), "depth": L.tunnel_depth(layers, F.length(raw)), "caplen": F.length(raw)})
    d = d.withColumns({
        "ip_layers": L.ip_layers(raw, layers, F.col("encap")), "vlans": F.transform(L.named(layers, "Dot1Q", "Dot1AD"), lambda l: L.vlan_fields(raw, l)),
        "__t": F.try_element_at(L.named(layers, *L.TRANSPORTS), F.lit(-1))})
    o = F.col("__t.off")
    tcp = F.col("__t.name") == "TCP"
    body_at = o + F.col("__t.len")
    enclosing = F.size(F.filter("ip_layers", lambda i: F.col("__t").isNull() | (i["depth"] < F.col("__t.depth"))))
    d = d.withColumns({
        "l4": F.col("__t.name"), "proto": F.lower("__t.name"), "sport": be_int(raw, o, 2), "dport": be_int(raw, o + 2, 2), "seq": F.when(tcp, be_int(raw, o + 4, 4)),
        "ip_index": enclosing, "payload_off": body_at,
        "payload": F.when(F.col("__t").isNotNull(), F.substring(raw, body_at + 1, F.greatest(F.col("stop") - body_at, F.lit(0))))})
    d = d.withColumn("__ip", F.when(F.col("ip_index") > 0, F.get("ip_layers", F.col("ip_index") - 1)))
    return d.withColumns({
        "src_ip": F.col("__ip.src"), "dst_ip": F.col("__ip.dst"), "ip_version": F.col("__ip.version"), "len": F.coalesce(F.length("payload"), F.lit(0)).cast("bigint"),
        "is_encrypted": L.looks_encrypted(F.col("payload"))}).drop("__t", "__ip")


def innermost_ip() -> Column:
    return F.try_element_at("ip_layers", F.lit(-1))


def outermost_ip() -> Column:
    return F.try_element_at("ip_layers", F.lit(1))


def is_encapsulated() -> Column:
    return F.col("encap") != "plain"


def has_vlan() -> Column:
    return F.col("encap").isin("vlan", "double_vlan")


def has_multiple_ips() -> Column:
    return F.size("ip_layers") > 1


def is_complex() -> Column:
    return (F.col("encap") == "composite") | (F.size("layers") > 3) | has_multiple_ips()


def overlay(raw: Column, patches: Column) -> Column:
    """Replace byte ranges: ``patches`` is ARRAY<STRUCT<off INT, bytes BINARY>> with disjoint ranges."""
    def step(acc: Column, p: Column) -> Column:
        tail = p["off"] + F.length(p["bytes"])
        return F.concat(F.substring(acc, F.lit(1), p["off"]), p["bytes"], F.substring(acc, tail + 1, F.length(acc)))

    return F.aggregate(patches, raw, step)


def _sum16(data: bytes) -> int:
    if len(data) % 2:
        data += b"\0"
    return int(np.frombuffer(data, dtype=">u2").sum(dtype=np.uint64))


def _fold(total: int) -> int:
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


@F.pandas_udf(T.BinaryType())
def fix_checksums(raw: pd.Series, names: pd.Series, offs: pd.Series, lens: pd.Series) -> pd.Series:
    """Internet checksums of every IPv4 header and of TCP/UDP layers whose datagram is whole, innermost first."""
    out = []
    for frame, names_, offs_, lens_ in zip(raw, names, offs, lens):
        b = bytearray(frame)
        for i in range(len(names_) - 1, -1, -1):
            kind, o, n = names_[i], int(offs_[i]), int(lens_[i])
            if kind in ("TCP", "UDP"):
                ip = next((j for j in range(i - 1, -1, -1) if names_[j] in ("IP", "IPv6")), None)
                if ip is None:
                    continue
                a = int(offs_[ip])
                if names_[ip] == "IP":
                    total = int.from_bytes(b[a + 2 : a + 4], "big")
                    end, ends, proto = a + total, bytes(b[a + 12 : a + 20]), b[a + 9]
                else:
                    end, ends, proto = a + 40 + int.from_bytes(b[a + 4 : a + 6], "big"), bytes(b[a + 8 : a + 40]), 6 if kind == "TCP" else 17
                at = o + (16 if kind == "TCP" else 6)
                if end > len(b) or end < o + n or (kind == "UDP" and b[at : at + 2] == b"\0\0"):
                    continue  # cut off by the snap length, or UDP without checksum
                b[at : at + 2] = b"\0\0"
                value = _fold(_sum16(ends) + proto + (end - o) + _sum16(bytes(b[o:end])))
                b[at : at + 2] = (value or (0xFFFF if kind == "UDP" else 0)).to_bytes(2, "big")
            elif kind == "IP":
                b[o + 10 : o + 12] = b"\0\0"
                b[o + 10 : o + 12] = _fold(_sum16(bytes(b[o : o + n]))).to_bytes(2, "big")
        out.append(bytes(b))
    return pd.Series(out)


def rebuild(packets: DataFrame, checksums: bool = True) -> DataFrame:
    """Write ``payload`` and the addresses in ``new_ips`` (one STRUCT<src, dst> per IP layer) back into ``raw``.

    Layers are taken from the dissected columns; only frames that were changed are touched.
    """
    size = lambda v: F.when(v == 4, 4).otherwise(16)
    addresses = F.flatten(F.zip_with("ip_layers", "new_ips", lambda i, n: F.array(
        F.struct((i["off"] + F.when(i["version"] == 4, 12).otherwise(8)).cast("int").alias("off"), to_binary(n["src"]).alias("bytes")),
        F.struct((i["off"] + F.when(i["version"] == 4, 12).otherwise(8) + size(i["version"])).cast("int").alias("off"), to_binary(n["dst"]).alias("bytes")))))
    body = F.when(F.col("payload").isNotNull() & (F.length("payload") > 0), F.array(F.struct(F.col("payload_off").cast("int").alias("off"), F.col("payload").alias("bytes")))).otherwise(
        F.array().cast("array<struct<off:int,bytes:binary>>"))
    out = packets.withColumn("__new", overlay(F.col("raw"), F.concat(addresses, body)))
    if checksums:
        fixed = fix_checksums("__new", F.col("layers.name"), F.col("layers.off"), F.col("layers.len"))
        out = out.withColumn("__new", F.when(F.col("__new") != F.col("raw"), fixed).otherwise(F.col("raw")))
    return out.withColumn("raw", F.col("__new")).drop("__new")
