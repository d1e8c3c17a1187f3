"""Protocol layers of a raw frame as column expressions.

``layer_walk`` reads the nesting, batch by batch. Field values are projected afterwards from the recorded offsets, and only if used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions.addresses import v4_from_binary, v6_from_binary
from wireloom.functions.octets import be_int

TUNNELS = ("Dot1Q", "Dot1AD", "MPLS", "GRE", "VXLAN")
ADDRESSED = ("IP", "IPv6")
TRANSPORTS = ("TCP", "UDP")


def first_layer(raw: Column, linktype: Column) -> Column:
    """Outermost header by capture link type; a type that is not known is named so, and its frames fail to parse."""
    nibble = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    by_version = F.when(nibble.between(64, 79), "IP").when(nibble.between(96, 111), "IPv6").otherwise("unknown IP version")
    return (
        F.when(linktype.isNull() | (linktype == 1), "Ethernet").when(linktype.isin(0, 108), "Loopback").when(linktype.isin(12, 14, 101), by_version)
        .when(linktype == 113, "Cooked").when(linktype == 276, "Cooked2").when(linktype == 228, "IP").when(linktype == 229, "IPv6").otherwise("unknown link type")
    )


def named(layers: Column, *names: str) -> Column:
    return F.filter(layers, lambda l: l["name"].isin(*names))


def encapsulation(layers: Column) -> Column:
    """Class of a frame by priority: double VLAN, VLAN, VXLAN, GRE, MPLS, plain; unknown without any of these."""
    has = lambda n: F.exists(layers, lambda l: l["name"] == n)
    return (
        F.when(has("Dot1AD") | (F.size(named(layers, "Dot1Q")) > 1), "double_vlan").when(has("Dot1Q"), "vlan").when(has("VXLAN"), "vxlan")
        .when(has("GRE"), "gre").when(has("MPLS"), "mpls").when(has("IP") | has("IPv6"), "plain").otherwise("unknown")
    )


def tunnel_depth(layers: Column, size: Column) -> Column:
    """Encapsulation layers that carry something."""
    return F.size(F.filter(named(layers, *TUNNELS), lambda l: l["off"] + l["len"] < size))


def _bin(raw: Column, off: Column, n: int) -> Column:
    return F.substring(raw, off + 1, F.lit(n))


def mac(raw: Column, off: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(_bin(raw, off, 6))), "(..)", "$1:"), F.lit(":"))


def _hex16(v: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(v), 4, "0")))


def ethernet_fields(raw: Column, o: Column) -> Column:
    return F.struct(mac(raw, o).alias("dst"), mac(raw, o + 6).alias("src"), _hex16(be_int(raw, o + 12, 2)).alias("type"))


def vlan_fields(raw: Column, layer: Column) -> Column:
    tci = be_int(raw, layer["off"], 2)
    outer = layer["name"] == "Dot1AD"
    return F.struct(
        (tci % 4096).alias("id"), F.floor(tci / 8192).alias("priority"), (F.floor(tci / 4096) % 2 == 1).alias("dei"),
        F.when(outer, 0x88A8).otherwise(0x8100).alias("tpid"), outer.alias("is_outer"))


def mpls_fields(raw: Column, o: Column) -> Column:
    v = be_int(raw, o, 4)
    return F.struct(F.floor(v / 4096).alias("label"), (F.floor(v / 512) % 8).alias("cos"), (F.floor(v / 256) % 2 == 1).alias("bottom"), (v % 256).alias("ttl"))


def vxlan_fields(raw: Column, o: Column) -> Column:
    return F.struct(be_int(raw, o + 4, 3).alias("vni"), be_int(raw, o, 1).alias("flags"), be_int(raw, o + 7, 1).alias("reserved"))


def gre_fields(raw: Column, o: Column) -> Column:
    f = be_int(raw, o, 1)
    bit = lambda n: F.floor(f / n) % 2 == 1
    key_at = o + 4 + F.when(bit(128), 4).otherwise(0)
    return F.struct(
        _hex16(be_int(raw, o + 2, 2)).alias("proto"), bit(128).alias("checksum"), bit(32).alias("has_key"), bit(16).alias("has_seq"),
        F.when(bit(32), be_int(raw, key_at, 4)).alias("key"))


def ipv4_fields(raw: Column, o: Column) -> Column:
    b = lambda i, n=1: be_int(raw, o + i, n)
    return F.struct(
        v4_from_binary(_bin(raw, o + 12, 4)).alias("src"), v4_from_binary(_bin(raw, o + 16, 4)).alias("dst"), F.floor(b(0) / 16).alias("version"),
        (b(0) % 16).alias("ihl"), b(1).alias("tos"), b(2, 2).alias("len"), b(4, 2).alias("id"), F.floor(b(6, 2) / 8192).alias("flags"),
        (b(6, 2) % 8192).alias("frag"), b(8).alias("ttl"), b(9).alias("proto"))


def ipv6_fields(raw: Column, o: Column) -> Column:
    head = be_int(raw, o, 4)
    return F.struct(
        v6_from_binary(_bin(raw, o + 8, 16)).alias("src"), v6_from_binary(_bin(raw, o + 24, 16)).alias("dst"), F.floor(head / 268435456).alias("version"),
        (F.floor(head / 1048576) % 256).alias("tc"), (head % 1048576).alias("fl"), be_int(raw, o + 4, 2).alias("plen"), be_int(raw, o + 6, 1).alias("nh"), be_int(raw, o + 7, 1).alias("hlim"))


def tcp_fields(raw: Column, o: Column) -> Column:
    b = lambda i, n: be_int(raw, o + i, n)
    return F.struct(
        b(0, 2).alias("sport"), b(2, 2).alias("dport"), b(4, 4).alias("seq"), b(8, 4).alias("ack"), F.floor(b(12, 1) / 16).alias("dataofs"),
        (b(12, 2) % 512).alias("flags"), b(14, 2).alias("window"), b(16, 2).alias("chksum"), b(18, 2).alias("urgptr"))


def udp_fields(raw: Column, o: Column) -> Column:
    b = lambda i: be_int(raw, o + i, 2)
    return F.struct(b(0).alias("sport"), b(2).alias("dport"), b(4).alias("len"), b(6).alias("chksum"))


def ip_layers(raw: Column, layers: Column, encap: Column) -> Column:
    found = named(layers, *ADDRESSED)

    def one(l: Column, i: Column) -> Column:
        v4 = l["name"] == "IP"
        o = l["off"]
        src = F.when(v4, v4_from_binary(_bin(raw, o + 12, 4))).otherwise(v6_from_binary(_bin(raw, o + 8, 16)))
        dst = F.when(v4, v4_from_binary(_bin(raw, o + 16, 4))).otherwise(v6_from_binary(_bin(raw, o + 24, 16)))
        return F.struct(
            src.alias("src"), dst.alias("dst"), l["depth"].alias("depth"), F.when(v4, 4).otherwise(6).alias("version"), encap.alias("encap"),
            (i == F.size(found) - 1).alias("is_innermost"), o.alias("off"))

    return F.transform(found, one)


def looks_encrypted(payload: Column) -> Column:
    ok = be_int(payload, 0, 1).between(20, 23) & be_int(payload, 1, 2).between(0x0301, 0x0304) & (F.length(payload) >= 5)
    return F.coalesce(ok, F.lit(False))
