"""TLS labels, frame predicates and plausibility tests as column expressions.

Frame tables carry ``content_types``, ``opaque_types``, ``lengths``, ``versions``, ``segment_data`` and ``app_data`` as ARRAY<STRING>
and ``protocols`` as text, the way dissectors export them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions.octets import be_int, clean_hex, zero_bytes

# TLS content types and their names.
TYPE_NAMES = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData", 24: "Heartbeat"}
APP_DATA = 23
HEADER = 5
MAX_RECORD = 16384
MAX_WIRE = MAX_RECORD + 2048  # the protocol's largest encrypted record
# Version labels by minor number of (3, n).
VERSION_NAMES = {0: "SSL 3.0", 1: "TLS 1.0", 2: "TLS 1.1", 3: "TLS 1.2", 4: "TLS 1.3"}
# Certificate protocols of which only the first occurrence in a path counts, and the layers that always stay.
CERTIFICATE_LAYERS = ("x509sat", "x509af", "x509ce", "x509if", "pkcs1", "pkix1explicit", "pkix1implicit", "cms", "pkcs7")
CORE_LAYERS = ("eth", "ethertype", "ip", "ipv6", "tcp", "udp", "tls", "ssl", "http", "http2")


def _choose(value: Column, table: dict, other: Column | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out if other is None else out.otherwise(other)


def type_name(content_type: Column) -> Column:
    return _choose(content_type, TYPE_NAMES)


def strategy(content_type: Column) -> Column:
    return F.when(content_type == APP_DATA, F.lit("mask_payload")).when(content_type.between(20, 24), F.lit("keep_all"))


def version_name(major: Column, minor: Column) -> Column:
    known = _choose(minor, VERSION_NAMES)
    return F.coalesce(F.when(major == 3, known), F.concat(F.lit("TLS "), major, F.lit("."), minor))


def to_int(text: Column) -> Column:
    """``"23"`` or ``"0x17"`` to INT; NULL otherwise."""
    text = F.trim(text)
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,7}$"), F.conv(F.substring(text, 3, 7), 16, 10).cast("int")).when(
        text.rlike(r"^\d{1,9}$"), text.cast("int")
    )


def all_types(decimal_only: bool = False) -> Column:
    """Content and opaque types of a frame, as integers in field order; unparsable or unknown ones become NULL in place."""
    both = F.concat(F.col("content_types"), F.col("opaque_types"))

    def known(t: Column) -> Column:
        n = F.when(t.rlike(r"^\d{1,9}$"), t.cast("int")) if decimal_only else to_int(t)
        return F.when(n.between(20, 24), n)

    return F.transform(both, known)


def frame_types() -> Column:
    return F.filter(all_types(), lambda t: t.isNotNull())


def has_tls_record(decimal_only: bool = False) -> Column:
    return F.exists(all_types(decimal_only), lambda t: t.isNotNull())


def has_segment() -> Column:
    return F.exists("segment_data", lambda s: s != "")


def has_tls_content() -> Column:
    return has_tls_record() | has_segment() | F.contains(F.lower("protocols"), F.lit("tls"))


def decode_as(ports) -> Column:
    """Treat the listed ports as TLS whatever the payload looks like."""
    return F.col("sport").isin(*ports) | F.col("dport").isin(*ports)


def is_record_start(payload: Column) -> Column:
    kind, major, minor, length = be_int(payload, 0, 1), be_int(payload, 1, 1), be_int(payload, 2, 1), be_int(payload, 3, 2)
    ok = kind.between(20, 24) & (major == 3) & minor.between(0, 3) & length.between(1, MAX_RECORD)
    return F.coalesce(ok, F.lit(False))


def is_fragment() -> Column:
    return has_segment()


def is_app_data_fragment() -> Column:
    """Type 23 when types are known, otherwise any untyped fragment."""
    return F.when(F.size("content_types") > 0, F.exists("content_types", lambda t: t == "23")).otherwise(is_fragment())


def type_matches_payload(payload: Column, content_type: Column) -> Column:
    return F.coalesce(be_int(payload, 0, 1) == content_type, F.lit(False))


def segment_type(segment_hex: Column) -> Column:
    """Content type guessed from the first byte of a segment; NULL when it is none of the known ones."""
    first = be_int(clean_hex(segment_hex), 0, 1).cast("int")
    return F.when(first.between(20, 24), first)


def clean_path(protocols: Column, limit: int | None = None) -> Column:
    """Protocol path without repeated certificate layers. With a ``limit``, longer paths keep core layers and the first three others."""
    parts = F.split(protocols, ":")
    firsts = F.filter(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: ~F.lower(x["p"]).isin(*CERTIFICATE_LAYERS)
        | (F.array_position(F.transform(parts, lambda q: F.lower(q)), F.lower(x["p"])) == x["i"] + 1),
    )
    names = F.transform(firsts, lambda x: x["p"])
    if limit is None:
        return names
    core = F.filter(names, lambda p: F.lower(p).isin(*CORE_LAYERS))
    others = F.filter(names, lambda p: ~F.lower(p).isin(*CORE_LAYERS))
    return F.when(F.size(names) > limit, F.concat(core, F.slice(others, 1, 3))).otherwise(names)


def app_data_zero_bytes(count: Column) -> Column:
    """0x00 bytes in the first ``count`` application-data fields (they are listed in the order of the type-23 records)."""
    used = F.slice(F.col("app_data"), F.lit(1), F.greatest(count, F.lit(0)))
    return F.aggregate(used, F.lit(0).cast("bigint"), lambda acc, h: acc + F.coalesce(zero_bytes(clean_hex(h)), F.lit(0)))


def plausible_partial_record(content_type: Column, declared: Column, actual: Column) -> Column:
    small = ~content_type.isin(20, 21) | (declared <= 10)
    return (declared <= MAX_RECORD) & small & (actual <= declared) & (actual * 10 >= declared)


def plausible_rule(strategy_col: Column, content_type: Column, rule_len: Column, tcp_len: Column, first_byte: Column, ccs_limit: int | None = None) -> Column:
    """Single-packet rules: header rules are five bytes, full rules fit the segment, CCS rules start with their type (and are short, with a limit)."""
    shape = F.when(strategy_col == "header_only", rule_len == HEADER).when(strategy_col == "full_message", rule_len <= tcp_len).otherwise(True)
    kind = (
        F.when((content_type == APP_DATA) & (strategy_col == "header_only"), first_byte == APP_DATA)
        .when(content_type == 20, (first_byte == 20) & (F.lit(True) if ccs_limit is None else rule_len <= ccs_limit))
        .otherwise(True)
    )
    return shape & kind


def plausible_partial_rule(is_cross: Column, content_type: Column, strategy_col: Column, rule_len: Column, actual: Column) -> Column:
    """Size limits for rules of records that were cut off (an option: they also drop long handshakes)."""
    limit = F.when(content_type == 20, 100).when(content_type == 21, 50).otherwise(2048)
    size_ok = ~is_cross | (rule_len <= F.least(limit, F.lit(2048)))
    full_ok = (strategy_col != "full_message") | (F.abs(rule_len - (HEADER + actual)) <= 10)
    return size_ok & full_ok


def zeroed(lengths: Column, zero_count: Column) -> Column:
    """Is the app data of a hit fully zeroed: against its lengths when known, else any zero byte."""
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.size(lengths) > 0, zero_count >= total).otherwise(zero_count > 0)
