"""IP anonymisation over packet tables and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions import addresses as A
from wireloom.functions.ratios import percent
from wireloom.operators.skew import lookup


def address_occurrences(packets: DataFrame) -> DataFrame:
    """One row per address occurrence (source and destination)."""
    return packets.select("capture_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip IS NOT NULL")


def tunnel_occurrences(packets: DataFrame) -> DataFrame:
    """As above for every IP layer of dissected packets (``ip_layers`` array), so addresses inside tunnels count too."""
    layer = packets.select("capture_id", F.explode("ip_layers").alias("l"))
    return layer.select("capture_id", F.explode(F.array("l.src", "l.dst")).alias("ip")).where("ip IS NOT NULL")


def _address_counts(packets: DataFrame) -> DataFrame:
    """Occurrences per address. Everything below starts from this map-side-combined table, so a hot address is a single row."""
    return address_occurrences(packets).groupBy("ip").agg(F.count("*").alias("n"))


def prefix_frequencies(packets: DataFrame) -> DataFrame:
    """Occurrences per prefix: /8, /16, /24 for IPv4 and seven 16-bit levels for IPv6."""
    counts = _address_counts(packets).withColumn("version", A.ip_version("ip")).where("version IS NOT NULL")
    parts = F.when(F.col("version") == 4, F.split("ip", r"\.")).otherwise(
        F.transform(A.v6_groups("ip"), lambda g: F.lower(F.hex(g.cast("bigint"))))
    )
    sep = F.when(F.col("version") == 4, F.lit(".")).otherwise(F.lit(":"))
    levels = F.sequence(F.lit(1), F.when(F.col("version") == 4, F.lit(3)).otherwise(F.lit(7)))
    rows = counts.select("version", "n", parts.alias("parts"), sep.alias("sep"), F.explode(levels).alias("level"))
    prefix = F.when(F.col("version") == 4, F.array_join(F.slice("parts", 1, F.col("level")), ".")).otherwise(
        F.array_join(F.slice("parts", 1, F.col("level")), ":")
    )
    return rows.select("version", "level", prefix.alias("prefix"), "n").groupBy("version", "level", "prefix").agg(F.sum("n").alias("n"))


def unique_addresses(packets: DataFrame) -> DataFrame:
    """Distinct addresses in numeric order, IPv4 before IPv6, unparsable text last."""
    return _address_counts(packets).select("ip", A.ip_version("ip").alias("version"), A.sort_key("ip").alias("sort_key")).orderBy("sort_key")


def ip_map(packets: DataFrame, key: str, rotate_host: bool = False) -> DataFrame:
    counts = _address_counts(packets).withColumn("version", A.ip_version("ip")).where("version IS NOT NULL")
    return counts.select(F.col("ip").alias("orig"), A.anonymise("ip", key, rotate_host).alias("anon"), "version")


def anonymise_packets(packets: DataFrame, key: str, rotate_host: bool = False) -> DataFrame:
    """Rewrite both addresses in place: a projection, no map, no join, no shuffle."""
    src, dst = A.anonymise("src_ip", key, rotate_host), A.anonymise("dst_ip", key, rotate_host)
    return (
        packets.withColumns({"__src": src, "__dst": dst})
        .withColumn(
            "ip_modified",
            F.coalesce(F.col("__src") != F.col("src_ip"), F.lit(False)) | F.coalesce(F.col("__dst") != F.col("dst_ip"), F.lit(False)),
        )
        .withColumns({"src_ip": F.col("__src"), "dst_ip": F.col("__dst")})
        .drop("__src", "__dst")
    )


def apply_ip_map(packets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite addresses from a user-supplied map ``(orig, anon)``; unmapped addresses stay.

    A hot address is spread over blocks of frames instead of forming one join group.
    """
    one = mapping.groupBy("orig").agg(F.max("anon").alias("anon"))
    out = packets
    for side in ("src_ip", "dst_ip"):
        out = lookup(out, one.withColumnRenamed("orig", side).withColumnRenamed("anon", f"__{side}"), [side])
    hit = F.col("__src_ip").isNotNull() | F.col("__dst_ip").isNotNull()
    return (
        out.withColumn("ip_modified", hit)
        .withColumns({"src_ip": F.coalesce("__src_ip", "src_ip"), "dst_ip": F.coalesce("__dst_ip", "dst_ip")})
        .drop("__src_ip", "__dst_ip")
    )


def inconsistent_prefixes(mapping: DataFrame) -> DataFrame:
    """IPv4 prefixes (two and three octets) whose addresses map to more than one target prefix; empty when consistent."""
    v4 = mapping.where("version = 4")
    rows = v4.select(F.explode(F.array(F.lit(2), F.lit(3))).alias("level"), "orig", "anon").select(
        "level",
        F.array_join(F.slice(F.split("orig", r"\."), 1, F.col("level")), ".").alias("prefix"),
        F.array_join(F.slice(F.split("anon", r"\."), 1, F.col("level")), ".").alias("target"),
    )
    return rows.groupBy("level", "prefix").agg(F.count_distinct("target").alias("targets"), F.count("*").alias("addresses"))


def consistency_check(mapping: DataFrame) -> DataFrame:
    rows = inconsistent_prefixes(mapping)
    return rows.groupBy("level").agg(
        F.count("*").alias("prefixes"), F.sum(F.when(F.col("targets") > 1, 1).otherwise(0)).alias("conflicts")
    )


def injectivity_check(mapping: DataFrame) -> DataFrame:
    per_target = mapping.groupBy("anon").agg(F.count("*").alias("n"))
    return per_target.agg(
        F.sum("n").alias("originals"), F.count("*").alias("targets"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("collisions")
    )


def version_distribution(packets: DataFrame) -> DataFrame:
    v4 = (A.ip_version("src_ip") == 4) | (A.ip_version("dst_ip") == 4)
    v6 = (A.ip_version("src_ip") == 6) | (A.ip_version("dst_ip") == 6)
    flags = packets.select("capture_id", F.coalesce(v4, F.lit(False)).alias("v4"), F.coalesce(v6, F.lit(False)).alias("v6"))
    out = flags.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.count_if("v4").alias("v4_packets"), F.count_if("v6").alias("v6_packets"),
        F.count_if(F.col("v4") & F.col("v6")).alias("both_packets"),
    )
    return out.withColumns({
        "v4_ratio": F.col("v4_packets") / F.col("packets"),
        "v6_ratio": F.col("v6_packets") / F.col("packets"),
        "both_ratio": F.col("both_packets") / F.col("packets"),
    })


def top_prefixes(packets: DataFrame, level: int, k: int = 5) -> DataFrame:
    freq = prefix_frequencies(packets).where((F.col("version") == 4) & (F.col("level") == level))
    return freq.orderBy(F.desc("n"), "prefix").limit(k)


def global_map(mapping_rows: DataFrame) -> DataFrame:
    """Accumulate per-capture maps ``(orig, anon, load_order)``: the latest load wins."""
    return mapping_rows.groupBy("orig").agg(F.max_by("anon", "load_order").alias("anon"))


def anonymise_stats(packets: DataFrame, key: str, rotate_host: bool = False) -> DataFrame:
    """Address counts come from distinct (capture, address) rows, packet counts from a plain aggregation; joined per capture."""
    addresses = address_occurrences(packets).distinct()
    changed = A.anonymise("ip", key, rotate_host) != F.col("ip")
    ips = addresses.groupBy("capture_id").agg(F.count("*").alias("original_ips"), F.count_if(changed).alias("anonymised_ips"))
    modified = anonymise_packets(packets.select("capture_id", "src_ip", "dst_ip"), key, rotate_host)
    counts = modified.groupBy("capture_id").agg(F.count("*").alias("packets"), F.count_if("ip_modified").alias("modified_packets"))
    return counts.join(ips, "capture_id", "left").withColumn(
        "anonymised_rate", percent(F.col("anonymised_ips"), F.col("original_ips"))
    )


def mapping_listing(mapping: DataFrame) -> DataFrame:
    """The whole map, sorted by original address text."""
    return mapping.select("orig", "anon").distinct().orderBy("orig")


def first_mappings(packets: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The first ``k`` mappings of each capture; the rank limit applies before the shuffle, so a task sends at most k rows a capture."""
    per_capture = address_occurrences(packets).groupBy("capture_id", F.col("ip").alias("orig")).agg(F.count("*").alias("packets"))
    ranked = per_capture.withColumn("n", F.row_number().over(Window.partitionBy("capture_id").orderBy("orig"))).where(F.col("n") <= k)
    return ranked.select("capture_id", "n", "orig", A.anonymise("orig", key).alias("anon"))
