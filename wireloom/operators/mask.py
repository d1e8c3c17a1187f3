"""Payload masking: everything is zeroed unless a keep rule covers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.octets import filler
from wireloom.functions.ratios import safe_divide
from wireloom.operators.reassembly import KEY
from wireloom.operators.rules import both_directions, valid
from wireloom.operators.scan import covering_end, disjoint, merged_blocks
from wireloom.operators.skew import FRAME_BLOCK, lookup
from wireloom.operators.stage import materialise

SEGMENT = [*KEY, "seq", "len"]
#: Positions of a direction that have one list of kept ranges; a segment looks through the list of the bucket it begins in, so a bucket is small.
BUCKET = 2048
#: Where packets and lists meet. What differs most comes first, as rows are sorted by it.
PLACE = ["__bucket", "__frames", *KEY]


def kept_ranges(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, seq, len, ranges, has_rules)`` for each distinct segment: byte offsets that stay, sorted and disjoint; NULL without any."""
    distinct = segments.where("len > 0").select(*SEGMENT).distinct().withColumns({"__bucket": F.floor(F.col("seq") / BUCKET), "__frames": F.lit(0)})
    out = distinct.join(_lists(distinct, rules), PLACE, "left").withColumn("ranges", _own_ranges())
    return out.select(*SEGMENT, F.when(F.size("ranges") > 0, F.col("ranges")).alias("ranges"), "has_rules")


def _lists(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(place, kept, has_rules)`` for each place (bucket, block of frames and direction) of packets whose direction has rules.

    ``kept`` has the positions that stay, sorted and disjoint, from the bucket's start to the end of its segments. Rows are buckets with
    arrays, not segments and rules, so what is moved besides the packets is small. A rule stands in the bucket it begins in and, as what a
    sweep finds open there, at the start of buckets that hold segments; it is not spread over the buckets it spans.
    """
    places = packets.groupBy(*PLACE).agg(F.max(F.col("seq") + F.col("len")).alias("__end"))
    # several branches read them, and each comes out of a long plan: written once
    places = materialise(places.withColumn("__at", F.col("__bucket") * BUCKET))
    own = materialise(merged_blocks(valid(rules), KEY, "seq_start", "seq_end", "__bucket", BUCKET, "kept"))
    # a direction that borrows rules is told whose, instead of copying them
    served = both_directions(own.select(*KEY).distinct().withColumns({"__from": F.col("direction"), "seq_start": F.lit(0)})).drop("seq_start")
    places = lookup(places, served, KEY, by="__at", how="inner")
    touched = places.withColumn("__touched", F.explode(F.sequence("__bucket", F.floor((F.col("__end") - 1) / BUCKET))))
    lender = [*KEY[:2], F.col("__from").alias("direction")]
    heads = own.select(*KEY, *[F.element_at("kept", -1)[x].alias(f"__{x}") for x in "ab"])
    still = covering_end(places.select(*lender, "__at").distinct(), KEY, "__at", heads, "__a", "__b", "__open").where("__open > __at")
    still = still.select(*KEY, F.floor(F.col("__at") / BUCKET).alias("__bucket"), F.array(F.struct(F.col("__at").alias("a"), F.col("__open").alias("b"))).alias("kept"))
    lent = own.unionByName(still).select(F.col("__bucket").alias("__touched"), *KEY[:2], F.col("direction").alias("__from"), "kept")
    near = touched.join(lent, ["__touched", *KEY[:2], "__from"], "left")
    near = near.withColumn("kept", F.filter("kept", lambda r: (r["a"] < F.col("__end")) & (r["b"] > F.col("__at"))))
    lists = near.groupBy(*PLACE).agg(F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"))
    return lists.select(*PLACE, disjoint(F.col("kept")).alias("kept"), F.lit(True).alias("has_rules"))


def _own_ranges() -> Column:
    """What of the list ``kept`` lies in the segment, as offsets."""
    end = F.col("seq") + F.col("len")
    near = F.filter("kept", lambda r: (r["a"] < end) & (r["b"] > F.col("seq")))
    return F.transform(near, lambda r: F.struct((F.greatest(r["a"], F.col("seq")) - F.col("seq")).cast("int").alias("a"), (F.least(r["b"], end) - F.col("seq")).cast("int").alias("b")))


def apply_ranges(payload: Column, ranges: Column, mask_byte: int = 0) -> Column:
    """Payload of the same length with only ``ranges`` kept."""
    start = F.struct(F.unhex(F.lit("")).alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, r: Column) -> Column:
        gap = filler(r["a"] - acc["at"], mask_byte)
        return F.struct(F.concat(acc["out"], gap, F.substring(payload, r["a"] + 1, r["b"] - r["a"])).alias("out"), r["b"].alias("at"))

    return F.aggregate(ranges, start, step, lambda s: F.concat(s["out"], filler(F.length(payload) - s["at"], mask_byte)))


def mask_payloads(packets: DataFrame, rules: DataFrame, mask_byte: int = 0, mask_udp: bool = False) -> DataFrame:
    """Masked packets with ``kept_bytes``, ``masked_bytes`` and ``payload_modified``; payload length never changes.

    Expects flow keys, ``proto``, ``seq``, ``len`` and ``payload``.  Any TCP payload without a rule is fully masked; UDP payloads are
    only touched on request.  A packet is moved once, with its neighbours, to the list of its bucket.
    """
    packets = packets.withColumns({"__tcp": F.expr("proto = 'tcp' AND len > 0"), "__ruled": F.expr("proto = 'tcp' AND len > 0")})
    if mask_udp:  # one that is equal to a TCP segment keeps what that one keeps
        of = lambda kind: packets.where(kind).select(*SEGMENT).distinct()
        twins = materialise(of("proto = 'udp' AND len > 0").join(of("__tcp"), SEGMENT, "left_semi"))
        if not twins.isEmpty():
            packets = packets.join(twins.withColumn("__twin", F.lit(True)), SEGMENT, "left").withColumn("__ruled", F.expr("__ruled OR proto = 'udp' AND __twin")).drop("__twin")
    packets = packets.withColumns({"__bucket": F.when(F.col("__ruled"), F.floor(F.col("seq") / BUCKET)), "__frames": F.floor(F.col("frame_no") / FRAME_BLOCK)})
    # the packets' plan is run once for where segments occur, and once more for the packets themselves
    lists = _lists(packets.where("__ruled").select(*PLACE, "seq", "len"), rules)
    joined = packets.join(lists, PLACE, "left").withColumn("ranges", _own_ranges()).drop("__ruled", "__bucket", "__frames", "kept")
    touch = F.col("__tcp") | ((F.col("proto") == "udp") & (F.col("len") > 0) if mask_udp else F.lit(False))
    kept = F.coalesce(F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["b"] - r["a"]), F.lit(0).cast("bigint"))
    masked = F.when(F.col("ranges").isNotNull(), apply_ranges(F.col("payload"), F.col("ranges"), mask_byte)).otherwise(filler(F.length("payload"), mask_byte))
    out = joined.withColumns({
        "__masked": F.when(touch, masked).otherwise(F.col("payload")),
        "kept_bytes": F.when(touch, kept).otherwise(F.col("len")),
    })
    changed = touch & ((F.col("__masked") != F.col("payload")) | F.col("has_rules").isNull())
    return out.withColumns({
        "payload_modified": F.coalesce(changed, F.lit(False)), "masked_bytes": F.col("len") - F.col("kept_bytes"), "payload": F.col("__masked"),
    }).drop("__masked", "__tcp", "ranges", "has_rules")


def mask_all(packets: DataFrame, mask_byte: int = 0, mask_udp: bool = False) -> DataFrame:
    """Masking without any keep rule is a projection: nothing is joined or shuffled."""
    touch = F.coalesce(F.expr("len > 0 AND proto = 'tcp'") | (F.expr("len > 0 AND proto = 'udp'") if mask_udp else F.lit(False)), F.lit(False))
    return packets.withColumns({
        "payload_modified": touch, "kept_bytes": F.when(touch, F.lit(0)).otherwise(F.col("len")).cast("bigint"),
        "masked_bytes": F.when(touch, F.col("len")).otherwise(F.lit(0)).cast("bigint"),
        "payload": F.when(touch, filler(F.length("payload"), mask_byte)).otherwise(F.col("payload"))})


def masking_stats(masked: DataFrame) -> DataFrame:
    out = masked.where("proto = 'tcp'").groupBy("capture_id").agg(
        F.count("*").alias("processed"), F.count_if("payload_modified").alias("modified"),
        F.sum("masked_bytes").cast("bigint").alias("masked_bytes"), F.sum("kept_bytes").cast("bigint").alias("kept_bytes"))
    total = F.col("masked_bytes") + F.col("kept_bytes")
    return out.withColumns({
        "masked_ratio": safe_divide(F.col("masked_bytes"), total), "kept_ratio": safe_divide(F.col("kept_bytes"), total),
        "modified_ratio": safe_divide(F.col("modified"), F.col("processed"))})


def merge_stats(stats: DataFrame) -> DataFrame:
    """Totals over runs: counts add up, the longest duration counts, success only if all succeeded."""
    return stats.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("processed", "modified", "masked_bytes", "kept_bytes")],
        F.max("duration_us").alias("duration_us"), F.bool_and("success").alias("success"))
