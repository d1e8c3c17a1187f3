"""Keep rules: half-open sequence ranges per flow-direction that survive masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions import tls as T
from wireloom.functions.octets import be_int
from wireloom.operators.flows import FLOW
from wireloom.operators.reassembly import KEY
from wireloom.operators.scan import covering_end, merge_intervals
from wireloom.operators.skew import lookup

RULE = [*KEY, "seq_start", "seq_end", "rule_type", "strategy"]
# What is kept in full by default, by option name and content type.
DEFAULT_POLICY = {"change_cipher_spec": True, "alert": True, "handshake": True, "application_data": False, "heartbeat": True}
OPTION_TYPES = {"change_cipher_spec": 20, "alert": 21, "handshake": 22, "application_data": 23, "heartbeat": 24}


def policy(options: Mapping[str, bool] | None = None) -> dict[int, bool]:
    """Content type -> keep in full. Names may be spelled with or without a ``preserve_`` prefix."""
    merged = dict(DEFAULT_POLICY)
    for name, keep in (options or {}).items():
        plain = name.removeprefix("preserve_")
        if plain not in merged:
            raise ValueError(f"unknown preserve option: {name}")
        merged[plain] = bool(keep)
    return {OPTION_TYPES[n]: v for n, v in merged.items()}


def _is_kept(content_type: Column, keep: Mapping[int, bool]) -> Column:
    full = [t for t, v in keep.items() if v]
    return content_type.isin(*full) if full else F.lit(False)


def tls_rules(records: DataFrame, options: Mapping[str, bool] | None = None, partial_limits: bool = False) -> DataFrame:
    """A rule per record: whole record when its type is kept, else the five header bytes for application data, else none.

    A record that was cut off keeps its rule for what is there; ``partial_limits`` drops such rules beyond a size by type.
    """
    keep = policy(options)
    kind = F.col("content_type")
    full = _is_kept(kind, keep)
    r = records.where(full | (kind == T.APP_DATA)).withColumn("strategy", F.when(full, "full_message").otherwise("header_only"))
    r = r.withColumns({
        "seq_start": F.col("tls_header_seq_start"),
        "seq_end": F.when(F.col("strategy") == "full_message", F.col("tls_payload_seq_end")).otherwise(F.col("tls_header_seq_end")),
        "rule_type": F.when(F.col("strategy") == "header_only", "tls_applicationdata_header").otherwise(F.concat(F.lit("tls_"), F.lower("content_type_name"))),
    })
    if partial_limits:
        r = r.where(T.plausible_partial_rule(F.col("is_cross_segment"), kind, F.col("strategy"), F.col("seq_end") - F.col("seq_start"), F.col("actual_length")))
    return r.select(*RULE)


def fallback_rules(frames: DataFrame, rules: DataFrame, options: Mapping[str, bool] | None = None, ccs_limit: int | None = None) -> DataFrame:
    """Rules from single frames ``(key, seq, len, payload, content_types, segment_data)`` whose first byte no existing rule covers.

    What a frame alone would give is found in a projection; only those rules, without payload, are swept against the existing ones.
    """
    keep = policy(options)
    end = F.col("seq") + F.col("len")
    fragments = frames.where(T.is_fragment() & ~T.is_app_data_fragment()).select(
        *KEY, F.col("seq").alias("seq_start"), end.alias("seq_end"), F.lit("tls_fragment_full_preserve").alias("rule_type"), F.lit("full_preserve").alias("strategy"))
    starts = frames.where(~T.is_fragment() & T.is_record_start(F.col("payload")))
    typed = starts.withColumn("content_type", F.explode(F.array_distinct(F.filter(F.transform("content_types", T.to_int), lambda t: t.isNotNull()))))
    typed = typed.where(T.type_matches_payload(F.col("payload"), F.col("content_type")) & (_is_kept(F.col("content_type"), keep) | (F.col("content_type") == T.APP_DATA)))
    header = (F.col("content_type") == T.APP_DATA) & ~_is_kept(F.col("content_type"), keep)
    typed = typed.withColumns({
        "seq_start": F.col("seq"), "seq_end": F.when(header, F.col("seq") + T.HEADER).otherwise(end),
        "rule_type": F.when(header, "tls_applicationdata_header").otherwise(F.concat(F.lit("tls_"), F.lower(T.type_name(F.col("content_type"))))),
        "strategy": F.when(header, "header_only").otherwise("full_message"),
    })
    ok = T.plausible_rule(F.col("strategy"), F.col("content_type"), F.col("seq_end") - F.col("seq_start"), F.col("len"), be_int(F.col("payload"), 0, 1), ccs_limit)
    own = fragments.unionByName(typed.where(ok).select(*RULE)).distinct()
    swept = covering_end(own, KEY, "seq_start", rules.where("seq_start < seq_end"), "seq_start", "seq_end", "__covered")
    return swept.where("__covered IS NULL OR __covered <= seq_start").select(*RULE)


def combine(*rule_sets: DataFrame) -> DataFrame:
    out = rule_sets[0].select(*RULE)
    for r in rule_sets[1:]:
        out = out.unionByName(r.select(*RULE))
    return out


def normalise_strategy(rules: DataFrame) -> DataFrame:
    return rules.withColumn("strategy", F.when(F.col("strategy") == "header_only", "header_only").otherwise("full_preserve"))


def valid(rules: DataFrame) -> DataFrame:
    return rules.where("seq_start >= 0 AND seq_start < seq_end AND tuple_key <> '' AND direction IN ('forward', 'reverse')")


def orphaned(rules: DataFrame, flows: DataFrame) -> DataFrame:
    """Rules whose flow does not exist."""
    keys = rules.select(*FLOW).distinct().join(flows.select(*FLOW).distinct(), FLOW, "left_anti")
    return lookup(rules, keys, FLOW, by="seq_start", how="left_semi")


def merged_rules(rules: DataFrame) -> DataFrame:
    """Full ranges merged where they overlap or touch, header ranges left as they are, strategies never mixed."""
    norm = normalise_strategy(valid(rules))
    full = merge_intervals(norm.where("strategy = 'full_preserve'"), KEY, "seq_start", "seq_end").withColumn("strategy", F.lit("full_preserve"))
    header = norm.where("strategy = 'header_only'").select(*KEY, "seq_start", "seq_end", "strategy").distinct()
    return full.unionByName(header)


def both_directions(rules: DataFrame) -> DataFrame:
    """When only one direction of a flow has rules they also serve the other one."""
    dirs = rules.groupBy(*FLOW).agg(F.collect_set("direction").alias("__dirs"))
    one_way = dirs.where(F.size("__dirs") == 1).drop("__dirs")
    mirrored = lookup(rules, one_way, FLOW, by="seq_start", how="left_semi").withColumn(
        "direction", F.when(F.col("direction") == "forward", "reverse").otherwise("forward"))
    return rules.unionByName(mirrored)


def rule_statistics(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_type", "strategy").agg(
        F.count("*").alias("rules"), F.sum(F.col("seq_end") - F.col("seq_start")).alias("preserved_bytes"), F.count_distinct(*FLOW).alias("flows"))
