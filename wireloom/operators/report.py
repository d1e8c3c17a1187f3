"""Run reports over stage results ``(capture_id, batch, step, processed, modified, duration_us, errors, status, bytes_in, bytes_out)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.ratios import clamp, percent, safe_divide
from wireloom.operators.scan import running, running_count, trailing
from wireloom.operators.skew import lookup

STEPS = ("remove_dupes", "anonymize_ips", "mask_payloads")
METRICS = ("processed", "modified", "duration_us", "errors")


def stage_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("capture_id", "step").agg(*[F.sum(m).alias(m) for m in METRICS])


def file_status(runs: DataFrame) -> DataFrame:
    s = F.col("status")
    verdict = (
        F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "running"), "running")
        .when(F.bool_and(s.isin("completed", "skipped")), "completed").otherwise("pending")
    )
    return runs.groupBy("capture_id").agg(verdict.alias("overall_status"))


def batch_rollup(runs: DataFrame) -> DataFrame:
    per_file = runs.groupBy("batch", "capture_id").agg(
        F.bool_or(F.col("status") == "failed").alias("failed"), F.sum("duration_us").alias("duration_us"), F.sum("errors").alias("errors"))
    return per_file.groupBy("batch").agg(
        F.count_if(~F.col("failed")).alias("files_processed"), F.count_if("failed").alias("files_failed"), F.sum("duration_us").alias("duration_us"),
        F.sum("errors").alias("errors"), (F.sum("duration_us") / F.count("*")).alias("mean_duration_us"))


def step_totals(runs: DataFrame) -> DataFrame:
    """Every numeric metric summed per step, one row per (step, metric); summed before it is melted."""
    sums = runs.groupBy("step").agg(*[F.sum(m).alias(m) for m in METRICS], F.count_distinct("capture_id").alias("files_processed"))
    return sums.unpivot("step", [*METRICS, "files_processed"], "metric", "total")


def step_statistics(runs: DataFrame) -> DataFrame:
    out = runs.groupBy("step").agg(
        F.count("*").alias("executions"), F.count_if(F.col("status") == "completed").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"),
        (F.sum("duration_us") / F.count("*")).alias("mean_duration_us"), F.sum("processed").alias("packets"))
    return out.withColumn("success_rate", percent(F.col("successes"), F.col("executions")))


def overall_statistics(runs: DataFrame) -> DataFrame:
    """Files by status, packets (largest step per file, then summed), mean share of successful steps."""
    per_file = runs.groupBy("capture_id").agg(
        F.max("processed").alias("packets"), F.count("*").alias("steps"), F.count_if(F.col("status") == "completed").alias("ok"),
        F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_and(F.col("status").isin("completed", "skipped")).alias("done"))
    # shares are summed in millionths so that the result does not depend on the order of additions
    share = F.floor(F.col("ok") * 1000000 / F.col("steps"))
    out = per_file.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("done") & ~F.col("failed")).alias("completed_files"), F.count_if("failed").alias("failed_files"),
        F.sum("packets").alias("total_packets"), F.sum(share).alias("__share"))
    return out.withColumn("success_rate", percent(F.col("completed_files"), F.col("total_files"))).withColumn(
        "mean_step_success", safe_divide(F.col("__share"), F.col("total_files")) / 10000.0).drop("__share")


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Counts by every combination of type, severity and component (NULL marks a total)."""
    return errors.cube("error_type", "severity", "component").agg(F.count("*").alias("errors"))


def error_summary(errors: DataFrame, since: Column | None = None) -> DataFrame:
    chosen = errors if since is None else errors.where(F.col("ts") >= since)
    by_type = chosen.groupBy("error_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if("recovered").alias("r"))
    common = F.max(F.struct(F.col("n"), F.col("error_type")))["error_type"]
    return by_type.agg(
        F.sum("n").alias("total_errors"), common.alias("most_common"), F.sum("c").alias("critical_errors"), F.sum("r").alias("recovered_errors")
    ).withColumn("recovery_rate", safe_divide(F.col("recovered_errors"), F.col("total_errors")))


def errors_by(errors: DataFrame, *columns: str) -> DataFrame:
    return errors.groupBy(*columns).agg(F.count("*").alias("errors"))


def last_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.desc("error_id")).limit(k)


def throughput(runs: DataFrame) -> DataFrame:
    t = runs.groupBy("batch").agg(
        F.count_distinct("capture_id").alias("files"), F.sum("processed").alias("packets"), F.sum("bytes_in").alias("bytes"), F.sum("duration_us").alias("duration_us"))
    seconds, mb = F.col("duration_us") / 1000000.0, F.col("bytes") / 1048576.0
    on = lambda v: F.when(F.col("duration_us") > 0, v).otherwise(0.0)
    return t.select(
        "batch", on(F.col("files") / (seconds / 60.0)).alias("files_per_minute"), on(F.col("packets") / seconds).alias("packets_per_second"),
        on(mb / seconds).alias("mb_per_second"), on(mb / F.col("files")).alias("mean_file_mb"))


def rates(runs: DataFrame) -> DataFrame:
    t = runs.groupBy("capture_id").agg(
        F.sum("processed").alias("processed"), F.sum("modified").alias("modified"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"),
        F.count_if(F.col("status") == "completed").alias("ok"), F.count("*").alias("steps"))
    return t.select(
        "capture_id", percent(F.col("modified"), F.col("processed")).alias("modification_rate"), percent(F.col("ok"), F.col("steps")).alias("completion_rate"),
        percent(F.col("bytes_in") - F.col("bytes_out"), F.col("bytes_in")).alias("size_reduction"))


def capture_report(runs: DataFrame) -> DataFrame:
    """Per capture: packets of the first available step and the modified share of each step of it."""
    p = runs.groupBy("capture_id").pivot("step", list(STEPS)).agg(F.sum("processed").alias("p"), F.sum("modified").alias("m"))
    original = F.coalesce(*[F.col(f"{s}_p") for s in STEPS], F.lit(0))
    return p.select(
        "capture_id", original.alias("original_packets"), *[F.when(F.col(f"{s}_m").isNotNull(), percent(F.col(f"{s}_m"), original)).alias(f"{s}_rate") for s in STEPS])


def completeness(runs: DataFrame, expected: Sequence[str] = STEPS) -> DataFrame:
    done = runs.groupBy("capture_id").agg(F.collect_set("step").alias("done"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in expected]), F.col("done")))
    return done.select("capture_id", F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "completed").otherwise("partial").alias("state"))


def protocol_mix(packets: DataFrame, tls_ports=(443,)) -> DataFrame:
    tls = F.col("sport").isin(*tls_ports) | F.col("dport").isin(*tls_ports)
    out = packets.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.count_if(tls).alias("tls_packets"), F.array_join(F.array_sort(F.collect_set(F.when(tls, "tls").otherwise(F.col("proto")))), ",").alias("strategies"))
    return out.withColumns({"other_packets": F.col("packets") - F.col("tls_packets"), "tls_rate": percent(F.col("tls_packets"), F.col("packets"))})


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean, min, max and exact median of an integer column per key; NULLs are ignored.

    The median is found on distinct values with their counts and a running total, so a group of any size needs no per-group buffer.
    """
    keys = list(keys)
    v = F.col(value)
    basic = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    placed = running(counts, keys, value, F.col("__c"), "__before")
    covers = lambda i: (F.col("__before") <= i) & (i < F.col("__before") + F.col("__c"))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    mid = lookup(placed, basic.select(*keys, "n"), keys, by=value, width=1 << 30).groupBy(*keys).agg(
        ((F.max(F.when(covers(lo), v)) + F.max(F.when(covers(hi), v))) / 2.0).alias("median"))
    return basic.join(mid, keys).withColumn("mean", F.col("total") / F.col("n"))


def ordinal(series: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return running_count(series, keys, position, "idx")


def moving_average(series: DataFrame, keys: Sequence[str], position: str, value: str, window: int) -> DataFrame:
    """Mean over full windows of ``window`` points; the input itself when the window is invalid or longer than the series."""
    keys = list(keys)
    s = ordinal(series, keys, position)
    sizes = s.groupBy(*keys).agg(F.count("*").alias("__n"))
    if window <= 0:
        return s.withColumn("average", F.col(value).cast("double")).drop("idx")
    t = trailing(s, keys, "idx", window, {"__sum": F.sum(value)}).join(sizes, keys)
    full = F.col("__n") >= window
    return t.where(~full | (F.col("idx") >= window - 1)).withColumn(
        "average", F.when(full, F.col("__sum") / float(window)).otherwise(F.col(value).cast("double"))).drop("idx", "__n", "__sum")


def growth(series: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Change against the point before in percent, two decimals; infinite from zero, NULL for the first point."""
    t = trailing(ordinal(series, keys, position), keys, "idx", 2, {"__prev": F.first(value)})
    old, new = F.col("__prev"), F.col(value)
    g = F.when(F.col("idx") == 0, F.lit(None).cast("double")).when(old == 0, F.when(new > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.round((new - old) / old * 100, 2))
    return t.withColumn("growth", g).drop("idx", "__prev")


def normalise(series: DataFrame, keys: Sequence[str], value: str, low=None, high=None) -> DataFrame:
    """Min-max scaled value, and the value clamped to ``[low, high]``."""
    keys = list(keys)
    bounds = series.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = series.join(bounds, keys).withColumn(
        "scaled", F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")
    return out if low is None else out.withColumn("clamped", clamp(F.col(value), low, high))
