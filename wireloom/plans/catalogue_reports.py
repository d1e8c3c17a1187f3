"""Validation and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions.ratios import percent
from wireloom.operators import report as rp
from wireloom.operators import tls_frames as tf
from wireloom.operators import validate as va
from wireloom.plans.carriers import carrier
from wireloom.plans.catalogue_frames import _HIT, frames
from wireloom.plans.catalogue_packets import packets
from wireloom.plans.catalogue_streams import http_masked, segments


def before(spark, sf):
    return tf.type_hits(frames(spark, sf))


def after(spark, sf):
    """The hits as an imperfect masking run would leave them."""
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    b = before(spark, sf).where("frame_no % 13 <> 0")
    return b.withColumns({
        "zero_bytes": F.when(F.col("frame_no") % 3 == 0, total).when(F.col("frame_no") % 3 == 1, total - 5).otherwise(F.lit(1)).cast("bigint"),
        "lengths": F.when(F.col("frame_no") % 11 == 0, F.slice("lengths", 1, 1)).otherwise(F.col("lengths")),
        "path": F.when(F.col("frame_no") % 17 == 0, "eth:raw").otherwise(F.col("path"))})


def runs(spark, sf):
    return carrier(spark, sf, "stage_runs")


def errors(spark, sf):
    return carrier(spark, sf, "errors")


def daily(spark, sf):
    return runs(spark, sf).groupBy("step", F.unix_date("run_date").cast("bigint").alias("day")).agg(F.sum("processed").alias("packets"))


def _int(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("int"))
    return df


def v9_masked(spark, sf):
    return va.http_zero_body(http_masked(spark, sf))


QUERIES = {
    "v1_appdata": lambda s, d: va.app_data_masked(before(s, d), after(s, d)),
    "v1_frames": lambda s, d: va.app_data_frames(after(s, d)),
    "v2_preserved": lambda s, d: va.complete_preservation(before(s, d), after(s, d)),
    "v2_frames": lambda s, d: va.preservation_frames(before(s, d), after(s, d)),
    "v3_smart_mask": lambda s, d: va.smart_masking(before(s, d), after(s, d)),
    "v4_streams": lambda s, d: va.stream_consistency(before(s, d), after(s, d)),
    "v5_types": lambda s, d: va.type_detection(before(s, d)),
    "v5_missing": lambda s, d: va.missing_types(before(s, d)),
    "v6_boundary": lambda s, d: va.boundary_frames(before(s, d), after(s, d)),
    "v6_safety": lambda s, d: va.boundary_safety(before(s, d), after(s, d)),
    "v7_overall": lambda s, d: va.overall(va.all_checks(before(s, d), after(s, d))),
    "v8_batch": lambda s, d: va.batch_pass_rate(va.overall(va.all_checks(before(s, d), after(s, d)))),
    "v9_http_body": lambda s, d: va.http_zero_body(segments(s, d, "http_segments")),
    "v9_examples": lambda s, d: va.http_body_examples(segments(s, d, "http_segments")),
    "v9_http_body_masked": v9_masked,
    "v10_state": lambda s, d: _int(va.processing_state(rp.stage_stats(runs(s, d))), "is_valid"),
    "v11_counts": lambda s, d: _int(va.packet_counts(packets(s, d), packets(s, d).where("frame_no % 100 <> 7 OR capture_id < '2024-01-15'")), "matches"),
    "r1_stage_stats": lambda s, d: rp.stage_stats(runs(s, d)),
    "r2_batch": lambda s, d: rp.batch_rollup(runs(s, d)),
    "r3_steps": lambda s, d: rp.step_totals(runs(s, d)),
    "r4_status": lambda s, d: rp.file_status(runs(s, d)),
    "r5_overall": lambda s, d: rp.overall_statistics(runs(s, d)),
    "r6_step_stats": lambda s, d: rp.step_statistics(runs(s, d)),
    "r7_errors": lambda s, d: rp.error_breakdown(errors(s, d)),
    "r7_summary": lambda s, d: rp.error_summary(errors(s, d), F.lit("2024-01-10").cast("timestamp_ntz")),
    "r7_last": lambda s, d: rp.last_errors(errors(s, d)).select("error_id", "error_type", "component", "operation"),
    "r8_throughput": lambda s, d: rp.throughput(runs(s, d)),
    "r9_rates": lambda s, d: rp.rates(runs(s, d)),
    "r10_capture_report": lambda s, d: rp.capture_report(runs(s, d)),
    "r12_protocol_mix": lambda s, d: rp.protocol_mix(packets(s, d)),
    "r13_percent": lambda s, d: runs(s, d).groupBy("step").agg(F.sum("modified").alias("m"), F.sum("processed").alias("p")).select(
        "step", percent(F.col("m"), F.col("p"), 1).alias("pct"), percent(F.col("m"), F.lit(0), 1).alias("pct_of_none")),
    "r14_describe": lambda s, d: rp.describe(runs(s, d), ["step"], "duration_us"),
    "r15_moving_avg": lambda s, d: rp.moving_average(daily(s, d), ["step"], "day", "packets", 7),
    "r16_growth": lambda s, d: rp.growth(daily(s, d), ["step"], "day", "packets"),
    "r17_normalise": lambda s, d: rp.normalise(daily(s, d), ["step"], "packets", 20, 60),
    "r18_completeness": lambda s, d: rp.completeness(runs(s, d)),
}

_B = f"(SELECT capture_id, frame_no, path, types, lengths, zero_bytes FROM {_HIT.replace('WANTED', '20, 21, 22, 23, 24')})"
_AB = f"""WITH b AS (SELECT * FROM {_B}), a AS (SELECT capture_id, frame_no, CASE WHEN frame_no % 17 = 0 THEN 'eth:raw' ELSE path END AS path, types,
   CASE WHEN frame_no % 11 = 0 THEN lengths[1:1] ELSE lengths END AS lengths, CASE frame_no % 3 WHEN 0 THEN list_sum(lengths) WHEN 1 THEN list_sum(lengths) - 5 ELSE 1 END AS zero_bytes FROM b WHERE frame_no % 13 <> 0),
   j AS (SELECT b.*, a.types AS mt, a.lengths AS ml, a.zero_bytes AS mz, a.frame_no IS NOT NULL AS present FROM b LEFT JOIN a USING (capture_id, frame_no)),
   keepf AS (SELECT capture_id, frame_no, CASE WHEN NOT present THEN 'missing' WHEN types = mt AND lengths = ml THEN 'preserved' ELSE 'modified' END AS outcome FROM j WHERE list_has_any(types, [20, 21, 22, 24])),
   bound AS (SELECT capture_id, frame_no, CASE WHEN NOT present THEN 'frame_missing' WHEN len(lengths) <> len(ml) THEN 'length_mismatch' WHEN lengths <> ml THEN 'length_change' WHEN mz < zero_bytes THEN 'zero_bytes_decrease' ELSE 'safe' END AS outcome FROM j),
   ok AS (
     SELECT capture_id, 'complete_preservation' AS chk, 95 AS lim, count(*) AS total, count(*) FILTER (WHERE outcome = 'preserved') AS passed FROM keepf GROUP BY 1
     UNION ALL SELECT capture_id, 'smart_masking', 95, count(*), count(*) FILTER (WHERE present AND abs(mz - (list_sum(ml) - 5)) <= 5) FROM j WHERE list_contains(types, 23) GROUP BY 1
     UNION ALL SELECT capture_id, 'boundary_safety', 95, count(*), count(*) FILTER (WHERE outcome = 'safe') FROM bound GROUP BY 1
     UNION ALL SELECT capture_id, 'type_detection', 80, 5, count(DISTINCT t) FROM (SELECT capture_id, unnest(types) AS t FROM b) GROUP BY 1
     UNION ALL SELECT x.capture_id, 'stream_consistency', 90, count(*), count(*) FILTER (WHERE fb = fa) FROM
       (SELECT capture_id, CASE WHEN path LIKE '%tcp%' THEN 't' ELSE 'u' END AS st, list(frame_no ORDER BY frame_no) AS fb FROM b GROUP BY 1, 2) x LEFT JOIN
       (SELECT capture_id, CASE WHEN path LIKE '%tcp%' THEN 't' ELSE 'u' END AS st, list(frame_no ORDER BY frame_no) AS fa FROM a GROUP BY 1, 2) y ON x.capture_id = y.capture_id AND x.st = y.st GROUP BY 1),
   chk AS (SELECT capture_id, chk AS "check", total, passed, 100.0::DOUBLE * passed / total AS rate, CASE WHEN 100.0::DOUBLE * passed / total >= lim THEN 'pass' ELSE 'fail' END AS status FROM ok),
   ov AS (SELECT capture_id, sum(CASE WHEN status = 'pass' THEN 100.0::DOUBLE ELSE rate END) / 5 AS score, sum(CASE WHEN status = 'pass' THEN 100.0::DOUBLE ELSE 0 END) / 5 AS strict_score, count(*) FILTER (WHERE status = 'pass') AS passed_tests FROM chk GROUP BY 1),
   ovs AS (SELECT *, CASE WHEN strict_score >= 80 THEN 'pass' ELSE 'fail' END AS status FROM ov)"""
_Z = "CASE WHEN len(lengths) > 0 THEN zero_bytes >= list_sum(lengths) ELSE zero_bytes > 0 END"
_DAILY = "(SELECT step, (run_date - DATE '1970-01-01')::BIGINT AS day, sum(processed)::BIGINT AS packets FROM {stage_runs} GROUP BY 1, 2)"
_PH = "unhex(payload_hex)"
_HAS_HTTP = " OR ".join(f"contains(payload_hex, hex('{t}'))" for t in ("HTTP/1.", "GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "PATCH ", "TRACE ", "CONNECT "))
_BODY = f"""(SELECT capture_id, frame_no, chk AND length(body) > 0 AS checked, chk AND length(body) > 0 AND NOT regexp_full_match(body, '(00)*') AS violated, body FROM (
   SELECT capture_id, frame_no, page_id, ({_HAS_HTTP}) AND strpos(payload_hex, '0D0A0D0A') > 0 AS chk, substr(payload_hex, strpos(payload_hex, '0D0A0D0A') + 8) AS body FROM {{http_segments}}))"""

ORACLES = {
    "v1_appdata": f"""{_AB} SELECT capture_id, records_before, coalesce(records_after, 0) AS records_after, coalesce(masked_records, 0) AS masked_records, coalesce(unmasked_records, 0) AS unmasked_records,
        CASE WHEN coalesce(unmasked_records, 0) = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT capture_id, count(*) AS records_before FROM b GROUP BY 1)
        LEFT JOIN (SELECT capture_id, count(*) AS records_after, count(*) FILTER (WHERE {_Z}) AS masked_records, count(*) FILTER (WHERE NOT {_Z}) AS unmasked_records FROM a GROUP BY 1) USING (capture_id)""",
    "v1_frames": f"{_AB} SELECT capture_id, frame_no, CASE WHEN {_Z} THEN 'masked' ELSE 'failed' END AS outcome FROM a",
    "v2_preserved": f"{_AB} SELECT * FROM chk WHERE \"check\" = 'complete_preservation'",
    "v2_frames": f"{_AB} SELECT * FROM keepf",
    "v3_smart_mask": f"{_AB} SELECT * FROM chk WHERE \"check\" = 'smart_masking'",
    "v4_streams": f"{_AB} SELECT * FROM chk WHERE \"check\" = 'stream_consistency'",
    "v5_types": f"{_AB} SELECT * FROM chk WHERE \"check\" = 'type_detection'",
    "v5_missing": f"{_AB} SELECT capture_id, t AS content_type FROM (SELECT DISTINCT capture_id FROM b), (SELECT unnest([20, 21, 22, 23, 24]) AS t) EXCEPT SELECT capture_id, unnest(types) FROM b",
    "v6_boundary": f"{_AB} SELECT * FROM bound",
    "v6_safety": f"{_AB} SELECT * FROM chk WHERE \"check\" = 'boundary_safety'",
    "v7_overall": f"{_AB} SELECT * FROM ovs",
    "v8_batch": f"{_AB} SELECT count(*) AS files, count(*) FILTER (WHERE status = 'pass') AS passed, 100.0::DOUBLE * count(*) FILTER (WHERE status = 'pass') / count(*) AS pass_rate FROM ovs",
    "v9_http_body": f"SELECT capture_id, count(*) AS packets, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE violated) AS violations FROM {_BODY} GROUP BY 1",
    "v9_examples": f"SELECT capture_id, frame_no, lower(substr(body, 1, 64)) AS body_sample, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS n FROM {_BODY} WHERE violated QUALIFY n <= 5",
    # after masking only headers survive, so a token can only be seen in segments that hold a header
    "v9_http_body_masked": f"""SELECT capture_id, count(*) AS packets, count(*) FILTER (WHERE frame_no % 1000000 = len_h // 256 AND len_h % 256 <> 0 AND seen AND more) AS checked, 0::BIGINT AS violations FROM (
        SELECT s.capture_id, s.frame_no, length(header_hex) // 2 AS len_h, length(header_hex) // 2 < 256 AS seen, s.len > (length(header_hex) // 2) % 256 AS more FROM {{http_segments}} s JOIN {{http_streams}} h USING (page_id)) GROUP BY 1""",
    "v10_state": """SELECT *, 1 AS is_valid, CASE WHEN errors / greatest(processed, 1) > 0.1 THEN 'high' WHEN errors / greatest(processed, 1) > 0.05 THEN 'elevated' ELSE '' END AS error_warning,
        CASE WHEN processed > 0 AND modified = 0 THEN 'none' WHEN processed > 0 AND modified / processed > 0.8 THEN 'high' ELSE '' END AS modification_warning
        FROM (SELECT capture_id, step, sum(processed)::BIGINT AS processed, sum(modified)::BIGINT AS modified, sum(duration_us)::BIGINT AS duration_us, sum(errors)::BIGINT AS errors FROM {stage_runs} GROUP BY 1, 2)""",
    "v11_counts": """SELECT capture_id, count(*) AS expected, count(*) FILTER (WHERE frame_no % 100 <> 7 OR capture_id < '2024-01-15') AS actual,
        CASE WHEN count(*) = count(*) FILTER (WHERE frame_no % 100 <> 7 OR capture_id < '2024-01-15') THEN 1 ELSE 0 END AS matches FROM {packets} GROUP BY 1""",
    "r1_stage_stats": "SELECT capture_id, step, sum(processed)::BIGINT AS processed, sum(modified)::BIGINT AS modified, sum(duration_us)::BIGINT AS duration_us, sum(errors)::BIGINT AS errors FROM {stage_runs} GROUP BY 1, 2",
    "r2_batch": """SELECT batch, count(*) FILTER (WHERE NOT f) AS files_processed, count(*) FILTER (WHERE f) AS files_failed, sum(d)::BIGINT AS duration_us, sum(e)::BIGINT AS errors, sum(d)::DOUBLE / count(*) AS mean_duration_us
        FROM (SELECT batch, capture_id, bool_or(status = 'failed') AS f, sum(duration_us) AS d, sum(errors) AS e FROM {stage_runs} GROUP BY 1, 2) GROUP BY 1""",
    "r3_steps": """WITH t AS (SELECT step, sum(processed)::BIGINT AS processed, sum(modified)::BIGINT AS modified, sum(duration_us)::BIGINT AS duration_us, sum(errors)::BIGINT AS errors, count(DISTINCT capture_id) AS files_processed FROM {stage_runs} GROUP BY 1)
        SELECT step, 'processed' AS metric, processed AS total FROM t UNION ALL SELECT step, 'modified', modified FROM t UNION ALL SELECT step, 'duration_us', duration_us FROM t UNION ALL SELECT step, 'errors', errors FROM t
        UNION ALL SELECT step, 'files_processed', files_processed FROM t""",
    "r4_status": "SELECT capture_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS overall_status FROM {stage_runs} GROUP BY 1",
    "r5_overall": """SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT f) AS completed_files, count(*) FILTER (WHERE f) AS failed_files, sum(p)::BIGINT AS total_packets,
        100.0::DOUBLE * count(*) FILTER (WHERE NOT f) / count(*) AS success_rate, sum(ok * 1000000 // n)::DOUBLE / count(*) / 10000.0::DOUBLE AS mean_step_success
        FROM (SELECT capture_id, max(processed) AS p, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS ok, bool_or(status = 'failed') AS f FROM {stage_runs} GROUP BY 1)""",
    "r6_step_stats": """SELECT step, count(*) AS executions, count(*) FILTER (WHERE status = 'completed') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, sum(duration_us)::DOUBLE / count(*) AS mean_duration_us,
        sum(processed)::BIGINT AS packets, 100.0::DOUBLE * count(*) FILTER (WHERE status = 'completed') / count(*) AS success_rate FROM {stage_runs} GROUP BY 1""",
    "r7_errors": "SELECT error_type, severity, component, count(*) AS errors FROM {errors} GROUP BY CUBE (error_type, severity, component)",
    "r7_summary": """WITH e AS (SELECT * FROM {errors} WHERE ts >= TIMESTAMP '2024-01-10') SELECT count(*) AS total_errors, (SELECT error_type FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS most_common,
        count(*) FILTER (WHERE severity = 'critical') AS critical_errors, count(*) FILTER (WHERE recovered) AS recovered_errors, count(*) FILTER (WHERE recovered) / count(*) AS recovery_rate FROM e""",
    "r7_last": "SELECT error_id, error_type, component, operation FROM {errors} ORDER BY ts DESC, error_id DESC LIMIT 10",
    "r8_throughput": """SELECT batch, files / (d / 1000000.0::DOUBLE / 60.0::DOUBLE) AS files_per_minute, p / (d / 1000000.0::DOUBLE) AS packets_per_second, (b / 1048576.0::DOUBLE) / (d / 1000000.0::DOUBLE) AS mb_per_second, (b / 1048576.0::DOUBLE) / files AS mean_file_mb
        FROM (SELECT batch, count(DISTINCT capture_id) AS files, sum(processed)::BIGINT AS p, sum(bytes_in)::BIGINT AS b, sum(duration_us)::BIGINT AS d FROM {stage_runs} GROUP BY 1)""",
    "r9_rates": """SELECT capture_id, CASE WHEN p = 0 THEN 0 ELSE m * 100.0::DOUBLE / p END AS modification_rate, ok * 100.0::DOUBLE / n AS completion_rate, CASE WHEN bi = 0 THEN 0 ELSE (bi - bo) * 100.0::DOUBLE / bi END AS size_reduction
        FROM (SELECT capture_id, sum(processed)::BIGINT AS p, sum(modified)::BIGINT AS m, sum(bytes_in)::BIGINT AS bi, sum(bytes_out)::BIGINT AS bo, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS ok FROM {stage_runs} GROUP BY 1)""",
    "r10_capture_report": """WITH t AS (SELECT capture_id, step, sum(processed)::BIGINT AS p, sum(modified)::BIGINT AS m FROM {stage_runs} GROUP BY 1, 2),
        w AS (SELECT capture_id, max(p) FILTER (WHERE step = 'remove_dupes') AS p1, max(m) FILTER (WHERE step = 'remove_dupes') AS m1, max(p) FILTER (WHERE step = 'anonymize_ips') AS p2, max(m) FILTER (WHERE step = 'anonymize_ips') AS m2,
              max(p) FILTER (WHERE step = 'mask_payloads') AS p3, max(m) FILTER (WHERE step = 'mask_payloads') AS m3 FROM t GROUP BY 1)
        SELECT capture_id, coalesce(p1, p2, p3, 0) AS original_packets, m1 * 100.0::DOUBLE / coalesce(p1, p2, p3) AS remove_dupes_rate, m2 * 100.0::DOUBLE / coalesce(p1, p2, p3) AS anonymize_ips_rate, m3 * 100.0::DOUBLE / coalesce(p1, p2, p3) AS mask_payloads_rate FROM w""",
    "r12_protocol_mix": """SELECT capture_id, count(*) AS packets, count(*) FILTER (WHERE sport = 443 OR dport = 443) AS tls_packets, array_to_string(list_sort(list(DISTINCT CASE WHEN sport = 443 OR dport = 443 THEN 'tls' ELSE proto END)), ',') AS strategies,
        count(*) FILTER (WHERE NOT (sport = 443 OR dport = 443)) AS other_packets, 100.0::DOUBLE * count(*) FILTER (WHERE sport = 443 OR dport = 443) / count(*) AS tls_rate FROM {packets} GROUP BY 1""",
    "r13_percent": "SELECT step, round(sum(modified)::DOUBLE * 100 / sum(processed), 1) AS pct, 0.0::DOUBLE AS pct_of_none FROM {stage_runs} GROUP BY 1",
    "r14_describe": "SELECT step, count(*) AS n, sum(duration_us)::BIGINT AS total, min(duration_us) AS low, max(duration_us) AS high, median(duration_us)::DOUBLE AS median, sum(duration_us)::DOUBLE / count(*) AS mean FROM {stage_runs} GROUP BY 1",
    "r15_moving_avg": f"SELECT step, day, packets, sum(packets) OVER (PARTITION BY step ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / 7.0::DOUBLE AS average FROM {_DAILY} QUALIFY row_number() OVER (PARTITION BY step ORDER BY day) >= 7",
    "r16_growth": f"SELECT step, day, packets, round((packets - old) / old * 100, 2) AS growth FROM (SELECT *, lag(packets) OVER (PARTITION BY step ORDER BY day) AS old FROM {_DAILY})",
    "r17_normalise": f"SELECT *, (packets - min(packets) OVER (PARTITION BY step)) / (max(packets) OVER (PARTITION BY step) - min(packets) OVER (PARTITION BY step)) AS scaled, least(greatest(packets, 20), 60) AS clamped FROM {_DAILY}",
    "r18_completeness": """SELECT capture_id, array_to_string(list_sort(list_filter(['anonymize_ips', 'mask_payloads', 'remove_dupes'], lambda s: NOT list_contains(done, s))), ',') AS missing, CASE WHEN len(done) = 3 THEN 'completed' ELSE 'partial' END AS state
        FROM (SELECT capture_id, list(DISTINCT step) AS done FROM {stage_runs} GROUP BY 1)""",
}
