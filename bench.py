"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wireloom.plans import catalogue
from wireloom.session import local_session

HEADLINE = (
    "sanitise_flagship", "d1_dedup", "d2_dedup_stats", "a7_ip_map", "a8_anonymised", "w2_streams", "w7_flows", "w9_trimmed_segments", "t2_records",
    "t13_type_hits", "h1_headers", "k1_tls_rules", "k9_masked_payload", "v7_overall", "r5_overall", "r14_describe", "p1_layers", "s2_packets",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(app="bench")
    queries = catalogue.queries()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
