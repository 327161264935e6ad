"""Times the headline queries on one data folder and prints one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Every query is
run once to the end with all columns computed; tables shared by several queries are built by the first one
that needs them, as in a normal session, and count there.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "vitalsign", "bg", "chemistry", "ventilation", "urine_output_rate", "vasoactive_agent", "first_day_lab", "kdigo_stages", "sofa", "sapsii", "apsiii",
    "suspicion_of_infection", "sepsis3", "charlson", "filter_aggregate_mean", "filter_hour_window", "cohort_expression", "code_filter_any", "pivot_max",
    "join_interval_closed", "join_asof", "join_self_range", "window_lag_lead", "window_range_sums", "exact_quantiles", "unify_events", "event_catalogue", "table_one",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vitalgrid.plans.registry import all_queries
    from vitalgrid.session import local_session
    spark = local_session("bench", cpus)
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q in queries]
    times: dict[str, float] = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
