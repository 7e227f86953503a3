"""Headline queries on local cores; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and is then timed, writing all rows to a no-op sink.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg_2_port_scan", "agg_3_repeated_failure", "agg_4_high_rate", "jn_5_rule_set",
    "agg_7_alert_rollup", "jn_3_touched_buckets", "snk_4_model_matrix", "win_11_feature_table",
    "src_1_canonical_lines", "jn_7_indicator_match", "fld_1_alert_lifecycle_steps",
    "fld_5_decisions", "ml_14_score_fusion", "agg_23_roc_auc", "agg_26_metric_snapshot",
    "agg_27_sli_snapshot", "win_12_group_time_split", "ml_8_isolation_scores",
]


def main():
    from flowguard.plans import load_all
    from flowguard.session import build_session
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), "flowguard-bench",
                          spark__driver__memory="12g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    took = {}
    for key in HEADLINE:
        for timed in (False, True):
            start = time.time()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                took[key] = round(time.time() - start, 3)
        print(f"{key} {took[key]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
