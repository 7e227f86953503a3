"""Show what in the physical plans of registered queries could hurt at scale.

usage: python tools/plans.py [sf] [key-prefix ...]
Counts joins without keys, single-partition exchanges with what they carry, and Python steps.
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from flowguard.plans import load_all
    from flowguard.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", 8, spark__ui__enabled="false",
                          spark__sql__autoBroadcastJoinThreshold="-1")
    spark.sparkContext.setLogLevel("ERROR")
    for key, fn in load_all()[0].items():
        if key.startswith(("str_", "ml_4", "ml_5", "ml_6", "ml_11", "ml_12", "agg_16_lead")) \
                or (prefixes and not key.startswith(prefixes)):
            continue
        plan = fn(spark, f"/root/testdata/sf{sf}")._jdf.queryExecution().executedPlan().toString()
        found = {n: len(re.findall(n, plan)) for n in (
            "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "collect_list",
            "collect_set")}
        single = re.findall(r"Exchange SinglePartition.*\n.*?[-+]\s*(\S.*)", plan)
        found = {k: v for k, v in found.items() if v}
        if found or single:
            kinds = sorted({re.sub(r"\(\d+\)|\*", "", s)[:70].strip() for s in single})
            print(key, found, kinds, flush=True)


if __name__ == "__main__":
    main()
