"""Look for plan shapes that do not scale: ``python tests/plan_scan.py [name ...]``."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def findings(plan):
    found = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if n in plan]
    if re.search(r"Exchange SinglePartition", plan):
        found.append("SinglePartition")
    return found


def main():
    from faultline.cluster import local_session
    from faultline.registry import QUERIES

    spark = local_session(8)
    for name, fn in QUERIES.items():
        if len(sys.argv) > 1 and not any(a in name for a in sys.argv[1:]):
            continue
        plan = physical_plan(fn(spark, "/root/testdata/sf0.001"))
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan))
        print(f"{name:40s} shuffles={shuffles:3d} python={plan.count('ArrowEvalPython') + plan.count('MapInPandas')} {findings(plan)}", flush=True)


if __name__ == "__main__":
    main()
