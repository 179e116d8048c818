"""Summarise the physical plan of every non-model query (writes PLANS.md).

Usage: python scripts/plan_summary.py [sf_dir] > PLANS.md
Counts operators in the planned (pre-execution) physical plan; AQE may
still turn a sort-merge join into a broadcast join at run time.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans import registry  # noqa: E402
from tillroll.session import build_session  # noqa: E402

# Fits, and whole ingests whose plans are those of the queries listed.
MODELS = {"basket_value_gbt", "clv_rf", "clv_holdout", "churn_model", "clv_predict", "clv_top", "streamed_kpi_totals",
          "maintained_dashboard", "ingest_rejects"}
OPS = [
    ("shuffles", r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)"),
    ("broadcasts", r"BroadcastExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("aggregates", r"(HashAggregate|ObjectHashAggregate|SortAggregate)"),
    ("Expand", r"\bExpand\b"),
    ("Window", r"\bWindow\b"),
    ("Generate", r"\bGenerate\b"),
    ("subqueries", r"Subquery subquery"),
]
BAD = r"(BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin)"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16, driver_memory="8g")
    qs = registry.build()
    print("# Physical plan summary\n")
    print(f"Generated by `scripts/plan_summary.py` over `{sf_dir}` (planned physical plan, before AQE "
          "re-optimisation; models and whole ingests omitted because building them runs a fit or an ingest).\n")
    print("| query | " + " | ".join(n for n, _ in OPS) + " | Python/cartesian |")
    print("| --- | " + " | ".join("---" for _ in OPS) + " | --- |")
    for name in sorted(set(qs) - MODELS):
        plan = qs[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for _, p in OPS]
        bad = "yes" if re.search(BAD, plan) else "no"
        print(f"| {name} | " + " | ".join(counts) + f" | {bad} |")
    spark.stop()


if __name__ == "__main__":
    main()
