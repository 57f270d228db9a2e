"""Lists, per registered query, plan nodes that deserve a look: cross joins, single-task exchanges, Python stages.

    python tests/plan_audit.py [-s SF_DIR] [NAME_PART ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MARKS = {"cross": r"CartesianProduct|BroadcastNestedLoopJoin", "single": r"Exchange SinglePartition", "shuffles": r"Exchange hashpartitioning",
         "bhj": r"BroadcastHashJoin", "smj": r"SortMergeJoin", "sortagg": r"SortAggregate", "python": r"ArrowEval|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython",
         "windows": r"\bWindow \["}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    from panelwright.session import local_session

    spark = local_session("8")
    for name, fn in sorted(entry.queries().items()):
        if a.names and not any(n in name for n in a.names):
            continue
        try:
            plan = fn(spark, a.s)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # too few rows to train on at the smallest size
            print(name, "ERROR", str(e).splitlines()[0][:150], flush=True)
            continue
        counts = {k: len(re.findall(v, plan)) for k, v in MARKS.items()}
        print(name, " ".join(f"{k}={v}" for k, v in counts.items() if v), flush=True)


if __name__ == "__main__":
    main()
