"""Print the plans' warning signs of every registered query.

    python tools/plans.py [name-prefix ...]

Looks for cross joins, sorts or windows on a single partition, row-at-a-time Python
and grouped collects.
"""

from __future__ import annotations

import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from tidewell import catalog  # noqa: E402
from tidewell.session import local_session  # noqa: E402

SIGNS = {
    "cross join": r"CartesianProduct|BroadcastNestedLoopJoin",
    "single-partition window": r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition",
    "row-at-a-time python": r"BatchEvalPython",
    "grouped collect": r"collect_(list|set)\(",
    "grouped python": r"FlatMapGroupsInPandas|FlatMapCoGroups",
}


def main() -> None:
    spark = local_session(8)
    for name, fn in catalog.QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        found = [s for s, rx in SIGNS.items() if re.search(rx, plan)]
        shuffles = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        if found or sys.argv[1:]:
            print(f"{name}: shuffles {shuffles} {', '.join(found)}")
    print("done")


if __name__ == "__main__":
    main()
