"""Physical-plan facts of every registered query (PLANS.md).

For each query: shuffles (Exchange), join strategies, window group limits,
top-k operators, and what each Parquet scan reads (ReadSchema) and pushes
down. Generated from ``explain("formatted")`` text at the given sf folder.

    python scripts/plan_report.py /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from polylabel.plans import catalog  # noqa: E402
from polylabel.session import local_session  # noqa: E402

SKIP = {"streaming_metrics", "streaming_clean"}  # executed through a sink; plans are per micro-batch


def facts(text: str) -> dict:
    tree = text.split("\n\n(1)", 1)[0]  # operator tree only; the details section repeats names
    count = lambda pat: len(re.findall(pat, tree))
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
    pushed = sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if p))
    return {
        "exchanges": count(r"\bExchange\b") - count(r"ReusedExchange"),
        "broadcast_joins": count(r"BroadcastHashJoin"),
        "sort_merge_joins": count(r"SortMergeJoin"),
        "nested_loop/cartesian": count(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "window_group_limit": count(r"WindowGroupLimit"),
        "take_ordered": count(r"TakeOrderedAndProject"),
        "scans": scans,
        "pushed": pushed,
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py {sf}` from `explain(\"formatted\")` (AQE initial plan).")
    print("Exchange counts include the local-only `spread` repartition of the single-file `documents`")
    print("table (one per read); on a many-file input that exchange is absent.\n")
    print("| query | exchanges | BHJ | SMJ | NLJ/cartesian | window group limit | top-k | scans (ReadSchema) |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        f = facts(buf.getvalue())
        scans = "<br>".join(s.replace("|", "\\|") for s in f["scans"])
        print(f"| {name} | {f['exchanges']} | {f['broadcast_joins']} | {f['sort_merge_joins']} | "
              f"{f['nested_loop/cartesian']} | {f['window_group_limit']} | {f['take_ordered']} | {scans} |")
    spark.stop()


if __name__ == "__main__":
    main()
