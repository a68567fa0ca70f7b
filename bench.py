"""Benchmark: runs the headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS] and prints one JSON line.

Every query is executed to completion with the ``noop`` sink (the whole plan
runs, nothing is collected to the driver). One warm-up query runs first so
JVM start-up is not charged to the first measured query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from polylabel.plans import catalog  # noqa: E402
from polylabel.session import local_session  # noqa: E402

HEADLINE = [
    "per_label_metrics", "macro_sample_metrics", "exact_match_multilabel", "row_set_metrics",
    "bce_loss", "clean_text", "corpus_union", "source_distribution", "label_cooccurrence",
    "label_combinations", "sample_weights", "oversample_rows", "stratified_split",
    "training_shards", "augment_words", "confusion_pairs", "mismatch_examples",
    "detailed_predictions", "annotator_agreement", "annotator_examples", "error_words",
    "threshold_advice", "encode_tokens", "streaming_metrics", "corpus_build", "train_and_score",
    "token_attribution",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app_name="polylabel-bench")
    catalog.QUERIES["label_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"bench: {name} failed: {failed[name]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if failed:
        out["failed"] = sorted(failed)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
