"""Time the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE), BENCH_EVENT_LOG (set to 1 or a
folder to write Spark's event log there for stage and task times).  Each query runs its whole plan
into the ``noop`` sink (no driver collect); the value is the sum of seconds.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "class_distribution", "clean_text", "dedup_text", "forward_fill", "holdout_split",
    "stratified_split", "label_dictionary", "encode_labels", "vocabulary", "encode_tokens",
    "pad_and_mask", "assign_batches", "classification_report", "mean_loss", "best_epoch", "augment_drop",
    "augment_replace", "score_batches", "train_classifier",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from labeltide.plans.catalog import QUERIES
    from labeltide.session import local_session

    extra = {}
    event_log = os.environ.get("BENCH_EVENT_LOG")
    if event_log:
        import tempfile
        folder = event_log if os.path.isdir(event_log) else tempfile.mkdtemp(prefix="run-events-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": folder}
        print(f"event log: {folder}", file=sys.stderr)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="labeltide-bench",
                          extra=extra)
    # JVM, regex and codegen warm-up on the smallest fixture, not timed.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        QUERIES["clean_text"](spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
