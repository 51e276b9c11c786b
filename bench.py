"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from earshot import catalog
from earshot.session import local_session

HEADLINE = [
    "ud3_few_shot_eval",
    "ag5_error_rates",
    "ag6_reduce_metrics",
    "ag7_rollup_log",
    "wn1_balanced_head",
    "wn1_balanced_head_window",
    "wn6_token_budget_batches",
    "ar1_collate",
    "ar6_assemble_prompt",
    "ar8_encode",
    "sc6_masked_nll",
    "sm4_greedy_decode",
    "jn1_attach_labels",
    "tx7_split_words",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    queries = catalog.queries()
    for name in ("ag6_reduce_metrics", "sc2_word_edits", "ud3_few_shot_eval"):
        run(queries[name](spark, sf_dir))  # start-up of JVM, scans, writers and Python workers
    times = {}
    for name in names:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": os.environ.get("BENCH_CPUS", "8"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
