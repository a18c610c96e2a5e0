"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pricetide.plans import catalog
from pricetide.session import local_session

HEADLINE = (
    "repeat_index",
    "merge_by_code",
    "history_dedup",
    "upsert_latest",
    "normalize_text",
    "panel_features",
    "cumulative_index",
    "horizon_pairs",
    "leakfree_prepare",
    "regression_metrics",
    "auc_brier",
    "bootstrap_rates",
    "backcast_adjusted",
    "fuzzy_adjustment",
    "connected_components",
    "visual_duplicates",
    "json_attr_extract",
    "html_label_map",
    "spearman_matrix",
    "dedup_end_to_end",
    "stream_history",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="pricetide-bench")
    registered = catalog.queries()
    registered["repeat_index"](spark, sf_dir).limit(1).collect()  # start-up is not measured
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
