"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logtide import get_spark  # noqa: E402
from logtide.plans import catalog  # noqa: E402

HEADLINES = (
    "clean_log_messages",
    "clean_documents",
    "prepare_upload",
    "first_of_duplicate_rows",
    "dataset_context",
    "audit_summary",
    "hourly_timeline",
    "session_units",
    "session_timeline",
    "connected_groups",
    "grouped_split_contract",
    "exact_quota_allocation",
    "document_vocabulary",
    "document_tfidf_vectors",
    "log_tfidf_weights",
    "event_masking",
    "masked_event_surprise",
    "standard_scaling",
    "best_f1_threshold",
    "roc_and_pr_area",
    "fusion_search",
    "prediction_evidence",
    "evidence_of_one_model",
    "logistic_regression_scores",
    "scan_csv_strings",
    "near_word_scores",
    "session_context_surprise",
    "contract_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "logtide-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(8, int(cpus) if cpus.isdigit() else 8)),
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    entries = catalog.entries()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
