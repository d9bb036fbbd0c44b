"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sorrel.plans.registry import QUERIES
from sorrel.session import build_session

HEADLINE = (
    "clean_text_doc", "build_documents", "dedupe_first", "postings", "bm25_match", "best_fields", "phrase_match", "nested_match", "cosine_topk", "rrf_fusion",
    "hybrid_search", "stage_summary", "qwk", "per_class_metrics", "stratified_kfold", "ensemble_weighted", "focal_loss_eval", "upsert_last_wins", "ingest_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_distribution"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
