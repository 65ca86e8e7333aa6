"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from inkwell.plans.catalogue import QUERIES
from inkwell.session import session

HEADLINE = ["plagiarism_doc_score", "plagiarism_sentence_pairs", "self_repetition_pairs", "readability_metrics", "tone_lexicon_rates", "hybrid_retrieval_rrf", "paragraph_cohesion", "extractive_summary", "ai_style_signals", "term_variants"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
