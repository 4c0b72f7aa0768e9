"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINES = ("q_collection_stats", "q_normalized_weights", "q_vector_rank", "q_bm25", "q_hybrid_rrf", "q_vector_prf", "q_semantic_topk", "q_lang_ngram", "q_summary_keywords", "q_exact_duplicates")


def main() -> None:
    from pyspark.sql import SparkSession

    from lexweave.plans import all_queries
    from lexweave.sources.index import Index

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own, took = all_queries(), {}
    spark.read.parquet(f"{folder}/documents.parquet").count()
    began = time.perf_counter()
    Index.of(spark, folder, anew=True)
    took["build_index"] = round(time.perf_counter() - began, 3)
    for name in HEADLINES:
        began = time.perf_counter()
        own[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
