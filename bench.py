"""Times of the headline queries as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from callweave.plans import catalog_queries

HEADLINE = ["catalog", "api_weights", "sequence_weights", "similar_sequences", "merged_values", "cluster_histogram", "graph_edges", "contraction", "degree", "pruned_sequences", "join_first", "folds"]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog_queries.queries(), {}
    for name in HEADLINE:
        start = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
