"""Times the headline queries, warm, each written to the no-op sink; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from leanprompt import plans

NAMES = ["turn_token_footprint", "token_estimate_documents", "redact_pii", "dedupe_first_wins", "waste_points", "word_overuse", "streak", "rapid_regenerations", "by_length", "attested_words", "classifier_inference", "masked_span_census", "compression_benchmark"]


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        for _ in range(2):  # the second run counts
            began = time.time()
            plans.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
