"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=4 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textguard.operators.obfuscation import detect_obfuscation, quick_flag
from textguard.plans.catalog import QUERIES
from textguard.plans.catalog.language_queries import documents

REGISTERED = (
    "redact_together",
    "redact_by_type",
    "pii_spans",
    "pii_counts_by_type",
    "language_profiles",
    "detect_language_by_join",
    "translate_to_english",
    "translate_back",
    "conversation_replies",
    "training_set",
    "metrics_row",
    "classifier_scores",
    "guard_messages",
    "verdict_summary",
)


def report_on_documents(spark, folder):
    return detect_obfuscation(documents(spark, folder)).select("msg_id", "report")


def flag_on_documents(spark, folder):
    return quick_flag(documents(spark, folder)).select("msg_id", "should_flag")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textguard-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.textguard.scanPartitions", str(4 * int(cpus)))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {
        "obfuscation_report": report_on_documents,
        "obfuscation_flag": flag_on_documents,
    } | {name: QUERIES[name] for name in REGISTERED}
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    # one untimed job, so that session start is not billed to the first query
    documents(spark, folder).select(F.length("text")).write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name, query in runs.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    per_second = {
        name: round(rows / seconds[name], 1)
        for name in (
            "obfuscation_report",
            "obfuscation_flag",
            "redact_together",
            "detect_language_by_join",
            "classifier_scores",
        )
    }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
                "documents": rows,
                "documents_per_second": per_second,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
