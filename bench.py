"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["sessionize_gap", "session_rows", "session_hit_and_page_number", "previous_next_page", "time_on_page", "session_totals_and_uniques", "session_mode_client", "split_sessions", "traffic_filter", "stitch_by_stamp", "fx_convert", "ip_range_join", "items_revenue", "wide_events"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hitloom.plans import catalogue

    queries = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the JVM's readers
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    catalogue.entry(spark, sf_dir).write.format("noop").mode("overwrite").save()
    full = round(time.time() - began, 3)  # all columns of the wide row; beside the headline queries
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "hits": hits, "wide_row_all_columns": full, "hits_per_s_sessionize": round(hits / took["session_rows"])}))
    spark.stop()


if __name__ == "__main__":
    main()
