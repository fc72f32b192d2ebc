"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quotewell.plans.queries import QUERIES

NAMES = ["valued_instruments", "currency_conversion", "strict_asof_join", "chronological_merge", "causal_merge", "first_source_wins", "integrity_windows", "book_at_time", "snapshot_difference", "source_ownership", "coverage_gaps", "instrument_ranking"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rows = {}, {}
    for name in NAMES:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = {k: round(events / seconds[k]) for k in ("currency_conversion", "chronological_merge", "integrity_windows")}
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "events_per_sec": rows}))


if __name__ == "__main__":
    main()
