"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from tidebook.plans import registry  # noqa: E402

HEADLINE = ["census_by_type", "order_episodes", "level_depth_running", "micro_symbols", "order_lifetime_histogram", "inside_after_every_message", "feature_windows", "crossed_locked_excuses", "spread_depth_by_minute", "fill_reasons", "bias_vs_exact", "median_time_to_fill", "value_at_horizon", "placement_schedule", "maker_strategy_pnl"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["census_by_type"](spark, sf).collect()
    took, start, left = {}, time.time(), []
    for name in HEADLINE:
        if time.time() - start > float(os.environ.get("BENCH_MAX_S", "1200")):  # what is left out is named
            left.append(name)
            continue
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), **({"left_out": left} if left else {})}))


if __name__ == "__main__":
    sys.exit(main())
