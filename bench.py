"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tailwise.plans import catalog

QUERIES = ["pm_grouped", "pm_ratio_targets", "moments_population", "pm_matrix_long", "copula3", "ecdf", "cdf_deg1", "var_deg1", "gravity", "superiority", "ssd_pairs", "seasonality", "linear_static_arma", "rolling_dispersion", "anova_two", "dependence", "partition_map"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = catalog.queries(), {}
    known[QUERIES[0]](spark, folder).collect()  # starts the JVM's code
    for name in QUERIES:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
