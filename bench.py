"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weft.queries.registry import QUERIES, flagship  # noqa: E402

HEADLINE = (
    "join_to_one", "join_to_many", "merge_graph", "asof_join", "agg_mv_union", "group_num_stats", "count_enc",
    "pair_count_key", "pair_nunique_key", "group_mode_key", "pair_count_cross", "triple_count", "fe_transform",
    "fe_cumcount", "diff_global", "diff_by_key", "rolling10", "range_sum", "time_diff", "mv_prefix_code",
    "pair_code", "hellinger_score", "mutual_info", "fe_topk", "collinear", "balanced_sample", "auc", "gbt_train")


def session(cpus: str) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("weft-bench")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weft-bench-"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not part of any query
    runs = {"flagship": flagship, **{n: QUERIES[n][0] for n in HEADLINE}}
    times: dict[str, float] = {}
    for name, fn in runs.items():
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
