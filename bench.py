"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

NAMES = (
    "reduce_sum", "map_reduce", "fold", "aggregate_length", "sum_pairs", "product_by_key", "count_even", "min_max", "min_custom_order", "find_first", "exists_gt", "forall_lt",
    "map_sqrt_int", "flat_map", "filter_mod3", "filter_cos", "group_map_aggregate", "group_by_bag", "group_by_set", "map_first", "map_last", "set_map", "copy_to_array_slice",
    "accumulate_bounds", "accumulate_sectors", "accumulate_custom", "product_wrapped", "list_fold_left", "pipeline_euler1", "pipeline_nested", "pagerank", "mandelbrot",
    "barnes_hut_step",
)


def main() -> None:
    from millrace.queries import QUERIES
    from millrace.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
