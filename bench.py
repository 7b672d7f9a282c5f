"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proxima.plans.queries import QUERIES  # noqa: E402
from proxima.session import ensure_shared_dir, scratch  # noqa: E402

HEADLINE = (
    "rnn_particles_open", "rnn_particles_periodic", "rnn_ties_events", "rnn_crowded_lineitem",
    "rnn_halos_offset", "knn_pairs_open", "radius_pairs_open", "radius_counts",
    "wrap_positions", "pair_distance_periodic", "bbox_grid", "bbox_coalesced", "file_overlap",
    "buffered_read", "halo_box_assign", "ph_key_order", "hp_ang2nest", "hp_nest_ring",
    "hp_query_disc", "hp_neighbors", "hp_interpol", "hp_interp_tri", "sky_file_overlap",
    "ph_key_by_file", "knn_join_halos",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of every column
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        with scratch(spark):
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
