"""Times the headline queries and reads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Reads are of 24 noisy images of 1024 x 1024 in a temporary folder: 120 points as 5 places on each,
2,400 as 100, and 40 windows, for a link of 5 ms and 100 Mb/s.  Beside their seconds are requests,
bytes and the bytes of whole tiles, which do not depend on the machine; values are checked.
"""

import json
import os
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

from rasterlake import FileTransport, Lake, Options, scan
from rasterlake.queries import QUERIES
from rasterlake.sources.tiff import write

HEADLINE = ("theoretical_minimum", "required_tiles_distinct", "tile_plan", "prefix_plan", "coalesce_groups", "restart_plan", "byte_attribution", "point_batch_tiles", "diagnosis_by_run", "workload_scattered", "log_metrics_by_kind", "predictor2_undo", "cost_surface")


def reads(spark: SparkSession, folder: str) -> tuple[dict, dict]:
    rng = np.random.default_rng(1)
    images = {f"day{k:02d}.tif": rng.integers(0, 512, (1024, 1024), dtype=np.uint16) for k in range(24)}
    for key, image in images.items():
        with open(f"{folder}/{key}", "wb") as f:
            f.write(write([image], 256))
    transport, keys = FileTransport(folder), sorted(images)
    found = scan(spark.createDataFrame([(k,) for k in keys], "key string"), transport)
    objects = spark.createDataFrame(found.collect(), found.schema)
    sets = {
        "read_120_points": [(k, 37 + 211 * p % 1000, 11 + 157 * p % 1000) for p in range(5) for k in keys],
        "read_2400_points": [(k, 7 + 83 * p % 1000, 11 + 61 * p % 1000) for p in range(100) for k in keys],
        "read_40_windows": [(keys[w % 24], 13 * w, 11 * w, 256, 256) for w in range(40)],
    }
    seconds, facts = {}, {}
    for name, rows in sets.items():
        lake = Lake(spark, objects, transport, Options(min_fetch=1024, rtt_s=0.005))
        start = time.perf_counter()
        got = lake.read(rows)
        seconds[name] = round(time.perf_counter() - start, 3)
        wrong = sum(not np.array_equal(g, images[k][y : y + g.shape[0], x : x + g.shape[1]]) for g, (k, x, y, *_) in zip(got, rows))
        s = lake.stats
        facts[name] = {"reads": len(rows), "wrong": wrong, "requests": s.requests, "bytes": s.bytes, "whole_tiles": s.whole_bytes, "gain": s.as_dict()["gain_over_whole_blocks"]}
    return seconds, facts


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    with tempfile.TemporaryDirectory() as folder:
        read_seconds, facts = reads(spark, folder)
    seconds |= read_seconds
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "reads": facts, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
