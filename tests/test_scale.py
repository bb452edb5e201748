"""What keeps queries within bounds on larger tables, and that their results stay the same."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake import queries as Q
from rasterlake import reader
from rasterlake.operators import geo, tiles, workloads
from rasterlake.plans import driver_tables as D
from rasterlake.sources import catalog
from rasterlake.streaming import sessions as S

SF = "/root/testdata/sf0.001"
LEVELS = "key string, level int, width int, height int, blockw int, blockh int, nbx int, nby int, itemsize int"
REQUESTS = "req_id long, key string, level int, x int, y int, w int, h int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    """The most rows that any step of a plan gave when it ran."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        rows = p.metrics().get("numOutputRows")
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return max([rows.get().value() if rows.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["tile_plan", "prefix_plan", "coalesce_groups", "cost_sweep", "point_batch_tiles"])
def test_tiles_of_jobs_are_not_broadcast(spark, name):
    assert re.search(r"SortMergeJoin \[key#\d+, (?:level#\d+, |0, )?block#\d+\]", plan(Q.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["restart_asof", "restart_plan", "restart_rows"])
def test_restart_points_are_not_broadcast(spark, name):
    assert re.search(r"SortMergeJoin \[key#\d+, block#\d+\]", plan(Q.QUERIES[name](spark, SF)))


def test_tiles_of_levels_are_not_broadcast(spark):
    assert re.search(r"SortMergeJoin \[key#\d+, level#\d+, block#\d+\]", plan(Q.QUERIES["theoretical_per_level"](spark, SF)))


@pytest.mark.parametrize("name", ["byte_attribution", "diagnosis_by_run", "stacked_shares"])
def test_tiles_of_logs_are_not_broadcast(spark, name):
    assert re.search(r"SortMergeJoin \[key#\d+, cell#\d+L?\]", plan(Q.QUERIES[name](spark, SF)))


def test_tiles_are_made_by_more_tasks_where_there_are_more(spark):
    assert D.tiles(spark, SF).rdd.getNumPartitions() == 1 < D.tiles(spark, "/root/testdata/sf0.1").rdd.getNumPartitions()


def test_areas_are_united_by_strips(spark):
    draw = random.Random(5)
    levels = [("a", 0, 2000, 1500, 1024, 700, 2, 3, 2), ("b", 0, 300, 300, 1024, 1024, 1, 1, 2)]
    asked = [(i, draw.choice("ab"), 0, draw.randrange(-50, 1900), draw.randrange(-50, 1400), draw.randrange(1, 400), draw.randrange(1, 700)) for i in range(60)] + [(99, "b", 0, 0, 0, 300, 300)] * 2
    want, met = 0, 0
    for key, _, width, height, bw, bh, *_ in levels:
        seen = np.zeros((height, width), bool)
        for _, _, _, x, y, w, h in (r for r in asked if r[1] == key):
            seen[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = True
        want += int(seen.sum())
        met += sum(bw * bh for top in range(0, height, bh) for left in range(0, width, bw) if seen[top : top + bh, left : left + bw].any())
    r = tiles.granularity(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(levels, LEVELS)).first()
    assert (r.req_px, r.blk_px) == (want, met)
    one = tiles.granularity(spark.createDataFrame([(0, "b", 0, 0, 0, 300, 300)], REQUESTS), spark.createDataFrame(levels, LEVELS))
    assert most_rows(one) < 20 and one.first().req_px == 90000  # a row for each row of pixels before


def test_points_are_dealt_out_before_they_meet_images(spark):
    t = workloads.timeseries(D.stack_points(spark, SF), D.stack(spark, "/root/testdata/sf0.1"), "s2ts/T1/")
    n = D.stack_points(spark, SF).rdd.getNumPartitions()
    assert n < 4 == t.rdd.getNumPartitions() and t.select("visit").distinct().count() == t.count()


def test_boxes_in_the_same_place_meet_points_once(spark):
    boxes = spark.range(500).select(F.format_string("k%03d", 499 - F.col("id")).alias("key"), *[F.lit(v).alias(c) for c, v in (("w", 0.0), ("s", 0.0), ("e", 2.0), ("n", 2.0))])
    boxes = boxes.unionByName(spark.createDataFrame([("a", 1.0, 1.0, 3.0, 3.0)], boxes.schema))
    points = spark.range(40).select(F.col("id").alias("pt_id"), (F.col("id") / 10.0).alias("px"), F.lit(1.5).alias("py"))
    found = geo.covering(points, boxes, 3.0)
    assert most_rows(found) < 1000
    assert {r.pt_id: r.key for r in found.collect()} == {i: "k000" if i < 10 else "a" if i < 30 else None for i in range(40)}


@pytest.mark.parametrize("name", ["streaming_new_connections", "streaming_sessions"])
def test_streams_give_files(spark, name):
    assert Q.QUERIES[name](spark, SF).inputFiles()


def test_sessions_in_any_order_of_rows(spark, tmp_path):
    draw = random.Random(8)
    rows = [(draw.choice("pqrs") if k % 9 else None, draw.choice(["req"] * 12 + ["session_start", "session_end", "other", None]), draw.randrange(3000) / 2, f"n{k}", "c", "GET", draw.choice([None, k, 5 * k])) for k in range(4000)]
    seen = set()
    for k, r in enumerate(rows):  # starts and ends at one time have no order of their own
        if r[1] in ("session_start", "session_end"):
            if (r[0], r[1], r[2]) in seen:
                rows[k] = (r[0], "req", *r[2:])
            seen.add((r[0], r[1], r[2]))
    spark.createDataFrame(rows, S.EVENT).repartition(7).write.json(f"{tmp_path}/in")
    S.sessions(S.read_events(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = []
    for source in ("p", "q", "r", "s", None):
        n, now = 0, None
        for _, kind, ts, label, _, _, size in sorted((r for r in rows if r[0] == source and r[1] in S.RANKS), key=lambda r: (r[2], S.RANKS.index(r[1]))):
            if kind == "req":
                if now:
                    now[5:] = [now[5] + 1, now[6] + (size or 0)]
                continue
            if now:
                now[4] = ts
                want.append(tuple(now))
            now = None
            if kind == "session_start":
                n += 1
                now = [source, n, label, ts, None, 0, 0]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(want, key=str)


def test_requests_are_packed_before_they_meet(spark):
    n = 10000
    b = pa.RecordBatch.from_pydict({"source": ["p"] * n, "record": ["req"] * n, "ts": [float(k) for k in range(n)], "label": ["s1"] * n, "resp_body_bytes": [k * 7919 % 100000 for k in range(n)]})
    (got,) = S._runs(iter([b]))
    assert got.num_rows == 1 and got.nbytes < 4 * n
    assert S._unpacked(got["size"][0].as_py(), np.int64).tolist() == b["resp_body_bytes"].to_pylist()


def test_items_of_a_range_are_held_as_columns(spark, monkeypatch):
    held = []
    monkeypatch.setattr(reader, "_batch", lambda parts, f=reader._batch: held.append(len(parts)) or f(parts))
    n = 20000
    items = pa.array([{"req_id": k, "ly0": 0, "ly1": 1, "lx0": k % 8, "lx1": k % 8 + 1, "dy0": 0, "dx0": 0} for k in range(n)])
    job = {"key": "a", "level": 0, "group_id": -1, "block": 0, "bytecount": 0, "blockw": 8, "itemsize": 2, "dtype": "uint16", "fill": 7.0, "items": [items]}
    got = pa.Table.from_batches(reader._run(None, [job]))
    assert max(held) <= 4096 and got["req_id"].to_pylist() == list(range(n)) and set(got["value"].to_pylist()) == {7.0}
    assert sum(got["blocks"].to_pylist()) == 1


def test_lists_of_requests_stay_short(spark, monkeypatch):
    monkeypatch.setattr(reader, "SLICE", 50)
    transport = D.series(1)
    lake = reader.Lake(spark, catalog.scan(spark.createDataFrame([("day0.tif",)], "key string"), transport), transport)
    asked = spark.range(1000).select(F.col("id").alias("req_id"), F.lit("day0.tif").alias("key"), F.lit(0).alias("level"), (F.col("id") % 100).cast("int").alias("x"), F.lit(3).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    rows = lake.read_frame(asked)
    assert rows.count() == 1000 and rows.agg(F.sum("blocks")).first()[0] == 1  # a tile's lists are one job
    assert re.search(r"ObjectHashAggregate\(keys=\[[^\]]*slice#", plan(rows))
    assert {r.req_id: r.value for r in rows.collect()} == {k: (k % 100 * 7 + 39) % 5000 for k in range(1000)}
