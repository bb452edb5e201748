"""Paths, request sets, files of runs and streams against plain loops."""

import heapq
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import study_queries as Q
from rasterlake.operators import frontier, gates, geo, logs, reports, workloads
from rasterlake.plans import driver_tables as D
from rasterlake.sources import runs as R
from rasterlake.streaming import sessions as S

SF = "/root/testdata/sf0.001"


def plain_distances(cost, start, mx, my):
    h, w = cost.shape
    dist = {start: 0.0}
    heap, done = [(0.0, start)], set()
    while heap:
        d, (x, y) = heapq.heappop(heap)
        if (x, y) in done:
            continue
        done.add((x, y))
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                i, j = x + dx, y + dy
                if (dx or dy) and 0 <= i < w and 0 <= j < h and math.isfinite(cost[j, i]):
                    n = d + 0.5 * (cost[y, x] + cost[j, i]) * math.hypot(dx * mx, dy * my)
                    if n < dist.get((i, j), math.inf):
                        dist[i, j] = n
                        heapq.heappush(heap, (n, (i, j)))
    return dist


@pytest.fixture
def save(tmp_path):
    n = []

    def write(table, name):
        n.append(name)
        path = f"{tmp_path}/{name}-{len(n)}"
        table.write.parquet(path)
        return table.sparkSession.read.schema(table.schema).parquet(path)

    return write


def test_paths_over_blocks(spark, save):
    rng = np.random.default_rng(4)
    cost = rng.uniform(1, 9, (23, 31))
    cost[rng.random(cost.shape) < 0.25] = np.inf
    cost[0, 0] = 2.0
    want = plain_distances(cost, (0, 0), 30.0, 40.0)
    cells = spark.createDataFrame([(x, y, float(cost[y, x])) for y in range(23) for x in range(31)], "x long, y long, cost double")
    state = frontier.least_cost(cells, (0, 0), save, 30.0, 40.0, block=8)
    got = {(r.x, r.y): r.dist for r in frontier.distances(state).collect()}
    assert got == pytest.approx(want)
    goal = max(want, key=want.get)
    way = frontier.path(state, goal)
    assert way[0] == (0, 0) and way[-1] == goal
    assert sum(0.5 * (cost[a[1], a[0]] + cost[b[1], b[0]]) * math.hypot((a[0] - b[0]) * 30, (a[1] - b[1]) * 40) for a, b in zip(way, way[1:])) == pytest.approx(want[goal])
    shut = next((x, y) for y in range(23) for x in range(31) if (x, y) not in want)
    assert frontier.path(state, shut) == []

    def costs(bx, by):
        own = cost[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8] if bx >= 0 and by >= 0 else cost[:0]
        return own if own.size else None

    found = frontier.search(costs, (0, 0), goal, 8, 30.0, 40.0)
    assert found["found"] and found["cost"] == pytest.approx(want[goal]) and found["blocks"][0] == (0, 0) and len(set(found["blocks"])) == len(found["blocks"])
    assert not frontier.search(costs, (0, 0), shut, 8, 30.0, 40.0)["found"]
    assert frontier.search(costs, (0, 0), goal, 8, 30.0, 40.0, most=3)["expanded"] == 3


def test_cover_must_be_complete(spark):
    cells = spark.createDataFrame([(0, x, 0, 5.0, x, 0) for x in range(4)], "block long, x long, y long, v double, wgx long, wgy long")
    cover = spark.createDataFrame([(x, 0, 30) for x in range(3)], "wgx long, wgy long, kind int")
    with pytest.raises(Exception, match="land cover"):
        geo.cost_surface(cells, cover, 1.0, 1.0, None).collect()
    assert geo.cost_surface(cells.filter("x < 3"), cover, 1.0, 1.0, None).count() == 3


def test_polylines_keep_inside(spark):
    v = workloads.polylines(spark, 12, tries=80).orderBy("line_id", "seq").collect()
    by = {}
    for r in v:
        by.setdefault(r.line_id, []).append(r)
    assert len(by) == 12 and all([r.seq for r in x] == list(range(6)) for x in by.values())
    assert all(0.15 < r.lon < 9.85 and 0.15 < r.lat < 9.85 for r in v if r.seq)
    for x in by.values():
        km = [math.hypot((a.lon - b.lon) * 111.32 * math.cos(math.radians(a.lat)), (a.lat - b.lat) * 110.574) for a, b in zip(x, x[1:])]
        assert 150 <= sum(km) <= 250 and max(km) - min(km) < 1e-6
    with pytest.raises(ValueError):
        workloads.timeseries(v, v, "x", "other")


def test_request_sets_do_not_depend_on_partitions(spark):
    a = workloads.windows(spark, D.scenes(spark, SF), n=50).collect()
    b = workloads.windows(spark, D.scenes(spark, SF).repartition(7), n=50).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and all(0 <= r.x <= 488 and 0 <= r.y <= 488 for r in a)


def test_specs(spark, tmp_path):
    reads = D.windows(spark, SF)
    facts = R.save_spec(f"{tmp_path}/w", "W", 3, reads, {"n": 1}, levels=D.levels(spark, SF), tiles=D.tiles(spark, SF), headers=D.headers(spark, SF))
    again, table = R.load_spec(spark, f"{tmp_path}/w")
    assert again == json.loads(json.dumps(facts)) and facts["n_reads"] == table.count() == reads.count() and facts["theoretical"]["n_reads"] == reads.count()
    made = R.generate_all({"a": (1, lambda: reads), "b": (2, lambda: 1 / 0)}, str(tmp_path))
    assert made["a"]["n_reads"] == reads.count() and made["b"].startswith("ZeroDivisionError")
    (tmp_path / "s.json").write_text(json.dumps({"name": "W9", "seed": 1, "params": {}, "reads": [["k", 0, 1, 2, 3, 4], ["m", 1, 5, 6, 7, 8]]}))
    assert [tuple(r) for r in R.read_spec_json(spark, f"{tmp_path}/s.json").orderBy("req_id").collect()] == [("W9", 0, "k", 0, 1, 2, 3, 4), ("W9", 1, "m", 1, 5, 6, 7, 8)]


def test_run_files(spark, tmp_path):
    for k, cut in enumerate((False, True)):
        run = {"workload": "W1", "config": "TUNED", "latency_ms": 50, "versions": {"gdal": "3"}, "passes": [{"pass": p, "wall_s": 1.5, "truncated": cut, "metrics": {"bytes_fetched": 10 + k, "requests": 2, "byte_amplification": 1.5, "http_versions": {f"1.{k}": 2}}} for p in ("cold", "warm")]}
        (tmp_path / f"r{k}.json").write_text(json.dumps(run))
    (tmp_path / "r9.json").write_text(json.dumps({"workload": "W1", "config": "X", "latency_ms": 5, "versions": {}, "passes": [{"pass": "cold", "metrics": None}]}))
    runs = R.read_runs(spark, f"{tmp_path}/r*.json")
    assert runs.count() == 5 and [(r.run_file, r.bytes) for r in R.whole_runs(runs).collect()] == [("r0.json", 10)]
    assert {r.value for r in reports.environment(runs).collect()} == {"3", "1.0, 1.1"}
    text = reports.markdown(runs.select("run_file", "bytes", "byte_amp"))
    assert text.count("\n") == 6 and "| r9.json | -- | -- |" in text
    reports.write_csv(runs.select("run_file", "bytes"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 5


def test_catalogs_and_digests(spark, tmp_path):
    found = {"features": [{"id": f"S{k}", "properties": {"datetime": f"2024-01-0{k}T00", "eo:cloud_cover": str(c), "grid:code": "T1"}, "assets": {"B04": {"href": f"u{k}"}}} for k, c in ((1, 7), (2, 3), (3, 3))]}
    entries = R.catalog_entries(spark, json.dumps(found), "json")
    best = R.first_by_tile(entries).first()
    assert (best.key, best.url, best.date) == ("S2/B04.tif", "u2", "2024-01-02")
    with pytest.raises(LookupError):
        R.first_by_tile(entries, spark.createDataFrame([("T1", "B08")], "tile string, band string"))
    (tmp_path / "f").write_bytes(b"abc")
    import hashlib

    assert R.file_digests(spark, f"{tmp_path}/f").first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_logs_gzipped(spark, tmp_path):
    import gzip

    rows = [{"record": "req", "seq": k, "kind": "GET", "key": "a", "resp_body_bytes": k} for k in range(5)] + [{"record": "session_end"}]
    with gzip.open(tmp_path / "log.jsonl.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, rows)))
    assert logs.totals(logs.read(spark, f"{tmp_path}/log.jsonl.gz")).first().bytes == 10


def test_sessions_over_batches(spark, tmp_path):
    events = [("p", "session_start", 0.0, "a"), ("p", "req", 1.0, None), ("p", "req", 2.0, None), ("p", "session_start", 2.0, "b"), ("p", "req", 3.0, None), ("p", "session_end", 3.0, None), ("p", "req", 4.0, None), ("q", "session_end", 1.0, None), ("q", "session_start", 5.0, "c"), ("q", "req", 6.0, None), ("q", "session_end", 7.0, None)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((events[:3], events[3:9], events[9:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"source": s, "record": r, "ts": t, "label": n, "conn": "c", "resp_body_bytes": 5}) for s, r, t, n in part))
        stream = S.sessions(S.read_events(spark, f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("p", 1, "a", 0.0, 2.0, 2, 10), ("p", 2, "b", 2.0, 3.0, 1, 5), ("q", 1, "c", 5.0, 7.0, 1, 5)]


def test_staging_takes_in_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for names in (("a", "b"), ("c",)):
        for n in names:
            (tmp_path / "in" / n).write_bytes(n.encode() * 3)
        S.stage(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["size"] for r in rows) == [3, 3, 3] and len({r.sha256 for r in rows}) == 3


def test_sweep_and_gates(spark):
    rows = {(r.rtt_s, r.mbps): r for r in Q.cost_sweep(spark, SF).collect()}
    assert rows[0.05, 0.0].requests <= rows[0.05, 100.0].requests <= rows[0.05, 10.0].requests and rows[0.05, 0.0].bytes >= rows[0.05, 10.0].bytes
    none = spark.createDataFrame([], "source string, bytecount long, need long, row long, blockh int")
    assert gates.prefix_gate(none).filter("source is not null").count() == 0


def test_top_share_of_any_scores(spark):
    rng = np.random.default_rng(3)
    for scores in ([1.0] * 50, [1.0] * 20 + [2.0] * 20, rng.normal(size=300).tolist(), [0.0]):
        rows = [(0, k, s) for k, s in enumerate(scores)] + [(None, k, s) for k, s in enumerate(scores[:7])]
        got = geo.top_share(spark.createDataFrame(rows, "g int, k int, s double"), "g", "s", "k", 0.4, buckets=8).collect()
        for g in (0, None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
            assert sorted((r.k, r.s) for r in got if r.g == g) == sorted((k, s) for _, k, s in own[: max(1, round(len(own) * 0.4))])


def test_digests_of_bytes(spark):
    import hashlib

    rows = [("a", 2, 0.5), ("a", 1, -3.0), ("b", 1, 7.0)]
    got = {r.g: r.digest for r in reports.digest_bytes(spark.createDataFrame(rows, "g string, req_id long, value double"), ["g"]).collect()}
    assert got == {"a": hashlib.sha256(np.array([-3.0, 0.5], "<f8").tobytes()).hexdigest(), "b": hashlib.sha256(np.array([7.0], "<f8").tobytes()).hexdigest()}
