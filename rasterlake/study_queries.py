"""Queries of the study around the reader: request sets, gates, run reports, logs as streams, paths."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import checks, frontier, gates, geo, logs, reports, tiles, workloads
from .plans import driver_tables as D
from .queries import query
from .sources import runs as R
from .streaming import sessions as S


def _u(*parts) -> str:
    """columns.unit in SQL; parts are SQL expressions."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


def _hit(of: str, on: str = "") -> str:
    """Points (pt_id, dataset, px, py) with the least scene that covers each, and its pixel."""
    return f"""SELECT p.*, s.key, s.width, s.height, least(width - 1, floor((px - s.w) / (s.e - s.w) * width))::BIGINT AS gx, (height - 1 - least(height - 1, floor((py - s.s) / (s.n - s.s) * height)))::BIGINT AS gy
  FROM {of} p JOIN (SELECT p.pt_id, min(s.key) AS k FROM {of} p JOIN v_scene s ON s.dataset = p.dataset AND s.w <= px AND px < s.e AND s.s < py AND py <= s.n GROUP BY p.pt_id) h USING (pt_id) JOIN v_scene s ON s.key = h.k"""


@query("SELECT i AS win_id, key, greatest(0, least(width - 512, gx - 256)) AS x, greatest(0, least(height - 512, gy - 256)) AS y, 512::BIGINT AS w, 512::BIGINT AS h FROM (SELECT i, width, height, gx, gy, CASE WHEN dataset = 's2' THEN regexp_extract(key, '^(.*)/[^/]*$', 1) || '/' || b || '.tif' ELSE key END AS key FROM f, (SELECT unnest(['B02', 'B03', 'B04', 'B08']) AS b) WHERE dataset = 's2' OR b = 'B02')",
       f", p AS (SELECT i * 40 + t AS pt_id, i, t, ['dem', 'wc', 's2'][(floor({_u(1, chr(39) + 'family' + chr(39), 'i')} * 3) + 1)::INT] AS dataset, {_u(1, chr(39) + 'x' + chr(39), 'i', 't')} * 10.0::DOUBLE AS px, {_u(1, chr(39) + 'y' + chr(39), 'i', 't')} * 10.0::DOUBLE AS py FROM (SELECT unnest(range(200)) AS i), (SELECT unnest(range(40)) AS t)), q AS ({_hit('p')}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS rn FROM q) WHERE rn = 1)")
def workload_windows(spark, sf):
    """200 windows at random places of random datasets, in four bands where the scene has them."""
    return workloads.windows(spark, D.scenes(spark, sf))


def _bell(axis: str) -> str:
    return "(" + " + ".join(_u(2, f"'{axis}'", "i", k) for k in range(4)) + " - 2) * sqrt(3.0::DOUBLE)"


@query(f"SELECT i AS pt_id, dataset, key, gx AS x, gy AS y, {_u(2, chr(39) + 'visit' + chr(39), 'i')} AS visit FROM ({_hit('p')})",
       f", d AS (SELECT i, floor({_u(2, chr(39) + 'cluster' + chr(39), 'i')} * 40)::BIGINT AS c FROM (SELECT unnest(range(2000)) AS i)), e AS (SELECT *, {_u(2, chr(39) + 'cx' + chr(39), 'c')} * 10.0::DOUBLE AS cx, {_u(2, chr(39) + 'cy' + chr(39), 'c')} * 10.0::DOUBLE AS cy FROM d), g AS (SELECT i, CASE WHEN i >= 1800 THEN {_u(2, chr(39) + 'x' + chr(39), 'i')} * 10.0::DOUBLE ELSE cx + {_bell('dx')} * (15.0::DOUBLE / (111.32::DOUBLE * cos(radians(cy)))) END AS px, CASE WHEN i >= 1800 THEN {_u(2, chr(39) + 'y' + chr(39), 'i')} * 10.0::DOUBLE ELSE cy + {_bell('dy')} * (15.0::DOUBLE / 110.574::DOUBLE) END AS py FROM e), p AS (SELECT i || ':' || dataset AS pt_id, i, dataset, least(10 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, px)) AS px, least(10 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, py)) AS py FROM g, (SELECT unnest(['dem', 'wc']) AS dataset))")
def workload_scattered(spark, sf):
    """2000 points in clusters, one pixel of two layers each."""
    return workloads.scattered(spark, D.scenes(spark, sf), n=2000)


_DENSE = ", d AS (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)), s AS (SELECT *, greatest(1, round_even(sqrt(pow((lon1 - lon) * (111.32::DOUBLE * cos(radians((lat + lat1) / 2))), 2) + pow((lat1 - lat) * 110.574::DOUBLE, 2)) / 10.0::DOUBLE, 0))::BIGINT AS n FROM d WHERE lon1 IS NOT NULL), u AS (SELECT line_id, seq, part, lon + (lon1 - lon) * (part / n) AS lon0, lat + (lat1 - lat) * (part / n) AS lat0, lon + (lon1 - lon) * ((part + 1) / n) AS lon1, lat + (lat1 - lat) * ((part + 1) / n) AS lat1 FROM (SELECT *, unnest(range(n)) AS part FROM s))"


@query("SELECT line_id, seq, part, key, greatest(wx0, gx0) - gx0 AS x, greatest(wy0, gy0) - gy0 AS y, least(wx1 + 1, gx0 + 100) - greatest(wx0, gx0) AS w, least(wy1 + 1, gy0 + 100) - greatest(wy0, gy0) AS h FROM b JOIN v_grid g ON wx0 < gx0 + 100 AND wx1 + 1 > gx0 AND wy0 < gy0 + 100 AND wy1 + 1 > gy0",
       _DENSE + ", k AS (SELECT *, 2.0::DOUBLE / (111.32::DOUBLE * cos(radians((lat0 + lat1) / 2))) AS dx, 2.0::DOUBLE / 110.574::DOUBLE AS dy FROM u), b AS (SELECT line_id, seq, part, floor((least(lon0, lon1) - dx - 4.9::DOUBLE) / 0.0015::DOUBLE)::BIGINT AS wx0, floor((greatest(lon0, lon1) + dx - 4.9::DOUBLE) / 0.0015::DOUBLE)::BIGINT AS wx1, floor((greatest(lat0, lat1) + dy - 45.6::DOUBLE) / -0.0015::DOUBLE)::BIGINT AS wy0, floor((least(lat0, lat1) - dy - 45.6::DOUBLE) / -0.0015::DOUBLE)::BIGINT AS wy1 FROM k)")
def workload_corridors(spark, sf):
    """Windows along lines with two kilometres around, cut at the tiles of a mosaic."""
    return workloads.corridors(D.vertices(spark, sf), geo.mosaic(D.grid_tiles(spark, sf)), (4.9, 45.6, 0.0015, -0.0015), 100, 100, 2.0, 10.0)


_SERIES = ", a AS (SELECT key, width, row_number() OVER (ORDER BY key) - 1 AS d FROM v_stack WHERE key LIKE 's2ts/T1/%' AND key LIKE '%/B04.tif'), c AS (SELECT key, width, row_number() OVER (ORDER BY key) - 1 AS d FROM v_stack WHERE key LIKE 's2ts/T1/%' AND key LIKE '%/SCL.tif'), m AS (SELECT max(d) AS last FROM a), n AS (SELECT max(pt) AS last_pt FROM v_spt), s AS (SELECT d, key, 0 AS band, width FROM a UNION ALL SELECT d, key, 1, width FROM c WHERE d <= (SELECT last FROM m))"
_series = "SELECT ({0}) * 2 + band AS visit, pt, split_part(key, '/', -2) AS date, key, CASE WHEN band = 0 THEN x ELSE x * width // 1000 END AS x, CASE WHEN band = 0 THEN y ELSE y * width // 1000 END AS y FROM v_spt, s, m, n"


@query(_series.format("pt * (last + 1) + d"), _SERIES)
def workload_timeseries_by_point(spark, sf):
    """Every point at every date of a stack in two bands, point by point."""
    return workloads.timeseries(D.stack_points(spark, sf), D.stack(spark, sf), "s2ts/T1/")


@query(_series.format("d * (last_pt + 1) + pt"), _SERIES)
def workload_timeseries_by_date(spark, sf):
    return workloads.timeseries(D.stack_points(spark, sf), D.stack(spark, sf), "s2ts/T1/", "date")


@query("SELECT * FROM (SELECT '1 point' AS shape, 2560 AS x, 2560 AS y, 1 AS w, 1 AS h UNION ALL SELECT '10 points, one tile', 2048 + 17 * k % 1024, 2048 + 91 * k % 1024, 1, 1 FROM r10 UNION ALL SELECT '10 points, scattered', k * 1024 + 31 * (k + 1) % 1024, (9 - k) * 1024 + 57 * (k + 1) % 1024, 1, 1 FROM r10 UNION ALL SELECT 'a row near the top', 1024, 1029, 1024, 1 UNION ALL SELECT 'a row near the end', 1024, 2034, 1024, 1 UNION ALL SELECT 'a whole tile', 1024, 1024, 1024, 1024 UNION ALL SELECT '512 x 512', 512, 512, 512, 512 UNION ALL SELECT '2048 x 2048', 512, 512, 2048, 2048 UNION ALL SELECT '40 windows of 256 x 256', k % 8 * 1024 + 100, k // 8 * 1024 + 100, 256, 256 FROM (SELECT unnest(range(40)) AS k)), (SELECT 'obj/0' AS key) UNION ALL SELECT '5 points, 12 images', 211 * p, 307 * p, 1, 1, 'obj/' || k FROM (SELECT unnest(range(12)) AS k), (SELECT unnest(range(1, 6)) AS p)",
       ", r10 AS (SELECT unnest(range(10)) AS k)")
def workload_shapes(spark, sf):
    """The audit's ten shapes of requests."""
    return workloads.shapes(spark, "obj/0", 1024, series=[f"obj/{k}" for k in range(12)])


@query("SELECT key, pt, x, y FROM (SELECT DISTINCT key FROM v_stack WHERE key LIKE '%/B04.tif'), (SELECT * FROM v_spt WHERE pt < 60)")
def workload_keys_by_points(spark, sf):
    return workloads.keys_by_points(D.stack(spark, sf).filter(F.col("key").endswith("/B04.tif")).select("key").distinct(), D.stack_points(spark, sf).filter("pt < 60"))


@query(f"SELECT key, level, block, \"offset\", bytecount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_u(9, chr(39) + 'tile' + chr(39), 'key', 'level', 'block')}, level, block) AS rn FROM v_tile WHERE bytecount > 0) WHERE rn = 1 ORDER BY {_u(9, chr(39) + 'object' + chr(39), 'key')}, key LIMIT 40")
def workload_sample_tiles(spark, sf):
    """A stored tile at random of each of 40 objects at random."""
    return workloads.sample_tiles(D.tiles(spark, sf), 40)


@query("SELECT dataset, key, w, s, e, n, width, height FROM v_scene WHERE dataset = 's2' AND key LIKE '%/B04.tif'")
def objects_by_dataset_and_band(spark, sf):
    return workloads.select_objects(D.scenes(spark, sf), dataset="s2", band="B04")


@query("SELECT req_id, x, y, w, h FROM (SELECT req_id, greatest(0, floor(x / 4.0)::BIGINT) AS x, greatest(0, floor(y / 4.0)::BIGINT) AS y, least(2745, ceil((x + w) / 4.0)::BIGINT) - greatest(0, floor(x / 4.0)::BIGINT) AS w, least(2745, ceil((y + h) / 4.0)::BIGINT) - greatest(0, floor(y / 4.0)::BIGINT) AS h FROM v_window WHERE level = 0) WHERE w > 0 AND h > 0")
def clip_to_overview(spark, sf):
    """Windows of full size on an overview four times smaller."""
    r = D.windows(spark, sf).filter("level = 0").select("req_id", "x", "y", "w", "h", F.lit(2745).alias("width"), F.lit(2745).alias("height"))
    return workloads.clip_scaled(r, F.lit(4.0))


@query("SELECT req_id, key, x, y FROM v_window WHERE level = 0 AND w <= 100 AND h <= 100")
def small_reads_of_level_0(spark, sf):
    return D.windows(spark, sf).filter("level = 0 and w <= 100 and h <= 100").select("req_id", "key", "x", "y")


@query("SELECT key, level, block, count(*) AS n_items, any_value(\"offset\") AS \"offset\" FROM (SELECT key, level, y // 1024 * 11 + x // 1024 AS block FROM v_point) p JOIN v_tile USING (key, level, block) GROUP BY key, level, block")
def point_batch_tiles(spark, sf):
    """A point for each line item, as one batch: each tile once."""
    found = tiles.items(D.points(spark, sf), D.levels(spark, sf))
    return tiles.jobs(found, D.tiles(spark, sf)).select("key", "level", "block", "n_items", "offset")


@query("SELECT req_id, 'remote/' || substr(key, 5) AS key, x FROM v_window WHERE length(key) % 2 = 0 OR key = 'obj/1'")
def renamed_keys(spark, sf):
    names = D.headers(spark, sf).select("key", F.concat(F.lit("remote/"), F.substring("key", 5, 99)).alias("other")).filter("length(key) % 2 = 0 or key = 'obj/1'")
    return workloads.rename_keys(D.windows(spark, sf).select("req_id", "key", "x"), names)


@query("SELECT key, level, block, n_items, shallow, max(r.\"out\") AS \"out\", max(r.\"out\") // 2048 AS restart_row FROM v_job LEFT JOIN (SELECT key AS rk, block AS rb, \"out\" FROM v_restart) r ON rk = key AND rb = block AND level = 0 AND r.\"out\" <= shallow * 2048 GROUP BY ALL")
def restart_rows(spark, sf):
    """Tiles with the rows asked for and the row at which their restart point lies."""
    found = tiles.fetch_plan(tiles.jobs(tiles.items(D.windows(spark, sf), D.levels(spark, sf)), D.tiles(spark, sf)), D.levels(spark, sf), points=D.restart(spark, sf))
    return found.select("key", "level", "block", "n_items", "shallow", F.col("point.out").alias("out"), F.floor(F.col("point.out") / F.col("row_bytes")).alias("restart_row"))


@query("SELECT scene, cx, cy, round(score, 6) AS score FROM (SELECT vec_id % 4 AS scene, (vec_id // 4 % 2 * 2 + CASE WHEN x % 8 >= 4 THEN 1 ELSE 0 END) AS cx, (vec_id // 8 % 2 * 2 + CASE WHEN x // 8 >= 4 THEN 1 ELSE 0 END) AS cy, avg(v::FLOAT) AS score FROM (SELECT row_id AS vec_id, x, v FROM v_pixel) GROUP BY 1, 2, 3)")
def quadrant_means(spark, sf):
    """Mean score of each quarter of cells of eight by eight pixels."""
    i = F.col("row_id")
    p = D.pixels(spark, sf).select((i % 4).alias("scene"), (F.floor(i / 4) % 2).alias("cx"), (F.floor(i / 8) % 2).alias("cy"), (F.col("x") % 8).alias("x"), F.floor(F.col("x") / 8).alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("v").alias("score"))
    return workloads.quadrant_means(p).withColumn("score", F.round("score", 6))


@query("SELECT scene, level, cells_read, children_scored FROM (SELECT scene, 2 AS level, 4 AS cells_read, 16 AS children_scored FROM q UNION ALL SELECT scene, 1, 6, 24 FROM q UNION ALL SELECT scene, 0, 10, 40 FROM q)",
       ", q AS (SELECT unnest(range(5)) AS scene)")
def hierarchical_descent(spark, sf):
    """Cells read and scored on the way down three levels, keeping 40 % of the quarters."""
    start = spark.range(5).select(F.col("id").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).select("scene", (F.col("c") % 2).alias("cx"), F.floor(F.col("c") / 2).alias("cy"))

    def pixels(level: int, cells: DataFrame) -> DataFrame:
        at = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
        return at.select("scene", "cx", "cy", (F.col("k") % 4).alias("x"), F.floor(F.col("k") / 4).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"), (((F.col("cx") * 4 + F.col("k") % 4) * 7919 + (F.col("cy") * 4 + F.floor(F.col("k") / 4)) * 104729 + F.lit(level)) % 1000).alias("score"))

    return workloads.descend(start, pixels, 3)[1]


@query("SELECT source, count(*) AS blocks, sum(bytecount)::BIGINT AS whole, sum(need)::BIGINT AS oracle, sum(spec)::BIGINT AS spec, sum(short)::BIGINT AS undershoots, round_even(1 - sum(need) / sum(bytecount)::DOUBLE, 4) AS oracle_saving, round_even(1 - sum(spec) / sum(bytecount)::DOUBLE, 4) AS speculative_saving, round_even(sum(short) / greatest(1, count(*))::DOUBLE, 4) AS undershoot_rate FROM g GROUP BY ROLLUP (source)",
       ", e AS (SELECT *, floor(least(bytecount, bytecount * ((\"row\" + 1)::DOUBLE / 1024 + 0.12::DOUBLE)))::BIGINT AS guess FROM v_gate WHERE bytecount > 0), g AS (SELECT *, (guess < need)::BIGINT AS short, CASE WHEN guess < need THEN bytecount ELSE guess END AS spec FROM e)")
def prefix_gate(spark, sf):
    """What whole tiles, exact prefixes and guessed ones cost, by source and in all."""
    return gates.prefix_gate(D.gate_tiles(spark, sf))


@query("SELECT key, block, max(greatest(0, least(1023, h))) AS \"row\" FROM (SELECT key, block, ly1 + w AS h FROM v_item JOIN (SELECT req_id, w FROM v_window) USING (req_id)) GROUP BY key, block")
def deepest_row_of_block(spark, sf):
    w = D.windows(spark, sf).select("req_id", "w")
    r = tiles.items(D.windows(spark, sf), D.levels(spark, sf)).join(w, "req_id").select("key", "block", (F.col("ly1") + F.col("w")).alias("row"), F.lit(1024).alias("blockh"))
    return gates.deepest_rows(r)


_GATE = "SELECT span, count(*) AS tiles, sum(whole)::BIGINT AS whole, sum(prefix)::BIGINT AS prefix, sum(\"fetch\")::BIGINT AS \"fetch\", (sum(\"fetch\") + sum(\"window\"))::BIGINT AS fetch_and_index, sum(decode)::BIGINT AS decode, round_even(sum(points) / count(*)::DOUBLE, 1) AS points_per_tile, round_even(100 * sum(\"index\") / sum(whole)::DOUBLE, 1) AS index_pct, round_even(sum(whole)::DOUBLE / greatest(1, sum(\"fetch\")), 2) AS gain_cached, round_even(sum(whole)::DOUBLE / greatest(1, sum(\"fetch\") + sum(\"window\")), 2) AS gain_remote, round_even(sum(prefix)::DOUBLE / greatest(1, sum(\"fetch\")), 2) AS gain_over_prefix FROM v_cost GROUP BY span"


@query(_GATE)
def restart_gate(spark, sf):
    """Bytes with restart points by span, with and without a cached index."""
    return gates.restart_gate(D.gate_costs(spark, sf))


@query("SELECT 'Restart points' AS approach, span, \"fetch\" AS cached, gain_cached AS cached_gain, fetch_and_index AS remote, gain_remote AS remote_gain, index_pct FROM g UNION ALL SELECT 'Whole tiles', NULL, w, 1.0, w, 1.0, NULL FROM o UNION ALL SELECT 'Prefix', NULL, p, round_even(w / p::DOUBLE, 2), p, round_even(w / p::DOUBLE, 2), NULL FROM o",
       f", g AS ({_GATE}), o AS (SELECT sum(whole)::BIGINT AS w, sum(prefix)::BIGINT AS p FROM v_cost WHERE span = 65536)")
def restart_table(spark, sf):
    return gates.restart_table(D.gate_costs(spark, sf))


@query("SELECT ttfb_s, round(mbps, 6) AS mbps, small, large, " + ", ".join(f"round_even(1 - (ttfb_s + small / ({b} * 1e6::DOUBLE / 8)) / (ttfb_s + large / ({b} * 1e6::DOUBLE / 8)), 3) AS saved_{b}" for b in (50, 200, 1000, 5000)) + " FROM (SELECT median(ttfb) AS ttfb_s, median(mbps) FILTER (bytes >= 262144) AS mbps, min(bytes) AS small, max(bytes) AS large FROM g)",
       ", g AS (SELECT bytes, median(ttfb_s) AS ttfb, bytes * 8 / 1e6::DOUBLE / median(transfer_s) AS mbps FROM (SELECT [16384, 65536, 262144, 1048576][(req % 4 + 1)::INT]::BIGINT AS bytes, 0.1::DOUBLE + (req % 13) / 100.0::DOUBLE AS ttfb_s, 0.01::DOUBLE + (req % 17) / 50.0::DOUBLE AS transfer_s FROM v_log) GROUP BY bytes)")
def link_timing(spark, sf):
    """Latency and bandwidth of a link from timed requests, and what smaller requests save at other bandwidths."""
    r = F.col("req")
    t = D.log(spark, sf).select(F.element_at(F.array(*[F.lit(b).cast("long") for b in (16384, 65536, 262144, 1048576)]), (r % 4 + 1).cast("int")).alias("bytes"), (F.lit(0.1) + (r % 13) / 100.0).alias("ttfb_s"), (F.lit(0.01) + (r % 17) / 50.0).alias("transfer_s"))
    return gates.timing(t).withColumn("mbps", F.round("mbps", 6))


@query("SELECT workload, threads, wall_s, bytes, requests, round_even(first_value(wall_s) OVER w / wall_s, 2) AS speedup, round_even(bytes::DOUBLE / first_value(bytes) OVER w, 3) AS byte_ratio, ok AS no_fewer_requests FROM r JOIN (SELECT workload, bool_and(requests >= 0.95::DOUBLE * f) AS ok FROM (SELECT workload, requests, first_value(requests) OVER (PARTITION BY workload ORDER BY threads) AS f FROM r) GROUP BY workload) USING (workload) WINDOW w AS (PARTITION BY workload ORDER BY threads)",
       ", r AS (SELECT workload, rtt_ms AS threads, sum(wall_s) + 1 AS wall_s, sum(bytes)::BIGINT + 1 AS bytes, sum(requests)::BIGINT AS requests FROM v_run GROUP BY ALL)")
def thread_gate(spark, sf):
    r = D.runs(spark, sf).groupBy("workload", F.col("rtt_ms").alias("threads")).agg((F.sum("wall_s") + 1).alias("wall_s"), (F.sum("bytes") + 1).alias("bytes"), F.sum("requests").alias("requests"))
    return gates.thread_gate(r, 0.95)


@query("SELECT key, level, block, bytecount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bytecount DESC, level, block) AS rn FROM v_tile) WHERE rn = 1")
def largest_tile(spark, sf):
    return gates.largest_tile(D.tiles(spark, sf))


@query("SELECT req_id, key FROM v_window WHERE key = (SELECT key FROM v_window GROUP BY key ORDER BY count(*) DESC, key LIMIT 1) ORDER BY req_id LIMIT 400")
def busiest_object(spark, sf):
    return gates.busiest_object(D.windows(spark, sf)).select("req_id", "key")


@query("SELECT req_id, key, level FROM v_window WHERE req_id < 100")
def first_reads(spark, sf):
    return D.windows(spark, sf).filter("req_id < 100").select("req_id", "key", "level")


# Reports over passes of runs.


@query("SELECT workload, reads_total, min_total_bytes FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY run_file) AS rn FROM v_pass WHERE min_total_bytes > 0) WHERE rn = 1")
def theoretical_report(spark, sf):
    return reports.theoretical_report(D.passes(spark, sf), ("reads_total", "min_total_bytes"))


_TEXT = ", c AS (SELECT workload, config, rtt_ms, format('{:.2f}', byte_amp) || CASE WHEN truncated THEN ' !' ELSE '' END AS bytes_x, format('{:.1f}', req_amp) AS requests_x, format('{:.1f}', wall_s) || 's' AS wall FROM (SELECT *, row_number() OVER (PARTITION BY workload, config, rtt_ms ORDER BY run_file DESC) AS rn FROM v_pass WHERE phase = 'cold') WHERE rn = 1)"


@query("SELECT workload, config, " + ", ".join(f"coalesce(max({c}) FILTER (rtt_ms = {r}), '--') AS \"{r}_{c}\"" for r in (5, 50, 150) for c in ("requests_x", "wall")) + " FROM c GROUP BY workload, config", _TEXT)
def main_report(spark, sf):
    """Amplification and wall time of cold passes as text, by round trip."""
    out = reports.main_report(D.passes(spark, sf), [5, 50, 150])
    return out.select("workload", "config", *[f"{r}_{c}" for r in (5, 50, 150) for c in ("requests_x", "wall")])


@query("SELECT b.workload, b.rtt_ms, b.config, b.byte_amp, d.default_amp, w.bytes AS warm_bytes, w.requests AS warm_requests, round((1 - 1 / b.byte_amp) * 100, 9) AS headroom_pct, round((1 - 1 / b.req_amp) * 100, 9) AS request_headroom_pct FROM t b LEFT JOIN (SELECT workload, rtt_ms, min(byte_amp) AS default_amp FROM v_pass WHERE config = 'DEFAULT' AND phase = 'cold' GROUP BY ALL) d USING (workload, rtt_ms) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workload, rtt_ms, config ORDER BY run_file DESC) AS rn FROM v_pass WHERE phase = 'warm') WHERE rn = 1) w USING (workload, rtt_ms, config)",
       ", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workload, rtt_ms ORDER BY byte_amp, run_file) AS rn FROM v_pass WHERE config LIKE 'TUNED%' AND phase = 'cold') WHERE rn = 1)")
def headroom_with_warm(spark, sf):
    out = reports.headroom_report(D.passes(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("headroom_pct", "request_headroom_pct")})


@query("SELECT count(*) AS passes, sum(bytes)::BIGINT AS bytes FROM v_pass WHERE phase = 'cold' AND NOT truncated")
def whole_cold_passes(spark, sf):
    return R.whole_runs(D.passes(spark, sf)).agg(F.count("*").alias("passes"), F.sum("bytes").alias("bytes"))


@query("SELECT 'gdal' AS component, '3.' || (SELECT min(run_file) % 5 FROM v_pass) AS value UNION ALL SELECT 'curl', '8' UNION ALL SELECT 'HTTP version', string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT 'HTTP/' || (run_file % 3) AS v FROM v_pass)")
def environment_report(spark, sf):
    return reports.environment(D.passes(spark, sf))


@query("SELECT key, 1000000000000 AS size, count(*) - 1 AS overviews, sum(nbx * (nby + CASE WHEN sid % 11 = 3 THEN 1 ELSE 0 END))::BIGINT AS blocks, CASE WHEN any_value(sid) % 7 = 0 THEN 'LZW' ELSE 'DEFLATE' END AS compression, CASE WHEN any_value(sid) % 23 = 9 THEN 'HTTP 404' END AS error FROM v_level GROUP BY key")
def catalog_manifest(spark, sf):
    """Every object of the catalog, its overviews, blocks and compression."""
    return reports.manifest(D.objects(spark, sf))


@query("SELECT block, x, y, v FROM v_cell WHERE block < 3 ORDER BY block, y, x LIMIT 250")
def cells_row_by_row(spark, sf):
    """The first cells of a surface, block by block, row by row."""
    return D.cells(spark, sf).filter("block < 3").orderBy("block", "y", "x").limit(250).select("block", "x", "y", F.when(F.col("v") != -9999.0, F.col("v")).alias("v"))


@query("SELECT quantity, value FROM (SELECT count(*)::VARCHAR AS runs, sum(bytes)::BIGINT::VARCHAR AS bytes, max(requests)::VARCHAR AS most_requests, '--' AS nothing FROM v_run) UNPIVOT (value FOR quantity IN (runs, bytes, most_requests, nothing))")
def summary_unpivoted(spark, sf):
    return reports.unpivoted(D.runs(spark, sf).agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes"), F.max("requests").alias("most_requests"), F.lit(None).cast("long").alias("nothing")))


@query("SELECT source, tiles, round(mean_tile, 6) AS mean_tile, round(needed, 9) AS needed, round(p95, 9) AS p95_ahead, round(mx, 9) AS max_ahead, round(1 - needed, 9) AS saving FROM (SELECT source, count(*) AS tiles, avg(b) AS mean_tile, avg(u) AS needed FROM (SELECT source, key, max(bytecount) AS b, avg(used) AS u FROM p GROUP BY source, key) GROUP BY source) JOIN (SELECT source, quantile_cont(used - rf, 0.95) AS p95, max(used - rf) AS mx FROM p GROUP BY source) USING (source)",
       ", p AS (SELECT source, key, bytecount, (\"row\" + 1) / 1024.0::DOUBLE AS rf, need / bytecount::DOUBLE AS used FROM v_gate WHERE bytecount > 0)")
def prefix_report(spark, sf):
    """Share of a tile that a row needs, and how far bytes run ahead of rows, by source."""
    t = D.gate_tiles(spark, sf).filter("bytecount > 0").select("source", "key", "bytecount", ((F.col("row") + 1) / 1024.0).alias("row_frac"), (F.col("need") / F.col("bytecount")).alias("used_frac"))
    out = reports.prefix_report(t)
    return out.select("source", "tiles", *[F.round(c, n).alias(c) for c, n in (("mean_tile", 6), ("needed", 9), ("p95_ahead", 9), ("max_ahead", 9), ("saving", 9))])


@query("SELECT key, fraction, x / 64.0::DOUBLE AS used_frac FROM (SELECT row_id AS key, x FROM v_pixel), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS fraction) WHERE x = greatest(0, floor(fraction * 64) - 1)")
def used_at_fractions(spark, sf):
    """The value at six shares of the rows of each tile."""
    p = D.pixels(spark, sf).select(F.col("row_id").alias("key"), F.col("x").alias("row"), F.lit(64).alias("rows"), (F.col("x") / 64.0).alias("used_frac"))
    return reports.at_fractions(p)


@query("SELECT workload, config, rtt_ms, req_amp AS value FROM (SELECT *, row_number() OVER (PARTITION BY workload, config, rtt_ms ORDER BY run_file DESC) AS rn FROM v_pass WHERE phase = 'cold') WHERE rn = 1")
def plot_series(spark, sf):
    """The points of plots over round trips."""
    return reports.series(D.passes(spark, sf), "req_amp").select("workload", "config", F.explode("points").alias("p")).select("workload", "config", "p.rtt_ms", "p.value")


def _diagnosis(spark, sf, by="label"):
    need = tiles.required(D.windows(spark, sf), D.levels(spark, sf))
    return logs.diagnose(D.log(spark, sf), D.tiles(spark, sf), need, D.headers(spark, sf), [by])


_DIAG = ", j AS (SELECT l.label, req, t.key, t.level, t.block, bytecount AS size, least(hi + 1, \"offset\" + bytecount) - greatest(lo, \"offset\") AS ov FROM v_log l JOIN v_tile t ON l.key = t.key AND hi >= lo AND bytecount > 0 AND \"offset\" <= hi AND \"offset\" + bytecount > lo), g AS (SELECT label, key, level, block, size, sum(ov)::BIGINT AS got FROM j GROUP BY ALL), m AS (SELECT label, sum(CASE WHEN n.key IS NOT NULL THEN least(size, got) END)::BIGINT AS needed, sum(CASE WHEN n.key IS NOT NULL THEN greatest(0, got - size) END)::BIGINT AS redundant, sum(CASE WHEN n.key IS NULL THEN got END)::BIGINT AS unneeded, count(*) AS blocks, count(*) FILTER (got > size) AS blocks_refetched, max(got / size) AS worst FROM g LEFT JOIN v_need n ON g.key = n.key AND g.level = n.level AND g.block = n.block GROUP BY label), h AS (SELECT label, sum(CASE WHEN hi >= lo THEN greatest(0, least(hi + 1, 4096) - lo) END)::BIGINT AS header, sum(CASE WHEN hi >= lo THEN greatest(0, hi - lo + 1 - greatest(0, least(hi + 1, 4096) - lo) - coalesce(it, 0)) END)::BIGINT AS padding, sum(CASE WHEN hi < lo THEN greatest(0, resp_body_bytes) ELSE 0 END)::BIGINT AS list_and_other FROM v_log LEFT JOIN (SELECT req, sum(ov)::BIGINT AS it FROM j GROUP BY req) USING (req) GROUP BY label), q AS (SELECT label, coalesce(header, 0) AS header, coalesce(needed, 0) AS needed, coalesce(redundant, 0) AS redundant, coalesce(unneeded, 0) AS unneeded, coalesce(padding, 0) AS padding, list_and_other, coalesce(blocks, 0) AS blocks, coalesce(blocks_refetched, 0) AS blocks_refetched, worst FROM h LEFT JOIN m USING (label)), z AS (SELECT *, greatest(1, header + needed + redundant + unneeded + padding + list_and_other) AS total FROM q)"


@query("SELECT label, header, needed, redundant, unneeded, padding, list_and_other, blocks, blocks_refetched, worst, " + ", ".join(f"round_even(100 * {c} / total::DOUBLE, 2) AS {c}_pct" for c in logs.PARTS) + " FROM z", _DIAG)
def diagnosis_by_run(spark, sf):
    """Where the bytes of each labelled log went, with shares."""
    return _diagnosis(spark, sf)


@query("SELECT label AS tag, category, round(top, 2) AS top FROM (SELECT label, [" + ", ".join(f"struct_pack(category := '{c}', top := " + " + ".join(f"round_even(100 * {p} / total::DOUBLE, 2)" for p in ("needed", "redundant", "unneeded", "padding", "header", "list_and_other")[: k + 1]) + ")" for k, c in enumerate(("needed", "redundant", "unneeded", "padding", "header", "list_and_other"))) + "] AS s FROM z), LATERAL (SELECT unnest(s, recursive := true))", _DIAG)
def stacked_shares(spark, sf):
    """What a stacked plot of the shares shows."""
    return reports.stacked(_diagnosis(spark, sf).withColumnRenamed("label", "tag")).select("tag", "category", F.round("top", 2).alias("top"))


@query("SELECT b.workload, b.config, 100.0::DOUBLE * (length(b.config)) AS needed_pct FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY byte_amp, run_file) AS rn FROM v_pass WHERE config LIKE 'TUNED%' AND phase = 'cold' AND rtt_ms = 50) b WHERE rn = 1")
def attribution_report(spark, sf):
    """Diagnosis of each workload's best tuned run, by its tag."""
    p = D.passes(spark, sf)
    diagnosis = p.select("workload", "config").distinct().select(F.concat(F.col("workload"), F.lit("."), F.col("config"), F.lit(".rtt50.cold")).alias("tag"), (F.length("config") * 100.0).alias("needed_pct"))
    return reports.attribution_report(p, diagnosis, 50)


@query("SELECT count(*) AS reads, count(*) FILTER (a.value IS DISTINCT FROM b.value OR a.req IS NULL OR b.req IS NULL) AS mismatches, (SELECT sum(resp_body_bytes)::BIGINT FROM v_log WHERE req % 7 > 0) AS our_bytes, (SELECT count(*) FROM v_log WHERE req % 7 > 0) AS our_requests, (SELECT sum(resp_body_bytes)::BIGINT FROM v_log) AS other_bytes, (SELECT count(*) FROM v_log) AS other_requests, round_even((SELECT sum(resp_body_bytes)::DOUBLE FROM v_log) / (SELECT sum(resp_body_bytes) FROM v_log WHERE req % 7 > 0), 3) AS byte_gain, round_even((SELECT count(*)::DOUBLE FROM v_log) / (SELECT count(*) FROM v_log WHERE req % 7 > 0), 3) AS request_gain FROM (SELECT req, req % 100 + 0.5::DOUBLE AS value FROM v_log WHERE req % 7 > 0) a FULL JOIN (SELECT req, req % 100 + CASE WHEN req % 11 = 0 THEN 1 ELSE 0.5 END::DOUBLE AS value FROM v_log) b ON a.req = b.req")
def verify_values(spark, sf):
    """Values of two readers, pair by pair, and what one saves."""
    log, r = D.log(spark, sf), F.col("req")
    ours = log.filter("req % 7 > 0").select(r.alias("req_id"), (r % 100 + 0.5).alias("value"), F.col("resp_body_bytes").alias("bytes"), F.lit(1).alias("requests"))
    other = log.select(r.alias("req_id"), (r % 100 + F.when(r % 11 == 0, 1.0).otherwise(0.5)).alias("value"), F.col("resp_body_bytes").alias("bytes"), F.lit(1).alias("requests"))
    return reports.verify(ours, other)


@query("SELECT kind, sha256(string_agg(v::VARCHAR || '.5', ',' ORDER BY req)) AS digest, sum(v + 0.5::DOUBLE) AS checksum FROM (SELECT kind, req, req % 100 AS v FROM v_log) GROUP BY kind")
def value_digests(spark, sf):
    v = D.log(spark, sf).select("kind", F.col("req").alias("req_id"), (F.col("req") % 100 + 0.5).alias("value"))
    return reports.digest(v, ["kind"])


@query()
def cost_sweep(spark, sf):
    """Requests and bytes of the plan under five models of cost."""
    plan = tiles.fetch_plan(tiles.jobs(tiles.items(D.windows(spark, sf), D.levels(spark, sf)), D.tiles(spark, sf)), D.levels(spark, sf))
    parts = [tiles.coalesce(plan, tiles.Options(rtt_s=r, bandwidth_mbps=b)).agg(F.count("*").alias("requests"), F.sum("length").alias("bytes"), F.sum("extra_bytes").alias("extra")).select(F.lit(r).alias("rtt_s"), F.lit(float(b)).alias("mbps"), "requests", "bytes", "extra") for r, b in ((0.005, 1000), (0.05, 100), (0.15, 50), (0.05, 10), (0.05, 0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Logs.


@query("SELECT http_version, count(*) AS requests FROM (SELECT 'HTTP/' || (req % 3) AS http_version FROM v_log) GROUP BY 1")
def log_by_version(spark, sf):
    return logs.by_version(D.log(spark, sf).withColumn("http_version", F.concat(F.lit("HTTP/"), (F.col("req") % 3).cast("string"))))


@query("SELECT key, count(*) AS requests, sum(resp_body_bytes)::BIGINT AS bytes FROM v_log GROUP BY key")
def log_by_key(spark, sf):
    return logs.by_key(D.log(spark, sf))


def _ran(stream: DataFrame) -> DataFrame:
    """All that a stream has to give now."""
    at = f"{_checkpoints(stream)}/t_{uuid.uuid4().hex}"
    # to files in the shared folder: a sink in memory would hold all rows in the driver
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def _checkpoints(stream: DataFrame) -> str:
    spark = stream.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp()


def _events(spark, sf):
    return D.session_events(spark.readStream.schema(D.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("SELECT 'proxy' AS source, event_id // 100 + 1 AS session, 's' || (event_id // 100) AS label, min(event_id)::DOUBLE AS started, (event_id // 100 * 100 + 98)::DOUBLE AS ended, count(*) FILTER (event_id % 100 BETWEEN 1 AND 97) AS requests, coalesce(sum(floor(abs(value) * 1000)::BIGINT) FILTER (event_id % 100 BETWEEN 1 AND 97), 0)::BIGINT AS bytes FROM events GROUP BY event_id // 100 HAVING max(event_id % 100) >= 98 AND min(event_id % 100) = 0")
def streaming_sessions(spark, sf):
    """Capture sessions of a stream of records, between their markers."""
    return _ran(S.sessions(_events(spark, sf)))


@query("SELECT DISTINCT label, conn FROM (SELECT 's' || (event_id // 100) AS label, 'c' || (user_id % 50) AS conn, event_id % 100 AS k FROM events) WHERE k NOT IN (0, 98)")
def streaming_new_connections(spark, sf):
    """Connections of a stream's sessions, each once."""
    return _ran(S.new_connections(_events(spark, sf))).select("label", "conn")


# Functions that reports and readers use, over the driver's rows.


@query("SELECT req, nullif(regexp_extract(t, '^bytes (\\d+)-(\\d+)/(\\d+)$', 1), '')::BIGINT AS first, nullif(regexp_extract(t, '^bytes (\\d+)-(\\d+)/(\\d+)$', 2), '')::BIGINT AS last, nullif(regexp_extract(t, '^bytes (\\d+)-(\\d+)/(\\d+)$', 3), '')::BIGINT AS size FROM (SELECT req, CASE WHEN req % 3 = 0 THEN 'bytes */5' ELSE 'bytes ' || req || '-' || (req + 9) || '/' || (req * 10) END AS t FROM v_log)")
def content_ranges(spark, sf):
    r = F.col("req")
    text = F.when(r % 3 == 0, "bytes */5").otherwise(F.concat(F.lit("bytes "), r.cast("string"), F.lit("-"), (r + 9).cast("string"), F.lit("/"), (r * 10).cast("string")))
    a, b, c = C.content_range(text)
    return D.log(spark, sf).select("req", a.alias("first"), b.alias("last"), c.alias("size"))


@query("SELECT req, CASE req % 4 WHEN 0 THEN 'version-id:v' || req WHEN 3 THEN NULL ELSE 'etag:\"' || req || '\"' END AS identity, CASE WHEN req % 5 = 0 OR req % 6 = 0 THEN 'LIST' WHEN req % 7 = 0 THEN 'HEAD' || CASE WHEN \"range\" IS NOT NULL THEN '_RANGE' ELSE '' END ELSE 'GET' || CASE WHEN \"range\" IS NOT NULL THEN '_RANGE' ELSE '' END END AS kind FROM v_log")
def identity_and_kind(spark, sf):
    """The name of an object's version, and the kind of a request."""
    r = F.col("req")
    version = F.when(r % 4 == 0, F.concat(F.lit("v"), r.cast("string"))).when(r % 4 == 1, "null")
    etag = F.when(r % 4 == 3, "  ").otherwise(F.concat(F.lit(' "'), r.cast("string"), F.lit('" ')))
    key = F.when(r % 6 == 0, "").otherwise(F.col("key"))
    method = F.when((r % 7 == 0) & (r % 6 > 0), "HEAD").otherwise("GET")
    kind = C.request_kind(method, F.when(r % 5 == 0, "list-type=2"), key, F.col("range").isNotNull())
    return D.log(spark, sf).select("req", C.identity(version, etag).alias("identity"), kind.alias("kind"))


@query("SELECT key, split_part(key, '/', 1) AS bucket, substr(key, 6) AS object, split_part(key, '/', -2) AS date, regexp_extract(key, '/([^/.]*)[^/]*$', 1) AS band, '/s2ts/a%20b%2B/' || substr(key, 6) AS path FROM (SELECT DISTINCT key FROM v_stack)")
def path_parts(spark, sf):
    """Pieces of a key, and its path with what must be escaped."""
    p = C.key_parts(F.col("key"))
    keys = D.stack(spark, sf).select("key").distinct()
    return keys.select("key", *[v.alias(k) for k, v in p.items()], C.object_path(F.lit("s2ts"), F.concat(F.lit("a b+/"), p["object"])).alias("path"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN -9999.0 ELSE NULL END AS nodata, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 2 THEN -9999.0 ELSE 0.0 END AS fill, event_id % 2 = 0 AS wrapped FROM events")
def nodata_and_wrapping(spark, sf):
    """Values of a nodata tag, what unstored tiles are filled with, and whether bytes begin a zlib stream."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit("\0"))).when(i % 4 == 1, "none").when(i % 4 == 2, "-9999 \0")
    data = F.when(i % 2 == 0, F.unhex(F.lit("789c03"))).otherwise(F.unhex(F.lit("799c03")))
    return D.table(spark, sf, "events").select("event_id", C.nodata_value(text).alias("nodata"), C.sparse_fill(C.nodata_value(text)).alias("fill"), C.zlib_wrapped(data).alias("wrapped"))


@query("SELECT sid, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(abs(lat)::VARCHAR, 2, '0') || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || lpad(abs(lon)::VARCHAR, 3, '0') AS name, lat, lon, 'W1.a_b.rtt' || sid || CASE WHEN sid % 2 = 1 THEN '.bw100' ELSE '' END AS tag, 'a_b.c-d_' || sid AS label, CASE sid % 3 WHEN 0 THEN 'GDAL default' WHEN 1 THEN 'tuned' ELSE 'other' END AS config, (sid + 15) // 16 AS across, sid % 11 AS bx, sid // 11 AS \"by\" FROM (SELECT s_suppkey AS sid, s_suppkey % 90 - 45 AS lat, s_suppkey * 7 % 360 - 180 AS lon FROM supplier)")
def names_and_labels(spark, sf):
    """Names of degree cells and back, tags of runs, labels, blocks across and block numbers."""
    s = F.col("s_suppkey")
    lat, lon = s % 90 - 45, s * 7 % 360 - 180
    name = C.cell_name(lat, lon)
    back = C.parse_cell(name)
    tag = C.run_tag(F.lit("W1"), C.safe_label(F.lit("a b")), s.cast("double"), F.when(s % 2 == 1, 100).otherwise(0))
    config = F.element_at(F.array(F.lit("DEFAULT"), F.lit("TUNED"), F.lit("other")), (s % 3 + 1).cast("int"))
    block = C.block_id(s % 11, F.floor(s / 11), F.lit(11))
    return D.table(spark, sf, "supplier").select(s.alias("sid"), name.alias("name"), back[0].alias("lat"), back[1].alias("lon"), tag.alias("tag"), C.safe_label(F.concat(F.lit("a b.c-d/"), s.cast("string"))).alias("label"), C.config_label(config, {"DEFAULT": "GDAL default", "TUNED": "tuned"}).alias("config"), C.blocks_across(s, F.lit(16)).alias("across"), (block % 11).alias("bx"), F.floor(block / 11).alias("by"))


@query("SELECT req, CASE WHEN n >= 1000000000 THEN format('{:.2f}', n / 1e9::DOUBLE) || ' GB' WHEN n >= 1000000 THEN format('{:.1f}', n / 1e6::DOUBLE) || ' MB' WHEN n >= 1000 THEN (round_even(n / 1e3::DOUBLE, 0)::BIGINT)::VARCHAR || ' kB' ELSE n || ' B' END AS text FROM (SELECT req, [5, 999, 2000, 17000, 3000000, 250500000, 7250000000][(req % 7 + 1)::INT]::BIGINT AS n FROM v_log)")
def size_texts(spark, sf):
    n = F.element_at(F.array(*[F.lit(x).cast("long") for x in (5, 999, 2000, 17000, 3000000, 250500000, 7250000000)]), (F.col("req") % 7 + 1).cast("int"))
    return D.log(spark, sf).select("req", C.size_text(n).alias("text"))


_TM = ", k AS (SELECT pt_id, px, 40 + py AS lat, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n, sqrt(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE)) AS e FROM v_pt), c AS (SELECT *, sin(radians(lat)) AS s, radians(px - 3) AS lam FROM k), t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM c), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] AS a FROM t)"


@query("SELECT pt_id, round(500000 + r * (eta + a[1] * cos(2 * xi) * sinh(2 * eta) + a[2] * cos(4 * xi) * sinh(4 * eta) + a[3] * cos(6 * xi) * sinh(6 * eta) + a[4] * cos(8 * xi) * sinh(8 * eta)), 4) AS east, round(r * (xi + a[1] * sin(2 * xi) * cosh(2 * eta) + a[2] * sin(4 * xi) * cosh(4 * eta) + a[3] * sin(6 * xi) * cosh(6 * eta) + a[4] * sin(8 * xi) * cosh(8 * eta)), 4) AS north FROM (SELECT *, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64 + n ** 6 / 256) AS r FROM x)", _TM)
def utm_places(spark, sf):
    """Places on the UTM grid."""
    east, north = C.utm(F.col("px"), F.col("py") + 40, F.lit(31), F.lit(False))
    return D.box_points(spark, sf).select("pt_id", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@query("SELECT key, size FROM (SELECT 'obj/' || s_suppkey AS key, s_suppkey * 10 AS size, s_suppkey AS s FROM supplier) WHERE s % 3 = 0 OR s % 5 = 0")
def not_staged(spark, sf):
    """Entries that a store does not hold with their size yet."""
    s = F.col("s_suppkey")
    key = F.concat(F.lit("obj/"), s.cast("string")).alias("key")
    t = D.table(spark, sf, "supplier")
    return R.not_staged(t.select(key, (s * 10).alias("size")), t.filter("s_suppkey % 3 > 0").select(key, (s * 10 + F.when(s % 5 == 0, 1).otherwise(0)).alias("size")))


@query("SELECT key AS level_key, level, sum((bytecount = 0)::BIGINT)::BIGINT AS empty_tiles, sum(bytecount)::BIGINT AS sum_bytes FROM v_tile GROUP BY key, level")
def level_details(spark, sf):
    """Unstored tiles and bytes of each level."""
    from .sources.catalog import details

    o = details(D.objects(spark, sf).filter("levels is not null"))
    return o.select(F.col("key").alias("level_key"), F.inline("details")).select("level_key", "level", "empty_tiles", "sum_bytes")


@query("SELECT reason, count(*) AS levels FROM (SELECT DISTINCT sid, level, CASE sid % 6 WHEN 0 THEN 'sizes must be positive' WHEN 1 THEN 'the grid does not match the image' WHEN 2 THEN 'the tile tables do not match the grid' WHEN 3 THEN 'a block is too large' WHEN 4 THEN 'a tile lies outside the object' END AS reason FROM v_level) GROUP BY reason")
def bad_metadata_reasons(spark, sf):
    """Each thing that can be wrong with a level's layout."""
    s = F.split("key", "/")[1].cast("long") % 6
    lv = tiles.levels_of(D.objects(spark, sf).select("key", "size", "nodata", "levels"))
    right = F.when(s == 1, F.ceil(F.col("height") / F.col("blockh")) + 1).otherwise(F.ceil(F.col("height") / F.col("blockh"))).cast("int")
    lv = lv.withColumn("nby", right).withColumn("width", F.when(s == 0, 0).otherwise(F.col("width"))).withColumn("offsets", F.when(s == 2, F.array()).otherwise(F.col("offsets")))
    lv = lv.withColumn("itemsize", F.when(s == 3, 1 << 10).otherwise(F.col("itemsize"))).withColumn("object_size", F.when(s == 4, 5000).otherwise(F.col("object_size")))
    return lv.select(checks.bad_metadata().alias("reason")).groupBy("reason").agg(F.count("*").alias("levels"))


# Paths.


def _surface(spark, n: int = 60) -> DataFrame:
    c = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    wall = (F.col("x") % 20 == 10) & (F.col("y") % 40 < 35)
    return c.withColumn("cost", F.when(wall, float("inf")).otherwise(1.0 + (F.col("x") * 7 + F.col("y") * 13) % 5))


def _save(table: DataFrame, name: str) -> DataFrame:
    spark = table.sparkSession
    path = f"{_checkpoints(table)}/tables/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@query()
def least_cost_distances(spark, sf):
    """Distances from a corner over a surface with walls, settled block by block."""
    return frontier.distances(frontier.least_cost(_surface(spark), (0, 0), _save, 30.0, 40.0, block=16)).withColumn("dist", F.round("dist", 6))


@query()
def search_demand(spark, sf):
    """Cost and demanded blocks of searches between customers' places."""
    import numpy as np

    y, x = np.mgrid[0:64, 0:64]
    cost = np.where((x % 20 == 10) & (y % 40 < 35) | (x >= 60) | (y >= 60), np.inf, 1.0 + (x * 7 + y * 13) % 5)

    def costs(bx: int, by: int):
        own = cost[by * 16 : by * 16 + 16, bx * 16 : bx * 16 + 16] if bx >= 0 and by >= 0 else cost[:0]
        return own if own.size else None

    c = F.col("c_custkey")
    q = D.table(spark, sf, "customer").filter("c_custkey < 40").select(c.alias("query"), (c * 7 % 60).alias("sx"), (c * 11 % 60).alias("sy"), (59 - c).alias("gx"), (c * 3 % 60).alias("gy"))
    out = frontier.demand(q, costs, 16, 30.0, 40.0)
    return out.select("query", "found", F.round("cost", 6).alias("cost"), F.size("path").alias("cells"), F.size("blocks").alias("blocks"))


@query("SELECT i AS query, round(lon0, 6) AS lon0, round(lat0, 6) AS lat0, round(lon1, 6) AS lon1, round(lat1, 6) AS lat1 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS rn FROM q WHERE lon1 > 0.2 AND lon1 < 9.8 AND lat1 > 0.2 AND lat1 < 9.8 AND EXISTS (SELECT 1 FROM v_box WHERE w <= lon0 AND lon0 < e AND s < lat0 AND lat0 <= n) AND EXISTS (SELECT 1 FROM v_box WHERE w <= lon1 AND lon1 < e AND s < lat1 AND lat1 <= n)) WHERE rn = 1",
       f", p AS (SELECT i, t, 0.3::DOUBLE + {_u(5, chr(39) + 'x' + chr(39), 'i', 't')} * (9.7::DOUBLE - 0.3::DOUBLE) AS lon0, 0.3::DOUBLE + {_u(5, chr(39) + 'y' + chr(39), 'i', 't')} * (9.7::DOUBLE - 0.3::DOUBLE) AS lat0, {_u(5, chr(39) + 'bearing' + chr(39), 'i', 't')} * 6.283185307179586::DOUBLE AS b FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(200)) AS t)), q AS (SELECT *, lon0 + 200.0::DOUBLE * sin(b) / (111.32::DOUBLE * cos(radians(lat0))) AS lon1, lat0 + 200.0::DOUBLE * cos(b) / 110.574::DOUBLE AS lat1 FROM p)")
def path_endpoints(spark, sf):
    """Twenty pairs of places some 200 km apart."""
    out = frontier.endpoints(spark, D.boxes(spark, sf), 20, 200.0)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("lon0", "lat0", "lon1", "lat1")])
