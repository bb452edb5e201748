"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C

from .operators import checks, geo, logs, reports, tiles
from .plans import driver_tables as D
from .reader import Lake
from .sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Register a function under its name, with the SQL of its rows over D.SQL's tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: D.plain(f(spark, sf))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in more else ''}{D.SQL.strip()}{more.replace('RECURSIVE', '')} {sql}"
        return f

    return add


def _items(spark, sf):
    return tiles.items(D.windows(spark, sf), D.levels(spark, sf))


def _jobs(spark, sf):
    return tiles.jobs(_items(spark, sf), D.tiles(spark, sf))


@query("SELECT n_reads, n_files, n_blocks, n_empty_blocks, min_block_bytes, header_bytes, min_block_bytes + header_bytes AS min_total_bytes, n_blocks + n_files AS min_requests, n_contiguous_runs + n_files AS min_requests_coalesced, n_contiguous_runs, coalescing_pad_bytes FROM (SELECT count(*) AS n_reads, count(DISTINCT key) AS n_files, count(DISTINCT key) * 4096 AS header_bytes FROM v_window), (SELECT count(*) AS n_blocks, count(*) FILTER (bytecount = 0) AS n_empty_blocks, sum(bytecount)::BIGINT AS min_block_bytes FROM v_need JOIN v_tile USING (key, level, block)), (SELECT sum(n_runs)::BIGINT AS n_contiguous_runs, sum(pad_bytes)::BIGINT AS coalescing_pad_bytes FROM r)",
       ", o AS (SELECT t.key, nd.key IS NOT NULL AS need, lag(nd.key IS NOT NULL, 1, false) OVER w AS before, \"offset\" - lag(\"offset\" + bytecount) OVER w AS gap FROM v_tile t LEFT JOIN v_need nd ON t.key = nd.key AND t.level = nd.level AND t.block = nd.block WHERE bytecount > 0 WINDOW w AS (PARTITION BY t.key ORDER BY \"offset\", \"offset\" + bytecount)), r AS (SELECT key, sum(CASE WHEN need AND NOT before THEN 1 ELSE 0 END)::BIGINT AS n_runs, sum(CASE WHEN need AND before THEN greatest(0, gap) ELSE 0 END)::BIGINT AS pad_bytes FROM o GROUP BY key)")
def theoretical_minimum(spark, sf):
    """Least bytes and requests of all windows."""
    return tiles.theoretical(D.windows(spark, sf), D.levels(spark, sf), D.tiles(spark, sf), D.headers(spark, sf))


@query("SELECT level, count(*) AS blocks, sum(bytecount)::BIGINT AS bytes FROM v_need JOIN v_tile USING (key, level, block) GROUP BY level")
def theoretical_per_level(spark, sf):
    return tiles.per_level(D.windows(spark, sf), D.levels(spark, sf), D.tiles(spark, sf))


@query("SELECT * FROM v_item")
def tile_items(spark, sf):
    """Every window cut along the tiles."""
    return _items(spark, sf)


@query("SELECT * FROM v_need")
def required_tiles_distinct(spark, sf):
    return tiles.required(D.windows(spark, sf), D.levels(spark, sf))


@query("SELECT * FROM v_job")
def tile_plan(spark, sf):
    """One job for each touched tile, with its shallowest and deepest row."""
    return _jobs(spark, sf)


@query("SELECT key, sum(CASE WHEN need AND NOT before THEN 1 ELSE 0 END)::BIGINT AS n_runs, sum(CASE WHEN need AND before THEN greatest(0, gap) ELSE 0 END)::BIGINT AS pad_bytes FROM o GROUP BY key",
       ", o AS (SELECT t.key, nd.key IS NOT NULL AS need, lag(nd.key IS NOT NULL, 1, false) OVER w AS before, \"offset\" - lag(\"offset\" + bytecount) OVER w AS gap FROM v_tile t LEFT JOIN v_need nd ON t.key = nd.key AND t.level = nd.level AND t.block = nd.block WHERE bytecount > 0 WINDOW w AS (PARTITION BY t.key ORDER BY \"offset\", \"offset\" + bytecount))")
def contiguous_runs(spark, sf):
    return tiles.runs(D.tiles(spark, sf), tiles.required(D.windows(spark, sf), D.levels(spark, sf)))


@query("SELECT req_px, blk_px, round_even(blk_px / req_px::DOUBLE, 2) AS ratio FROM (SELECT sum(greatest(0, lx1 - greatest(lx0, coalesce(before, 0))))::BIGINT AS req_px FROM s), (SELECT count(*) * 1048576 AS blk_px FROM v_need)",
       ", e AS (SELECT *, unnest(range(ly0, ly1)) AS r FROM v_item), s AS (SELECT lx0, lx1, max(lx1) OVER (PARTITION BY key, level, block, r ORDER BY lx0, lx1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)")
def granularity_union(spark, sf):
    """Pixels asked for, each once, against whole tiles."""
    return tiles.granularity(D.windows(spark, sf), D.levels(spark, sf))


@query("SELECT key, level, block, start, prefix FROM v_fetch")
def prefix_plan(spark, sf):
    """Bytes to fetch of each tile, from its beginning."""
    return tiles.fetch_plan(_jobs(spark, sf), D.levels(spark, sf)).select("key", "level", "block", "start", "prefix")


@query("SELECT key, level, group_id, min(start) AS start, max(total) AS length, count(*) AS n_jobs, max(used) AS job_bytes, greatest(0, max(total) - max(used)) AS extra_bytes FROM f GROUP BY key, level, group_id",
       ", RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, level, block) AS rn FROM v_fetch WHERE bytecount > 0), f AS (SELECT key, level, rn, start, start AS first, prefix AS total, prefix AS used, 1::BIGINT AS jobs, 0::BIGINT AS group_id FROM q WHERE rn = 1 UNION ALL SELECT q.key, q.level, q.rn, q.start, CASE WHEN ok THEN f.first ELSE q.start END, CASE WHEN ok THEN greatest(f.total, q.start + q.prefix - f.first) ELSE q.prefix END, CASE WHEN ok THEN f.used + q.prefix ELSE q.prefix END, CASE WHEN ok THEN f.jobs + 1 ELSE 1 END, CASE WHEN ok THEN f.group_id ELSE f.group_id + 1 END FROM f JOIN q ON q.key = f.key AND q.rn = f.rn + 1, LATERAL (SELECT q.level = f.level AND q.start + q.prefix - f.first <= 134217728 AND q.start + q.prefix - f.first - (f.used + q.prefix) <= 625000 * f.jobs AS ok))")
def coalesce_groups(spark, sf):
    """Ranges to request, joined while that is worth a round trip."""
    return tiles.coalesce(tiles.fetch_plan(_jobs(spark, sf), D.levels(spark, sf))).drop("blocks")


@query("SELECT j.key, j.level, j.block, max(r.\"out\") AS point_out FROM v_job j LEFT JOIN v_restart r ON r.key = j.key AND r.block = j.block AND j.level = 0 AND r.\"out\" <= j.shallow * 2048 GROUP BY j.key, j.level, j.block")
def restart_asof(spark, sf):
    """The restart point that each job would begin at."""
    return tiles.fetch_plan(_jobs(spark, sf), D.levels(spark, sf), points=D.restart(spark, sf)).select("key", "level", "block", F.col("point.out").alias("point_out"))


@query("SELECT key, level, block, CASE WHEN bytecount = 0 THEN 0 WHEN po IS NULL THEN start ELSE \"offset\" + first END AS start, CASE WHEN bytecount = 0 THEN 0 WHEN po IS NULL THEN prefix ELSE trunc(least((bytecount - first)::DOUBLE, greatest(16384.0::DOUBLE, bytecount * (((deep + 1) * 2048 - po)::DOUBLE / 2097152 + 0.03::DOUBLE))))::BIGINT END AS prefix FROM p",
       ", m AS MATERIALIZED (SELECT * FROM v_fetch), p AS (SELECT m.*, CASE WHEN k > 0 THEN k * 262144 END AS po, (bytecount * k) // 8 - CASE WHEN (block + k) % 8 > 0 THEN 1 ELSE 0 END AS first FROM (SELECT *, CASE WHEN level = 0 AND bytecount > 0 THEN least(7, shallow * 2048 // 262144) ELSE 0 END AS k FROM m) m)")
def restart_plan(spark, sf):
    """Bytes to fetch with restart points."""
    return tiles.fetch_plan(_jobs(spark, sf), D.levels(spark, sf), points=D.restart(spark, sf)).select("key", "level", "block", "start", "prefix")


@query("SELECT key, level, block, CASE WHEN n >= 1 THEN greatest(32768, floor(2097152 / n)::BIGINT) END AS span FROM (SELECT *, floor(0.1::DOUBLE * bytecount / 32768) AS n FROM v_tile)")
def restart_budget(spark, sf):
    return D.tiles(spark, sf).select("key", "level", "block", C.restart_span(F.col("bytecount"), F.lit(2097152), 0.1).alias("span"))


@query("SELECT 'obj/' || s_suppkey AS key, CASE WHEN s_suppkey % 5 = 1 THEN 'missing' WHEN s_suppkey % 5 IN (2, 3) OR s_suppkey % 5 = 4 THEN 'stale' ELSE 'fresh' END AS status FROM supplier")
def sidecar_freshness(spark, sf):
    """Sidecars against objects: some are of another size, layout or identity, some of no object."""
    s = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    key = F.concat(F.lit("obj/"), F.col("s").cast("string")).alias("key")
    own = s.select(key, (F.lit(100) + F.when(F.col("s") % 5 == 2, 1).otherwise(0)).alias("source_size"), F.when(F.col("s") % 5 == 3, "b").otherwise("a").alias("layout_hash"), F.when(F.col("s") % 5 == 4, "").otherwise("x").alias("identity"))
    there = s.filter("s % 5 <> 1").select(key, F.lit(100).alias("size"), F.lit("a").alias("layout_hash"), F.when(F.col("s") % 5 == 4, "").otherwise("x").alias("identity"))
    return checks.fresh_sidecars(own, there)


@query("SELECT DISTINCT key, block FROM (SELECT *, lag(o2) OVER w AS po, lag(in_byte) OVER w AS pi FROM (SELECT *, CASE WHEN block % 9 = 4 AND seq = 5 THEN 262144 ELSE \"out\" END AS o2 FROM v_restart) WINDOW w AS (PARTITION BY key, block ORDER BY seq)) WHERE o2 <= po OR in_byte < pi")
def sidecar_order_check(spark, sf):
    p = D.restart(spark, sf).withColumn("out", F.when((F.col("block") % 9 == 4) & (F.col("seq") == 5), 262144).otherwise(F.col("out")))
    return checks.disordered_points(p)


_REASON = "CASE WHEN sid % 23 = 9 THEN 'not described: HTTP 404' WHEN sid % 11 = 3 THEN 'the grid does not match the image' WHEN sid % 7 = 0 THEN 'compression is not Deflate' WHEN sid % 4 = 3 THEN 'unknown predictor' WHEN sid % 17 = 4 THEN 'more than one sample a pixel' WHEN sid % 19 = 6 THEN 'not little-endian' WHEN sid % 4 = 1 AND sid % 13 = 5 THEN 'predictor 2 needs whole numbers' WHEN sid % 4 = 2 AND sid % 13 <> 5 THEN 'predictor 3 needs floating point' END"


@query(f"SELECT DISTINCT key, level, {_REASON} AS reason FROM v_window JOIN v_level USING (key, level)")
def capability_reason(spark, sf):
    """Why each object and level asked for can't be read; null if it can."""
    return checks.reasons(D.objects(spark, sf), D.windows(spark, sf))


@query(f"SELECT req_id, ({_REASON}) IS NULL AS ok FROM v_window JOIN v_level USING (key, level)")
def split_ok_refused(spark, sf):
    ok, no = checks.split(D.objects(spark, sf), D.windows(spark, sf))
    return ok.select("req_id", F.lit(True).alias("ok")).unionByName(no.select("req_id", F.lit(False).alias("ok")))


@query("SELECT req_id, CASE WHEN w % 50 = 0 THEN 'the size must be positive' ELSE 'outside the level' END AS why FROM v_window JOIN v_level USING (key, level) WHERE w % 50 = 0 OR x < 0 OR y < 0 OR x + w > width OR y + h > height")
def window_bounds_reject(spark, sf):
    r = D.windows(spark, sf)
    return checks.out_of_bounds(r.withColumn("w", F.when(F.col("w") % 50 == 0, 0).otherwise(F.col("w"))), D.levels(spark, sf))


@query("SELECT sum(w * h * 2)::BIGINT AS bytes FROM v_window")
def output_bytes(spark, sf):
    return checks.output_bytes(D.windows(spark, sf), D.levels(spark, sf))


@query("SELECT DISTINCT CASE WHEN sid % 6 = 0 THEN key ELSE key || '@L1' END AS missing FROM v_window JOIN v_level USING (key, level) WHERE sid % 6 = 0 OR (sid % 6 = 1 AND level = 1)")
def missing_objects(spark, sf):
    known = D.levels(spark, sf).filter("sid % 6 <> 0 and not (sid % 6 = 1 and level = 1)")
    return tiles.missing(D.windows(spark, sf), known)


@query("SELECT pt_id, px, py, min(key) AS key FROM v_pt LEFT JOIN v_box ON w <= px AND px < e AND s < py AND py <= n GROUP BY pt_id, px, py")
def bbox_covering(spark, sf):
    return geo.covering(D.box_points(spark, sf), D.boxes(spark, sf), 3.0)


@query("SELECT win_id AS pt_id, key, gx - gx0 AS lx, gy - gy0 AS ly FROM (SELECT *, row_number() OVER (PARTITION BY win_id ORDER BY key) AS rn FROM v_win v JOIN v_grid g ON gx >= gx0 AND gx < gx0 + 100 AND gy >= gy0 AND gy < gy0 + 100) WHERE rn = 1")
def mosaic_locate(spark, sf):
    pts = D.grid_windows(spark, sf).select(F.col("win_id").alias("pt_id"), "gx", "gy")
    return geo.locate(pts, geo.mosaic(D.grid_tiles(spark, sf)), 100, 100)


@query("SELECT win_id, key, greatest(gx, gx0) - gx0 AS x, greatest(gy, gy0) - gy0 AS y, least(gx + v.w, gx0 + g.w) - greatest(gx, gx0) AS w, least(gy + v.h, gy0 + g.h) - greatest(gy, gy0) AS h FROM v_win v JOIN v_grid g ON gx < gx0 + g.w AND gx + v.w > gx0 AND gy < gy0 + g.h AND gy + v.h > gy0")
def mosaic_split(spark, sf):
    return geo.split_window(D.grid_windows(spark, sf), geo.mosaic(D.grid_tiles(spark, sf)), 100, 100)


@query("SELECT pt_id, floor((px + 1) / 0.03::DOUBLE)::BIGINT AS gx, floor((py - 20) / -0.03::DOUBLE)::BIGINT AS gy, round(-1 + (floor((px + 1) / 0.03::DOUBLE) + 0.5) * 0.03::DOUBLE, 9) AS wx, round(20 + (floor((py - 20) / -0.03::DOUBLE) + 0.5) * -0.03::DOUBLE, 9) AS wy FROM v_pt")
def affine_roundtrip(spark, sf):
    t = [F.lit(x) for x in (0.03, 0.0, -1.0, 0.0, -0.03, 20.0)]
    gx, gy = C.to_pixel(F.col("px"), F.col("py"), t)
    p = D.box_points(spark, sf).select("pt_id", gx.alias("gx"), gy.alias("gy"))
    wx, wy = C.to_world(F.col("gx"), F.col("gy"), t)
    return p.select("pt_id", "gx", "gy", F.round(wx, 9).alias("wx"), F.round(wy, 9).alias("wy"))


@query("SELECT pt_id, round(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(45 - py) / 2), 2) + cos(radians(py)) * cos(radians(45.0::DOUBLE)) * pow(sin(radians(5 - px) / 2), 2))), 6) AS km FROM v_pt")
def haversine(spark, sf):
    return D.box_points(spark, sf).select("pt_id", F.round(C.haversine_km(F.col("px"), F.col("py"), F.lit(5.0), F.lit(45.0)), 6).alias("km"))


@query("SELECT line_id, seq, part, round(lon + (lon1 - lon) * (part / n), 9) AS lon0, round(lat + (lat1 - lat) * (part / n), 9) AS lat0, round(lon + (lon1 - lon) * ((part + 1) / n), 9) AS lon1, round(lat + (lat1 - lat) * ((part + 1) / n), 9) AS lat1 FROM (SELECT *, unnest(range(n)) AS part FROM s)",
       ", d AS (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)), s AS (SELECT *, greatest(1, round_even(sqrt(pow((lon1 - lon) * 111.32::DOUBLE * cos(radians((lat + lat1) / 2)), 2) + pow((lat1 - lat) * 110.574::DOUBLE, 2)) / 10.0::DOUBLE, 0))::BIGINT AS n FROM d WHERE lon1 IS NOT NULL)")
def corridor_densify(spark, sf):
    out = geo.densify(D.vertices(spark, sf), 10.0)
    return out.select("line_id", "seq", "part", *[F.round(c, 9).alias(c) for c in ("lon0", "lat0", "lon1", "lat1")])


@query("SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.4::DOUBLE, 0)) AS k FROM n) WHERE rn <= k",
       ", n AS (SELECT vec_id, label::BIGINT AS label, CASE WHEN r + i > 0 THEN ((i - r) / greatest((r + i)::DOUBLE, 1.0))::FLOAT::DOUBLE ELSE 0.0 END AS score FROM (SELECT vec_id, label, floor(abs(embedding[1]::DOUBLE) * 1000)::BIGINT AS r, floor(abs(embedding[2]::DOUBLE) * 1000)::BIGINT AS i FROM embeddings))")
def ndvi_topk(spark, sf):
    """Vegetation index scores, the best 40 % of each group."""
    e = D.table(spark, sf, "embeddings")
    band = lambda k: F.floor(F.abs(F.col("embedding")[k].cast("double")) * 1000).cast("long")
    return geo.top_share(e.select("label", "vec_id", C.ndvi(band(0), band(1)).cast("double").alias("score")), "label", "score", "vec_id", 0.4)


@query("SELECT row_id, x, (((sum(v) OVER (PARTITION BY row_id ORDER BY x ROWS UNBOUNDED PRECEDING))::BIGINT % 65536) + 65536) % 65536 AS value FROM v_pixel")
def predictor2_undo(spark, sf):
    return geo.undo_predictor2(D.pixels(spark, sf), 16)


@query("SELECT req_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY req_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM v_window) WHERE n <= 12 OR list_contains(list_transform(range(12), lambda k: floor(k * (n / 12.0::DOUBLE))::BIGINT), i)")
def every_kth(spark, sf):
    return geo.every_kth(D.windows(spark, sf).select("req_id", "key"), "key", "req_id", 12)


@query("SELECT key, \"by\", bx, least FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY least DESC, \"by\", bx) AS rn FROM (SELECT key, block // 11 AS \"by\", block % 11 AS bx, min(bytecount) OVER w AS least, count(*) OVER w AS got FROM v_tile WHERE level = 0 WINDOW w AS (PARTITION BY key, block // 11 ORDER BY block % 11 ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE got = 4 AND least > 0) WHERE rn = 1")
def adjacent_blocks(spark, sf):
    return geo.adjacent(D.tiles(spark, sf).filter("level = 0"), 11, 4)


@query("SELECT g.block, g.x, g.y, round(slope, 9) AS slope, CASE WHEN raw IS NULL THEN NULL ELSE (coalesce(map {0: 1e6, 10: 1.6, 20: 1.3, 30: 1.0, 40: 1.1, 50: 2.0, 60: 1.0, 70: 3.0, 80: 50.0, 90: 3.0, 95: 5.0, 100: 1.2}[kind]::DOUBLE, 1.5) * (1 + 0.08::DOUBLE * slope))::FLOAT::DOUBLE END AS cost FROM g JOIN v_cover ON wgx = floor((x + 0.5) / 3) AND wgy = floor((y + 0.5) / 3)",
       ", f AS (SELECT block, x, y, v AS raw, coalesce(v, avg(v) OVER (PARTITION BY block)) AS v FROM v_cell), h AS (SELECT *, (coalesce(lead(v) OVER wx, v) - coalesce(lag(v) OVER wx, v)) / (CASE WHEN x IN (0, 9) THEN 1 ELSE 2 END * 30.0::DOUBLE) AS gx, (coalesce(lead(v) OVER wy, v) - coalesce(lag(v) OVER wy, v)) / (CASE WHEN y IN (0, 9) THEN 1 ELSE 2 END * 40.0::DOUBLE) AS gy FROM f WINDOW wx AS (PARTITION BY block, y ORDER BY x), wy AS (PARTITION BY block, x ORDER BY y)), g AS (SELECT *, greatest(0.0, least(45.0, degrees(atan(sqrt(gx * gx + gy * gy))))) AS slope FROM h)")
def cost_surface(spark, sf):
    """Slope and travel cost of cells; null where the height is unknown."""
    out = geo.cost_surface(D.cells(spark, sf), D.cover(spark), 30.0, 40.0, -9999.0)
    cost = F.col("cost").cast("double")
    return out.select("block", "x", "y", F.round("slope", 9).alias("slope"), F.when(cost != float("inf"), cost).alias("cost"))


@query("SELECT kind, count(*) AS requests, sum(resp_body_bytes)::BIGINT AS bytes FROM v_log GROUP BY kind")
def log_metrics_by_kind(spark, sf):
    return logs.metrics(D.log(spark, sf))


@query("SELECT count(*) AS requests, sum(resp_body_bytes)::BIGINT AS bytes, count(DISTINCT key) AS keys, count(DISTINCT conn) AS connections, round(avg(resp_body_bytes) FILTER (\"range\" IS NOT NULL), 6) AS mean_range_bytes, round(sum(resp_body_bytes) / 1e6::DOUBLE, 9) AS byte_amplification, round(count(*) / 100.0::DOUBLE, 9) AS request_amplification FROM v_log")
def log_totals(spark, sf):
    out = logs.totals(D.log(spark, sf), 1e6, 100.0)
    return out.select("requests", "bytes", "keys", "connections", F.round("mean_range_bytes", 6).alias("mean_range_bytes"), F.round("byte_amplification", 9).alias("byte_amplification"), F.round("request_amplification", 9).alias("request_amplification"))


@query("SELECT kind, count(*) FILTER (status = 206) AS \"206\", count(*) FILTER (status = 404) AS \"404\" FROM v_log GROUP BY kind")
def log_status_pivot(spark, sf):
    return logs.status_pivot(D.log(spark, sf), [206, 404])


@query("SELECT req, label, row_number() OVER (PARTITION BY label ORDER BY ts, req) - 1 AS seq, row_number() OVER (PARTITION BY label, conn ORDER BY ts, req) = 1 AS new_conn FROM v_log")
def new_connection_seq(spark, sf):
    return logs.sequence(D.log(spark, sf)).select("req", "label", "seq", "new_conn")


@query("SELECT req, CASE req % 4 WHEN 0 THEN NULL WHEN 1 THEN lo WHEN 2 THEN lo ELSE greatest(0, 1000000 - resp_body_bytes) END AS lo, CASE req % 4 WHEN 0 THEN NULL WHEN 1 THEN hi WHEN 2 THEN 999999 ELSE 999999 END AS hi FROM v_log")
def range_header_parse(spark, sf):
    r = F.col("req") % 4
    text = F.when(r == 0, "none").when(r == 1, F.concat(F.lit("bytes="), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit(",5-6"))).when(r == 2, F.concat(F.lit("bytes="), F.col("lo").cast("string"), F.lit("-"))).otherwise(F.concat(F.lit("bytes=-"), F.col("resp_body_bytes").cast("string")))
    lo, hi = C.range_bounds(text, F.lit(1000000).cast("long"))
    return D.log(spark, sf).select("req", lo.alias("lo"), hi.alias("hi"))


@query("SELECT (SELECT sum(ih)::BIGINT FROM h) AS header, coalesce(sum(CASE WHEN need THEN least(size, got) END), 0)::BIGINT AS needed, coalesce(sum(CASE WHEN need THEN greatest(0, got - size) END), 0)::BIGINT AS redundant, coalesce(sum(CASE WHEN NOT need THEN got END), 0)::BIGINT AS unneeded, (SELECT sum(greatest(0, hi - lo + 1 - ih - it))::BIGINT FROM h) AS padding, count(*) AS blocks, count(*) FILTER (got > size) AS blocks_refetched FROM m",
       ", j AS (SELECT req, t.key, t.level, t.block, bytecount AS size, least(hi + 1, \"offset\" + bytecount) - greatest(lo, \"offset\") AS ov FROM v_log l JOIN v_tile t ON l.key = t.key AND hi >= lo AND bytecount > 0 AND \"offset\" <= hi AND \"offset\" + bytecount > lo), g AS (SELECT key, level, block, size, sum(ov)::BIGINT AS got FROM j GROUP BY ALL), m AS (SELECT g.*, n.key IS NOT NULL AS need FROM g LEFT JOIN v_need n ON g.key = n.key AND g.level = n.level AND g.block = n.block), h AS (SELECT l.lo, l.hi, greatest(0, least(hi + 1, 4096) - lo) AS ih, coalesce(it, 0) AS it FROM v_log l LEFT JOIN (SELECT req, sum(ov)::BIGINT AS it FROM j GROUP BY req) USING (req) WHERE hi >= lo)")
def byte_attribution(spark, sf):
    """Where the log's bytes went."""
    need = tiles.required(D.windows(spark, sf), D.levels(spark, sf))
    return logs.attribution(D.log(spark, sf), D.tiles(spark, sf), need, D.headers(spark, sf))


@query("SELECT workload, config, count(DISTINCT rtt_ms) AS points, count(DISTINCT struct_pack(b := bytes, r := requests)) AS variants FROM v_run GROUP BY workload, config HAVING points >= 2 AND variants > 1")
def rtt_invariance(spark, sf):
    return logs.rtt_violations(D.runs(spark, sf))


@query("SELECT workload, rtt_ms, config, byte_amp, req_amp, wall_s, bytes, requests, run_file FROM v_best")
def best_tuned(spark, sf):
    return reports.best_tuned(D.runs(spark, sf))


@query("SELECT b.workload, b.rtt_ms, b.config, b.byte_amp, d.default_amp, round((1 - 1 / b.byte_amp) * 100, 9) AS headroom_pct FROM v_best b LEFT JOIN (SELECT workload, rtt_ms, min(byte_amp) AS default_amp FROM v_run WHERE config = 'DEFAULT' GROUP BY ALL) d USING (workload, rtt_ms)")
def headroom_report(spark, sf):
    return reports.headroom(D.runs(spark, sf)).withColumn("headroom_pct", F.round("headroom_pct", 9))


@query("SELECT workload, config, " + ", ".join(f'min(bytes) FILTER (rtt_ms = {r}) AS "{r}_bytes", max(requests) FILTER (rtt_ms = {r}) AS "{r}_requests"' for r in (5, 50, 150)) + " FROM v_run GROUP BY workload, config")
def pivot_rtt(spark, sf):
    one = D.runs(spark, sf).groupBy("workload", "config", "rtt_ms").agg(F.min("bytes").alias("bytes"), F.max("requests").alias("requests"))
    return reports.pivot_rtt(one, [5, 50, 150], ("bytes", "requests"))


@query("SELECT c.workload, c.config, c.bandwidth, capped_s, free_s, round(capped_s / nullif(free_s, 0), 9) AS slowdown FROM (SELECT workload, config, 100::BIGINT AS bandwidth, min(wall_s) AS capped_s FROM v_run WHERE rtt_ms = 150 GROUP BY ALL) c LEFT JOIN (SELECT workload, config, min(wall_s) AS free_s FROM v_run WHERE rtt_ms = 50 GROUP BY ALL) f USING (workload, config)")
def bandwidth_slowdown(spark, sf):
    r = D.runs(spark, sf)
    out = reports.slowdown(r.filter("rtt_ms = 50"), r.filter("rtt_ms = 150").withColumn("bandwidth", F.lit(100)))
    return out.select("workload", "config", "bandwidth", "capped_s", "free_s", F.round("slowdown", 9).alias("slowdown"))


@query("SELECT workload, threads, wall_s, bytes, round(first_value(wall_s) OVER w / wall_s, 9) AS speedup, round(bytes / first_value(bytes) OVER w::DOUBLE, 9) AS byte_ratio FROM (SELECT workload, rtt_ms AS threads, sum(wall_s) + 1 AS wall_s, sum(bytes)::BIGINT + 1 AS bytes FROM v_run GROUP BY ALL) WINDOW w AS (PARTITION BY workload ORDER BY threads)")
def multithread_speedup(spark, sf):
    r = D.runs(spark, sf).groupBy("workload", F.col("rtt_ms").alias("threads")).agg((F.sum("wall_s") + 1).alias("wall_s"), (F.sum("bytes") + 1).alias("bytes"))
    return reports.speedup(r).select("workload", "threads", "wall_s", "bytes", F.round("speedup", 9).alias("speedup"), F.round("byte_ratio", 9).alias("byte_ratio"))


@query("SELECT config AS label, count(*) AS n, median(requests) AS requests, median(bytes) AS bytes, median(wall_s) AS wall_s, min(wall_s) AS min_s, max(wall_s) AS max_s, count(DISTINCT requests) = 1 AS same, round((SELECT median(bytes) FROM v_run WHERE config = 'DEFAULT') / median(bytes), 9) AS gain FROM v_run GROUP BY config")
def bench_median(spark, sf):
    rows = D.runs(spark, sf).select(F.col("config").alias("label"), "requests", "bytes", "wall_s", F.col("requests").alias("digest"))
    return reports.bench(rows, "DEFAULT").withColumn("gain", F.round("gain", 9))


@query("SELECT round(avg(u), 9) AS mean_used, round(max(u - r), 9) AS max_ahead, round(quantile_cont(u - r, 0.95), 9) AS p95_ahead FROM (SELECT (bytecount % 1000) / 1000.0::DOUBLE AS u, (block % 100) / 100.0::DOUBLE AS r FROM v_tile)")
def prefix_percentiles(spark, sf):
    t = D.tiles(spark, sf).select(((F.col("bytecount") % 1000) / 1000.0).alias("used_frac"), ((F.col("block") % 100) / 100.0).alias("row_frac"))
    return reports.prefix_statistics(t).select(*[F.round(c, 9).alias(c) for c in ("mean_used", "max_ahead", "p95_ahead")])


@query("SELECT coalesce(dataset, 'Total') AS dataset, count(*) AS objects, sum(size)::BIGINT AS bytes, sum(blocks)::BIGINT AS blocks FROM (SELECT 'set' || (sid % 3) AS dataset, sum(bytecount)::BIGINT AS size, count(*) AS blocks FROM v_tile GROUP BY sid) GROUP BY ROLLUP (dataset)")
def corpus_rollup(spark, sf):
    o = D.tiles(spark, sf).groupBy("sid").agg(F.sum("bytecount").alias("size"), F.count("*").alias("blocks")).withColumn("dataset", F.concat(F.lit("set"), (F.col("sid") % 3).cast("string")))
    return reports.corpus(o)


@query("SELECT *, log_bytes - debug_bytes AS delta, ((log_bytes - debug_bytes) % 1000 + 1000) % 1000 = 0 AS whole_chunks FROM (SELECT count(*) AS debug_ranges, sum(resp_body_bytes)::BIGINT AS debug_bytes FROM v_log WHERE req % 5 > 0 AND resp_body_bytes > 0), (SELECT count(*) AS log_ranges, sum(resp_body_bytes)::BIGINT AS log_bytes FROM v_log)")
def crosscheck_delta(spark, sf):
    log = D.log(spark, sf)
    line = F.concat(F.lit("vsis3: downloading "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    return logs.debug_delta(log.filter("req % 5 > 0 and resp_body_bytes > 0").select(line.alias("line")), log.select(F.col("resp_body_bytes").alias("bytes")), 1000)


@query("SELECT a.config AS shape, round_even(b.bytes / a.bytes::DOUBLE, 3) AS gain, a.d = b.d AS same, a.bytes > b.bytes AS worse FROM (SELECT config, sum(bytes)::BIGINT AS bytes, count(*) % 2 AS d FROM v_run WHERE rtt_ms = 5 GROUP BY 1) a JOIN (SELECT config, sum(bytes)::BIGINT AS bytes, count(*) % 2 AS d FROM v_run WHERE rtt_ms = 50 GROUP BY 1) b USING (config)")
def shape_gain(spark, sf):
    side = lambda ms: D.runs(spark, sf).filter(f"rtt_ms = {ms}").groupBy(F.col("config").alias("shape")).agg(F.sum("bytes").alias("bytes"), (F.count("*") % 2).alias("digest"))
    return reports.shape_gain(side(5), side(50))


@query("SELECT c_custkey AS pt_id, k AS date, c_custkey * 10 + k AS req_id FROM customer, (SELECT unnest(range(6)) AS k)")
def timeseries_cross(spark, sf):
    """Every point at every date."""
    p = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("pt_id"))
    return p.select("pt_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("date")).withColumn("req_id", F.col("pt_id") * 10 + F.col("date"))


@query("SELECT c_custkey * 10 + k AS req_id, CASE WHEN k = 2 AND x >= 256 AND x < 512 AND y >= 256 AND y < 512 THEN 0.0 ELSE ((x * 7 + y * 13 + k * 31) % 5000)::DOUBLE END AS value FROM (SELECT c_custkey, (c_custkey * 37) % 600 AS x, (c_custkey * 91) % 600 AS y FROM customer), (SELECT unnest(range(6)) AS k)")
def sample_timeseries(spark, sf):
    """Pixel values of points at six dates, read from compressed tiles."""
    transport = D.series()
    keys = spark.createDataFrame([(k,) for k in transport.files], "key string")
    lake = Lake(spark, catalog.scan(keys, transport), transport)
    c = F.col("c_custkey")
    p = D.table(spark, sf, "customer").select(c, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    req = p.select((c * 10 + F.col("k")).alias("req_id"), F.concat(F.lit("day"), F.col("k").cast("string"), F.lit(".tif")).alias("key"), F.lit(0).alias("level"), (c * 37 % 600).cast("int").alias("x"), (c * 91 % 600).cast("int").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return lake.sample_frame(req).select("req_id", "value")


from . import study_queries  # noqa: E402, F401  (registers its queries)
