"""Raster-shaped tables derived from the driver's star schema, by whole-number formulas, in Spark and as SQL.

An object per supplier with two levels (121 and 36 tiles), a window per order, a point per line
item, a request log and runs from events, pixels from embeddings, scenes and image stacks from
suppliers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tiff import write
from ..sources.transport import Range

WIDTH, NBX, TILES = (10980, 5490), (11, 6), (121, 36)
TILES_A_TASK = 100_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others as double: the types that SQL gives."""
    kinds = {"tinyint": "long", "smallint": "long", "int": "long", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes])


def count_of(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, name).count()


def levels(spark: SparkSession, sf: str) -> DataFrame:
    two = F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(WIDTH[k]).alias("width"), F.lit(WIDTH[k]).alias("height"), F.lit(1024).alias("blockw"), F.lit(1024).alias("blockh"), F.lit(NBX[k]).alias("nbx"), F.lit(NBX[k]).alias("nby"), F.lit(2).alias("itemsize")) for k in (0, 1)]))
    return table(spark, sf, "supplier").select(F.concat(F.lit("obj/"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_suppkey").alias("sid"), two)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    # the file is small and its rows become many: objects are dealt out before, so that a task makes some 100,000 tiles however many there are
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"))
    s = s.repartition(1 + count_of(spark, sf, "supplier") * sum(TILES) // TILES_A_TASK, "sid")
    t = s.select("sid", F.explode(F.sequence(F.lit(0), F.lit(sum(TILES) - 1))).alias("g"))
    size = F.when((F.col("sid") * 7 + F.col("g") * 13) % 17 == 0, 0).otherwise(20000 + (F.col("sid") * 7919 + F.col("g") * 104729) % 1700000).cast("long")
    t = t.withColumn("bytecount", size).withColumn("level", F.when(F.col("g") < TILES[0], 0).otherwise(1))
    w = Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(F.concat(F.lit("obj/"), F.col("sid").cast("string")).alias("key"), "sid", "level", (F.col("g") - TILES[0] * F.col("level")).alias("block"), (4096 + F.coalesce(F.sum(F.col("bytecount") + 8).over(w), F.lit(0))).alias("offset"), "bytecount")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("obj/"), F.col("s_suppkey").cast("string")).alias("key"), F.lit(4096).cast("long").alias("header_bytes"))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with their levels, some of which this engine refuses."""
    lv = levels(spark, sf)
    t = tiles(spark, sf).groupBy("key", "level").agg(F.array_sort(F.collect_list(F.struct("block", "offset", "bytecount"))).alias("t"))
    s = F.col("sid")
    one = F.struct(
        "level", F.lit(False).alias("is_mask"), "width", "height", "blockw", "blockh", "nbx", F.when(s % 11 == 3, F.col("nby") + 1).otherwise(F.col("nby")).alias("nby"), F.lit(1).alias("nplanes"), F.when(s % 13 == 5, "float16").otherwise("uint16").alias("dtype"), "itemsize",
        F.when(s % 17 == 4, 3).otherwise(1).alias("samples"), F.lit(1).alias("planar"), F.when(s % 7 == 0, 5).otherwise(8).alias("compression"), (1 + s % 4).cast("int").alias("predictor"), F.when(s % 19 == 6, ">").otherwise("<").alias("byteorder"), F.col("t.offset").alias("offsets"), F.col("t.bytecount").alias("bytecounts"),
    )
    full = lv.join(t, ["key", "level"]).groupBy("key", "sid").agg(F.array_sort(F.collect_list(one)).alias("levels"))
    return full.select("key", F.lit(10**12).alias("size"), F.lit(False).alias("bigtiff"), F.lit(None).cast("double").alias("nodata"), F.concat(F.lit("etag:"), s.cast("string")).alias("identity"), F.when(s % 23 == 9, "HTTP 404").alias("error"), F.lit(4096).cast("long").alias("header_bytes"), F.lit(None).cast("array<double>").alias("transform"), F.lit(None).cast("int").alias("epsg"), "levels")


def windows(spark: SparkSession, sf: str, partial: bool = True) -> DataFrame:
    n = count_of(spark, sf, "supplier")
    o = table(spark, sf, "orders").withColumn("level", F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    wide = F.when(F.col("level") == 1, WIDTH[1]).otherwise(WIDTH[0]) - 50
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("req_id"), F.concat(F.lit("obj/"), (c % n).cast("string")).alias("key"), "level", ((k * 7919) % wide - 20).cast("int").alias("x"), ((c * 104729 + k * 31) % wide - 20).cast("int").alias("y"), (1 + k % 480).cast("int").alias("w"), (1 + c % 480).cast("int").alias("h"))


def restart(spark: SparkSession, sf: str) -> DataFrame:
    t = tiles(spark, sf).filter("bytecount > 0 and level = 0").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return t.select("key", "block", "seq", (F.col("seq") * 262144).cast("long").alias("out"), F.floor(F.col("bytecount") * F.col("seq") / 8).alias("in_byte"), ((F.col("block") + F.col("seq")) % 8).cast("int").alias("bits"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    n = count_of(spark, sf, "supplier")
    e = table(spark, sf, "events")
    size = F.floor(F.abs("value") * 1000).cast("long")
    lo = (F.col("event_id") * 65537) % 90000000
    return e.select(F.col("event_id").alias("req"), F.col("event_id").alias("ts"), (F.col("event_id") % 3).cast("string").alias("label"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conn"), F.col("event_type").alias("kind"), F.concat(F.lit("obj/"), (F.col("user_id") % n).cast("string")).alias("key"), lo.alias("lo"), (lo + size - 1).alias("hi"), size.alias("resp_body_bytes"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("bytes="), lo.cast("string"), F.lit("-"), (lo + size - 1).cast("string"))).alias("range"), F.when(F.col("event_id") % 10 == 0, 404).otherwise(206).alias("status"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    size = F.floor(F.abs("value") * 1000).cast("long")
    config = F.element_at(F.array(*[F.lit(x) for x in ("DEFAULT", "TUNED16", "TUNED256", "TUNED1M", "MT")]), (i % 5 + 1).cast("int"))
    rtt = F.element_at(F.array(F.lit(5), F.lit(50), F.lit(150)), (F.floor(i / 5) % 3 + 1).cast("int"))
    return e.select(F.col("event_type").alias("workload"), config.alias("config"), rtt.alias("rtt_ms"), i.alias("run_file"), size.alias("bytes"), (i % 7).alias("requests"), (F.floor(i / 7) % 100).cast("double").alias("wall_s"), (1 + size / 65536).alias("byte_amp"), (1 + (i % 8) / 8).alias("req_amp"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.col("n_name").alias("key"), (k % 5 * 2).cast("double").alias("w"), (F.floor(k / 5) * 2).cast("double").alias("s"), (k % 5 * 2 + 3).cast("double").alias("e"), (F.floor(k / 5) * 2 + 3).cast("double").alias("n"))


def box_points(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("pt_id"), ((c * 37 % 520) / 40.0 - 1).alias("px"), ((c * 91 % 520) / 40.0 - 1).alias("py"))


def grid_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """25 tiles of 100 x 100 pixels of half a unit, some of them overlapping by 10."""
    k = F.col("n_nationkey")
    gx, gy = k % 5 * 90, F.floor(k / 5) * 100
    return table(spark, sf, "nation").select(F.lpad(k.cast("string"), 2, "0").alias("key"), F.lit(0.5).alias("a"), (1000 + gx * 0.5).alias("c"), F.lit(-0.5).alias("e"), (2000 - gy * 0.5).alias("f"), F.lit(100).alias("w"), F.lit(100).alias("h"))


def grid_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("win_id"), (c * 53 % 430).alias("gx"), (c * 97 % 470).alias("gy"), (1 + c % 150).alias("w"), (1 + c * 3 % 150).alias("h"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select((o % 500).alias("line_id"), o.alias("seq"), (5 + (o * 7919 % 1000) / 2000.0).alias("lon"), (45 + (o * 104729 % 1000) / 2000.0).alias("lat"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 10 x 10 heights from parts, some unknown, with the cover cell of each centre."""
    p = F.col("p_partkey")
    x, y = p % 10, F.floor(p / 10) % 10
    return table(spark, sf, "part").select(F.floor(p / 100).alias("block"), x.alias("x"), y.alias("y"), F.when(p % 37 == 0, -9999.0).otherwise((p * 7919 % 1000) / 4.0).alias("v"), F.floor((x + 0.5) / 3).alias("wgx"), F.floor((y + 0.5) / 3).alias("wgy"))


def cover(spark: SparkSession) -> DataFrame:
    n = spark.range(16)
    kind = F.element_at(F.array(*[F.lit(k) for k in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0, 7)]), (F.col("id") % 13 + 1).cast("int"))
    return n.select((F.col("id") % 4).alias("wgx"), F.floor(F.col("id") / 4).alias("wgy"), kind.alias("kind"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of 64 whole numbers."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("x", "f")).select("row_id", F.col("x").cast("long").alias("x"), F.floor(F.col("f").cast("double") * 1000).cast("long").alias("v"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel of level 0 for each line item; req_id is not unique where line items aren't."""
    n = count_of(spark, sf, "supplier")
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select((k * 8 + F.col("l_linenumber")).alias("req_id"), F.concat(F.lit("obj/"), (F.col("l_suppkey") % n).cast("string")).alias("key"), F.lit(0).alias("level"), (p * 7919 % WIDTH[0]).cast("int").alias("x"), (k * 104729 % WIDTH[0]).cast("int").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Images of three datasets over a square of ten degrees."""
    s = F.col("s_suppkey")
    of = F.element_at(F.array(F.lit("dem"), F.lit("wc"), F.lit("s2")), (s % 3 + 1).cast("int"))
    key = F.when(s % 3 == 2, F.concat(F.lit("s2/T"), (s % 5).cast("string"), F.lit("/d"), F.lpad(F.floor(s / 15).cast("string"), 3, "0"), F.lit("/B04.tif"))).otherwise(F.concat(of, F.lit("/"), s.cast("string"), F.lit(".tif")))
    w, south = (F.floor(s / 3) % 4 * 2.5).cast("double"), (F.floor(s / 12) % 4 * 2.5).cast("double")
    rows = table(spark, sf, "supplier").select(of.alias("dataset"), key.alias("key"), w.alias("w"), south.alias("s"), (w + 3).alias("e"), (south + 3).alias("n"), F.lit(1000).cast("long").alias("width"), F.lit(1000).cast("long").alias("height"))
    return rows.groupBy("dataset", "key").agg(*[F.min(c).alias(c) for c in ("w", "s")], *[F.min(c).alias(c) for c in ("e", "n", "width", "height")])


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """Images of places at dates, in two bands of which the second is half as large and sometimes missing."""
    s = F.col("s_suppkey")
    second = F.floor(s / 4) % 2 == 1
    key = F.concat(F.lit("s2ts/T"), (s % 4).cast("string"), F.lit("/2024-"), F.lpad(F.floor(s / 8).cast("string"), 3, "0"), F.when(second, "/SCL.tif").otherwise("/B04.tif"))
    size = F.when(second, 500).otherwise(1000).cast("long")
    return table(spark, sf, "supplier").select(key.alias("key"), size.alias("width"), size.alias("height"))


def stack_points(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("pt"), (c * 37 % 1000).alias("x"), (c * 91 % 1000).alias("y"))


def gate_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tiles with the bytes that a row of theirs needs."""
    t = tiles(spark, sf).filter("level = 0")
    b = F.col("block")
    need = F.floor(F.col("bytecount") * (20 + (F.col("sid") * 31 + b * 17) % 80) / 100)
    return t.select(F.when(b % 3 == 0, "SCL").otherwise("B04").alias("source"), "key", "block", "bytecount", need.alias("need"), ((F.col("sid") * 7 + b * 13) % 1024).alias("row"), F.lit(1024).alias("blockh"))


def gate_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What a row of a stored tile costs with restart points of four spans."""
    g = gate_tiles(spark, sf).filter("bytecount > 0")
    span = F.explode(F.array(*[F.lit(k * 65536) for k in (1, 2, 4, 8)])).alias("span")
    g = g.select(F.concat_ws("/", "key", F.col("block").cast("string")).alias("tile"), F.col("bytecount").alias("whole"), F.col("need").alias("prefix"), span)
    points = F.floor(2097152 / F.col("span")) - 1
    fetch = F.floor(F.col("whole") * F.col("span") / 2097152)
    return g.select("tile", "span", "whole", "prefix", fetch.alias("fetch"), F.col("span").cast("long").alias("decode"), (points * 32784).alias("index"), points.alias("points"), F.lit(32768).cast("long").alias("window"))


def passes(spark: SparkSession, sf: str) -> DataFrame:
    """runs() as passes of run files: cold and warm, some cut short, with minima and versions."""
    i = F.col("run_file")
    r = runs(spark, sf).withColumn("phase", F.when(i % 4 == 3, "warm").otherwise("cold")).withColumn("truncated", i % 50 == 1)
    r = r.withColumn("min_total_bytes", F.when(i % 3 > 0, i * 10 + 1)).withColumn("reads_total", i % 1000)
    return r.withColumn("versions", F.create_map(F.lit("gdal"), F.concat(F.lit("3."), (i % 5).cast("string")), F.lit("curl"), F.lit("8"))).withColumn("http_versions", F.create_map(F.concat(F.lit("HTTP/"), (i % 3).cast("string")), i))


def session_events(e: DataFrame) -> DataFrame:
    """events as a proxy's records: of each hundred the first opens a session and the last but one closes it."""
    i = F.col("event_id")
    kind = F.when(i % 100 == 0, "session_start").when(i % 100 == 98, "session_end").otherwise("req")
    return e.select(F.lit("proxy").alias("source"), kind.alias("record"), i.cast("double").alias("ts"), F.concat(F.lit("s"), F.floor(i / 100).cast("string")).alias("label"), F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("conn"), F.col("event_type").alias("kind"), F.floor(F.abs("value") * 1000).cast("long").alias("resp_body_bytes"))


class MemoryTransport:
    """A few small objects held in memory; for examples and tests."""

    def __init__(self, files: dict[str, bytes]):
        self.files = files

    def get_range(self, path: str, start: int, length: int) -> Range:
        data = self.files[path]
        return Range(data[start : start + length], len(data), f"etag:{len(data)}")


def series(n: int = 6, size: int = 600, tile: int = 256) -> MemoryTransport:
    """Images of a place at n dates: pixel (x, y) of image k is (x * 7 + y * 13 + k * 31) % 5000; predictors alternate, one tile is missing."""
    y, x = np.mgrid[0:size, 0:size]
    images = [((x * 7 + y * 13 + k * 31) % 5000).astype(np.uint16) for k in range(n)]
    return MemoryTransport({f"day{k}.tif": write([a], tile, predictor=1 + k % 2, empty={4} if k == 2 else frozenset()) for k, a in enumerate(images)})


#: The same tables for DuckDB, as a list of common table expressions.
SQL = """
nsup AS (SELECT count(*)::BIGINT AS n FROM supplier),
v_level AS (SELECT 'obj/' || s_suppkey AS key, s_suppkey AS sid, level::BIGINT AS level, width::BIGINT AS width, width::BIGINT AS height, 1024::BIGINT AS blockw, 1024::BIGINT AS blockh, nb::BIGINT AS nbx, nb::BIGINT AS nby, 2::BIGINT AS itemsize
  FROM supplier, (VALUES (0, 10980, 11), (1, 5490, 6)) AS l(level, width, nb)),
v_tile0 AS (SELECT s_suppkey AS sid, g, CASE WHEN g < 121 THEN 0::BIGINT ELSE 1::BIGINT END AS level, CASE WHEN (s_suppkey * 7 + g * 13) % 17 = 0 THEN 0 ELSE 20000 + (s_suppkey * 7919 + g * 104729) % 1700000 END::BIGINT AS bytecount
  FROM supplier, (SELECT unnest(range(157))::BIGINT AS g)),
v_tile AS (SELECT 'obj/' || sid AS key, sid, level, g - 121 * level AS block, (4096 + coalesce(sum(bytecount + 8) OVER (PARTITION BY sid ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", bytecount FROM v_tile0),
v_window AS (SELECT o_orderkey AS req_id, 'obj/' || (o_custkey % n) AS key, level, (o_orderkey * 7919) % (width - 50) - 20 AS x, (o_custkey * 104729 + o_orderkey * 31) % (width - 50) - 20 AS y, 1 + o_orderkey % 480 AS w, 1 + o_custkey % 480 AS h
  FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS level, CASE WHEN o_orderkey % 5 = 0 THEN 5490 ELSE 10980 END AS width FROM orders), nsup),
v_clip AS (SELECT r.*, l.width, l.height, l.blockw, l.blockh, l.nbx, greatest(0, x) AS x0, greatest(0, y) AS y0, least(width, x + w) AS x1, least(height, y + h) AS y1 FROM v_window r JOIN v_level l USING (key, level) WHERE least(width, x + w) > greatest(0, x) AND least(height, y + h) > greatest(0, y)),
v_by AS (SELECT *, unnest(range(y0 // blockh, (y1 - 1) // blockh + 1)) AS "by" FROM v_clip),
v_bxy AS (SELECT *, unnest(range(x0 // blockw, (x1 - 1) // blockw + 1)) AS bx FROM v_by),
v_item AS (SELECT req_id, key, level, "by" * nbx + bx AS block, greatest(0, y0 - "by" * blockh) AS ly0, least(blockh, y1 - "by" * blockh) AS ly1, greatest(0, x0 - bx * blockw) AS lx0, least(blockw, x1 - bx * blockw) AS lx1, greatest(y0, "by" * blockh) - y AS dy0, greatest(x0, bx * blockw) - x AS dx0 FROM v_bxy),
v_need AS (SELECT DISTINCT key, level, block FROM v_item),
v_job AS (SELECT key, level, block, min(ly0) AS shallow, max(ly1) - 1 AS deep, count(*) AS n_items, any_value("offset") AS "offset", any_value(bytecount) AS bytecount FROM v_item JOIN v_tile USING (key, level, block) GROUP BY key, level, block),
v_fetch AS (SELECT *, CASE WHEN bytecount > 0 THEN "offset" ELSE 0 END AS start, CASE WHEN bytecount > 0 THEN trunc(least(bytecount::DOUBLE, greatest(16384.0::DOUBLE, bytecount * ((deep + 1)::DOUBLE / 1024 + 0.03::DOUBLE))))::BIGINT ELSE 0 END AS prefix FROM v_job),
v_restart AS (SELECT key, block, seq, seq * 262144 AS "out", (bytecount * seq) // 8 AS in_byte, (block + seq) % 8 AS bits FROM v_tile, (SELECT unnest(range(1, 8))::BIGINT AS seq) WHERE bytecount > 0 AND level = 0),
v_log AS (SELECT event_id AS req, event_id AS ts, (event_id % 3)::VARCHAR AS label, 'c' || user_id AS conn, event_type AS kind, 'obj/' || (user_id % n) AS key, (event_id * 65537) % 90000000 AS lo, (event_id * 65537) % 90000000 + size - 1 AS hi, size AS resp_body_bytes,
  CASE WHEN event_id % 4 > 0 THEN 'bytes=' || ((event_id * 65537) % 90000000) || '-' || ((event_id * 65537) % 90000000 + size - 1) END AS "range", CASE WHEN event_id % 10 = 0 THEN 404 ELSE 206 END::BIGINT AS status FROM (SELECT *, floor(abs(value) * 1000)::BIGINT AS size FROM events), nsup),
v_run AS (SELECT event_type AS workload, ['DEFAULT', 'TUNED16', 'TUNED256', 'TUNED1M', 'MT'][(event_id % 5 + 1)::INT] AS config, [5, 50, 150][((event_id // 5) % 3 + 1)::INT]::BIGINT AS rtt_ms, event_id AS run_file, floor(abs(value) * 1000)::BIGINT AS bytes, event_id % 7 AS requests, ((event_id // 7) % 100)::DOUBLE AS wall_s, 1 + floor(abs(value) * 1000)::BIGINT / 65536 AS byte_amp, 1 + (event_id % 8) / 8 AS req_amp FROM events),
v_best AS (SELECT workload, rtt_ms, config, byte_amp, req_amp, wall_s, bytes, requests, run_file FROM (SELECT *, row_number() OVER (PARTITION BY workload, rtt_ms ORDER BY byte_amp, run_file) AS rn FROM v_run WHERE config LIKE 'TUNED%') WHERE rn = 1),
v_box AS (SELECT n_name AS key, (n_nationkey % 5 * 2)::DOUBLE AS w, (n_nationkey // 5 * 2)::DOUBLE AS s, (n_nationkey % 5 * 2 + 3)::DOUBLE AS e, (n_nationkey // 5 * 2 + 3)::DOUBLE AS n FROM nation),
v_pt AS (SELECT c_custkey AS pt_id, (c_custkey * 37 % 520) / 40.0::DOUBLE - 1 AS px, (c_custkey * 91 % 520) / 40.0::DOUBLE - 1 AS py FROM customer),
v_grid AS (SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS key, (n_nationkey % 5 * 90)::BIGINT AS gx0, (n_nationkey // 5 * 100)::BIGINT AS gy0, 100::BIGINT AS w, 100::BIGINT AS h FROM nation),
v_win AS (SELECT c_custkey AS win_id, c_custkey * 53 % 430 AS gx, c_custkey * 97 % 470 AS gy, 1 + c_custkey % 150 AS w, 1 + c_custkey * 3 % 150 AS h FROM customer),
v_vertex AS (SELECT o_orderkey % 500 AS line_id, o_orderkey AS seq, 5 + (o_orderkey * 7919 % 1000) / 2000.0::DOUBLE AS lon, 45 + (o_orderkey * 104729 % 1000) / 2000.0::DOUBLE AS lat FROM orders),
v_cell AS (SELECT p_partkey // 100 AS block, p_partkey % 10 AS x, (p_partkey // 10) % 10 AS y, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE (p_partkey * 7919 % 1000) / 4.0::DOUBLE END AS v FROM part),
v_cover AS (SELECT i % 4 AS wgx, i // 4 AS wgy, [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0, 7][(i % 13 + 1)::INT] AS kind FROM (SELECT unnest(range(16)) AS i)),
v_pixel AS (SELECT vec_id AS row_id, unnest(range(64)) AS x, floor(unnest(embedding)::DOUBLE * 1000)::BIGINT AS v FROM embeddings),
v_point AS (SELECT l_orderkey * 8 + l_linenumber AS req_id, 'obj/' || (l_suppkey % n) AS key, 0::BIGINT AS level, l_partkey * 7919 % 10980 AS x, l_orderkey * 104729 % 10980 AS y FROM lineitem, nsup),
v_scene AS (SELECT dataset, key, min(w) AS w, min(s) AS s, min(w) + 3 AS e, min(s) + 3 AS n, 1000::BIGINT AS width, 1000::BIGINT AS height FROM (SELECT ['dem', 'wc', 's2'][(s_suppkey % 3 + 1)::INT] AS dataset, CASE WHEN s_suppkey % 3 = 2 THEN 's2/T' || (s_suppkey % 5) || '/d' || lpad((s_suppkey // 15)::VARCHAR, 3, '0') || '/B04.tif' ELSE ['dem', 'wc', 's2'][(s_suppkey % 3 + 1)::INT] || '/' || s_suppkey || '.tif' END AS key, (s_suppkey // 3 % 4 * 2.5)::DOUBLE AS w, (s_suppkey // 12 % 4 * 2.5)::DOUBLE AS s FROM supplier) GROUP BY dataset, key),
v_stack AS (SELECT 's2ts/T' || (s_suppkey % 4) || '/2024-' || lpad((s_suppkey // 8)::VARCHAR, 3, '0') || CASE WHEN s_suppkey // 4 % 2 = 1 THEN '/SCL.tif' ELSE '/B04.tif' END AS key, CASE WHEN s_suppkey // 4 % 2 = 1 THEN 500 ELSE 1000 END::BIGINT AS width FROM supplier),
v_spt AS (SELECT c_custkey AS pt, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y FROM customer),
v_gate AS (SELECT CASE WHEN block % 3 = 0 THEN 'SCL' ELSE 'B04' END AS source, key, block, bytecount, bytecount * (20 + (sid * 31 + block * 17) % 80) // 100 AS need, (sid * 7 + block * 13) % 1024 AS "row" FROM v_tile WHERE level = 0),
v_cost AS (SELECT key || '/' || block AS tile, span, bytecount AS whole, need AS prefix, bytecount * span // 2097152 AS "fetch", span AS decode, (2097152 // span - 1) * 32784 AS "index", 2097152 // span - 1 AS points, 32768::BIGINT AS "window" FROM v_gate, (SELECT unnest([65536, 131072, 262144, 524288])::BIGINT AS span) WHERE bytecount > 0),
v_pass AS (SELECT *, CASE WHEN run_file % 4 = 3 THEN 'warm' ELSE 'cold' END AS phase, run_file % 50 = 1 AS truncated, CASE WHEN run_file % 3 > 0 THEN run_file * 10 + 1 END AS min_total_bytes, run_file % 1000 AS reads_total FROM v_run)
"""
