"""From requests to tiles, ranges of bytes and costs: all of a batch in one plan.

Tables, by column: requests (req_id, key, level, x, y, w, h); levels (key, level, width,
height, blockw, blockh, nbx, nby, itemsize ..); tiles (key, level, block, offset, bytecount).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, prefix_length, restart_length
from ..model import Options

TILE = ["key", "level", "block"]
BAND = 256  # rows of a tile that one task takes when areas are united


def levels_of(objects: DataFrame) -> DataFrame:
    """A row for each level of each object."""
    return objects.select("key", F.col("size").alias("object_size"), "nodata", F.inline("levels"))


def tiles_of(objects: DataFrame) -> DataFrame:
    """A row for each tile; bytecount 0 is a tile that isn't stored."""
    flat = objects.select("key", F.explode("levels").alias("l"))
    return flat.select("key", F.col("l.level").alias("level"), F.posexplode(F.arrays_zip(F.col("l.offsets").alias("offset"), F.col("l.bytecounts").alias("bytecount"))).alias("block", "t")).select(*TILE, "t.offset", "t.bytecount")


def unsent(table: DataFrame) -> DataFrame:
    """The table with a hint against sending it to the driver and every executor for a join.

    Spark takes what explode makes for as small as what it is made from, so tables of tiles and
    restart points would be broadcast at any size.
    """
    return table.hint("merge")


def clip(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Requests with their part inside the level (x0, y0, x1, y1, half-open); those with none go.

    Levels are joined as they are: small tables are broadcast by their size.
    """
    geometry = levels.select("key", "level", "width", "height", "blockw", "blockh", "nbx")
    out = requests.join(geometry, ["key", "level"])
    out = out.select("*", F.greatest(F.lit(0), "x").alias("x0"), F.greatest(F.lit(0), "y").alias("y0"), F.least("width", F.col("x") + F.col("w")).alias("x1"), F.least("height", F.col("y") + F.col("h")).alias("y1"))
    return out.filter("x1 > x0 and y1 > y0")


def items(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each request and tile: the part of the tile (ly0..ly1, lx0..lx1) and its place (dy0, dx0) in the request."""
    c = clip(requests, levels)
    span = lambda a, z, b: F.sequence(div(F.col(a), F.col(b)), div(F.col(z) - 1, F.col(b)))
    c = c.withColumn("by", F.explode(span("y0", "y1", "blockh"))).withColumn("bx", F.explode(span("x0", "x1", "blockw")))
    left, top = F.col("bx") * F.col("blockw"), F.col("by") * F.col("blockh")
    at = {
        "ly0": F.greatest(F.lit(0), F.col("y0") - top),
        "ly1": F.least(F.col("blockh"), F.col("y1") - top),
        "lx0": F.greatest(F.lit(0), F.col("x0") - left),
        "lx1": F.least(F.col("blockw"), F.col("x1") - left),
        "dy0": F.greatest("y0", top) - F.col("y"),
        "dx0": F.greatest("x0", left) - F.col("x"),
    }
    return c.select("req_id", "key", "level", (F.col("by") * F.col("nbx") + F.col("bx")).cast("int").alias("block"), *[v.cast("int").alias(k) for k, v in at.items()])


def required(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """The distinct tiles that a batch touches."""
    return items(requests, levels).select(*TILE).distinct()


def jobs(found: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row for each touched tile: its bytes, shallowest and deepest row, number of items."""
    grouped = found.groupBy(*TILE).agg(F.min("ly0").alias("shallow"), (F.max("ly1") - 1).alias("deep"), F.count("*").alias("n_items"))
    return grouped.join(unsent(tiles.select(*TILE, "offset", "bytecount")), TILE)


def as_of(wanted: DataFrame, points: DataFrame, by: list[str], at: str, out: str = "out") -> DataFrame:
    """wanted with `point`: the struct of the last of `points` (with columns by) whose `out` is at most wanted[at]; null without any.

    wanted: one row for each of `by` and at.
    """
    rest = [c for c in points.columns if c not in by]
    own = wanted.select(*by, F.col(at).alias("_at")).distinct()
    best = own.join(unsent(points), by).filter(F.col(out) <= F.col("_at")).groupBy(*by, "_at").agg(F.max(F.struct(out, *[c for c in rest if c != out])).alias("point"))
    return wanted.join(best.withColumnRenamed("_at", at), [*by, at], "left")


def valid_point(count: Column, total: Column, in_byte: Column, bits: Column, out: Column, window_size: Column) -> Column:
    return bits.between(0, 7) & in_byte.between(0, count) & out.between(0, total) & (window_size <= 32768)


def fetch_plan(job: DataFrame, levels: DataFrame, options: Options = Options(), points: DataFrame | None = None) -> DataFrame:
    """Jobs with `start` and `prefix`, the bytes to fetch, and `point`, the restart point to decode from or null.

    points: key, block, out, in_byte, bits, for level 0 (windows are not looked at).  One is used if it is past
    the tile's beginning and at or before the first row wanted.
    """
    geometry = levels.select("key", "level", "blockw", "blockh", "itemsize")
    j = job.join(geometry, ["key", "level"]).withColumn("row_bytes", F.col("blockw").cast("long") * F.col("itemsize")).withColumn("total", F.col("row_bytes") * F.col("blockh")).withColumn("first_out", F.col("shallow") * F.col("row_bytes"))
    if points is not None:
        j = as_of(j, points.select("key", "block", "out", "in_byte", "bits"), ["key", "block"], "first_out").withColumn("point", F.when((F.col("level") == 0) & (F.col("point.out") > 0), F.col("point")))
        first, length = restart_length(F.col("bytecount"), F.col("point.in_byte"), F.col("point.bits"), F.col("point.out"), (F.col("deep") + 1) * F.col("row_bytes"), F.col("total"), options.margin, options.min_fetch)
        has = F.col("point").isNotNull()
    else:
        j, first, length, has = j.withColumn("point", F.lit(None).cast("struct<out:long,in_byte:long,bits:int>")), F.lit(0), F.lit(0), F.lit(False)
    whole = prefix_length(F.col("bytecount"), F.col("deep"), F.col("blockh"), options.margin, options.min_fetch)
    stored = F.col("bytecount") > 0
    start = F.when(stored & has, F.col("offset") + first).when(stored, F.col("offset")).otherwise(0)
    return j.withColumn("start", start.cast("long")).withColumn("prefix", F.when(stored & has, length).when(stored, whole).otherwise(0).cast("long"))


GROUPS = "key string, level int, group_id int, start long, length long, n_jobs int, job_bytes long, extra_bytes long, blocks array<int>"


def coalesce(planned: DataFrame, options: Options = Options()) -> DataFrame:
    """Ranges to request: planned jobs of an object and level, in order of start, joined while that is worth a round trip.

    A run takes in the next job if the whole stays within max_fetch_bytes and the bytes between
    jobs within the merge budget for each job so far.  What decides depends on the run until
    then, so an object's jobs, one for each tile at most however many requests there are, go
    through one task in order; it holds one run at a time.
    A job above max_fetch_bytes gives a range of more than that: see too_large().
    """
    budget, most = options.merge_budget, options.max_fetch_bytes
    names = [c.split()[0] for c in GROUPS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in GROUPS.split(", ")]

    def fold(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        run, done, n = None, [], 0

        def batch():
            rows = [(r["key"], r["level"], r["group_id"], r["start"], r["length"], len(r["blocks"]), r["used"], max(0, r["length"] - r["used"]), r["blocks"]) for r in done]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in it:
            for key, level, block, start, prefix in zip(*[c.to_pylist() for c in b.columns]):
                if run is not None and run["key"] == key and run["level"] == level:
                    merged = start + prefix - run["start"]
                    if merged <= most and merged - (run["used"] + prefix) <= budget * len(run["blocks"]):
                        run["length"] = max(run["length"], merged)
                        run["used"] += prefix
                        run["blocks"].append(block)
                        continue
                if run is not None:
                    n = n + 1 if run["key"] == key else 0
                run = {"key": key, "level": level, "group_id": n, "start": start, "length": prefix, "used": prefix, "blocks": [block]}
                done.append(run)
            if len(done) > 1024:
                done, last = done[:-1], done[-1]
                yield batch()
                done = [last]
        if done:
            yield batch()

    rows = planned.filter("bytecount > 0").select(*TILE, "start", "prefix")
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "start", "level", "block").mapInArrow(fold, GROUPS)


def too_large(planned: DataFrame, options: Options = Options()) -> DataFrame:
    """Jobs whose bytes alone are above max_fetch_bytes."""
    return planned.filter(F.col("prefix") > options.max_fetch_bytes)


def runs(tiles: DataFrame, needed: DataFrame) -> DataFrame:
    """Maximal runs of needed tiles among all stored tiles of an object, in file order: key, n_runs, pad_bytes.

    pad_bytes lie between tiles inside runs.
    """
    stored = tiles.filter("bytecount > 0").join(needed.select(*TILE).distinct().withColumn("need", F.lit(1)), TILE, "left").fillna({"need": 0})
    w = Window.partitionBy("key").orderBy("offset", F.col("offset") + F.col("bytecount"), "level", "block")
    before, end = F.coalesce(F.lag("need").over(w), F.lit(0)), F.lag(F.col("offset") + F.col("bytecount")).over(w)
    marked = stored.select("key", "need", before.alias("before"), (F.col("offset") - end).alias("gap"))
    return marked.groupBy("key").agg(F.sum(F.when((F.col("need") == 1) & (F.col("before") == 0), 1).otherwise(0)).alias("n_runs"), F.sum(F.when((F.col("need") == 1) & (F.col("before") == 1), F.greatest(F.lit(0).cast("long"), "gap")).otherwise(0)).alias("pad_bytes"))


def theoretical(requests: DataFrame, levels: DataFrame, tiles: DataFrame, headers: DataFrame) -> DataFrame:
    """The least bytes and requests that a batch needs, as one row.  headers: key, header_bytes.

    Tiles that aren't stored count as blocks and requests but not as bytes; a file counts once
    asked for, even by a window outside it.
    """
    # all totals of tiles come from one table of tiles, marked where they are needed
    stored = F.col("bytecount") > 0
    m = tiles.select(*TILE, "offset", "bytecount").join(required(requests, levels).withColumn("need", F.lit(1)), TILE, "left").fillna({"need": 0})
    w = Window.partitionBy("key", stored).orderBy("offset", F.col("offset") + F.col("bytecount"), "level", "block")
    m = m.select("key", "need", "bytecount", stored.alias("stored"), F.coalesce(F.lag("need").over(w), F.lit(0)).alias("before"), (F.col("offset") - F.lag(F.col("offset") + F.col("bytecount")).over(w)).alias("gap"))
    add = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    need, run = F.col("need") == 1, (F.col("need") == 1) & F.col("stored")
    a = m.agg(
        add(need, 1).alias("n_blocks"),
        add(need & ~F.col("stored"), 1).alias("n_empty_blocks"),
        add(need, F.col("bytecount")).alias("min_block_bytes"),
        add(run & (F.col("before") == 0), 1).alias("n_contiguous_runs"),
        add(run & (F.col("before") == 1), F.greatest(F.lit(0).cast("long"), "gap")).alias("coalescing_pad_bytes"),
    )
    asked = requests.groupBy("key", "level").agg(F.count("*").alias("n")).join(levels.select("key", "level").withColumn("known", F.lit(True)), ["key", "level"], "left")
    per_key = asked.groupBy("key").agg(F.sum("n").alias("n"), F.max("known").alias("known")).join(headers.select("key", "header_bytes"), "key", "left")
    there = F.col("known") & F.col("header_bytes").isNotNull()
    b = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_reads"), add(there, 1).alias("n_files"), add(there, F.col("header_bytes")).alias("header_bytes"))
    one = b.crossJoin(a)  # two rows of totals
    return one.select("n_reads", "n_files", "n_blocks", "n_empty_blocks", "min_block_bytes", "header_bytes", (F.col("min_block_bytes") + F.col("header_bytes")).alias("min_total_bytes"), (F.col("n_blocks") + F.col("n_files")).alias("min_requests"), (F.col("n_contiguous_runs") + F.col("n_files")).alias("min_requests_coalesced"), "n_contiguous_runs", "coalescing_pad_bytes")


def per_level(requests: DataFrame, levels: DataFrame, tiles: DataFrame) -> DataFrame:
    return required(requests, levels).join(unsent(tiles), TILE).groupBy("level").agg(F.count("*").alias("blocks"), F.sum("bytecount").alias("bytes"))


def missing(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Names of what isn't there: key, or key@L and the level where only that is missing."""
    keys = levels.select("key").distinct().withColumn("known", F.lit(True))
    gone = requests.join(levels.select("key", "level"), ["key", "level"], "left_anti").join(keys, "key", "left")
    return gone.select(F.when(F.col("known"), F.concat("key", F.lit("@L"), F.col("level").cast("string"))).otherwise(F.col("key")).alias("missing")).distinct()


def granularity(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Pixels asked for (each once) against pixels of the tiles that hold them: req_px, blk_px, ratio.

    Tiles are cut into bands of BAND rows, and a band where an item begins or ends.  Between two
    such cuts all rows are alike: there the spans asked for are united by a running maximum of
    their ends.  Only items are dealt out, by tile and band; their strips stay in the same task.
    """
    band = lambda c: div(c, F.lit(BAND))
    cut = items(requests, levels).withColumn("band", F.explode(F.sequence(band(F.col("ly0")), band(F.col("ly1") - 1))))
    cut = cut.select(*TILE, "band", F.greatest("ly0", F.col("band") * BAND).alias("y0"), F.least("ly1", (F.col("band") + 1) * BAND).alias("y1"), "lx0", "lx1")
    of_band = Window.partitionBy(*TILE, "band")
    cut = cut.withColumn("cuts", F.array_sort(F.array_union(F.collect_set("y0").over(of_band), F.collect_set("y1").over(of_band))))
    strips = F.transform("cuts", lambda c, i: F.struct(c.alias("y"), (F.get("cuts", i + 1) - c).alias("high")))
    rows = cut.select(*TILE, "band", "lx0", "lx1", F.inline(F.filter(strips, lambda s: (s["y"] >= F.col("y0")) & (s["y"] < F.col("y1")))))
    w = Window.partitionBy(*TILE, "band", "y").orderBy("lx0", "lx1").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.col("high") * F.greatest(F.lit(0), F.col("lx1") - F.greatest("lx0", F.coalesce(F.max("lx1").over(w), F.lit(0))))
    wanted = rows.select(covered.alias("px")).agg(F.coalesce(F.sum("px"), F.lit(0)).cast("long").alias("req_px"))
    whole = required(requests, levels).join(levels, ["key", "level"]).agg(F.coalesce(F.sum(F.col("blockw").cast("long") * F.col("blockh")), F.lit(0)).alias("blk_px"))
    return wanted.crossJoin(whole).select("req_px", "blk_px", F.bround(F.try_divide(F.col("blk_px").cast("double"), F.col("req_px")), 2).alias("ratio"))
