"""Analytics over request logs: totals, where bytes went, consistency between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tiles import unsent

LOG = "record string, seq long, ts double, ts_end double, method string, kind string, bucket string, key string, query string, `range` string, status int, resp_body_bytes long, http_version string, conn string, new_conn boolean, label string"


def read(spark, path: str) -> DataFrame:
    """Requests of JSON-lines logs, plain or gzipped."""
    return spark.read.schema(LOG).json(path).filter("record = 'req'")


def metrics(log: DataFrame) -> DataFrame:
    """Requests and bytes by kind."""
    return log.groupBy("kind").agg(F.count("*").alias("requests"), F.coalesce(F.sum("resp_body_bytes"), F.lit(0)).alias("bytes"))


def by_version(log: DataFrame) -> DataFrame:
    """Requests by HTTP version."""
    return log.groupBy("http_version").agg(F.count("*").alias("requests"))


def by_key(log: DataFrame) -> DataFrame:
    """Requests and bytes by object."""
    return log.groupBy("key").agg(F.count("*").alias("requests"), F.coalesce(F.sum("resp_body_bytes"), F.lit(0)).alias("bytes"))


def totals(log: DataFrame, min_bytes: float | None = None, min_requests: float | None = None) -> DataFrame:
    """One row: requests, bytes, keys, connections, mean bytes of ranged requests (0 if none), and both against their minimum."""
    ranged = F.avg(F.when(F.col("range").isNotNull(), F.col("resp_body_bytes")))
    a = log.agg(F.count("*").alias("requests"), F.coalesce(F.sum("resp_body_bytes"), F.lit(0)).alias("bytes"), F.count_distinct("key").alias("keys"), F.count_distinct("conn").alias("connections"), F.coalesce(ranged, F.lit(0.0)).alias("mean_range_bytes"))
    over = lambda c, m: F.try_divide(F.col(c).cast("double"), F.lit(m).cast("double"))
    return a.withColumn("byte_amplification", over("bytes", min_bytes)).withColumn("request_amplification", over("requests", min_requests))


def status_pivot(log: DataFrame, statuses: list) -> DataFrame:
    """Requests of each kind by status."""
    return log.groupBy("kind").pivot("status", statuses).count().fillna(0)


def sequence(log: DataFrame, chunk: float = 3600.0) -> DataFrame:
    """Requests with their number in the session (label), from 0, and whether they are the first of their connection.

    A session is numbered in stretches of `chunk` units of ts at once; a stretch is moved up by
    the sizes of those before it, so no task gets a whole session.
    """
    rows = log.withColumn("_part", F.floor(F.col("ts") / F.lit(float(chunk))))
    before = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("label", "_part").agg(F.count("*").alias("_n")).select("label", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("label", "_part").orderBy("ts", "req"))
    numbered = rows.withColumn("_at", at).join(sizes, ["label", "_part"]).withColumn("seq", F.col("_before") + F.col("_at") - 1)
    first = log.groupBy("label", "conn").agg(F.min(F.struct("ts", "req")).alias("_first"))
    out = numbered.join(first.select(F.col("label").alias("_l"), F.col("conn").alias("_c"), "_first"), F.col("label").eqNullSafe(F.col("_l")) & F.col("conn").eqNullSafe(F.col("_c")), "left")
    return out.withColumn("new_conn", F.struct("ts", "req") == F.col("_first")).drop("_part", "_before", "_at", "_first", "_l", "_c")


PARTS = ("header", "needed", "redundant", "unneeded", "padding", "list_and_other")


def diagnose(log: DataFrame, tiles: DataFrame, required: DataFrame, headers: DataFrame, by: list[str] | None = None, bucket: int = 1 << 20) -> DataFrame:
    """Where bytes went, a row for each group `by` (of log): header, needed, redundant, unneeded, padding, list_and_other.

    log: req, key, lo, hi (inclusive), resp_body_bytes.  A tile's bytes are needed until it is
    whole, then redundant; padding is what no header or tile covers; what isn't a range of a known
    object is list_and_other.  Also: blocks met and met again, the worst ratio of bytes to size
    of a tile, and each part in percent.  Ranges and tiles meet by cells of `bucket` bytes, each
    pair in the first cell that both touch.
    """
    by = by or []
    cells = lambda a, z: F.explode(F.sequence(F.floor(a / bucket), F.floor(z / bucket)))
    t = tiles.filter("bytecount > 0").select("key", "level", "block", F.col("offset").alias("s"), (F.col("offset") + F.col("bytecount")).alias("e"))
    r = log.select(*by, "req", "key", "lo", "hi", F.coalesce("resp_body_bytes", F.lit(0)).alias("size"))
    ranged = r.filter("hi >= lo")
    both = ranged.withColumn("cell", cells(F.col("lo"), F.col("hi"))).join(unsent(t.withColumn("cell", cells(F.col("s"), F.col("e") - 1))), ["key", "cell"])
    both = both.filter((F.col("s") <= F.col("hi")) & (F.col("e") > F.col("lo")) & (F.col("cell") == F.floor(F.greatest("s", "lo") / bucket)))
    overlap = both.withColumn("ov", F.least(F.col("hi") + 1, "e") - F.greatest("lo", "s"))
    per_tile = overlap.groupBy(*by, "key", "level", "block", (F.col("e") - F.col("s")).alias("of")).agg(F.sum("ov").alias("got"))
    marked = per_tile.join(required.select("key", "level", "block").distinct().withColumn("need", F.lit(True)), ["key", "level", "block"], "left")
    need = F.coalesce("need", F.lit(False))
    zero = F.lit(0).cast("long")
    add = lambda c: F.coalesce(F.sum(c), zero)
    a = marked.groupBy(*by).agg(
        add(F.when(need, F.least("of", "got"))).alias("needed"),
        add(F.when(need, F.greatest(zero, F.col("got") - F.col("of")))).alias("redundant"),
        add(F.when(~need, F.col("got"))).alias("unneeded"),
        F.count("*").alias("blocks"),
        F.count(F.when(F.col("got") > F.col("of"), 1)).alias("blocks_refetched"),
        F.max(F.col("got") / F.col("of")).alias("worst"),
    )
    covered = overlap.groupBy("req").agg(F.sum("ov").alias("in_tiles"))
    h = r.join(headers, "key", "left").join(covered, "req", "left")
    known = F.col("header_bytes").isNotNull() & (F.col("hi") >= F.col("lo"))
    in_header = F.greatest(zero, F.least(F.col("hi") + 1, F.col("header_bytes")) - F.col("lo"))
    rest = F.greatest(zero, F.col("hi") - F.col("lo") + 1 - in_header - F.coalesce("in_tiles", zero))
    b = h.groupBy(*by).agg(add(F.when(known, in_header)).alias("header"), add(F.when(known, rest)).alias("padding"), add(F.when(~F.coalesce(known, F.lit(False)), F.greatest(zero, F.col("size")))).alias("list_and_other"))
    one = b.join(a, by, "left") if by else b.crossJoin(a)  # without groups two rows of totals
    whole = sum((F.coalesce(F.col(c), zero) for c in PARTS[1:]), F.col("header"))
    pct = [F.bround(100 * F.coalesce(F.col(c), zero) / F.greatest(F.lit(1), whole), 2).alias(f"{c}_pct") for c in PARTS]
    return one.select(*by, *[F.coalesce(c, zero).alias(c) for c in PARTS], F.coalesce("blocks", zero).alias("blocks"), F.coalesce("blocks_refetched", zero).alias("blocks_refetched"), "worst", *pct)


def attribution(log: DataFrame, tiles: DataFrame, required: DataFrame, headers: DataFrame) -> DataFrame:
    """diagnose() of a whole log, as one row: header, needed, redundant, unneeded, padding, blocks, blocks_refetched."""
    return diagnose(log, tiles, required, headers).select("header", "needed", "redundant", "unneeded", "padding", "blocks", "blocks_refetched")


def rtt_violations(runs: DataFrame) -> DataFrame:
    """(workload, config) whose bytes or requests differ between round-trip times: they should not."""
    g = runs.groupBy("workload", "config").agg(F.count_distinct("rtt_ms").alias("points"), F.count_distinct(F.struct("bytes", "requests")).alias("variants"))
    return g.filter("points >= 2 and variants > 1")


def debug_delta(lines: DataFrame, logged: DataFrame, chunk: int) -> DataFrame:
    """Bytes that debug lines tell of (line) against those logged (bytes), as one row, and whether they differ by whole chunks."""
    from ..functions.columns import downloads

    d = lines.select(F.explode(downloads(F.col("line"))).alias("r")).select((F.split("r", "-")[1].cast("long") - F.split("r", "-")[0].cast("long") + 1).alias("n"))
    a = d.agg(F.count("*").alias("debug_ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("debug_bytes"))
    b = logged.agg(F.count("*").alias("log_ranges"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("log_bytes"))
    delta = F.col("log_bytes") - F.col("debug_bytes")
    return a.crossJoin(b).withColumn("delta", delta).withColumn("whole_chunks", F.pmod(delta, F.lit(chunk)) == 0)
