"""Totals that decide whether a way of reading is worth it: prefixes, restart points, latency, thread counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _saved(part: str, whole: str = "whole") -> Column:
    return F.bround(1 - F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), 4)


def deepest_rows(reads: DataFrame) -> DataFrame:
    """reads (key, block, row, blockh): the deepest row of each tile, within it."""
    row = F.greatest(F.lit(0), F.least(F.col("blockh") - 1, F.col("row")))
    return reads.groupBy("key", "block").agg(F.max(row).alias("row"))


def prefix_gate(tiles: DataFrame, margin: float = 0.12) -> DataFrame:
    """tiles (source, bytecount, need, row, blockh): what whole tiles, exact prefixes and guessed ones cost, by source and in all.

    A guess is the share of rows and the margin of the tile; one that falls short costs the
    whole tile.  source null is the sum.
    """
    guess = F.least(F.col("bytecount"), F.floor(F.col("bytecount") * ((F.col("row") + 1).cast("double") / F.col("blockh") + F.lit(float(margin))))).cast("long")
    t = tiles.filter("bytecount > 0").withColumn("short", (guess < F.col("need")).cast("long")).withColumn("spec", F.when(guess < F.col("need"), F.col("bytecount")).otherwise(guess))
    g = t.rollup("source").agg(F.count("*").alias("blocks"), F.sum("bytecount").alias("whole"), F.sum("need").alias("oracle"), F.sum("spec").alias("spec"), F.sum("short").alias("undershoots"))
    return g.select("source", "blocks", "whole", "oracle", "spec", "undershoots", _saved("oracle").alias("oracle_saving"), _saved("spec").alias("speculative_saving"), F.bround(F.col("undershoots") / F.greatest(F.lit(1), "blocks"), 4).alias("undershoot_rate"))


def restart_gate(costs: DataFrame) -> DataFrame:
    """costs (tile, span, whole, prefix, fetch, decode, index, points, window): totals by span and gain over whole tiles and prefixes.

    Without a cached index the window of the point is fetched too.
    """
    g = costs.groupBy("span").agg(F.count("*").alias("tiles"), *[F.sum(c).alias(c) for c in ("whole", "prefix", "fetch", "decode", "index", "points", "window")])
    over = lambda a, b: F.bround(F.col(a).cast("double") / F.greatest(F.lit(1), b), 2)
    cold = F.col("fetch") + F.col("window")
    return g.select("span", "tiles", "whole", "prefix", "fetch", cold.alias("fetch_and_index"), "decode", F.bround(F.col("points") / F.col("tiles"), 1).alias("points_per_tile"), F.bround(100 * F.col("index") / F.col("whole"), 1).alias("index_pct"), over("whole", F.col("fetch")).alias("gain_cached"), over("whole", cold).alias("gain_remote"), over("prefix", F.col("fetch")).alias("gain_over_prefix"))


def restart_table(costs: DataFrame) -> DataFrame:
    """The gate as a report: whole tiles, prefixes, then restart points by span: approach, span, cached, cached_gain, remote, remote_gain, index_pct."""
    one = costs.select("tile", "whole", "prefix").distinct().agg(F.sum("whole").alias("w"), F.sum("prefix").alias("p"))
    gain = F.bround(F.col("w") / F.col("p"), 2)
    fixed = one.select(F.inline(F.array(
        F.struct(F.lit("Whole tiles").alias("approach"), F.lit(None).cast("long").alias("span"), F.col("w").alias("cached"), F.lit(1.0).alias("cached_gain"), F.col("w").alias("remote"), F.lit(1.0).alias("remote_gain"), F.lit(None).cast("double").alias("index_pct")),
        F.struct(F.lit("Prefix").alias("approach"), F.lit(None).cast("long").alias("span"), F.col("p").alias("cached"), gain.alias("cached_gain"), F.col("p").alias("remote"), gain.alias("remote_gain"), F.lit(None).cast("double").alias("index_pct")),
    )))
    own = restart_gate(costs).select(F.lit("Restart points").alias("approach"), F.col("span").cast("long"), F.col("fetch").alias("cached"), F.col("gain_cached").alias("cached_gain"), F.col("fetch_and_index").alias("remote"), F.col("gain_remote").alias("remote_gain"), "index_pct")
    return fixed.unionByName(own)


def timing(requests: DataFrame, projected: tuple[int, ...] = (50, 200, 1000, 5000), steady: int = 262144) -> DataFrame:
    """requests (bytes, ttfb_s, transfer_s): median times by size, and what they say of the link.

    One row: ttfb_s, the median of the medians; mbps, that of the sizes from `steady` on; and for
    each bandwidth of `projected` the share of a largest request that a smallest one saves.
    """
    g = requests.groupBy("bytes").agg(F.median("ttfb_s").alias("ttfb"), F.median("transfer_s").alias("transfer"))
    g = g.withColumn("mbps", F.try_divide(F.col("bytes") * 8 / 1e6, F.col("transfer")))
    one = g.agg(F.median("ttfb").alias("ttfb_s"), F.median(F.when(F.col("bytes") >= steady, F.col("mbps"))).alias("mbps"), F.min("bytes").alias("small"), F.max("bytes").alias("large"))
    at = lambda size, mbps: F.col("ttfb_s") + F.col(size) / F.lit(mbps * 1e6 / 8)
    return one.select("ttfb_s", "mbps", "small", "large", *[F.bround(1 - at("small", b) / at("large", b), 3).alias(f"saved_{b}") for b in projected])


def largest_tile(tiles: DataFrame) -> DataFrame:
    """The tile of most bytes of each object; of equal ones the first."""
    return tiles.groupBy("key").agg(F.max_by(F.struct("level", "block", "bytecount"), F.struct("bytecount", -F.col("level"), -F.col("block"))).alias("t")).select("key", "t.*")


def busiest_object(reads: DataFrame, most: int = 400) -> DataFrame:
    """The first `most` reads (by req_id) of the object that has most; of equal ones the least key."""
    n = reads.groupBy("key").agg(F.count("*").alias("n"))
    key = n.agg(F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("b")).select(F.col("b.key").alias("key"))
    return reads.join(F.broadcast(key), "key", "left_semi").orderBy("req_id").limit(most)


def thread_gate(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """rows (workload, threads, wall_s, bytes, requests) as by reports.speedup, with whether all runs of a workload ask for `least` or more of the requests of the fewest threads."""
    w = Window.partitionBy("workload").orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(w)
    out = rows.withColumn("speedup", F.bround(F.try_divide(first("wall_s"), F.col("wall_s")), 2)).withColumn("byte_ratio", F.bround(F.try_divide(F.col("bytes").cast("double"), first("bytes")), 3))
    enough = out.select("workload", (F.col("requests") >= F.lit(float(least)) * first("requests")).alias("ok")).groupBy("workload").agg(F.bool_and("ok").alias("no_fewer_requests"))
    return out.join(enough, "workload")
