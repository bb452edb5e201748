"""Reports over runs: (workload, config, rtt_ms, phase, bytes, requests, wall_s, byte_amp, req_amp, run_file ..)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import headroom_pct, run_tag


def best_tuned(runs: DataFrame, prefix: str = "TUNED") -> DataFrame:
    """For each workload and round trip the tuned run of least byte_amp; ties: the first file."""
    tuned = runs.filter(F.col("config").startswith(prefix) & F.col("byte_amp").isNotNull())
    return tuned.groupBy("workload", "rtt_ms").agg(F.min(F.struct("byte_amp", "run_file", "config", "req_amp", "wall_s", "bytes", "requests")).alias("b")).select("workload", "rtt_ms", "b.*")


def pivot_rtt(runs: DataFrame, rtts: list, values: tuple[str, ...] = ("byte_amp", "req_amp", "wall_s")) -> DataFrame:
    """One row for each workload and config, three columns for each round trip; null where there was no run."""
    return runs.groupBy("workload", "config").pivot("rtt_ms", rtts).agg(*[F.first(v).alias(v) for v in values])


def headroom(runs: DataFrame, default: str = "DEFAULT") -> DataFrame:
    """Best tuned against default: byte_amp of both and what is left to gain, in percent."""
    base = runs.filter(F.col("config") == default).groupBy("workload", "rtt_ms").agg(F.min("byte_amp").alias("default_amp"))
    return best_tuned(runs).join(base, ["workload", "rtt_ms"], "left").select("workload", "rtt_ms", "config", "byte_amp", "default_amp", headroom_pct(F.col("byte_amp")).alias("headroom_pct"))


def slowdown(runs: DataFrame, capped: DataFrame) -> DataFrame:
    """Wall time under a bandwidth cap over that without."""
    a = runs.groupBy("workload", "config").agg(F.min("wall_s").alias("free_s"))
    b = capped.groupBy("workload", "config", "bandwidth").agg(F.min("wall_s").alias("capped_s"))
    return b.join(a, ["workload", "config"], "left").withColumn("slowdown", F.try_divide("capped_s", "free_s"))


def speedup(rows: DataFrame) -> DataFrame:
    """(workload, threads, wall_s, bytes) against the fewest threads of the workload."""
    w = Window.partitionBy("workload").orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("speedup", F.try_divide(F.first("wall_s").over(w), F.col("wall_s"))).withColumn("byte_ratio", F.try_divide(F.col("bytes").cast("double"), F.first("bytes").over(w).cast("double")))


def bench(rows: DataFrame, reference: str) -> DataFrame:
    """(label, requests, bytes, wall_s, digest): medians and range by label, whether values agree, gain over a label's bytes."""
    g = rows.groupBy("label").agg(F.count("*").alias("n"), F.median("requests").alias("requests"), F.median("bytes").alias("bytes"), F.median("wall_s").alias("wall_s"), F.min("wall_s").alias("min_s"), F.max("wall_s").alias("max_s"), (F.count_distinct("digest") == 1).alias("same"))
    ref = g.filter(F.col("label") == reference).agg(F.max("bytes").alias("ref"))  # one row
    return g.crossJoin(ref).withColumn("gain", F.try_divide("ref", "bytes")).drop("ref")


def corpus(objects: DataFrame) -> DataFrame:
    """(dataset, size, blocks) by dataset, and a last row for all."""
    return objects.rollup("dataset").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.sum("blocks").alias("blocks")).select(F.coalesce("dataset", F.lit("Total")).alias("dataset"), "objects", "bytes", "blocks")


# Compression tags of TIFF files.
COMPRESSION = {1: "none", 5: "LZW", 7: "JPEG", 8: "DEFLATE", 32946: "DEFLATE", 50000: "ZSTD"}


def manifest(objects: DataFrame) -> DataFrame:
    """Each object of a catalog: key, size, overviews, blocks of all levels, compression, and what is wrong with it."""
    names = F.create_map(*[F.lit(x) for kv in COMPRESSION.items() for x in kv])
    code = F.col("levels")[0]["compression"]
    blocks = F.aggregate("levels", F.lit(0).cast("long"), lambda n, l: n + l["nbx"].cast("long") * l["nby"])
    return objects.select("key", "size", (F.size("levels") - 1).alias("overviews"), blocks.alias("blocks"), F.coalesce(names[code], code.cast("string")).alias("compression"), "error")


def prefix_statistics(tiles: DataFrame) -> DataFrame:
    """(row_frac, used_frac) of tiles: mean, and how far compressed bytes run ahead of rows at most and at the 95th percentile."""
    d = F.col("used_frac") - F.col("row_frac")
    return tiles.agg(F.avg("used_frac").alias("mean_used"), F.max(d).alias("max_ahead"), F.percentile(d, F.lit(0.95)).alias("p95_ahead"))


def shape_gain(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(shape, bytes, digest) joined with another reader's: gain, whether values agree, whether more bytes were used."""
    o = other.select("shape", F.col("bytes").alias("other_bytes"), F.col("digest").alias("other_digest"))
    return ours.join(o, "shape").select("shape", F.bround(F.try_divide(F.col("other_bytes").cast("double"), F.col("bytes").cast("double")), 3).alias("gain"), (F.col("digest") == F.col("other_digest")).alias("same"), (F.col("bytes") > F.col("other_bytes")).alias("worse"))


def number(v: Column, places: int = 2, dash: str = "--") -> Column:
    """A number as people read it; a dash for null."""
    return F.coalesce(F.format_number(v.cast("double"), places), F.lit(dash))


def theoretical_report(runs: DataFrame, values: tuple[str, ...] = ("reads_total", "n_files", "n_blocks", "min_block_bytes", "header_bytes", "min_total_bytes", "min_requests", "min_requests_naive")) -> DataFrame:
    """For each workload the minimum that its first run (by run_file) with one states."""
    return runs.filter("min_total_bytes > 0").groupBy("workload").agg(F.min_by(F.struct(*values), "run_file").alias("b")).select("workload", "b.*")


def main_report(runs: DataFrame, rtts: list, phase: str = "cold") -> DataFrame:
    """Amplification and wall time as text, three columns for each round trip; -- where there was no run, ! where it was cut short."""
    cells = runs.filter(F.col("phase") == phase).groupBy("workload", "config", "rtt_ms").agg(F.max_by(F.struct("byte_amp", "req_amp", "wall_s", "truncated"), "run_file").alias("b"))
    text = cells.select("workload", "config", "rtt_ms", F.concat(number(F.col("b.byte_amp")), F.when(F.col("b.truncated"), " !").otherwise("")).alias("bytes_x"), number(F.col("b.req_amp"), 1).alias("requests_x"), F.concat(number(F.col("b.wall_s"), 1), F.lit("s")).alias("wall"))
    wide = text.groupBy("workload", "config").pivot("rtt_ms", rtts).agg(*[F.first(c).alias(c) for c in ("bytes_x", "requests_x", "wall")])
    return wide.fillna("--")


def headroom_report(runs: DataFrame, default: str = "DEFAULT") -> DataFrame:
    """Best tuned cold run against the default and the warm run of the same configuration, and what is left to gain, in percent."""
    best = best_tuned(runs.filter("phase = 'cold'"))
    base = runs.filter((F.col("config") == default) & (F.col("phase") == "cold")).groupBy("workload", "rtt_ms").agg(F.min("byte_amp").alias("default_amp"))
    warm = runs.filter("phase = 'warm'").groupBy("workload", "rtt_ms", "config").agg(F.max_by(F.struct("bytes", "requests"), "run_file").alias("warm"))
    out = best.join(base, ["workload", "rtt_ms"], "left").join(warm, ["workload", "rtt_ms", "config"], "left")
    return out.select("workload", "rtt_ms", "config", "byte_amp", "default_amp", F.col("warm.bytes").alias("warm_bytes"), F.col("warm.requests").alias("warm_requests"), headroom_pct(F.col("byte_amp")).alias("headroom_pct"), headroom_pct(F.col("req_amp")).alias("request_headroom_pct"))


def attribution_report(runs: DataFrame, diagnosis: DataFrame, rtt: int) -> DataFrame:
    """Where the bytes of each workload's best tuned run went: diagnosis (tag, header_pct ..) joined by the run's tag."""
    best = best_tuned(runs.filter((F.col("phase") == "cold") & (F.col("rtt_ms") == rtt)))
    tag = F.concat(run_tag(F.col("workload"), F.col("config"), F.col("rtt_ms"), F.lit(0)), F.lit(".cold"))
    return best.select("workload", "config", tag.alias("tag")).join(diagnosis, "tag").drop("tag")


def environment(runs: DataFrame) -> DataFrame:
    """Component and value: versions of the first run, and all HTTP versions that any run saw (versions: map, http_versions: map)."""
    first = runs.agg(F.min_by("versions", "run_file").alias("v")).select(F.explode("v").alias("component", "value"))
    seen = runs.agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("http_versions"))))), ", ").alias("value"))
    return first.unionByName(seen.select(F.lit("HTTP version").alias("component"), "value"))


def unpivoted(one_row: DataFrame) -> DataFrame:
    """A row of quantities as rows (quantity, value), values as text."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("quantity"), F.coalesce(F.col(c).cast("string"), F.lit("--")).alias("value")) for c in one_row.columns])))


def prefix_report(tiles: DataFrame) -> DataFrame:
    """tiles (source, key, bytecount, row_frac, used_frac): by source the mean share of a tile that a row needs (over rows, then tiles), and how far bytes run ahead of rows."""
    d = F.col("used_frac") - F.col("row_frac")
    per_tile = tiles.groupBy("source", "key").agg(F.max("bytecount").alias("bytecount"), F.avg("used_frac").alias("mean_used"))
    a = per_tile.groupBy("source").agg(F.count("*").alias("tiles"), F.avg("bytecount").alias("mean_tile"), F.avg("mean_used").alias("needed"))
    b = tiles.groupBy("source").agg(F.percentile(d, F.lit(0.95)).alias("p95_ahead"), F.max(d).alias("max_ahead"))
    return a.join(b, "source").withColumn("saving", 1 - F.col("needed"))


def at_fractions(rows: DataFrame, fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """rows (key, row, rows, used_frac): the value at some shares of each tile's rows: key, fraction, used_frac."""
    at = F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction")
    wanted = rows.select("key", "row", "rows", "used_frac", at)
    return wanted.filter(F.col("row") == F.greatest(F.lit(0), F.floor(F.col("fraction") * F.col("rows")) - 1)).select("key", "fraction", "used_frac")


def series(runs: DataFrame, metric: str = "byte_amp", phase: str = "cold") -> DataFrame:
    """What a plot of a metric over round trips shows: workload, config, and points (rtt_ms, value) in order."""
    r = runs.filter((F.col("phase") == phase) & F.col(metric).isNotNull()).groupBy("workload", "config", "rtt_ms").agg(F.max_by(metric, "run_file").alias("value"))
    return r.groupBy("workload", "config").agg(F.array_sort(F.collect_list(F.struct("rtt_ms", "value"))).alias("points"))


def stacked(diagnosis: DataFrame, categories: tuple[str, ...] = ("needed", "redundant", "unneeded", "padding", "header", "list_and_other")) -> DataFrame:
    """What a stacked plot of shares shows: tag, category, bottom, top."""
    parts, below = [], F.lit(0.0)
    for c in categories:
        top = below + F.coalesce(F.col(f"{c}_pct"), F.lit(0.0))
        parts.append(F.struct(F.lit(c).alias("category"), below.alias("bottom"), top.alias("top")))
        below = top
    return diagnosis.select("tag", F.inline(F.array(*parts)))


def verify(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(req_id, value, bytes, requests) of two readers, one row: values that differ or are there once only, and the gains."""
    o = other.select("req_id", F.col("value").alias("other_value"), F.lit(True).alias("in_other"))
    both = ours.select("req_id", "value", F.lit(True).alias("in_ours")).join(o, "req_id", "full")
    same = F.col("in_ours") & F.col("in_other") & (F.col("value").eqNullSafe(F.col("other_value")))
    a = both.agg(F.count("*").alias("reads"), F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("mismatches"))
    totals = lambda df, name: df.agg(F.sum("bytes").alias(f"{name}_bytes"), F.sum("requests").alias(f"{name}_requests"))
    one = a.crossJoin(totals(ours, "our")).crossJoin(totals(other, "other"))  # three rows of totals
    return one.withColumn("byte_gain", F.bround(F.try_divide("other_bytes", "our_bytes"), 3)).withColumn("request_gain", F.bround(F.try_divide("other_requests", "our_requests"), 3))


def digest(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """SHA-256 over values in order of req_id, as text with commas between, and their sum.

    A group's values are one message, so they meet in one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("req_id", F.col("value").cast("double").alias("value"))))
    return values.groupBy(*(by or [])).agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["value"].cast("string")), ",").cast("binary"), 256).alias("digest"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("checksum"))


def digest_bytes(values: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over values in order of req_id, as little-endian doubles; a group's values meet in one task, 16 bytes each."""
    import hashlib

    import pyarrow as pa

    names = {f.name: f.dataType.simpleString() for f in values.schema}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raw = table.sort_by("req_id").column("value").combine_chunks().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        return pa.table({**{n: pa.array([k.as_py()], k.type) for n, k in zip(by, key)}, "digest": [hashlib.sha256(raw).hexdigest()]})

    return values.select(*by, "req_id", F.col("value").cast("double").alias("value")).groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {names[c]}" for c in by) + ", digest string")


def markdown(rows: DataFrame) -> str:
    """A report as text; reports are short, and all rows are in it."""
    lines = [rows.columns, ["---"] * len(rows.columns), *[["--" if v is None else f"{v:,.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows.toLocalIterator()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as one CSV file with a header, in a folder."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
