"""What can be read, what is refused, and why: the first reason that holds counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Options
from .tiles import levels_of

DEFLATE = (8, 32946)


def bad_metadata(options: Options = Options()) -> Column:
    """What is wrong with a level's layout; null if nothing is."""
    c = F.col
    n = c("nbx") * c("nby")
    tile_ok = F.forall(F.arrays_zip(c("offsets").alias("o"), c("bytecounts").alias("n")), lambda t: (t["o"] >= 0) & (t["n"] >= 0) & ((t["n"] == 0) | (t["o"] + t["n"] <= c("object_size"))))
    positive = F.least("width", "height", "blockw", "blockh", "nbx", "nby", "itemsize") > 0
    return (
        F.when(~F.coalesce(positive, F.lit(False)), "sizes must be positive")
        .when((c("nbx") != F.ceil(c("width") / c("blockw"))) | (c("nby") != F.ceil(c("height") / c("blockh"))), "the grid does not match the image")
        .when((F.size("offsets") != n) | (F.size("bytecounts") != n), "the tile tables do not match the grid")
        .when(c("blockw").cast("long") * c("blockh") * c("itemsize") > options.max_block_bytes, "a block is too large")
        .when(~F.coalesce(tile_ok, F.lit(False)), "a tile lies outside the object")
    )


def reasons(objects: DataFrame, requests: DataFrame, options: Options = Options()) -> DataFrame:
    """For each distinct (key, level) of requests: reason it can't be read, or null."""
    asked = requests.select("key", "level").distinct()
    known = objects.select("key", "error", F.size("levels").alias("n_levels"))
    c = F.col
    rows = asked.join(known, "key", "left").join(levels_of(objects), ["key", "level"], "left")
    whole, real = c("dtype").rlike("^u?int"), c("dtype").rlike("^float")
    reason = (
        F.when(c("n_levels").isNull() & c("error").isNull(), "not in the catalog")
        .when(c("error").isNotNull(), F.concat(F.lit("not described: "), c("error")))
        .when(c("width").isNull(), "no such level")
        .when(bad_metadata(options).isNotNull(), bad_metadata(options))
        .when(~c("compression").isin(*DEFLATE), "compression is not Deflate")
        .when(~c("predictor").isin(1, 2, 3), "unknown predictor")
        .when(c("samples") != 1, "more than one sample a pixel")
        .when(c("planar") != 1, "separate planes")
        .when(F.coalesce(c("byteorder") != "<", F.lit(True)), "not little-endian")
        .when((c("predictor") == 2) & ~whole, "predictor 2 needs whole numbers")
        .when((c("predictor") == 3) & ~real, "predictor 3 needs floating point")
    )
    return rows.select("key", "level", reason.alias("reason"))


def split(objects: DataFrame, requests: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Requests that can be read, and the others with their reason."""
    marked = requests.join(reasons(objects, requests, options), ["key", "level"])
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def out_of_bounds(requests: DataFrame, levels: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Requests that are refused for their window: req_id, why."""
    r = requests.join(levels.select("key", "level", "width", "height"), ["key", "level"])
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    why = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "the size must be positive").when(outside & F.lit(not allow_partial), "outside the level")
    return r.select("req_id", why.alias("why")).filter("why is not null")


def output_bytes(requests: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Bytes of all windows, as one row; without levels each pixel counts 8."""
    size = F.lit(8)
    if levels is not None:
        requests, size = requests.join(levels.select("key", "level", "itemsize"), ["key", "level"]), F.col("itemsize")
    return requests.agg(F.coalesce(F.sum(F.col("w").cast("long") * F.col("h") * size), F.lit(0)).alias("bytes"))


def fresh_sidecars(sidecars: DataFrame, objects: DataFrame) -> DataFrame:
    """Sidecars (key, source_size, layout_hash, identity) with status fresh, stale or missing object."""
    o = objects.select("key", F.col("size").alias("o_size"), F.col("layout_hash").alias("o_hash"), F.col("identity").alias("o_identity"))
    same = (F.col("source_size") == F.col("o_size")) & (F.col("layout_hash") == F.col("o_hash")) & (F.col("identity") == F.col("o_identity")) & (F.col("identity") != "")
    return sidecars.join(o, "key", "left").select("key", F.when(F.col("o_size").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "fresh").otherwise("stale").alias("status"))


def disordered_points(points: DataFrame) -> DataFrame:
    """Blocks (key, block) whose restart points don't advance: in_byte must not fall, out must rise."""
    from pyspark.sql import Window

    w = Window.partitionBy("key", "block").orderBy("seq")
    bad = (F.col("in_byte") < F.lag("in_byte").over(w)) | (F.col("out") <= F.lag("out").over(w))
    return points.select("key", "block", bad.alias("bad")).groupBy("key", "block").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad")).filter("bad").select("key", "block")
