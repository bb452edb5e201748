"""Points, boxes and mosaics, corridors, slopes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bad_height, cell_cost, km_per_degree, slope_degrees


def covering(points: DataFrame, boxes: DataFrame, cell: float = 1.0, on: list[str] | None = None) -> DataFrame:
    """points (pt_id, px, py) with the least key of the boxes (key, w, s, e, n) that hold them; null if none.

    w <= x < e and s < y <= n.  Boxes are cut into cells, so that the join has an equal key;
    `on` are more columns that must be equal.
    """
    on = on or []
    col = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
    # of boxes in the same place only the least key can be the answer
    alone = boxes.groupBy("w", "s", "e", "n", *on).agg(F.min("key").alias("key"))
    tiled = alone.withColumn("cx", F.explode(F.sequence(col("w"), col("e")))).withColumn("cy", F.explode(F.sequence(col("s"), col("n"))))
    p = points.select("pt_id", "px", "py", *on).withColumn("cx", col("px")).withColumn("cy", col("py"))
    hits = p.join(tiled, ["cx", "cy", *on]).filter("w <= px and px < e and s < py and py <= n").groupBy("pt_id").agg(F.min("key").alias("key"))
    return points.join(hits, "pt_id", "left")


def mosaic(tiles: DataFrame) -> DataFrame:
    """Places of same-scale tiles (key, a, c, e, f, w, h) on one grid: key, gx0, gy0, w, h."""
    corner = tiles.agg(F.min("c").alias("x0"), F.max("f").alias("y0"))
    return tiles.crossJoin(corner).select("key", F.bround((F.col("c") - F.col("x0")) / F.col("a")).cast("long").alias("gx0"), F.bround((F.col("f") - F.col("y0")) / F.col("e")).cast("long").alias("gy0"), "w", "h")  # corner is one row


def locate(points: DataFrame, placed: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Grid pixels (pt_id, gx, gy) in the first tile by key that has them: key, lx, ly.

    Tiles are on a grid of their size or smaller steps; each is entered in the cells it touches.
    """
    cells = lambda c, n: F.sequence(F.floor(F.col(c) / n), F.floor((F.col(c) + n - 1) / n))
    entered = placed.withColumn("cx", F.explode(cells("gx0", tile_w))).withColumn("cy", F.explode(cells("gy0", tile_h)))
    p = points.withColumn("cx", F.floor(F.col("gx") / tile_w)).withColumn("cy", F.floor(F.col("gy") / tile_h))
    hit = p.join(entered, ["cx", "cy"]).filter(f"gx >= gx0 and gx < gx0 + {tile_w} and gy >= gy0 and gy < gy0 + {tile_h}")
    best = hit.groupBy("pt_id").agg(F.min_by(F.struct("key", (F.col("gx") - F.col("gx0")).alias("lx"), (F.col("gy") - F.col("gy0")).alias("ly")), "key").alias("b"))
    return best.select("pt_id", "b.key", "b.lx", "b.ly")


def split_window(windows: DataFrame, placed: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Grid windows (win_id, gx, gy, w, h) cut along the tiles: key and the local x, y, w, h of each part."""
    cells = lambda a, z, n: F.sequence(F.floor(a / n), F.floor((z - 1) / n))
    t = placed.select("key", "gx0", "gy0", F.col("w").alias("tw"), F.col("h").alias("th"))
    t = t.withColumn("cx", F.explode(cells(F.col("gx0"), F.col("gx0") + F.col("tw"), tile_w))).withColumn("cy", F.explode(cells(F.col("gy0"), F.col("gy0") + F.col("th"), tile_h)))
    v = windows.withColumn("cx", F.explode(cells(F.col("gx"), F.col("gx") + F.col("w"), tile_w))).withColumn("cy", F.explode(cells(F.col("gy"), F.col("gy") + F.col("h"), tile_h)))
    x0, y0 = F.greatest("gx", "gx0"), F.greatest("gy", "gy0")
    x1, y1 = F.least(F.col("gx") + F.col("w"), F.col("gx0") + F.col("tw")), F.least(F.col("gy") + F.col("h"), F.col("gy0") + F.col("th"))
    out = v.join(t, ["cx", "cy"]).select("win_id", "key", (x0 - F.col("gx0")).alias("x"), (y0 - F.col("gy0")).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return out.filter("w > 0 and h > 0").distinct()


def densify(vertices: DataFrame, step_km: float) -> DataFrame:
    """Lines (line_id, seq, lon, lat) as sub-segments of about step_km: line_id, seq, part, lon0, lat0, lon1, lat1."""
    w = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.withColumn("lon1", F.lead("lon").over(w)).withColumn("lat1", F.lead("lat").over(w)).filter("lon1 is not null")
    kx, ky = km_per_degree((F.col("lat") + F.col("lat1")) / 2)
    d = F.hypot((F.col("lon1") - F.col("lon")) * kx, (F.col("lat1") - F.col("lat")) * ky)
    v = v.withColumn("n", F.greatest(F.lit(1), F.bround(d / F.lit(float(step_km))).cast("int"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, z, t: F.col(a) + (F.col(z) - F.col(a)) * (t / F.col("n"))
    return v.select("line_id", "seq", "part", at("lon", "lon1", F.col("part")).alias("lon0"), at("lat", "lat1", F.col("part")).alias("lat0"), at("lon", "lon1", F.col("part") + 1).alias("lon1"), at("lat", "lat1", F.col("part") + 1).alias("lat1"))


def top_share(scores: DataFrame, by: str, score: str, order: str, keep: float, buckets: int = 1024) -> DataFrame:
    """In each group the best `keep` of its rows, one at least; of equal scores the earlier by `order`.

    Scores are cut into `buckets` ranges; only the range in which the share ends is put in order
    row by row, so a group of most rows is not one task's.
    """
    g = scores.groupBy(by).agg(F.count("*").alias("_n"), F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    g = g.withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(keep))).cast("int"))).withColumnRenamed(by, "_of")
    place = (F.col("_hi") - F.col(score)) / (F.col("_hi") - F.col("_lo")) * (buckets - 1)
    rows = scores.join(g, F.col(by).eqNullSafe(F.col("_of"))).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.coalesce(F.floor(place), F.lit(buckets))).otherwise(0).cast("int"))
    before = Window.partitionBy("_of").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_of", "_b", "_k").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_k")
    marked = rows.join(sizes.withColumnRenamed("_of", "_of2").withColumnRenamed("_b", "_b2"), F.col("_of").eqNullSafe(F.col("_of2")) & (F.col("_b") == F.col("_b2"))).filter("_before < _k")
    all_of = marked.filter("_before + _in <= _k").select(*scores.columns)
    rank = F.row_number().over(Window.partitionBy("_of").orderBy(F.col(score).desc(), F.col(order)))
    some = marked.filter("_before + _in > _k").withColumn("_rank", rank).filter("_rank <= _k - _before").select(*scores.columns)
    return all_of.unionByName(some)


def every_kth(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """In each group n rows at even steps of its order (all, if it has fewer)."""
    rank = (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("int")
    ranked = rows.withColumn("_at", rank).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") / F.lit(float(n)))).cast("int"))
    return ranked.filter((F.col("_n") <= n) | F.array_contains(picks, F.col("_at"))).drop("_at", "_n")


def adjacent(tiles: DataFrame, nbx: int, n: int) -> DataFrame:
    """For each object the n stored tiles side by side whose least is largest: key, by, bx, least; ties: the first by (by, bx)."""
    t = tiles.withColumn("by", F.floor(F.col("block") / nbx).cast("int")).withColumn("bx", (F.col("block") % nbx).cast("int"))
    w = Window.partitionBy("key", "level", "by").orderBy("bx").rowsBetween(0, n - 1)
    c = t.withColumn("least", F.min("bytecount").over(w)).withColumn("got", F.count("*").over(w)).filter(f"got = {n} and least > 0 and level = 0")
    return c.groupBy("key").agg(F.max(F.struct("least", (-F.col("by")).alias("nby"), (-F.col("bx")).alias("nbx"))).alias("b")).select("key", (-F.col("b.nby")).alias("by"), (-F.col("b.nbx")).alias("bx"), "b.least")


def gradient(cells: DataFrame, mx: float, my: float) -> DataFrame:
    """cells (block, x, y, v) with gx, gy: central differences inside a block, one-sided at its edges.  v that is null takes the block's mean."""
    c = cells.withColumn("v", F.coalesce("v", F.avg("v").over(Window.partitionBy("block"))))

    def along(axis: str, other: str, step: float) -> Column:
        w = Window.partitionBy("block", other).orderBy(axis)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        d = F.coalesce(after, F.col("v")) - F.coalesce(before, F.col("v"))
        n = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 1).otherwise(0)
        return F.when(n > 0, d / (n * F.lit(float(step)))).otherwise(0.0)

    return c.withColumn("gx", along("x", "y", mx)).withColumn("gy", along("y", "x", my))


def cost_surface(heights: DataFrame, cover: DataFrame, mx: float, my: float, nodata: float | None) -> DataFrame:
    """Travel cost of cells: heights (block, x, y, v, wgx, wgy) with the class of the cover cell (wgx, wgy, kind) that holds their centre.

    A height without a cover cell ends the job: a hole would look like a way.
    """
    bad = bad_height(F.col("raw"), F.lit(nodata).cast("double"))
    c = heights.withColumn("raw", F.col("v")).withColumn("v", F.when(~bad, F.col("v")))
    g = gradient(c, mx, my).join(cover.withColumn("_there", F.lit(True)), ["wgx", "wgy"], "left")
    g = g.withColumn("kind", F.when(F.col("_there"), F.col("kind")).otherwise(F.raise_error(F.lit("the land cover does not span the heights")).cast("int")))
    slope = slope_degrees(F.col("gx"), F.col("gy"))
    return g.select("block", "x", "y", slope.alias("slope"), cell_cost(F.col("kind"), slope, bad).cast("float").alias("cost"))


def undo_predictor2(rows: DataFrame, bits: int, signed: bool = False) -> DataFrame:
    """Row-wise sums (row_id, x, v) wrapped to an integer of `bits` bits: the relational twin of codec.undo_predictor."""
    s = F.pmod(F.sum(F.col("v").cast("long")).over(Window.partitionBy("row_id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1 << bits))
    return rows.select("row_id", "x", (F.when(s >= 1 << (bits - 1), s - (1 << bits)).otherwise(s) if signed else s).alias("value"))
