"""Least-cost paths over cost surfaces: exact distances by blocks, path traceback, and the demand order of an A* search.

A surface is a table of cells (x, y, cost); cost is infinite where there is no way.  Moves go to
the eight neighbours and cost half of both cells' cost times the length of the step.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import km_per_degree, unit

MOVES = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
STATE = "bx long, by long, w int, h int, cost binary, dist binary, came binary"
_STEP = STATE + ", out_bx array<long>, out_by array<long>, out_cell array<int>, out_dist array<double>, out_step array<double>, out_from array<long>"


def blocks_of(cells: DataFrame, block: int) -> DataFrame:
    """A surface as one row for each block of block x block cells (STATE), no cell reached yet; cells that are missing are no way."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cost = np.full((block, block), np.inf)
        x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
        cost[y % block, x % block] = rows.column("cost").to_numpy()
        far = np.full((block, block), np.inf)
        return pa.table({"bx": pa.array([key[0].as_py()], pa.int64()), "by": pa.array([key[1].as_py()], pa.int64()), "w": pa.array([block], pa.int32()), "h": pa.array([block], pa.int32()), "cost": [cost.tobytes()], "dist": [far.tobytes()], "came": [np.full((block, block), -1, np.int64).tobytes()]})

    named = cells.select(F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("cost").cast("double").alias("cost"))
    return named.groupBy("bx", "by").applyInArrow(run, STATE)


def _settle(cost: np.ndarray, dist: np.ndarray, came: np.ndarray, seeds: Iterable[tuple[int, float, float, int]], origin: tuple[int, int], width: int, mx: float, my: float) -> dict[int, float]:
    """Dijkstra within one block from seeds (cell, distance up to its border, step, where from); the cells that came nearer."""
    h, w = cost.shape
    flat_cost, flat_dist, flat_came = cost.ravel(), dist.ravel(), came.ravel()
    heap, changed = [], {}
    for cell, d, step, source in seeds:
        c = flat_cost[cell]
        if math.isfinite(c) and (new := d + 0.5 * c * step) < flat_dist[cell]:
            flat_dist[cell], flat_came[cell] = new, source
            heapq.heappush(heap, (new, cell))
    length = [math.hypot(dx * mx, dy * my) for dx, dy in MOVES]
    while heap:
        d, cell = heapq.heappop(heap)
        if d > flat_dist[cell]:
            continue
        changed[cell] = d
        y, x = divmod(cell, w)
        own = flat_cost[cell]
        for (dx, dy), s in zip(MOVES, length):
            i, j = x + dx, y + dy
            if 0 <= i < w and 0 <= j < h:
                to = j * w + i
                c = flat_cost[to]
                if math.isfinite(c) and (new := d + 0.5 * (own + c) * s) < flat_dist[to]:
                    flat_dist[to], flat_came[to] = new, (origin[1] + y) * width + origin[0] + x
                    heapq.heappush(heap, (new, to))
    return changed


def least_cost(cells: DataFrame, start: tuple[int, int], save: Callable[[DataFrame, str], DataFrame], mx: float = 1.0, my: float = 1.0, block: int = 256, width: int = 1 << 31) -> DataFrame:
    """Distances from a start to all cells of a surface, as blocks (STATE).

    In each round the blocks that got nearer borders are settled, one task a block, and pass on
    what changed at their own borders; rounds end when nothing does, after about as many as
    blocks lie on a path.  save(table, name) writes a round's table where all executors read it
    (a lineage of many rounds would be lost with an executor).  width is above any x.
    """
    spark = cells.sparkSession
    state = save(blocks_of(cells, block), "blocks")
    shape = "bx long, by long, cell int, dist double, step double, source long"
    seeds = spark.createDataFrame([(start[0] // block, start[1] // block, start[1] % block * block + start[0] % block, 0.0, 0.0, -1)], shape)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _STEP.split(", ")]
        if left.empty:
            return pd.DataFrame(columns=names)
        r = left.iloc[0]
        size = int(r.w)
        cost = np.frombuffer(r.cost).reshape(size, size)
        dist, came = np.frombuffer(r.dist).reshape(size, size).copy(), np.frombuffer(r.came, np.int64).reshape(size, size).copy()
        x0, y0 = int(r.bx) * size, int(r.by) * size
        changed = _settle(cost, dist, came, right[["cell", "dist", "step", "source"]].itertuples(index=False), (x0, y0), width, mx, my)
        out: list[tuple] = []
        for cell, d in changed.items():
            y, x = divmod(cell, size)
            if 0 < x < size - 1 and 0 < y < size - 1:
                continue
            for dx, dy in MOVES:
                i, j = x0 + x + dx, y0 + y + dy
                if i // size != r.bx or j // size != r.by:
                    s = math.hypot(dx * mx, dy * my)
                    out.append((i // size, j // size, j % size * size + i % size, d + 0.5 * cost[y, x] * s, s, (y0 + y) * width + x0 + x))
        parts = [list(c) for c in zip(*out)] if out else [[]] * 6
        return pd.DataFrame([[r.bx, r.by, size, size, r.cost, dist.tobytes(), came.tobytes(), *parts]], columns=names)

    while True:
        touched = seeds.select("bx", "by").distinct()
        active = state.join(touched, ["bx", "by"], "left_semi")
        if active.isEmpty():
            return state
        settled = save(active.groupBy("bx", "by").cogroup(seeds.groupBy("bx", "by")).applyInPandas(run, _STEP), "settled")
        names = [c.split()[0] for c in STATE.split(", ")]
        state = save(state.join(touched, ["bx", "by"], "left_anti").select(names).unionByName(settled.select(names)), "blocks")
        sent = settled.select(F.explode(F.arrays_zip("out_bx", "out_by", "out_cell", "out_dist", "out_step", "out_from")).alias("m"))
        seeds = save(sent.groupBy(F.col("m.out_bx").alias("bx"), F.col("m.out_by").alias("by"), F.col("m.out_cell").alias("cell"), F.col("m.out_step").alias("step"), F.col("m.out_from").alias("source")).agg(F.min("m.out_dist").alias("dist")).select("bx", "by", "cell", "dist", "step", "source"), "seeds")


def distances(state: DataFrame) -> DataFrame:
    """Reached cells of least_cost's blocks: x, y, dist."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for bx, by, w, raw in zip(*[b.column(c).to_pylist() for c in ("bx", "by", "w", "dist")]):
                d = np.frombuffer(raw).reshape(w, w)
                y, x = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(x + bx * w), pa.array(y + by * w), pa.array(d[y, x])], names=["x", "y", "dist"])

    return state.mapInArrow(run, "x long, y long, dist double")


def path(state: DataFrame, goal: tuple[int, int], width: int = 1 << 31) -> list[tuple[int, int]]:
    """The cells from the start to a goal, by steps back; empty if the goal was not reached.  One block is fetched at a time."""
    out: list[tuple[int, int]] = []
    size = state.select("w").first()
    block, now = (size.w if size else 1), goal
    while True:
        r = state.filter((F.col("bx") == now[0] // block) & (F.col("by") == now[1] // block)).first()
        if r is None:
            return []
        came, dist = np.frombuffer(r.came, np.int64).reshape(block, block), np.frombuffer(r.dist).reshape(block, block)
        while (now[0] // block, now[1] // block) == (r.bx, r.by):
            if not math.isfinite(dist[now[1] % block, now[0] % block]):
                return []
            out.append(now)
            source = int(came[now[1] % block, now[0] % block])
            if source < 0:
                return out[::-1]
            now = (source % width, source // width)


def search(costs: Callable[[int, int], np.ndarray | None], start: tuple[int, int], goal: tuple[int, int], block: int, mx: float, my: float, least: float = 1.0, eps: float = 1.0, most: int = 40_000_000) -> dict:
    """A* from start to goal over blocks that costs(bx, by) gives when they are first met (None: no such block).

    least: the least cost of a cell, for the estimate.  Returns found, cost, expanded, the path
    and the blocks in the order in which they were demanded.
    """
    have: dict[tuple[int, int], np.ndarray | None] = {}

    def cost(x: int, y: int) -> float:
        at = (x // block, y // block)
        if at not in have:
            have[at] = costs(*at)
        own = have[at]
        x, y = x % block, y % block
        return float(own[y, x]) if own is not None and y < own.shape[0] and x < own.shape[1] else math.inf

    left = lambda x, y: eps * least * math.hypot((x - goal[0]) * mx, (y - goal[1]) * my)
    cost(*start), cost(*goal)
    best, came, closed = {start: 0.0}, {start: None}, set()
    heap, found = [(left(*start), start)], False
    while heap and len(closed) < most:
        _, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            found = True
            break
        own = cost(*at)
        if not math.isfinite(own):
            continue
        for dx, dy in MOVES:
            to = (at[0] + dx, at[1] + dy)
            if to in closed or not math.isfinite(c := cost(*to)):
                continue
            new = best[at] + 0.5 * (own + c) * math.hypot(dx * mx, dy * my)
            if new < best.get(to, math.inf):
                best[to], came[to] = new, at
                heapq.heappush(heap, (new + left(*to), to))
    way = []
    at = goal if found else None
    while at is not None:
        way.append(at)
        at = came[at]
    return {"found": found, "cost": best[goal] if found else None, "expanded": len(closed), "path": way[::-1], "blocks": [k for k, v in have.items() if v is not None]}


DEMAND = "query long, found boolean, cost double, expanded long, path array<struct<x:long,y:long>>, blocks array<struct<bx:long,by:long>>"


def demand(queries: DataFrame, costs: Callable[[int, int], np.ndarray | None], block: int, mx: float = 1.0, my: float = 1.0, **options) -> DataFrame:
    """A search for each row (query, sx, sy, gx, gy), one task a row where there are enough (DEMAND); costs is called on the executors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for q in b.to_pylist():
                got = search(costs, (q["sx"], q["sy"]), (q["gx"], q["gy"]), block, mx, my, **options)
                kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])), pa.list_(pa.struct([("bx", pa.int64()), ("by", pa.int64())]))]
                row = [q["query"], got["found"], got["cost"], got["expanded"], [{"x": x, "y": y} for x, y in got["path"]], [{"bx": x, "by": y} for x, y in got["blocks"]]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in DEMAND.split(", ")[:4]] + ["path", "blocks"])

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.select("query", "sx", "sy", "gx", "gy").repartition(n, "query").mapInArrow(run, DEMAND)


def endpoints(spark: SparkSession, boxes: DataFrame, n: int, km: float, seed: int = 5, tries: int = 200, region: tuple = (0.0, 0.0, 10.0, 10.0), cell: float = 3.0) -> DataFrame:
    """n pairs of places about `km` apart, both inside the region and a box: query, lon0, lat0, lon1, lat1; the first of `tries` draws that will do."""
    from .geo import covering

    i, t = F.col("i"), F.col("t")
    spread = lambda part, lo, hi: F.lit(lo) + part * F.lit(hi - lo)
    p = spark.range(n).select(F.col("id").alias("i")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    p = p.withColumn("lon0", spread(unit(seed, "x", i, t), region[0] + 0.3, region[2] - 0.3)).withColumn("lat0", spread(unit(seed, "y", i, t), region[1] + 0.3, region[3] - 0.3))
    kx, ky = km_per_degree(F.col("lat0"))
    b = unit(seed, "bearing", i, t) * F.lit(6.283185307179586)
    p = p.withColumn("lon1", F.col("lon0") + F.lit(km) * F.sin(b) / kx).withColumn("lat1", F.col("lat0") + F.lit(km) * F.cos(b) / ky)
    p = p.filter((F.col("lon1") > region[0] + 0.2) & (F.col("lon1") < region[2] - 0.2) & (F.col("lat1") > region[1] + 0.2) & (F.col("lat1") < region[3] - 0.2)).withColumn("pt_id", i * tries + t)
    for end in (0, 1):
        hit = covering(p.select("pt_id", F.col(f"lon{end}").alias("px"), F.col(f"lat{end}").alias("py")), boxes, cell).filter("key is not null").select("pt_id")
        p = p.join(hit, "pt_id")
    return p.groupBy("i").agg(F.min_by(F.struct("lon0", "lat0", "lon1", "lat1"), "t").alias("b")).select(F.col("i").alias("query"), "b.*")
