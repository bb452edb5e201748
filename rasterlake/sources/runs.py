"""Files of workloads and runs as tables: specs, run results, request logs, catalogs; and digests of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import theoretical

RUN = (
    "workload string, config string, latency_ms double, jitter_ms double, bandwidth_mbps double, versions map<string,string>, "
    "passes array<struct<pass:string,wall_s:double,reads_executed:long,reads_total:long,truncated:boolean,peak_rss_mb:double,log:string,checksum:double,"
    "metrics:struct<bytes_fetched:long,requests:long,byte_amplification:double,request_amplification:double,min_total_bytes:long,min_requests:long,min_requests_naive:long,"
    "n_files:long,min_block_bytes:long,header_bytes:long,n_blocks:long,mean_range_bytes:double,connections:long,http_versions:map<string,long>>>>"
)
SPEC = "name string, seed long, params string, notes string, theoretical string, n_reads long, reads array<array<string>>"


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each pass of each run file (JSON, one object a file); many folders or globs at once.

    Files are told apart by run_file, the last part of their path.
    """
    raw = spark.read.schema(RUN).option("multiLine", True).json(list(paths))
    flat = raw.select("workload", "config", F.col("latency_ms").alias("rtt_ms"), F.col("bandwidth_mbps").alias("bandwidth"), "versions", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run_file"), F.explode("passes").alias("p"))
    m = "p.metrics."
    return flat.select(
        "workload", "config", "rtt_ms", "bandwidth", "run_file", F.col("p.pass").alias("phase"), F.col(m + "bytes_fetched").alias("bytes"), F.col(m + "requests").alias("requests"), F.col(m + "byte_amplification").alias("byte_amp"), F.col(m + "request_amplification").alias("req_amp"),
        *[F.col(m + c).alias(c) for c in ("min_total_bytes", "min_requests", "min_requests_naive", "n_files", "min_block_bytes", "header_bytes", "n_blocks", "mean_range_bytes", "connections", "http_versions")],
        *[F.col("p." + c).alias(c) for c in ("wall_s", "peak_rss_mb", "reads_executed", "reads_total", "truncated", "checksum")], "versions",
    )


def whole_runs(runs: DataFrame, phase: str = "cold") -> DataFrame:
    """Passes of a phase that ran to their end."""
    return runs.filter((F.col("phase") == phase) & ~F.coalesce("truncated", F.lit(False)) & F.col("bytes").isNotNull())


def save_spec(path: str, name: str, seed: int, reads: DataFrame, params: dict, notes: str = "", levels: DataFrame | None = None, tiles: DataFrame | None = None, headers: DataFrame | None = None) -> dict:
    """Write a workload: a folder with its requests (Parquet, in order of req_id) and a line of facts; returns the facts.

    With levels, tiles and headers the theoretical minimum is among them.
    """
    reads.select("req_id", "key", "level", "x", "y", "w", "h").sortWithinPartitions("req_id").write.mode("overwrite").parquet(f"{path}/reads")
    spark = reads.sparkSession
    least = None
    if levels is not None:
        least = theoretical(spark.read.parquet(f"{path}/reads"), levels, tiles, headers).first().asDict()
    facts = {"name": name, "seed": seed, "params": params, "notes": notes, "theoretical": least, "n_reads": reads.count()}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return facts


def generate_all(makers: dict, folder: str, **tables) -> dict[str, dict | str]:
    """Make and save every workload (name: (seed, function that gives its requests)): the facts of each, or why it failed; one failure stops no other."""
    out: dict[str, dict | str] = {}
    for name, (seed, make) in makers.items():
        try:
            out[name] = save_spec(f"{folder}/{name}", name, seed, make(), {}, **tables)
        except Exception as e:  # told in the result
            out[name] = f"{type(e).__name__}: {e}"
    return out


def load_spec(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """What save_spec wrote: the facts and the requests."""
    return json.loads(spark.read.text(f"{path}/facts").first().value), spark.read.parquet(f"{path}/reads")


def read_spec_json(spark: SparkSession, path: str) -> DataFrame:
    """Requests of specs in one JSON object a file, `reads` as [key, level, x, y, w, h]: name, req_id (from 0 in each spec), key, level, x, y, w, h."""
    raw = spark.read.schema(SPEC).option("multiLine", True).json(path)
    r = raw.select("name", F.posexplode("reads").alias("req_id", "r"))
    return r.select("name", F.col("req_id").cast("long").alias("req_id"), F.col("r")[0].alias("key"), *[F.col("r")[k + 1].cast("int").alias(c) for k, c in enumerate(("level", "x", "y", "w", "h"))])


def catalog_entries(spark: SparkSession, text: str, kind: str = "yaml") -> DataFrame:
    """Pinned objects of a YAML document (its list `objects`) or of search answers (JSON, features with assets): key, url, size, dataset, tile, band, date, cloud_cover."""
    shape = "key string, url string, size long, dataset string, tile string, band string, date string, cloud_cover double"
    if kind == "yaml":
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs PyYAML; JSON catalogs need nothing") from e
        rows = [{c.split()[0]: o.get(c.split()[0]) for c in shape.split(", ")} for o in yaml.safe_load(text)["objects"]]
        return spark.createDataFrame(rows, shape)
    found = spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", "struct<features:array<struct<id:string,properties:map<string,string>,assets:map<string,struct<href:string>>>>>")["features"]).alias("f"))
    a = found.select(F.col("f.id").alias("scene"), F.col("f.properties").alias("p"), F.explode("f.assets").alias("band", "asset"))
    return a.select(F.concat_ws("/", "scene", F.concat("band", F.lit(".tif"))).alias("key"), F.col("asset.href").alias("url"), F.lit(None).cast("long").alias("size"), F.col("p")["collection"].alias("dataset"), F.col("p")["grid:code"].alias("tile"), "band", F.substring(F.col("p")["datetime"], 1, 10).alias("date"), F.col("p")["eo:cloud_cover"].cast("double").alias("cloud_cover"))


def first_by_tile(entries: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Of each tile and band the entry of least cloud, then date, then key; raises LookupError if a required (tile, band) is missing."""
    best = entries.groupBy("tile", "band").agg(F.min(F.struct("cloud_cover", "date", "key", "url")).alias("b")).select("tile", "band", "b.*")
    if required is not None:
        gone = required.join(best, ["tile", "band"], "left_anti").orderBy("tile", "band").limit(3).collect()
        if gone:
            raise LookupError(f"nothing found for {[tuple(r) for r in gone]}")
    return best


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def not_staged(wanted: DataFrame, staged: DataFrame) -> DataFrame:
    """Entries (key, size) that are not staged with their size yet."""
    return wanted.join(staged.select("key", "size"), ["key", "size"], "left_anti")
