"""The table of objects: from headers read on the executors, from JSON, or as a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import OBJECT, ObjectChanged
from .tiff import describe
from .transport import FileTransport, as_range


def record(transport, key: str) -> dict:
    """One object's row; `error` says why it could not be described."""
    first: list = []

    def read(start: int, length: int) -> bytes:
        found = as_range(transport.get_range(key, start, length))
        if first and (found.total, found.identity) != first[0]:
            raise ObjectChanged(f"{key} changed while its header was read")
        first[:] = [(found.total, found.identity)]
        return found.data

    empty = dict.fromkeys(("size", "bigtiff", "nodata", "identity", "error", "header_bytes", "transform", "epsg", "levels"))
    try:
        size = as_range(transport.get_range(key, 0, 1)).total
        first.clear()
        return empty | {"key": key} | describe(read, size) | {"identity": first[0][1] if first else None}
    except Exception as e:  # kept as data: one bad object must not end the scan of a catalog
        return empty | {"key": key, "error": f"{type(e).__name__}: {e}"}


def scan(keys: DataFrame, transport, seed: DataFrame | None = None) -> DataFrame:
    """Objects of all keys (column key): seed's rows, and for other keys what their headers say."""
    if seed is not None:
        keys = keys.join(seed.select("key"), "key", "left_anti")
    arrow = to_arrow_schema(StructType.fromDDL(OBJECT))

    def run(it: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_pylist([record(transport, k) for k in b.column(0).slice(at, 64).to_pylist()], schema=arrow)

    found = keys.select("key").distinct().mapInArrow(run, OBJECT)
    return found if seed is None else seed.select(*found.columns).unionByName(found)


def retry(objects: DataFrame, transport) -> DataFrame:
    """objects, with those that could not be described tried again; successes are kept as they are."""
    good = objects.filter("error is null")
    return good.unionByName(scan(objects.filter("error is not null").select("key"), transport).select(*good.columns))


def details(objects: DataFrame) -> DataFrame:
    """objects with what follows from their levels: by level empty_tiles, sum_bytes and transform; bounds, dataset name of the key.

    A level's pixel is larger by the width of level 0 over its own.
    """
    t = "transform"
    per_level = F.transform("levels", lambda l: F.struct(
        l["level"].alias("level"),
        F.size(F.filter(l["bytecounts"], lambda n: n == 0)).alias("empty_tiles"),
        F.aggregate(l["bytecounts"], F.lit(0).cast("long"), lambda a, n: a + n).alias("sum_bytes"),
        F.when(F.col(t).isNotNull(), F.array(F.col(t)[0] * F.col("levels")[0]["width"] / l["width"], F.col(t)[1], F.col(t)[2], F.col(t)[3], F.col(t)[4] * F.col("levels")[0]["height"] / l["height"], F.col(t)[5])).alias("transform"),
    ))
    w, h = F.col("levels")[0]["width"], F.col("levels")[0]["height"]
    bounds = F.when(F.col(t).isNotNull() & F.col("levels").isNotNull(), F.array(F.col(t)[2], F.col(t)[5] + F.col(t)[4] * h, F.col(t)[2] + F.col(t)[0] * w, F.col(t)[5]))
    return objects.withColumn("details", per_level).withColumn("bounds", bounds)


def from_index(spark: SparkSession, index) -> DataFrame:
    """Objects of an index: a path or list of paths to JSON (as write_json, or one object of records by key), a dict of records by key, or a DataFrame."""
    if isinstance(index, DataFrame):
        return index
    if isinstance(index, dict):
        shape = StructType.fromDDL(OBJECT)
        rows = [json.dumps({"key": k} | dict(v)) for k, v in index.items()]
        text = spark.createDataFrame([(r,) for r in rows], "value string")
        return text.select(F.from_json("value", shape).alias("o")).select("o.*")
    whole = spark.read.text(index, wholetext=True)
    by_key = whole.select(F.from_json("value", f"map<string,struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in StructType.fromDDL(OBJECT))}>>").alias("m"))
    lines = whole.select(F.explode(F.split("value", "\n")).alias("value")).filter("value <> ''").select(F.from_json("value", StructType.fromDDL(OBJECT)).alias("o")).select("o.*").filter("key is not null and levels is not null")
    named = by_key.select(F.explode("m").alias("k", "o")).filter("o.levels is not null").select(F.col("k").alias("key"), *[F.col(f"o.{f.name}").alias(f.name) for f in StructType.fromDDL(OBJECT) if f.name != "key"])
    return lines.unionByName(named)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects written by write_json."""
    return spark.read.schema(OBJECT).json(path)


def write_json(objects: DataFrame, path: str) -> None:
    objects.write.mode("overwrite").json(path)


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(0)
        self.keys = keys


class CogIndex(DataSource):
    """spark.read.format("cogindex").option("root", folder).option("keys", "a.tif,b.tif").load()"""

    @classmethod
    def name(cls) -> str:
        return "cogindex"

    def schema(self) -> str:
        return OBJECT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IndexReader(self.options, schema)


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.keys, self.each, self.schema = options["root"], [k for k in options["keys"].split(",") if k], int(options.get("keyspertask", "64")), schema

    def partitions(self) -> list[_Keys]:
        return [_Keys(self.keys[i : i + self.each]) for i in range(0, len(self.keys), self.each)]

    def read(self, partition: _Keys) -> Iterator[pa.RecordBatch]:
        rows = [record(FileTransport(self.root), k) for k in partition.keys]
        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(self.schema))
