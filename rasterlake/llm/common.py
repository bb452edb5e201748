"""What the corpus operators share: shared-folder tables, word splitting, stable hashes."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (local[...]) makes a temporary folder; on a
    cluster no folder would be shared, so RuntimeError is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table that was written.

    This cuts the lineage: later jobs read files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that materialize() returned, once nothing will read it again."""
    _drop(table.sparkSession, table._table_path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_drop, spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has been stopped
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_folder(uri: str):
    """A file system for Python code, and the folder's path in it; file, hdfs, s3, gs and abfs URIs."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def text_of(name: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def unit_from_md5(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, joined by colons: the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def mark_maybe(rows: DataFrame, key: str, ids: DataFrame, name: str, bits: int = 23) -> DataFrame:
    """rows with a boolean column: may the key be among ids[key]?

    By a bitmap of hashes: true for all that are, and for others, the more the larger ids is.  The
    broadcast bitmap has 2 ** bits bits, whatever the input.  A null key is a key like any other.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word, bit = F.shiftright(spot, 6).cast("int"), F.pmod(spot, F.lit(64)).cast("int")
    words = ids.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    there = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(words), word == F.col("_word"), "left").withColumn(name, F.coalesce(there, F.lit(False))).drop("_word", "_bits")


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """The rows whose key may be among ids[key] (mark_maybe); put it before a join, to shuffle less."""
    return mark_maybe(rows, key, ids, "_maybe", bits).filter("_maybe").drop("_maybe")


def tidy(run):
    """run, a function for mapInArrow, whose memory goes back to the system when its task ends.

    Workers live on between stages, and what one stage freed but kept would count against the next.
    """

    def inner(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not the GNU C library
            pass

    return inner


def batches(it, rows: int = 512, size: int = 4 << 20):
    """Split Arrow batches so that none has more than `rows` rows or, one long row aside, `size` bytes."""
    for b in it:
        step = max(1, min(rows, int(b.num_rows * size / max(b.nbytes, 1))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
