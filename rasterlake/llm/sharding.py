"""Rendezvous (highest-random-weight) hashing of stable record keys over weighted shards.

Each (key, shard) pair has a hash u in (0, 1); the record goes to the shard with the least
-ln(u) / weight.  Hashes are md5, the same in any engine.  A shard's scores do not depend on the other shards, so adding one only moves
the records that it wins, and a shard holds a share of keys in proportion to its weight.
All on DataFrame functions; no row's text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, unit_from_md5


def rendezvous(keys: Sequence[Column], weights: Sequence[float], seed: int = 17) -> Column:
    """The shard (0..len(weights)-1) of a record by its key columns.

    Ties go to the lower shard.  Null keys are a key like any other.
    Raises ValueError without shards or for a weight that isn't positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight, and there must be a shard")
    scores = []
    for shard, weight in enumerate(weights):
        u = unit_from_md5(F.lit(seed), *keys, F.lit(shard))
        scores.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return scores[0]["shard"] if len(scores) == 1 else F.least(*scores)["shard"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    grown: float | None = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_a_chunk: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """Shard, slot in the shard, and the shard after one more of weight `grown` has joined.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law ('key'), shard, slot,
    grown_shard.  Slots run from 0 without gaps in each shard: rows are numbered in hash
    chunks of a shard at once (256, or more so that they have some `rows_a_chunk` rows at most)
    and moved up by the sizes of the chunks before, so no task gets a whole shard.

    Nulls, ties, long texts: a null text has size 1 and the checksum of no bytes; null ids share a shard.  Equal
    rows and repeated ids each get a slot of their own.  Of an empty table the result is empty.
    Other columns are not looked at.
    """
    text = text_of(text_col)
    chunks = max(256, docs.count() // (rows_a_chunk * len(weights)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous([F.col(id_col)], weights, seed).alias("shard"),
        (rendezvous([F.col(id_col)], [*weights, grown], seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("chunk", F.floor(unit_from_md5(F.lit(seed), F.lit("chunk"), F.col("doc_id"), F.col("text_crc32"), F.col("size")) * chunks))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    at = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    # both sides are dealt by shard and chunk
    return (
        rows.withColumn("at", at)
        .join(offsets, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("at") - 1).alias("slot"),
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )


def _unit(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


_ID = "coalesce(doc_id::VARCHAR, 'null')"
#: op5 over documents, for DuckDB; crc32 byte by byte, by the usual table.
ORACLE = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc),
s AS (
  SELECT *, list_transform(range(17), lambda k: -ln({_unit("17", _ID, "k")})) AS score, floor({_unit("17", "'chunk'", _ID, "text_crc32", "size")} * greatest(256, (SELECT count(*) FROM documents) // 16777216))::BIGINT AS chunk FROM base),
d AS (SELECT *, list_position(score[1:16], list_min(score[1:16])) - 1 AS shard, list_position(score, list_min(score)) - 1 AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM d
"""
