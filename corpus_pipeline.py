"""A training-data pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import mixing, neardup, pieces, secrets, toxicity
from rasterlake.llm.common import materialize

#: Documents scored this or more are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC.  Rows without an id are kept."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = scored.filter(F.col("score") >= TOXIC).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document of least id; of rows that share that id, the one whose text has
    the least hash.  Rows without an id are kept."""
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; n_chars is that of the new text where it has changed."""
    old = docs.withColumn("_old", F.col("text"))
    new = secrets.redact(old)
    return new.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("_old")), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses none of the learned, sampled or encoding stages; tests hold run() against brute force.
ORACLE_SQL = None
