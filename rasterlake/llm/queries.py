"""The ten corpus queries over the tables in sf_dir, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, fingerprints, mixing, neardup, pieces, secrets, sharding, tokens, toxicity, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (neardup.near_duplicates)."""
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document (toxicity.score)."""
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and its edited text (fingerprints.fingerprint)."""
    return fingerprints.fingerprint(_documents(spark, sf_dir))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's URL (urls.judge), learned from those that urls.labelled marks."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, urls.labelled(pages))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendezvous shards of documents (sharding.assign_shards): 16, and with one more."""
    return sharding.assign_shards(_documents(spark, sf_dir))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links among all embeddings (embeddings.link)."""
    return embeddings.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents (secrets.scan)."""
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of each document's ids, read back from the files (tokens.tokenize)."""
    return tokens.tokenize(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in the mix (mixing.mix)."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document (pieces.encode_documents)."""
    return pieces.encode_documents(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_neardup, op2_toxicity, op3_fingerprints, op4_urls, op5_sharding, op6_embeddings, op7_secrets, op8_tokens, op9_mixing, op10_pieces)}
ORACLES = {"op5_sharding": sharding.ORACLE, "op7_secrets": secrets.ORACLE, "op9_mixing": mixing.ORACLE}
