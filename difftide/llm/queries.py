"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difftide.llm import ann, byte_bpe, divergence, embedding_dedup, packing, quality, resampling, sharding, simhash, suffix_dedup, suffix_tree, toxicity
from difftide.llm.checks import CHECKS as CHECKS
from difftide.llm.common import ship
from difftide.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed a window of 1,024."""
    counts = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed into sequences of at most 2,048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "shard": F.col("shard").cast("int"), "slot": F.col("slot").cast("long"), "grown_shard": F.lit(None).cast("int")})


@query
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: shingles of three words, at most three bits apart."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), words=3, radius=3)


@query
def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector: same label, cosine of 0.93 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to strings of 100 bytes that start earlier, and the digest of what stays."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by its nearest labelled examples."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the weak-label model, and whether it is kept."""
    return quality.quality(_table(spark, sf_dir, "documents"))


@query
def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by a probabilistic suffix tree, learnt from six of seven documents."""
    return suffix_tree.scores(_table(spark, sf_dir, "documents"), "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 7 = 2")


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the rank of the five in a hundred that are drawn."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that set them apart."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))
