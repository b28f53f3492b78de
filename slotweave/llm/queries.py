"""The queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    jaccard,
    licenses,
    mixture,
    pitman_yor,
    prefix_trie,
    quality,
    sharding,
    substring,
    topk,
    warc,
)
from slotweave.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(rows, public_tokenizers.path("word_bpe_49k.json")))


@_query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.repeated_words(read_table(spark, folder, "documents"))


@_query
def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc.write_archive(read_table(spark, folder, "pages"))
    return warc.page_digests(warc.read_archive(spark, archive))


@_query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, folder, "documents"))


@_query
def op5_hash_ring(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, folder, "documents"), shards=8)


@_query
def op6_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score(read_table(spark, folder, "documents"))


@_query
def op7_quality_network(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@_query
def op8_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer", "first_word")


@_query
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read_table(spark, folder, "embeddings"), k=10, every=100, scale=1024)


@_query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read_table(spark, folder, "documents"))


@_query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, folder, "conversations")).drop("n_ends", "mark")


@_query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, anchors=F.col("vec_id") % 50 == 0)


@_query
def op13_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# Of operators whose results SQL cannot state as a whole: the columns or counts that it can.


@_query
def shard_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and slots per shard of op5."""
    rows = op5_hash_ring(spark, folder)
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


@_query
def language_base(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op6 that do not depend on the sampler."""
    rows = op6_pitman_yor(spark, folder)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


@_query
def quality_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of op7 per row, whether its score is a probability, and whether its decision follows it."""
    rows = op7_quality_network(spark, folder)
    follows = F.col("predicted") == (F.col("score") >= 0.3).cast("int")
    return rows.select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), follows.alias("follows"))


@_query
def license_base(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op10 that do not depend on its own rules."""
    return op10_license_scan(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
