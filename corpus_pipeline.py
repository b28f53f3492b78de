"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

A classifier rejects low quality, one document of each group of near duplicates stays, repeated
passages go, documents with benchmark passages go, and the rest is encoded. The operators'
docstrings state what happens to null and empty texts and repeated rows. The result has doc_id,
n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotweave.llm import bpe, decontaminate, jaccard, quality, substring
from slotweave.llm.common import read_table, write_stage
from slotweave.session import drop_stages, stages_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the latent space have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = read_table(spark, sf_dir, "documents"), stages_made()
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name)
        # Only what the next stage reads stays in the shared folder.
        drop_stages(spark, earlier, newest=1)
    return docs
