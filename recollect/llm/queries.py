"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import embedding_neardup, oracles, setsketch
from recollect.llm.common import table
from recollect.llm.hard_negatives import hard_negatives
from recollect.llm.merkle import manifest
from recollect.llm.mixing import mix
from recollect.llm.packing import pack
from recollect.llm.quality import grade_documents
from recollect.llm.secrets import find_secrets
from recollect.llm.sharding import hilbert_shards
from recollect.llm.token_counts import count_tokens
from recollect.llm.toxicity import score_documents
from recollect.llm.warc import archive_round_trip
from recollect.llm.winnow import edit_trial


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_trial(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_secret_scan,
        op3_packing,
        op4_quality_classifier,
        op5_token_counts,
        op6_sharding,
        op7_warc,
        op8_minhash_near_dedup,
        op9_mixing,
        op10_document_fingerprints,
        op11_toxicity,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": oracles.OP1,
    "op7_warc": oracles.OP7,
    "op8_minhash_near_dedup": oracles.OP8,
    "op9_mixing": oracles.OP9,
    "op12_merkle_manifest": oracles.OP12,
    "op13_hard_negatives": oracles.OP13,
}
