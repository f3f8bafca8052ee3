"""A training corpus from raw documents: grade, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm.common import discard, materialize, table
from recollect.llm.packing import pack
from recollect.llm.quality import select_good
from recollect.llm.secrets import redact_secrets
from recollect.llm.setsketch import Params
from recollect.llm.stages import drop_near_duplicates, repeat_by_mix


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is below one half go."""
    return select_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays."""
    return drop_near_duplicates(docs, Params(words=5, num=8, den=10, bands=26))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by marks."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the mix: repeated, dropped, or cut at a source's last block."""
    return repeat_by_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2,048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", grade),
    ("minhash_near_dedup", deduplicate),
    ("secret_scan", redact),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages of tokenizers, compressors and trained weights are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
