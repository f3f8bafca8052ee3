"""Vectors for memories that lack one, from a provider that is asked once for each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.vectors import Provider, embed_column
from recollect.streaming.ingest import _read

_CACHE = "text_key string, model string, embedding array<float>"
_VECTORS = "memory_id string, embedding array<float>, epoch int"


def backfill_batch(memories: DataFrame, path: str, provider: Provider, model: str, epoch: int) -> None:
    """Vectors of a batch's memories that lack one, under the batch's epoch; texts that the cache lacks are embedded and kept in it.

    The key of the cache is (SHA-256 of the text, model). Distinct texts meet the cache first; a batch that is replayed finds what
    it embedded before and writes its vectors again. The cache grows by one committed write a batch, of texts that it lacked. Memories
    without content get no vector.
    """
    spark = memories.sparkSession
    rows = memories.where("embedding IS NULL AND content IS NOT NULL").select("memory_id", F.sha2("content", 256).alias("text_key"), "content")
    texts = rows.groupBy("text_key").agg(F.first("content").alias("content"))
    known = _read(spark, path, "cache", _CACHE).where(F.col("model") == model).select("text_key")
    fresh = texts.join(known, "text_key", "left_anti")
    fresh = fresh.select("text_key", F.lit(model).alias("model"), embed_column(F.col("content"), provider).alias("embedding"))
    fresh.write.mode("append").parquet(f"{path}/cache")
    cache = _read(spark, path, "cache", _CACHE).where(F.col("model") == model).select("text_key", "embedding")
    rows.select("memory_id", "text_key").join(cache, "text_key").select("memory_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors/epoch={epoch}")


def backfill_to_end(stream: DataFrame, path: str, checkpoint: str, provider: Provider, model: str) -> None:
    """Fill all memories that a bounded stream holds."""
    query = stream.writeStream.foreachBatch(lambda batch, epoch: backfill_batch(batch, path, provider, model, epoch))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_vectors(spark: SparkSession, memories: DataFrame, path: str) -> DataFrame:
    """The memories, with the vectors that were filled in where they lack one."""
    found = _read(spark, path, "vectors", _VECTORS).groupBy("memory_id").agg(F.max_by("embedding", "epoch").alias("_filled"))
    out = memories.join(found, "memory_id", "left").withColumn("embedding", F.coalesce("embedding", "_filled"))
    return out.select(memories.columns)
