"""Episodes taken in exactly once: a ledger of epochs, and Bloom filters of stored ids ahead of the exact look-up."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.sources.schemas import check_episodes
from recollect.sources.scratch import materialize

#: Bits and hashes an id has in a filter, for one false alarm in about a hundred; and ids of one filter at most, about.
BITS, HASHES, SEGMENT = 10, 7, 1_000_000
_FILTERS = "bucket int, segments int, segment int, bits binary, epoch int"
_LEDGER = "accepted long, rejected long, epoch int"


def _hashed(ids: DataFrame, buckets: int) -> DataFrame:
    """Ids with their bucket and two 64-bit hashes."""
    one, two = F.xxhash64(F.lit(1), "episode_id"), F.xxhash64(F.lit(2), "episode_id")
    return ids.select("episode_id", F.pmod(one, F.lit(buckets)).cast("int").alias("bucket"), one.alias("h1"), two.alias("h2"))


def places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(n, HASHES): the bits of each id in a filter of `size` bits, by double hashing."""
    a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(size)).astype(np.int64)


def _build(key: tuple, ids: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(max(64, -(-len(ids) * BITS // 8) * 8), bool)
    bits[places(ids["h1"].to_numpy(), ids["h2"].to_numpy(), len(bits)).ravel()] = True
    return pd.DataFrame({"bucket": [key[0]], "segments": [key[1]], "segment": [key[2]], "bits": [np.packbits(bits).tobytes()]})


def _maybe(key: tuple, ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The ids of a bucket that some filter of it may hold."""
    h1, h2, hit = ids["h1"].to_numpy(), ids["h2"].to_numpy(), np.zeros(len(ids), bool)
    for segments, segment, packed in zip(filters["segments"], filters["segment"], filters["bits"], strict=True):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        mine = h2 % segments == segment  # as pmod does
        hit |= mine & bits[places(h1, h2, len(bits))].all(axis=1)
    return ids.loc[hit, ["episode_id", "bucket"]]


def committed(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Epochs whose ledger entry is written; a row each."""
    ledger = _read(spark, path, "ledger", _LEDGER)
    return sorted(r["epoch"] for r in ledger.select("epoch").distinct().collect() if before is None or r["epoch"] < before)


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty before anything is written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)


def stored_episodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of committed epochs."""
    rows = _read(spark, path, "rows", f"{schema}, epoch int, bucket int")
    return rows.where(F.col("epoch").isin(committed(spark, path))).drop("epoch", "bucket")


def rejected_episodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What committed epochs turned away, with the reason in `rejected`: a field that is invalid, or `duplicate`."""
    rows = _read(spark, path, "rejects", f"{schema}, rejected string, epoch int")
    return rows.where(F.col("epoch").isin(committed(spark, path))).drop("epoch")


def ingest_batch(batch: DataFrame, path: str, epoch: int, buckets: int = 64) -> None:
    """Take in one batch: valid rows whose id is new go to the store, all others to its rejects.

    Of rows of one id the first by time is taken. Each id is asked of its bucket's filters first; only those that a filter may hold
    are looked up among the stored ids, so a false alarm costs a look-up and never a row. A batch's folders carry its epoch, and its
    ledger entry is written last: readers see it whole or not at all, and a batch that is replayed replaces itself. A null id is invalid.
    """
    spark = batch.sparkSession
    if epoch in committed(spark, path):
        return
    checked = check_episodes(batch)
    checked = checked.withColumn("rejected", F.when(F.col("episode_id").isNull(), "episode_id").otherwise(F.col("rejected")))
    again = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.col("rejected").isNotNull(), "created_at", "payload")) > 1
    checked = materialize(checked.withColumn("rejected", F.coalesce("rejected", F.when(again, "duplicate"))), "ingest-checked")

    ids = materialize(_hashed(checked.where("rejected IS NULL"), buckets), "ingest-ids")
    before = committed(spark, path, epoch)
    filters = _read(spark, path, "filters", _FILTERS).where(F.col("epoch").isin(before))
    maybe = ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_maybe, "episode_id string, bucket int")
    maybe = materialize(maybe, "ingest-maybe")
    asked = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most `buckets`
    stored = _read(spark, path, "rows", "episode_id string, epoch int, bucket int").where(F.col("epoch").isin(before) & F.col("bucket").isin(asked))
    known = materialize(maybe.join(stored.select("episode_id"), "episode_id", "left_semi").select("episode_id"), "ingest-known")

    late = known.select("episode_id", F.lit("duplicate").alias("_late"))
    judged = checked.join(late, "episode_id", "left")
    judged = judged.withColumn("rejected", F.coalesce("rejected", "_late")).drop("_late").select(checked.columns)
    fine = judged.where("rejected IS NULL").drop("rejected").withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "episode_id"), F.lit(buckets)).cast("int"))
    fine.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/epoch={epoch}")
    judged.where("rejected IS NOT NULL").write.mode("overwrite").parquet(f"{path}/rejects/epoch={epoch}")

    new = ids.join(known, "episode_id", "left_anti")
    accepted, total = new.count(), checked.count()
    segments = max(1, math.ceil(accepted / (buckets * SEGMENT)))
    dealt = new.withColumns({"segments": F.lit(segments), "segment": F.pmod("h2", F.lit(segments)).cast("int")})
    made = dealt.groupBy("bucket", "segments", "segment").applyInPandas(_build, "bucket int, segments int, segment int, bits binary")
    made.write.mode("overwrite").parquet(f"{path}/filters/epoch={epoch}")
    entry = spark.createDataFrame([(accepted, total - accepted)], "accepted long, rejected long")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/epoch={epoch}")


def ingest_to_end(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Take in all that a bounded source holds; a restart goes on from the checkpoint, and a batch that it replays adds nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, epoch: ingest_batch(batch, path, epoch, buckets)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
