"""Text search over memories by postings of three-character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.asof import in_ranges
from recollect.operators.common import per_subject_cap

GRAM = 3
#: Memories are numbered in order of subject; a posting holds a gram's memories among so many neighbours, as 16-bit offsets.
CHUNK = 4_096
#: Chunks of memories that share a folder, so that a search reads only the folders of its candidates.
FOLDER = 256
#: How many of a query's grams, the rarest ones, are intersected.
RAREST = 4
_ROWS = "tenant_id string, subject_id string, memory_id string, kind string, content string, created_at timestamp, chunk long, offset smallint, folder long, batch int"
_POSTINGS = "gram string, chunk long, n int, offsets array<smallint>, bucket int, batch int"


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case."""
    low = F.lower(text)
    places = F.when(F.char_length(low) >= GRAM, F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def add_memories(path: str, memories: DataFrame, batch: int, buckets: int = 64) -> None:
    """Index a batch of active memories: numbered by (tenant, subject, time) in sorted range partitions, and their postings by gram.

    A batch that is run again replaces what it wrote. Memories with null content have no grams, so a search can't find them.
    """
    rows = memories.where("status = 'active'").select("tenant_id", "subject_id", "memory_id", "kind", "content", "created_at")
    laid = in_ranges(rows, ["tenant_id", "subject_id"], [F.col("created_at"), F.col("memory_id")], "gram-order")
    # A partition's chunks are numbered apart from all others', so nothing is counted over the whole table.
    chunk = F.shiftleft(F.col("_part").cast("long"), 24) + F.expr(f"_at div {CHUNK}")
    numbered = laid.withColumns({"chunk": chunk, "offset": (F.col("_at") % CHUNK).cast("smallint"), "folder": F.expr(f"{'_at'} div {CHUNK * FOLDER}") + F.col("_part") * 65_536})
    numbered = numbered.drop("_part", "_at")
    numbered.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows/batch={batch}")
    # Neighbours are read by one task, so lists are nearly whole before they are shuffled.
    made = numbered.select("chunk", "offset", F.explode(grams(F.col("content"))).alias("gram"))
    lists = made.groupBy("gram", "chunk").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # CHUNK at most
    lists = lists.select("gram", "chunk", F.size("offsets").alias("n"), "offsets", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"))
    lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")


def indexable(query: str) -> bool:
    """Whether postings can answer: at least one gram, and no wildcards or escapes of `ilike`."""
    return len(query.lower()) >= GRAM and not set(query) & set("%_\\")


def candidates(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """(batch, chunk, offset) of the memories that have the query's rarest grams, a superset of those that hold the query.

    Lists are intersected chunk by chunk; a gram that no memory has gives no candidates.
    """
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(grams(F.col("q"))).alias("gram"))
    asked = [tuple(r) for r in asked.select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).collect()]
    lists = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    lists = lists.where(F.col("bucket").isin([b for _, b in asked]) & F.col("gram").isin([g for g, _ in asked]))
    known = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the query
    rarest = sorted((known.get(g, 0), g) for g, _ in asked)[:RAREST]
    lists = lists.where(F.col("gram").isin([g for _, g in rarest]))
    met = lists.groupBy("batch", "chunk").agg(F.collect_list("offsets").alias("ls")).where(F.size("ls") == len(rarest))
    both = F.aggregate("ls", F.element_at("ls", 1), lambda a, x: F.array_intersect(a, x))
    return met.select("batch", "chunk", F.explode(both).alias("offset"))


def search_indexed(
    spark: SparkSession, path: str, query: str, kind: str | None = None, limit: int | None = 20, inactive: DataFrame | None = None, buckets: int = 64
) -> DataFrame:
    """What search_memories finds, by postings: each subject's newest memories that hold the query.

    Candidates are verified by `ilike`, so the result is exact. A query of fewer than three characters, or with the wildcards % and _ or
    a backslash, is a scan of the index's memories. `inactive` names memories (memory_id) that have been superseded since they were
    indexed. An empty query finds all memories, as the scan does.
    """
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    if indexable(query):
        found = candidates(spark, path, query, buckets)
        found = found.withColumn("folder", F.expr(f"(chunk & {(1 << 24) - 1}) div {FOLDER} + shiftright(chunk, 24) * 65536"))
        few = found.limit(100_001).count() <= 100_000
        rows = rows.join(F.broadcast(found) if few else found, ["batch", "folder", "chunk", "offset"], "left_semi")
    rows = rows if not query else rows.where(F.col("content").ilike(f"%{query}%"))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows if inactive is None else rows.join(inactive.select("memory_id"), "memory_id", "left_anti")
    rows = rows.select("tenant_id", "subject_id", "memory_id", "kind", "content", "created_at")
    return per_subject_cap(rows, limit, F.desc("created_at"), F.col("memory_id"))
