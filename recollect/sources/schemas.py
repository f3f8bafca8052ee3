"""Table schemas and readers. JSON columns are strings, parsed where they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import strip

EPISODES = (
    "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, "
    "payload string, metadata string, provenance string, created_at timestamp, last_compiled_at timestamp"
)
MEMORIES = (
    "memory_id string, tenant_id string, subject_id string, kind string, content string, summary string, "
    "confidence double, valid_from timestamp, valid_to timestamp, source_episode_ids array<string>, metadata string, "
    "status string, embedding array<float>, created_at timestamp, updated_at timestamp"
)
RESOLUTIONS = (
    "resolution_id string, tenant_id string, subject_id string, session_id string, status string, "
    "resolution_summary string, resolved_at timestamp, metadata string, created_at timestamp, updated_at timestamp"
)

#: Longest subject, source and type.
MAX_SUBJECT, MAX_SOURCE, MAX_TYPE = 256, 128, 128


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_episodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, EPISODES, fmt)


def read_memories(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, MEMORIES, fmt)


def read_resolutions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, RESOLUTIONS, fmt)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: str, high: str, parts: int, **options: str
) -> DataFrame:
    """A table of a database, read by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def _too_long(name: str, most: int) -> Column:
    return F.coalesce(F.length(strip(F.col(name))) == 0, F.lit(True)) | (F.length(name) > most)


def check_episodes(df: DataFrame) -> DataFrame:
    """Add `rejected`: why an incoming episode is invalid, else null; fill empty JSON columns."""
    object_ = F.coalesce(strip(F.col("payload")).startswith("{") & F.try_parse_json("payload").isNotNull(), F.lit(False))
    why = (
        F.when(_too_long("subject_id", MAX_SUBJECT), "subject_id")
        .when(_too_long("source", MAX_SOURCE), "source")
        .when(_too_long("type", MAX_TYPE), "type")
        .when(~object_, "payload")
    )
    empty = {name: F.coalesce(F.col(name), F.lit("{}")) for name in ("metadata", "provenance") if name in df.columns}
    return df.withColumn("rejected", why).withColumns(empty)


def ingest_episodes(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Append the valid rows of a batch to a Parquet table; gives the rejected ones with their reason."""
    checked = check_episodes(df)
    checked.where("rejected IS NULL").drop("rejected").write.mode("append").partitionBy(*partition_by).parquet(path)
    return checked.where("rejected IS NOT NULL")
