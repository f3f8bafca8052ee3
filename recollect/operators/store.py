"""A stored table of subjects, of which a change rewrites only the buckets that it touches.

Rows lie in `data/version=v/bucket=b`, b by a hash of tenant and subject. A commit is one small table under `commits/n` that names each bucket's
version; readers take the last one. A change reads the touched buckets, writes them under a new version and then the commit, so
a reader sees all of it or nothing, and a change that dies before its commit leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.operators.common import SUBJECT, join_on

_COMMIT = "bucket int, version int, commit int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SUBJECT), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last commit and each bucket's version in it: a row a bucket."""
    rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    last = rows.agg(F.max("commit")).first()[0]
    return last, {r["bucket"]: r["version"] for r in rows.where(F.col("commit") == last).collect()}


def _commit(spark: SparkSession, path: str, n: int, versions: dict[int, int]) -> None:
    """Fails if somebody else has made commit n meanwhile."""
    rows = spark.createDataFrame(sorted(versions.items()), "bucket int, version int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/commit={n}")


def _write(rows: DataFrame, path: str, version: int, buckets: int) -> None:
    out = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", *SUBJECT)
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")


def create_store(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Store rows that have tenant_id and subject_id; the number of buckets stays."""
    _write(rows, path, 0, buckets)
    _commit(rows.sparkSession, path, 0, dict.fromkeys(range(buckets), 0))


def read_store(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of the last commit, or of some of its buckets."""
    _, versions = _versions(spark, path)
    held: dict[int, list[int]] = {}
    for bucket, version in versions.items():
        if only is None or bucket in only:
            held.setdefault(version, []).append(bucket)
    here = F.lit(False)
    for version, buckets in sorted(held.items()):
        here = here | ((F.col("version") == version) & F.col("bucket").isin(buckets))
    rows = spark.read.schema(f"{schema}, version int, bucket int").parquet(f"{path}/data")
    return rows.where(here).drop("version", "bucket")


def change_store(spark: SparkSession, path: str, schema: str, subjects: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of the given subjects (tenant_id, subject_id) by `change` of their rows; gives the buckets touched.

    `change` gets all rows of those buckets, other subjects' too, and must not make rows of other buckets.
    """
    last, versions = _versions(spark, path)
    touched = sorted(r[0] for r in subjects.select(_bucket(len(versions))).distinct().collect())  # at most the number of buckets
    if touched:
        _write(change(read_store(spark, path, schema, touched)), path, last + 1, len(versions))
        _commit(spark, path, last + 1, versions | dict.fromkeys(touched, last + 1))
    return touched


def purge_stored(spark: SparkSession, path: str, schema: str, subjects: DataFrame) -> list[int]:
    """Delete all rows of the subjects."""
    keys = subjects.select(*SUBJECT).distinct()
    return change_store(spark, path, schema, keys, lambda rows: join_on(rows, keys, SUBJECT, "left_anti"))


def upsert_stored(spark: SparkSession, path: str, schema: str, new: DataFrame, keys: tuple[str, ...], order: str) -> list[int]:
    """Put rows in the place of stored ones of the same keys, which have to name tenant and subject; of new rows of one key the last
    by `order` holds. Stored rows of other keys stay."""
    names = [f.split()[0] for f in schema.split(", ")]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*names)))
    rows = new.select(names).withColumn("_n", last).where("_n = 1").drop("_n")
    return change_store(spark, path, schema, new.select(*SUBJECT), lambda old: join_on(old, rows.select(*keys), keys, "left_anti").unionByName(rows))
