"""The shared folder for results that are written and read again."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()  # `lists`: the paths written within each `passing` of this thread


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where none is set
    and the master is local, for executors of a cluster do not share the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recollect-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files: what they write is all that is read again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table that several parts of a job read, once, and read it back; it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    if lists := getattr(_open, "lists", None):
        lists[-1].append(path)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes within are deleted at the end: nothing that is read later may stand on them."""
    lists = _open.__dict__.setdefault("lists", [])
    lists.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in lists.pop():
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What `build` gives, materialized; the tables that it materialized on the way are deleted."""
    path = scratch(spark, tag)
    if lists := getattr(_open, "lists", None):
        lists[-1].append(path)
    with passing(spark), tidy(spark):
        df = build()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
