"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Largest table, in rows, that is sent to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is
    local, for executors of a cluster do not share the driver's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again. What was made of them has been written itself."""
    for df in tables:
        path, context = getattr(df, "scratch", None), getattr(df.sparkSession, "sparkContext", None)
        if path and context:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(df: DataFrame, rows: int = 512, size: int = 1 << 24) -> DataFrame:
    """Let few rows, and few bytes, at a time go to Python: texts can be long, and a worker holds a batch.

    Spark reads the settings when the plan runs, so they are left on the session; smaller ones stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key, None) or "-1"
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialized table only if its row count is within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often and deep body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str = "_helper") -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_position(df: DataFrame, order: list[Column], tag: str) -> tuple[DataFrame, int]:
    """Add `_pos`, the 0-based global position by `order`, and give the row count.

    Range partitions are sorted and written once; the position is the partition's offset
    plus the row's index there. Only one count per partition meets in one place.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("_mid", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_mid", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    index = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    out = laid.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn("_pos", F.col("_off") + index).drop("_part", "_n", "_off", "_mid"), total


class Memo(dict):
    """word -> make(word), kept for at most two generations: words that come again pass to the next one, so a vocabulary
    of any size keeps its frequent words.

    A generation ends at `most` words or `size` bytes, counting words, what is made of them if it is bytes, and 200 bytes
    each for their objects. Words of over LONG bytes are made anew each time: they are seldom repeated and may be of any length.
    """

    LONG = 64

    def __init__(self, most: int = 125_000, size: int = 1 << 24):
        super().__init__()
        self.most, self.size, self.held, self.old = most, size, 0, {}

    def make(self, word: bytes):
        raise NotImplementedError

    def __missing__(self, word: bytes):
        if len(word) > self.LONG:
            return self.make(word)
        if len(self) >= self.most or self.held >= self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        self.held += len(word) + (len(found) if isinstance(found, bytes) else 0) + 200
        return found


def utf8_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8 (bytes.split knows exactly these separators)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
