"""Usage by day, stored as mergeable sketches with exact counts beside them, and windows of days made from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two: the estimate is off by 1.04 / sqrt(2 ** 12) = 1.6 % in one standard deviation.
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)
_DAYS = "tenant_id string, metric string, n long, subjects binary, day date"


def usage_days(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tenant_id, metric, day, n, subjects): rows of each table by tenant and day, and a sketch of the subjects that they name.

    Rows of a null time belong to no day and are left out; a null tenant is a tenant; null subjects count in n alone.
    """
    out = None
    for name, df in tables.items():
        one = df.where("created_at IS NOT NULL").groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(
            F.count("*").alias("n"), F.hll_sketch_agg("subject_id", LG_K).alias("subjects")
        )
        one = one.select("tenant_id", F.lit(name).alias("metric"), "day", "n", "subjects")
        out = one if out is None else out.unionAll(one)
    return out


def store_days(tables: Mapping[str, DataFrame], path: str, first: str, last: str) -> None:
    """Write the days from first to last, each in a folder of its own; one that is stored again is replaced. Only these days' rows are read."""
    inside = (F.col("created_at") >= F.lit(first).cast("timestamp")) & (F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    rows = usage_days({name: df.where(inside) for name, df in tables.items()}).repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def rolling_usage(spark: SparkSession, path: str, as_of: str, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """(tenant_id, metric, days, n, subjects): of the last so many stored days up to as_of, the exact number of rows and the estimated
    number of subjects. Only those days' sketches are read, a row a tenant, metric and day; no row of the tables is."""
    end = F.lit(as_of).cast("date")
    rows = spark.read.schema(_DAYS).parquet(path).where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, max(windows))))
    each = F.array(*[F.when(F.col("day") > F.date_sub(end, n), n) for n in windows])
    rows = rows.withColumn("days", F.explode(F.array_compact(each)))
    return rows.groupBy("tenant_id", "metric", "days").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("subjects")).alias("subjects")
    )


def usage_rollup(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(level, tenant_id, subject_id, and a count of each table): of every subject (level 0), tenant (1) and of all (3), in one pass.

    The level tells a subtotal's null from a row's own null tenant.
    """
    out = None
    for name in tables:
        one = tables[name].select("tenant_id", "subject_id", *[F.lit(int(n == name)).alias(n) for n in tables])
        out = one if out is None else out.unionAll(one)
    sums = [F.sum(n).alias(n) for n in tables]
    return out.rollup("tenant_id", "subject_id").agg(F.grouping_id().cast("int").alias("level"), *sums).select("level", "tenant_id", "subject_id", *tables)
