"""Keys, caps and helpers that jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUBJECT = ("tenant_id", "subject_id")


#: Rows of a table that is sent to every executor; a larger one shuffles instead.
FEW = 100_000


def few(rows: DataFrame) -> DataFrame:
    """Broadcast if counted small."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def tenant_scope(df: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Rows of a tenant; all rows where no tenant is given."""
    return df if tenant_id is None else df.where(F.col("tenant_id") == tenant_id)


def same_key(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    """Null-safe equality of key columns, for tenants may be null."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def join_on(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left side's keys."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(other[f"_{n}"])
    return left.join(other, on, how).drop(*[f"_{n}" for n in names])


#: Scope of a request that names no tenant: rows of all tenants count.
ANY_TENANT = "\0"
SCOPE = ("scope", "subject_id")


def scoped(rows: DataFrame) -> DataFrame:
    """Rows once for requests without a tenant and, if they have a tenant, once for its requests."""
    scopes = F.when(F.col("tenant_id").isNull(), F.array(F.lit(ANY_TENANT))).otherwise(F.array(F.lit(ANY_TENANT), F.col("tenant_id")))
    return rows.withColumn("scope", F.explode(scopes))


def scoped_top(rows: DataFrame, cap: Column | int, *order: Column, more: tuple[str, ...] = (), rank: str = "pool_rank") -> DataFrame:
    """The first `cap` rows of each scope and subject (and of columns `more`) in a total order, with their rank.

    What is first in a scope is first in its tenant, so rows are cut by tenant before they are put into scopes.
    """
    own = Window.partitionBy(*SUBJECT, *more).orderBy(*order)
    few = rows.withColumn(rank, F.row_number().over(own)).where(F.col(rank) <= cap).drop(rank)
    every = Window.partitionBy(*SCOPE, *more).orderBy(*order)
    return scoped(few).withColumn(rank, F.row_number().over(every)).where(F.col(rank) <= cap)


def in_scope(requests: DataFrame) -> DataFrame:
    """Requests with the scope that they ask for; without a tenant_id column they name no tenant."""
    tenant = F.col("tenant_id") if "tenant_id" in requests.columns else F.lit(None).cast("string")
    return requests.withColumn("scope", F.coalesce(tenant, F.lit(ANY_TENANT)))


def per_subject_cap(df: DataFrame, cap: int | None, *order: Column, keys: tuple[str, ...] = SUBJECT) -> DataFrame:
    """The first `cap` rows of each subject; all of them where there is no cap."""
    if cap is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order, each row with the `total` number of rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def visible_subjects(df: DataFrame) -> DataFrame:
    """Without subjects that hold snapshots or are being set up."""
    return df.where(~F.col("subject_id").like("_snapshot/%") & ~F.col("subject_id").like("_bootstrap_tmp/%"))
