"""Lexical and semantic search over memories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.operators.common import SCOPE, in_scope, per_subject_cap, scoped


def search_memories(memories: DataFrame, kind: str | None = None, query: str | None = None, limit: int | None = 20) -> DataFrame:
    """Active memories of each subject whose content holds the query (case-insensitive; % and _ are wildcards), newest first."""
    rows = memories.where("status = 'active'")
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows if not query else rows.where(F.col("content").ilike(f"%{query}%"))
    return per_subject_cap(rows, limit, F.desc("created_at"), F.col("memory_id"))


def _nearest(k: int):
    def nearest(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "memory_id", "distance"]
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "memory_id": [], "distance": []}).astype({"distance": float})
        q, v = (np.array(x.tolist(), np.float64) for x in (queries["vector"], rows["vector"]))
        q, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, v))
        d = 1 - q @ v.T
        out = []
        for i, query in enumerate(queries["query_id"]):
            at = np.argpartition(d[i], k - 1)[:k] if len(rows) > k else np.arange(len(rows))
            edge = d[i][at].max()
            at = np.flatnonzero(d[i] <= edge + 1e-12)  # ties at the edge are decided later
            out.append(pd.DataFrame({"query_id": query, "memory_id": rows["memory_id"].to_numpy()[at], "distance": d[i][at]}))
        return pd.concat(out)[columns]

    return nearest


def units(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one, as rows; a zero vector stays zero."""
    x = np.array(vectors.tolist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(memories: DataFrame) -> DataFrame:
    """Active memories that have a direction."""
    return memories.where("status = 'active' AND embedding IS NOT NULL AND exists(embedding, x -> x <> 0)")


def sample_units(memories: DataFrame, sample: int, seed: int) -> np.ndarray:
    """Unit vectors of about `sample` memories, by a hash of the id, on the driver."""
    rows = usable(memories).select("memory_id", "embedding")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "memory_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    got = rows.toPandas()
    return units(got["embedding"]) if len(got) else np.zeros((0, 1))


def spherical_centers(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds if len(x) else 0):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.maximum(size, 1e-300), centers)
    return centers


def fit_cells(memories: DataFrame, cells: int = 256, sample: int = 20_000, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of a coarse index: spherical k-means of about `sample` memories' vectors, by a hash of the id.

    Only the sample, which is bounded, goes to the driver; every memory is indexed by its nearest centroid.
    """
    return spherical_centers(sample_units(memories, sample, seed), cells, rounds, seed)


def with_cells(rows: DataFrame, centers: np.ndarray | None, probes: int) -> DataFrame:
    """Rows once for each of the `probes` cells nearest to their vector; without an index all are in cell 0."""
    if centers is None or not len(centers):
        return rows.withColumn("cell", F.lit(0))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        order = np.argsort(-(units(vectors) @ centers.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int32)))

    return rows.withColumn("cell", F.explode(nearest("vector")))


def dealt(queries: DataFrame, rows: DataFrame, more: list[str], block: int, most: int, run, schema: str) -> DataFrame:
    """`run` of each block of about `block` queries with each block of about `most` rows of the same (scope, subject, *more)."""
    key = [*SCOPE, *more]
    nq = queries.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    nv = rows.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("nv"))
    sizes = nq.join(nv, key)
    q = queries.join(sizes, key).withColumn("bq", F.pmod(F.xxhash64("query_id"), "nq").cast("int"))
    q = q.withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    v = rows.join(sizes, key).withColumn("bv", F.pmod(F.xxhash64("memory_id"), "nv").cast("int"))
    v = v.withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq", "nv")
    v = v.withColumnsRenamed({n: f"_{n}" for n in (*key, "bq", "bv")})
    return q.groupBy(*key, "bq", "bv").cogroup(v.groupBy(*[f"_{n}" for n in (*key, "bq", "bv")])).applyInPandas(run, schema)


def semantic_topk(
    queries: DataFrame, memories: DataFrame, k: int = 100, block: int = 256, rows: int = 8192, cells: np.ndarray | None = None, probes: int = 16
) -> DataFrame:
    """(query_id, rank, memory_id, distance): the k active memories nearest to each query in its subject.

    Queries (query_id, tenant_id, subject_id, vector) search their tenant's memories of the subject; those
    without a tenant search all tenants'. Queries and memories of a subject are dealt to blocks of about
    `block` queries and `rows` memories; every pair of blocks is one task's matrix product that
    keeps k memories a query, and the blocks' lists are merged. Ties go by memory_id.

    Exact, unless `cells` (of fit_cells) are given: then a query meets only the memories of the `probes` cells
    nearest to it, which costs probes / cells of the exact work; semantic_topk_recall measures what that misses.
    """
    active = scoped(usable(memories)).select(*SCOPE, "memory_id", F.col("embedding").cast("array<double>").alias("vector"))
    active = with_cells(active, cells, 1)
    queries = in_scope(queries).select(*SCOPE, "query_id", F.col("vector").cast("array<double>").alias("vector"))
    queries = with_cells(queries, cells, probes)
    kind = queries.schema["query_id"].dataType.simpleString()
    found = dealt(queries, active, ["cell"], block, rows, _nearest(k), f"query_id {kind}, memory_id string, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "memory_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "memory_id", "distance")


def query_vector_cache(cache: DataFrame, lookups: DataFrame, as_of: str, ttl_hours: int = 24, keep_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(hits, new cache) of keyed look-ups (text_key, model, embedding).

    A hit is an entry that has not expired. Every look-up refreshes its key's expiry; entries that
    expired more than `keep_days` ago go.
    """
    now = F.lit(as_of).cast("timestamp")
    keys = ["text_key", "model"]
    hits = lookups.select(*keys).distinct().join(cache.where(F.col("expires_at") > now), keys)
    fresh = lookups.groupBy(*keys).agg(F.first("embedding").alias("embedding"))
    fresh = fresh.withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(ttl_hours))).withColumn("created_at", now)
    old = cache.join(lookups.select(*keys).distinct(), keys, "left_anti")
    old = old.where(F.col("expires_at") >= now - F.make_dt_interval(F.lit(keep_days)))
    return hits, fresh.unionByName(old.select(fresh.columns))
