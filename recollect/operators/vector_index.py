"""Nearest memories by inverted lists with product codes: a short list by table look-ups, then exact distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.vectors import dot
from recollect.operators.common import SCOPE, in_scope, scoped
from recollect.operators.search import dealt, sample_units, spherical_centers, units, usable

#: Deviations (root mean squares) of a score's error that a memory may lie under the k-th best score and still get its exact distance.
SURE = 3.0


@dataclass(frozen=True)
class VectorIndex:
    """Centers of the lists (cells, dims), for each part of a residual its code book (parts, codes, width), and for each cell how far its
    scores of near vectors are off, as a multiple of `spread`."""

    centers: np.ndarray
    books: np.ndarray
    errors: np.ndarray

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, parts, width), the last part filled up with zeros."""
        parts, _, width = self.books.shape
        out = np.zeros((len(x), parts * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, width)

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centers.T), axis=1, kind="stable")[:, :n].astype(np.int32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors: a byte for each part of what the cell's center leaves."""
        cell = self.nearest_cells(x, 1)[:, 0]
        left = self.split(x - self.centers[cell])
        code = np.stack([_nearest(left[:, p], self.books[p]) for p in range(self.books.shape[0])], axis=1)
        return cell, code.astype(np.uint8)

    def miss(self, x: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The length of what each vector's code leaves."""
        left = self.split(x - self.centers[cell])
        return np.sqrt(sum(((left[:, p] - self.books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(self.books.shape[0])))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(n, parts, codes): what each code adds to the inner product with each query."""
        return np.einsum("npw,pcw->npc", self.split(q), self.books)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the inner products with a cell's vectors, as their codes give them."""
        for base, table in zip(q @ self.centers[cell], self.tables(q)):
            yield base + table[np.arange(codes.shape[1])[None, :], codes].sum(axis=1)

    def spread(self, q: np.ndarray, cell: int) -> np.ndarray:
        """For each query what a miss of length one would add to a score in standard deviation, if it pointed anywhere."""
        return np.linalg.norm(q - self.centers[cell], axis=1) / np.sqrt(q.shape[1])

    def measured(self, x: np.ndarray, most: int = 512, near: int = 10) -> np.ndarray:
        """`errors`, the root mean square over up to `most` of the vectors in a cell and the `near` others nearest to each; 1 where there are none."""
        cell, codes = self.encode(x)
        miss, out = self.miss(x, cell, codes), np.ones(len(self.centers))
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)[:most]
            true = x[at] @ x[at].T
            units = self.spread(x[at], c)[:, None] * miss[at][None, :]
            off = (true - np.stack(list(self.scores(x[at], c, codes[at])))) / np.maximum(units, 1e-12)
            np.fill_diagonal(true, -np.inf)
            off = np.take_along_axis(off, np.argsort(-true, axis=1, kind="stable")[:, : min(near, len(at) - 1)], 1)
            out[c] = np.sqrt((off**2).mean()) if off.size else 1.0
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)


def _book(x: np.ndarray, codes: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of one part of the residuals; of fewer rows than codes some codes are never used."""
    centers = np.zeros((codes, x.shape[1]))
    first = x[rng.choice(len(x), min(codes, len(x)), replace=False)]
    centers[: len(first)] = first
    for _ in range(rounds):
        near = _nearest(x, centers[: len(first)])
        count = np.bincount(near, minlength=len(first))
        sums = np.zeros_like(first)
        np.add.at(sums, near, x)
        centers[: len(first)] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers[: len(first)])
    return centers


def fit_index(memories: DataFrame, cells: int = 256, parts: int = 16, codes: int = 256, sample: int = 20_000, rounds: int = 8, seed: int = 11) -> VectorIndex:
    """Centers and code books from about `sample` memories' vectors, by a hash of the id; only they go to the driver. Every memory is indexed.

    Without a usable vector there is nothing to fit, which is an error.
    """
    x = sample_units(memories, sample, seed)
    if not len(x):
        raise ValueError("no active memory has a vector to fit the index to")
    centers = spherical_centers(x, cells, rounds, seed)
    index = VectorIndex(centers, np.zeros((parts, 1, -(-x.shape[1] // parts))), np.ones(len(centers)))
    left, rng = index.split(x - centers[(x @ centers.T).argmax(axis=1)]), np.random.default_rng(seed)
    index = replace(index, books=np.stack([_book(left[:, p], codes, rounds, rng) for p in range(parts)]))
    return replace(index, errors=index.measured(x))


def save_index(spark: SparkSession, index: VectorIndex, path: str) -> None:
    """The parameters, beside the lists."""
    rows = [(name, list(x.shape), x.ravel().tolist()) for name, x in (("centers", index.centers), ("books", index.books), ("errors", index.errors))]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/parameters").collect()}  # three rows
    return VectorIndex(rows["centers"], rows["books"], rows["errors"])


def add_vectors(path: str, memories: DataFrame, batch: int) -> None:
    """Index a batch of memories under the stored parameters, without fitting anew: their lists' codes, and their vectors for exact distances.

    A batch that is run again replaces what it wrote. Memories that aren't active, or whose vector is null or zero, are left out.
    """
    index = load_index(memories.sparkSession, path)

    @F.pandas_udf("cell int, code binary, miss double")
    def code(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "code": [], "miss": np.zeros(0)})
        x = units(vectors)
        cell, codes = index.encode(x)
        return pd.DataFrame({"cell": cell, "code": [c.tobytes() for c in codes], "miss": index.miss(x, cell, codes)})

    rows = usable(memories).select("tenant_id", "subject_id", "memory_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows.select("tenant_id", "subject_id", "memory_id", code("vector").alias("_c")).select("tenant_id", "subject_id", "memory_id", "_c.*").write.mode(
        "overwrite"
    ).parquet(f"{path}/lists/batch={batch}")
    rows.select("memory_id", "vector").write.mode("overwrite").parquet(f"{path}/vectors/batch={batch}")


def _asked(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(index.nearest_cells(units(vectors), probes)) if len(vectors) else [], dtype=object)

    rows = in_scope(queries).select(*SCOPE, "query_id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.withColumn("cell", F.explode(cells("vector")))


def short_lists(path: str, queries: DataFrame, k: int, probes: int, short: int, block: int = 256, rows: int = 65_536) -> DataFrame:
    """(query_id, memory_id) of the memories that get exact distances: of each query the best short * k by their codes, and all others
    whose score is within SURE deviations of its error of the k-th best.

    However many memories a cell holds, one is left out only if its code makes it unlikely to be among the k nearest: errors grow with what
    a code misses, and how much they do was measured cell by cell when the index was fitted. A block keeps what its own k-th best
    allows, which is no less than what the k-th best of all lists does.
    """
    spark = queries.sparkSession
    index = load_index(spark, path)
    lists = scoped(spark.read.parquet(f"{path}/lists")).select(*SCOPE, "cell", "memory_id", "code", "miss")
    most = short * k

    def look_up(key: tuple, asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or listed.empty:
            return pd.DataFrame({"query_id": asked["query_id"][:0], "memory_id": listed["memory_id"][:0], "score": [], "reach": []}).astype({"score": float, "reach": float})
        q, codes = units(asked["vector"]), np.frombuffer(b"".join(listed["code"]), np.uint8).reshape(len(listed), -1)
        cell, ids, out = int(asked["cell"].iloc[0]), listed["memory_id"].to_numpy(), []
        spread = SURE * index.errors[cell] * index.spread(q, cell)
        for i, (query, score) in enumerate(zip(asked["query_id"], index.scores(q, cell, codes))):
            reach = score + spread[i] * listed["miss"].to_numpy()
            if len(score) > most:
                kept = reach >= np.partition(score, -k)[-k]
                kept[np.argpartition(-score, most - 1)[:most]] = True
                at = np.flatnonzero(kept)
            else:
                at = np.arange(len(score))
            out.append(pd.DataFrame({"query_id": query, "memory_id": ids[at], "score": score[at], "reach": reach[at]}))
        return pd.concat(out)

    kind = queries.schema["query_id"].dataType.simpleString()
    found = dealt(_asked(queries, index, probes), lists, ["cell"], block, rows, look_up, f"query_id {kind}, memory_id string, score double, reach double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    found = found.withColumn("_r", F.row_number().over(best)).withColumn("_k", F.nth_value("score", k).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.where((F.col("_r") <= most) | (F.col("reach") >= F.col("_k"))).select("query_id", "memory_id")


def search_index(path: str, queries: DataFrame, k: int = 100, probes: int = 16, short: int = 4, block: int = 256, rows: int = 65_536) -> DataFrame:
    """(query_id, rank, memory_id, distance) of about the k nearest memories of each query's subject, as semantic_topk gives them exactly.

    A query (query_id, tenant_id, subject_id, vector) meets the lists of the `probes` cells nearest to it, within its subject and
    tenant. Codes are scored by look-ups in the query's tables; those of its short list get exact distances.
    """
    found = short_lists(path, queries, k, probes, short, block, rows)
    spark = queries.sparkSession
    exact = found.join(spark.read.parquet(f"{path}/vectors").select("memory_id", F.col("vector").alias("_v")), "memory_id")
    exact = exact.join(queries.select("query_id", F.col("vector").cast("array<double>").alias("_q")), "query_id")
    cosine = dot(F.col("_q"), F.col("_v")) / F.greatest(F.sqrt(dot(F.col("_q"), F.col("_q"))) * F.sqrt(dot(F.col("_v"), F.col("_v"))), F.lit(1e-300))
    exact = exact.withColumn("distance", 1 - cosine)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "memory_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "memory_id", "distance")


def index_work(path: str, queries: DataFrame, k: int, probes: int, short: int) -> DataFrame:
    """One row: queries, exact (the distances that an exact search computes) and work, those that the index does instead: centers
    and vectors of the short lists one each, and a code `parts / dims` of one, for it takes so many additions in place of multiplications."""
    spark = queries.sparkSession
    index = load_index(spark, path)
    lists = scoped(spark.read.parquet(f"{path}/lists")).groupBy(*SCOPE, "cell").agg(F.count("*").alias("n"))
    whole = lists.groupBy(*SCOPE).agg(F.sum("n").alias("n"))
    exact = in_scope(queries).join(whole, list(SCOPE)).groupBy("query_id").agg(F.sum("n").alias("exact"))
    read = _asked(queries, index, probes).join(lists, [*SCOPE, "cell"]).groupBy("query_id").agg(F.sum("n").alias("read"))
    listed = short_lists(path, queries, k, probes, short).groupBy("query_id").agg(F.count("*").alias("listed"))
    each = exact.join(read, "query_id", "left").join(listed, "query_id", "left").fillna(0, ["read", "listed"])
    part = index.books.shape[0] / index.centers.shape[1]
    cost = F.col("read") * part + F.col("listed") + len(index.centers)
    return each.agg(F.count("*").alias("queries"), F.sum("exact").alias("exact"), F.sum(cost).alias("work"))
