"""Hard-negative mining: exact best inner products, found behind bounds from segment means and deviations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import materialize, small_batches

#: Lengths of the segments at each level of the summary; each level cuts the segments of the one before.
SEGMENTS = (16, 4, 2)
#: Rows of a chunk and anchors of a block that meet in one task, and anchors scored at a time.
CHUNK, ANCHORS, STRIP = 8_192, 4_096, 128
#: Bounds are widened by this share of the norms' product, for means and deviations are kept as 32-bit floats.
SLACK = 1e-5


def summary(vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, sizes) of the segments of so many components: a deviation is the norm of what the mean leaves."""
    starts = np.arange(0, vectors.shape[1], length)
    sizes = np.minimum(length, vectors.shape[1] - starts)
    means = np.add.reduceat(vectors, starts, axis=1) / sizes if len(starts) else vectors[:, :0]
    left = vectors - np.repeat(means, sizes, axis=1)
    squares = np.add.reduceat(left * left, starts, axis=1) if len(starts) else left[:, :0]
    return means, np.sqrt(squares), sizes


def sketch(vectors: np.ndarray) -> np.ndarray:
    """Means and deviations of all levels, side by side."""
    parts = [x for length in SEGMENTS for x in summary(vectors, length)[:2]]
    return np.concatenate(parts, axis=1).astype("<f4")


def levels(sketches: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sketch as (means times the root of the segment's size, deviations) of each level."""
    out, at, sketches = [], 0, sketches.astype(float)
    for length in SEGMENTS:
        starts = np.arange(0, dims, length)
        root = np.sqrt(np.minimum(length, dims - starts))
        m, d = sketches[:, at : at + len(starts)], sketches[:, at + len(starts) : at + 2 * len(starts)]
        out.append((m * root, d))
        at += 2 * len(starts)
    return out


class Side:
    """Vectors of one block: ids, labels, whole components, norms and their summaries."""

    def __init__(self, rows: pd.DataFrame, dims: int):
        self.rows, self.ids, self.labels = (rows[n].to_numpy(np.int64) for n in ("row", "vec_id", "label"))
        self.vectors = np.frombuffer(b"".join(rows["vector"]), "<i8").reshape(len(rows), dims)
        self.levels = levels(np.frombuffer(b"".join(rows["sketch"]), "<f4").reshape(len(rows), -1), dims)
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))

    def part(self, at: slice) -> Side:
        out = object.__new__(Side)
        out.rows, out.ids, out.labels = self.rows[at], self.ids[at], self.labels[at]
        out.vectors, out.norms = self.vectors[at], self.norms[at]
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def _bounds(a: Side, b: Side, level: int, i: np.ndarray, j: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the scores of pairs (i, j): the means' product plus or minus the deviations'."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    if many:
        mean, spread = (am @ bm.T)[i, j], (ad @ bd.T)[i, j]
    else:
        mean, spread = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j])
    spread = spread + SLACK * a.norms[i] * b.norms[j]
    return mean - spread, mean + spread


def scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray, many: bool) -> np.ndarray:
    """Whole inner products; by floats where all sums are below 2**53, else in 64-bit integers."""
    exact = len(i) == 0 or a.norms.max() * b.norms.max() < 2**52
    x, y = (a.vectors.astype(float), b.vectors.astype(float)) if exact else (a.vectors, b.vectors)
    got = (x @ y.T)[i, j] if many and exact else np.einsum("ij,ij->i", x[i], y[j])
    return got.astype(np.int64)


def best(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` pairs of each i, by score downwards and then by id."""
    order = np.lexsort((ids[j], -score, i))
    i = i[order]
    starts = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0)) if len(i) else np.arange(0)
    return order[rank < most]


def _kth(i: np.ndarray, lower: np.ndarray, n: int, most: int) -> np.ndarray:
    """For each of n anchors the `most`-th greatest lower bound of its pairs, -inf where there are fewer: whatever lies below it isn't among the best."""
    order = np.lexsort((-lower, i))
    i, lower = i[order], lower[order]
    first = np.searchsorted(i, np.arange(n))
    last = np.searchsorted(i, np.arange(n), side="right")
    out = np.full(n, -np.inf)
    full = last - first >= most
    out[full] = lower[first[full] + most - 1]
    return out


def _positives(a: Side, b: Side, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the best rows of each anchor's own label, of one chunk."""
    i, j = np.nonzero((a.labels[:, None] == b.labels[None, :]) & (a.rows[:, None] != b.rows[None, :]))
    space = len(a.ids) * len(b.ids)
    for level in range(len(SEGMENTS)):
        lower, upper = _bounds(a, b, level, i, j, len(i) * 8 > space)
        keep = upper >= _kth(i, lower, len(a.ids), most)[i]
        i, j = i[keep], j[keep]
    score = scores(a, b, i, j, len(i) * 8 > space)
    keep = best(i, j, score, b.ids, most)
    return i[keep], j[keep], score[keep]


def _negatives(a: Side, b: Side, positive: np.ndarray, most: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(i, k, j, score) of the best rows of other labels that lie in the window of positive score k of anchor i; missing ones are nan."""
    floor, ceiling = low / 100 * positive, high / 100 * positive
    least = np.nanmin(np.where(np.isnan(floor), np.inf, floor), axis=1, initial=np.inf)
    highest = np.nanmax(np.where(np.isnan(ceiling), -np.inf, ceiling), axis=1, initial=-np.inf)
    i, j = np.nonzero(a.labels[:, None] != b.labels[None, :])
    space = len(a.ids) * len(b.ids)
    for level in range(len(SEGMENTS)):
        lower, upper = _bounds(a, b, level, i, j, len(i) * 8 > space)
        live = np.zeros(len(i), bool)
        for k in range(positive.shape[1]):  # a pair stays if it may be among the best of one window
            may = (upper >= floor[i, k]) & (lower <= ceiling[i, k])
            sure = (lower >= floor[i, k]) & (upper <= ceiling[i, k])
            live |= may & (upper >= _kth(i[sure], lower[sure], len(a.ids), most)[i])
        i, j = i[live], j[live]
    score = scores(a, b, i, j, len(i) * 8 > space)
    keep = (score >= np.floor(least)[i]) & (score <= np.ceil(highest)[i])
    i, j, score = i[keep], j[keep], score[keep]
    out = []
    for k in range(positive.shape[1]):
        p = np.nan_to_num(positive[i, k], nan=-1).astype(np.int64)
        here = np.flatnonzero((p >= 0) & (low * p <= 100 * score) & (100 * score <= high * p))
        got = here[best(i[here], j[here], score[here], b.ids, most)]
        out.append((i[got], np.full(len(got), k), j[got], score[got]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prepared(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, dims, vector, sketch): a number of the row's own, whole components floor(256 x) as 64-bit integers, and the
    summaries. Write it before use: the numbers are made anew by each run."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(e, lambda x: F.floor(x * 256).cast("long")).alias("v"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len)
            for d, part in batch.groupby(dims):
                flat = np.concatenate([np.zeros(0, np.int64), *part["v"]]).astype("<i8").reshape(len(part), d)
                sketches = sketch(flat.astype(float))
                yield pd.DataFrame({
                    "vec_id": part["vec_id"], "label": part["label"], "dims": np.int32(d),
                    "vector": [x.tobytes() for x in flat], "sketch": [x.tobytes() for x in sketches],
                })

    made = small_batches(rows).mapInPandas(make, "vec_id long, label long, dims int, vector binary, sketch binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _met(anchors: DataFrame, rows: DataFrame, chunks: int, blocks: int, run, schema: str) -> DataFrame:
    """`run` of every block of anchors with every chunk of rows; both are dealt by hash, so labels of any size are spread."""
    left = anchors.withColumn("_block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))
    left = left.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = rows.withColumn("_chunk", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(chunks)))
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dims", "_block", "_chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _first(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key by score; each chunk has sent `most` at most, from which the key's own `most` are taken."""
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id", "other")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor and each of its
    best rows of the same label, the best rows of other labels that score from `low` to `high` percent of it.

    Anchors are rows whose vec_id is divisible by `every`: they are the stated query set, and meet all rows in blocks. Rows
    with a null id, label or vector, or with a null or non-finite component, take no part; an empty vector scores 0. Only vectors
    of one length meet. Ties go by the smaller vec_id; rows that repeat an id are rows of their own, as
    anchors too; an anchor whose positive scores below 0 has no negatives for it; an empty table gives an empty
    result; other columns are not read. Scores are sums of 64-bit integers.
    """
    table = materialize(prepared(rows), "negatives-vectors")
    anchors = materialize(table.where(F.col("vec_id") % every == 0), "negatives-anchors")
    chunks, blocks = max(1, -(-table.count() // CHUNK)), max(1, -(-anchors.count() // ANCHORS))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dims = int(left["dims"].iloc[0])
            a, b = Side(left, dims), Side(right, dims)
            for k in range(0, len(left), STRIP):
                part = a.part(slice(k, k + STRIP))
                i, j, score = _positives(part, b, positives)
                out.append(pd.DataFrame({"anchor": part.rows[i], "anchor_id": part.ids[i], "other": b.rows[j], "other_id": b.ids[j], "score": score}))
        names = ["anchor", "anchor_id", "other", "other_id", "score"]
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names}, dtype=np.int64)

    found = _met(anchors, table, chunks, blocks, near, "anchor long, anchor_id long, other long, other_id long, score long")
    found = materialize(_first(found, ["anchor"], positives), "negatives-positives")
    listed = F.sort_array(F.collect_list(F.struct("rank", "other_id", "score")))  # `positives` at most
    held = found.groupBy("anchor").agg(listed.alias("_p"))
    asked = anchors.join(held, anchors["row"] == held["anchor"]).select(anchors["*"], F.col("_p.score").alias("positive"))

    def hard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dims = int(left["dims"].iloc[0])
            a, b = Side(left, dims), Side(right, dims)
            scores_of = np.full((len(left), positives), np.nan)
            for k, p in enumerate(left["positive"]):
                scores_of[k, : len(p)] = p
            for k in range(0, len(left), STRIP):
                part, mine = a.part(slice(k, k + STRIP)), scores_of[k : k + STRIP]
                i, p, j, score = _negatives(part, b, mine, negatives, low, high)
                out.append(pd.DataFrame({"anchor": part.rows[i], "place": p + 1, "other": b.rows[j], "other_id": b.ids[j], "score": score}))
        names = ["anchor", "place", "other", "other_id", "score"]
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names}, dtype=np.int64)

    hits = _met(asked, table, chunks, blocks, hard, "anchor long, place long, other long, other_id long, score long")
    hits = _first(hits, ["anchor", "place"], negatives)
    of = found.select(F.col("anchor").alias("_a"), "anchor_id", F.col("rank").alias("_place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hits.join(of, (F.col("anchor") == F.col("_a")) & (F.col("place") == F.col("_place")))
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
