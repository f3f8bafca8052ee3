"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with b < a. Each node's neighbours are tied to its least one."""
    if large:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = arcs.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("b < a").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b); component is the least id reachable.

    Nulls and loops are ignored; an empty edge table gives an empty result. Every round is
    written to the shared folder, so a lost executor costs one round at most, and the one before is deleted.
    """
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = materialize(edges.distinct(), "components")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        old, edges = edges, materialize(_star(_star(edges, True), False), "components")
        before, state = state, _state(edges)
        discard(old)
        if before == state:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
