"""Embedding near-duplicates by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import materialize, small_side
from recollect.llm.components import connected_components


@dataclass(frozen=True)
class Plan:
    """What the codes of one corpus look like; every figure follows from its size and width."""

    dim: int
    bits: int  # of a band; a bucket holds about 32 vectors that are unlike, more beyond 2**23 vectors
    bands: int
    cosine: float
    miss: float = 1e-5  # of a pair right at the threshold, over all bands
    sigmas: float = 5.0  # width of the confidence bound
    seed: int = 17
    block: int = 1024

    @classmethod
    def of(cls, n: int, dim: int, cosine: float, most_bits: int = 18) -> Plan:
        """Bits grow with the number of vectors up to most_bits, and with them the number of bands and of
        a vector's copies: 188 at most for a cosine of 0.9. Beyond that buckets grow, and are split."""
        bits = min(most_bits, max(4, round(math.log2(max(2, n))) - 5))
        hit = (1 - math.acos(cosine) / math.pi) ** bits
        return cls(dim, bits, math.ceil(math.log(cls.miss) / math.log1p(-hit)), cosine)

    def rotations(self) -> np.ndarray:
        """Random orthonormal matrices, enough for the bands' bits, side by side: (dim, k * dim)."""
        rng = np.random.default_rng(self.seed)
        k = math.ceil(self.bands * self.bits / self.dim)
        return np.hstack([np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0] for _ in range(k)])


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_keys(rotated: np.ndarray, plan: Plan) -> np.ndarray:
    """(n, bands): each band's sign bits as a number."""
    bits = (rotated[:, : plan.bands * plan.bits] > 0).reshape(len(rotated), plan.bands, plan.bits)
    return (bits * (1 << np.arange(plan.bits))).sum(axis=2).astype("<u4")


def _coder(plan: Plan, full: bool):
    turn = plan.rotations()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                y = unit_rows(part["e"]) @ turn
                keys = band_keys(y, plan)
                ids = (np.arange(plan.bands, dtype=np.int64) << 32) | keys
                if not full:
                    yield pd.DataFrame({"key": ids.ravel()})
                    continue
                y = y[:, : plan.dim]
                factor = np.abs(y).sum(axis=1) / math.sqrt(plan.dim)
                scale = np.abs(y).max(axis=1)
                query = np.round(y / scale[:, None] * 127).astype(np.int8).view(np.uint8)
                codes = np.hstack([np.packbits(y > 0, axis=1), query])
                numbers = {"rep": part["rep"].to_numpy(), "factor": factor, "scale": scale}
                out = pd.DataFrame({k: np.repeat(v, plan.bands) for k, v in numbers.items()}).assign(key=ids.ravel())
                out["code"] = pd.Series([r.tobytes() for r in codes], dtype=object).repeat(plan.bands).to_numpy()
                yield out

    return code


def _segments(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of their tiles, and the bounds of the tiles."""
    g = g.sort_values(["key", "bi", "bj", "rep"], ignore_index=True)
    tile = g[["key", "bi", "bj"]].to_numpy()
    new = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
    return g, np.concatenate([[0], new, [len(g)]])


def _pairs_here(near: np.ndarray, keys: np.ndarray, band: int, own: np.ndarray, across: bool) -> np.ndarray:
    """Of the pairs marked in `near`, those that meet in no earlier band (and, in a tile of two
    blocks, lie in different ones): each pair counts in one tile only."""
    i, j = np.nonzero(np.triu(near, 1))
    if across:
        ok = own[i] != own[j]
        i, j = i[ok], j[ok]
    keep = np.ones(len(i), bool)
    for at in range(0, len(i), 65_536):
        s = slice(at, at + 65_536)
        keep[s] = ~(keys[i[s], :band] == keys[j[s], :band]).any(axis=1)
    return np.stack([i[keep], j[keep]])


def _estimator(plan: Plan):
    """Phase 1, codes only: the members of a tile that may have a partner there."""
    spread = plan.sigmas / math.sqrt(max(1, plan.dim - 1))

    def estimate(g: pd.DataFrame) -> pd.DataFrame:
        g, cuts = _segments(g)
        n, width = len(g), -(-plan.dim // 8)
        code = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(n, -1)
        sign = np.unpackbits(code[:, :width], axis=1)[:, : plan.dim]
        sign = ((sign.astype(np.float32) * 2 - 1) / math.sqrt(plan.dim)).astype(np.float32)
        query = code[:, width:].view(np.int8).astype(np.float32)
        query *= (g["scale"].to_numpy(np.float32) / 127)[:, None]
        factor = g["factor"].to_numpy(np.float32)
        bound = spread * np.sqrt(np.maximum(1 - factor**2, 0)) / factor
        own, across = g["block"].to_numpy(), (g["bi"] != g["bj"]).to_numpy()
        flag = np.zeros(n, bool)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            s = slice(lo, hi)
            # <o, q> is about <code of o, q> / <code of o, o>, without bias; its error has a bound
            most = (sign[s] @ query[s].T) / factor[s, None] + bound[s, None]
            near = np.minimum(most, most.T) >= plan.cosine
            if across[lo]:
                near &= own[s, None] != own[None, s]
            np.fill_diagonal(near, False)
            flag[s] = near.any(axis=1)
        return g.loc[flag, ["key", "bi", "bj", "block", "rep"]]

    return estimate


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by repeated minima over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _exact(plan: Plan):
    """Phase 2, exact vectors: link counts and a spanning forest of each tile."""
    turn = plan.rotations()

    def exact(g: pd.DataFrame) -> pd.DataFrame:
        g, cuts = _segments(g)
        x = unit_rows(g["e"])
        keys = band_keys(x @ turn, plan)
        rep, m = g["rep"].to_numpy(), g["m"].to_numpy()
        band, own, across = (g["key"].to_numpy() >> 32), g["block"].to_numpy(), (g["bi"] != g["bj"]).to_numpy()
        count, root = np.zeros(len(g), np.int64), rep.copy()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = slice(lo, hi)
            i, j = _pairs_here(x[s] @ x[s].T >= plan.cosine, keys[s], int(band[lo]), own[s], bool(across[lo]))
            np.add.at(count, lo + i, m[lo + j])
            np.add.at(count, lo + j, m[lo + i])
            root[s] = rep[lo + forest(hi - lo, i, j)]
        out = pd.DataFrame({"rep": rep, "links": count, "root": root})
        return out[out["links"] > 0]

    return exact


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector; links have cosine >= the bound.

    1. Equal vectors are one class with a count. 2. Classes are rotated at random; the sign bits
    give band keys, and the first rotation's bits with their correction factor a code. A pair
    at the bound meets in no bucket with probability 1e-5. 3. Buckets are compared by codes alone, in
    tiles of bounded size: unbiased estimates of the cosine with a confidence bound decide which
    members need their vectors. 4. Those are compared exactly, in double precision. A pair counts in
    the first band where it meets. Tiles give each member's number of links and a spanning
    forest, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different widths with each other. Null ids link with nothing (component null,
    kept). Rows that repeat an id are separate vectors that share a component_id.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0)
    valid = rows.where(F.coalesce(good, F.lit(False)))
    classes = valid.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = materialize(classes.select("e", "rep", "m", F.size("e").alias("dim")), "embed-classes")
    found = None
    for dim, n in classes.groupBy("dim").count().orderBy("dim").collect():
        one = _tiles(classes.where(F.col("dim") == dim), Plan.of(n, dim, cosine), n)
        found = one if found is None else found.union(one)
    if found is None:
        none = F.lit(0).cast("long")
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "embed-tiles")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    components = connected_components(edges).withColumnsRenamed({"id": "rep", "component": "comp"})
    known = classes.join(links, "rep", "left").join(components, "rep", "left")
    known = known.select("e", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "rep").alias("comp"))
    out = rows.withColumn("_good", F.coalesce(good, F.lit(False))).join(known, "e", "left")
    count = F.when(F.col("_good"), F.col("m") - 1 + F.col("links")).otherwise(0).cast("long")
    component = F.when(F.col("_good"), F.col("comp")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", count.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _tiles(classes: DataFrame, plan: Plan, n: int) -> DataFrame:
    """Link counts and forests of all tiles. A vector is sent once a band with its code alone
    (about 1.1 bytes a dimension); the vectors themselves go to the tiles that need them."""
    bare = classes.select("rep", "e")
    hot = bare.mapInPandas(_coder(plan, False), "key long").groupBy("key").count()
    hot = hot.where(F.col("count") > 2 * plan.block)
    parts = F.ceil(F.col("count") / plan.block).cast("int")
    hot = materialize(hot.select("key", "count", parts.alias("parts")), "embed-hot")
    more = hot.agg(F.sum(F.col("count") * (F.col("parts") - 1))).first()[0] or 0
    rows = bare.mapInPandas(_coder(plan, True), "key long, rep long, code binary, factor float, scale float")
    rows = rows.join(small_side(hot.select("key", "parts")), "key", "left").fillna({"parts": 1})
    block = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0).cast("int")
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    # Tiles are dealt to tasks many at a time; a tile has at most about two blocks of rows.
    deal = F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(max(16, (n * plan.bands + more) // 16_384)))
    rows = rows.drop("parts", "other").withColumn("g", deal)
    maybe = rows.groupBy("g").applyInPandas(_estimator(plan), "key long, bi int, bj int, block int, rep long")
    maybe = materialize(maybe, "embed-maybe")
    deal = F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(max(16, maybe.count() // 16_384)))
    maybe = maybe.join(classes.select("rep", "e", "m"), "rep")
    return maybe.withColumn("g", deal).groupBy("g").applyInPandas(_exact(plan), "rep long, links long, root long")
