"""Hilbert-curve sharding of documents by several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import materialize, with_position

BITS = 6


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points; axes is (n, dims) with values below 2**bits."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess turns of each level
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS))


def _category(name: str) -> Column:
    """A category's cell: its hash, so that no table of categories is needed. Null has cell 0."""
    cells = F.lit((1 << BITS) - 1).cast("long")
    return F.when(F.col(name).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(name), cells)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Put documents into `shards` runs of the Hilbert curve over (lang, source, size).

    Size is the UTF-8 bytes of the text plus 16 and is quantised at the quantiles of all
    rows; lang and source by hash. The law is `rows`: runs of the curve are cut so that
    counts differ by one at most. A null text has no bytes; a null id sorts first; rows that
    repeat an id are separate rows; equal texts with equal metadata lie next to each other
    on the curve. An empty table gives an empty result. Returns doc_id, size, text_crc32,
    law, shard, slot, grown_shard (null under this law) and curve, the Hilbert index.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _category("lang").alias("a"),
            _category("source").alias("b"),
        ),
        "shard-meta",
    )
    cells = 1 << BITS
    cuts = meta.agg(
        F.percentile_approx("size", [i / cells for i in range(1, cells)], 10_000)
    ).first()[0] or []
    level = F.lit(0)
    for cut in sorted(set(cuts)):
        level = level + (F.col("size") > cut).cast("int")
    laid = meta.withColumn("c", level).withColumn("curve", _curve("a", "b", "c"))
    laid = laid.select("doc_id", "size", "text_crc32", "curve")
    order = [F.col(x).asc_nulls_first() for x in ("curve", "text_crc32", "doc_id", "size")]
    placed, total = with_position(laid, order, "shard-order")
    n = max(1, total)
    shard = F.floor(F.col("_pos") * shards / F.lit(n)) if total == 0 else F.expr(f"_pos * {shards}L div {n}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_pos - (shard * {n}L + {shards - 1}L) div {shards}L").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
