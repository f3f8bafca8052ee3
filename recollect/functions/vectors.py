"""Vector functions: built-in expressions, and a hook for embedding providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; null if a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def semantic_score(distance: Column, most: float = 8.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance) * most


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_embedding(text: Column, dim: int) -> Column:
    """A unit vector from SHA-512 digests of the text and a big-endian counter: 16 numbers a digest."""
    blocks = F.array(*[F.lit(i.to_bytes(4, "big")) for i in range(-(-dim // 16))])
    digests = F.transform(blocks, lambda i: F.sha2(F.concat(text.cast("binary"), i), 512))
    places = F.array(*[F.lit(8 * j + 1) for j in range(16)])

    def numbers(digest: Column) -> Column:
        return F.transform(places, lambda j: F.conv(F.substring(digest, j, F.lit(8)), 16, 10).cast("double") / 2147483647.5 - 1)

    raw = F.slice(F.flatten(F.transform(digests, numbers)), 1, dim)

    def unit(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        return let(norm, lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(v).cast("float")))

    return let(raw, unit)


@dataclass(frozen=True)
class Provider:
    """Embeds batches of texts. Vectors without meaning (as of hashes) must not be used for ranking."""

    embed: Callable[[list[str]], np.ndarray]
    semantic: bool = True


def embed_column(text: Column, provider: Provider) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = provider.embed(texts.fillna("").tolist())
            yield pd.Series([np.asarray(v, np.float32) for v in vectors])

    return run(text)


def backfill_embeddings(memories: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Vectors for the memories that lack one; others stay as they are."""
    missing = F.col("embedding").isNull()
    return memories.withColumn("embedding", F.when(missing, embed(F.col("content"))).otherwise(F.col("embedding")))
