"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, materialize, small_batches

SIZES = (2, 3, 4, 5, 6)
#: One label in so many is held out, by crc32 of the id as text.
FOLDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> tuple[str, int]:
    """The text in lower case with one space before, between and after its words, and the number of words."""
    words = text.lower().split() if text else []
    return (f" {' '.join(words)} " if words else ""), len(words)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a plain text, each within a word and the spaces beside it:
    (64-bit key, count, place of one occurrence, length)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inner = np.concatenate([[0], np.cumsum(points == 32)])
    keys, counts, places, lengths = [], [], [], []
    key = np.zeros(len(points), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        if n > len(points):
            break
        key = (key[: len(points) - n + 1] + points[n - 1 :] + np.uint64(1)) * _STEP
        key ^= key >> np.uint64(29)
        if n not in SIZES:
            continue
        at = np.arange(len(key))
        whole = inner[at + n - 1] - inner[at + 1] == 0  # no space but at its ends
        got, first, count = np.unique(key[whole], return_index=True, return_counts=True)
        keys.append(got)
        counts.append(count)
        places.append(at[whole][first])
        lengths.append(np.full(len(got), n))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(keys), np.concatenate(counts), np.concatenate(places), np.concatenate(lengths)


def value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: the logarithm of its count against that of the words, so that a few words stand out in long texts too."""
    return 3 * np.log1p(count) / np.log1p(words)


@dataclass
class NgramModel:
    """P(toxic) = 1 / (1 + exp(-(bias + sum of value * weight))); a weight is ratio times fitted coefficient."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for gram, weight in self.weights.items():
            found.add_word(gram, (gram, weight))
        found.make_automaton()
        return found

    def score(self, text: str | None, automaton: ahocorasick.Automaton | None) -> float:
        flat, words = plain(text)
        total = self.bias
        if automaton is not None and words:
            count = Counter(hit for _, hit in automaton.iter(flat))
            scale = 3 / np.log1p(words)
            total += scale * sum(weight * np.log1p(n) for (_, weight), n in sorted(count.items()))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Naive Bayes: logarithm of an n-gram's smoothed share of toxic documents over that of clean ones."""
    return np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))


def fit(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on triplets (row, col, x); gives coefficients and the bias."""
    n, d = len(y), int(col.max()) + 1 if len(col) else 0
    p, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        s = np.bincount(row, x * p[col], n) + p[d]
        g = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) / n
        grad = np.concatenate([np.bincount(col, x * g[row], d) + l2 * p[:d], [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], float(p[d])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from training; false for a null id, which no label names."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, toxic, clean): numbers of documents with an n-gram, summed within a batch."""
    for batch in batches:
        found = [grams(plain(t)[0])[0] for t in batch["text"]]
        y = np.repeat(batch["toxic"].to_numpy(int), [len(f) for f in found])
        keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
        toxic, every = np.bincount(at, y, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
        yield pd.DataFrame({"key": keys.view(np.int64), "toxic": toxic, "clean": every - toxic})


def _extract(told: np.ndarray):
    """Rows (doc, toxic, cols, vals, places) of the n-grams that tell, told being their sorted keys."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                flat, words = plain(text)
                keys, counts, places, lengths = grams(flat)
                at = np.searchsorted(told, keys)
                here = (at < len(told)) & (told[np.minimum(at, len(told) - 1)] == keys) if len(told) else np.zeros(len(keys), bool)
                names = [flat[p : p + n] for p, n in zip(places[here], lengths[here], strict=True)]
                out.append((at[here].astype("<i4").tobytes(), value(counts[here], words).astype("<f8").tobytes(), names))
            yield pd.DataFrame({"toxic": batch["toxic"], "cols": [o[0] for o in out], "vals": [o[1] for o in out], "names": [o[2] for o in out]})

    return extract


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, least_docs: int = 5, screen: float = 4.0, seed: int = 11) -> NgramModel:
    """Fit on a bounded sample of the labelled rows that are not held out: about `sample` of them, by a hash of doc_id.

    The bound is the only one of the operator; it keeps what the driver gathers (values of telling
    n-grams in the sample) the same at every size. An n-gram tells if at least `least_docs` documents
    have it and its share of toxic ones is `screen` standard errors or more from that of all. Labels of
    a null id or null mark teach nothing; a document that several rows of labels or documents name is
    one, with its greatest mark and least text. Without labels, or with marks of one kind only, the
    model is a bias alone: the smoothed share of toxic labels.
    """
    rated = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    rated = rated.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = rated.count()
    if n > sample:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rated = materialize(rated.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), "doc_id")
    texts = materialize(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-texts")
    n_toxic, total = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    bias = float(np.log((n_toxic + 1) / (total - n_toxic + 1)))
    if not n_toxic or n_toxic == total:
        discard(rated, texts)
        return NgramModel({}, bias)
    counts = small_batches(texts).mapInPandas(_count_grams, "key long, toxic long, clean long")
    counts = counts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    every, share = F.col("toxic") + F.col("clean"), n_toxic / total
    z = F.abs(F.col("toxic") - every * share) / F.sqrt(every * (share * (1 - share)))
    got = counts.where((every >= least_docs) & (z >= screen)).toPandas()  # of the sample
    keys = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    ratio = log_count_ratios(got["toxic"].to_numpy(float), got["clean"].to_numpy(float), n_toxic, total - n_toxic)[order]
    rows = small_batches(texts).mapInPandas(_extract(keys[order]), "toxic int, cols binary, vals binary, names array<string>")
    rows = rows.orderBy("toxic", "cols", "vals").toPandas()  # in an order of its own, so that reruns agree
    discard(rated, texts)
    cols = [np.frombuffer(x, "<i4") for x in rows["cols"]]
    col = np.concatenate(cols).astype(int)
    x = np.concatenate([np.frombuffer(x, "<f8") for x in rows["vals"]]) * ratio[col]
    names = dict(zip(col.tolist(), (name for r in rows["names"] for name in r), strict=True))
    coefficients, bias = fit(np.repeat(np.arange(len(cols)), [len(c) for c in cols]), col, x, rows["toxic"].to_numpy(float))
    weights = {names[k]: float(ratio[k] * c) for k, c in enumerate(coefficients) if k in names}
    return NgramModel({gram: weights[gram] for gram in sorted(weights)}, bias)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 8_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; score is the probability of label 1.

    Only the text makes the score. A null, empty or wordless text has no n-grams and gets the bias's
    probability; a null id stays null and is not held out; repeated rows are scored each, equal texts
    alike; an empty table gives an empty result. Other columns of docs are not read.
    """
    model = train(docs, labels, sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            found = np.array([model.score(t, automaton) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": found, "predicted": (found >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
