"""Quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from recollect.llm.common import Memo, materialize, small_batches

BUCKETS = 1 << 20
GRADES = 3  # 0 poor, 1 readable but toxic, 2 good
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)


class WordFeatures(Memo):
    """word -> (bucket of the lower-cased word, bucket of its shape).

    The shape writes letters a or A, digits 0 and marks as they are, each run once.
    """

    def make(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))[:8]
        core = word.lower().strip(b".,;:!?*#$%&|\"'()[]{}")
        return xxh32_intdigest(core, 1) % BUCKETS, xxh32_intdigest(shape, 2) % BUCKETS


def features(text: str | None, cache: WordFeatures) -> dict[int, float]:
    """Hashed text: 1 for each word that occurs, and for each shape (and for lines that repeat) its share."""
    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return {}
    out: dict[int, float] = {}
    for word, n in Counter(words).items():
        w, s = cache[word]
        out[w] = 1.0
        out[s] = out.get(s, 0.0) + 8.0 * n / len(words)
    lines = [x for x in text.split("\n") if x]
    out[BUCKETS] = 8.0 * (1 - len(set(lines)) / len(lines)) if lines else 0.0
    return out


@dataclass
class OrdinalModel:
    """P(grade >= k) = 1 / (1 + exp(threshold_k - w x)): one weight vector, ordered thresholds."""

    columns: np.ndarray  # sorted buckets with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.columns.tolist(), self.weights.tolist(), strict=True))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def objective(
    p: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, weight: np.ndarray, l2: float
) -> tuple[float, np.ndarray]:
    """Weighted mean negative log-likelihood of the grades and its gradient.

    p holds the weights of columns, then the first threshold and the logarithms of the gaps to the
    next ones, so thresholds stay in order. Features are triplets (row, col, val).
    """
    n, d = len(grades), len(p) - GRADES + 1
    w, gaps, at = p[:d], np.exp(p[d + 1 :]), np.arange(n)
    cuts = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
    s = np.bincount(row, val * w[col], n)
    tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -40, 40)))
    full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
    here = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
    slope = full * (1 - full)
    up, down = slope[at, grades] / here, slope[at, grades + 1] / here
    g = -weight * (up - down) / n
    cut_grad = np.array([np.sum(weight * (up * (grades == k) - down * (grades == k - 1))) / n for k in range(1, GRADES)])
    loss = -np.sum(weight * np.log(here)) / n + l2 / 2 * np.sum(w**2)
    later = np.cumsum(cut_grad[:0:-1])[::-1] * gaps
    return loss, np.concatenate([np.bincount(col, val * g[row], d) + l2 * w, [cut_grad.sum()], later])


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray,
    least_docs: int = 5, screen: float = 4.0, l2: float = 1e-4, steps: int = 1500, rate: float = 0.05,
) -> OrdinalModel:
    """Adam on the objective; buckets of few documents, or whose documents' grades are within
    `screen` standard errors of all documents', get no weight.

    Rare grades weigh more, by the square root of their rarity: selection should not pass toxic
    documents because they are few. So p_good is a cautious figure, below the share of good documents
    where good ones are many. Without rows, or with one grade only, the weights are zero and every
    document is taken as good.
    """
    n = len(grades)
    _, at, df = np.unique(cols, return_inverse=True, return_counts=True)
    told = np.zeros(len(df))
    for k in range(1, GRADES):
        y = (grades >= k) - np.mean(grades >= k) if n else np.zeros(0)
        z = np.abs(np.bincount(at, y[rows], len(df))) / np.sqrt(df * max(np.mean(y**2) if n else 0.0, 1e-12))
        told = np.maximum(told, z)
    keep = ((df >= least_docs) & (told >= screen))[at]
    columns, col = np.unique(cols[keep], return_inverse=True)
    row, val, d = rows[keep], vals[keep], len(columns)
    if n == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([-30.0, -29.0]))
    balance = np.sqrt(n / (len(np.unique(grades)) * np.bincount(grades, minlength=GRADES)[grades]))
    p = np.zeros(d + GRADES - 1)
    p[d] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        grad = objective(p, row, col, val, grades, balance, l2)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return OrdinalModel(columns.astype(np.int64), p[:d].copy(), cuts)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded rating of a label: 0 if poor, 1 if toxic, else 2; null if quality is."""
    good = F.when(F.coalesce(F.col(toxic), F.lit(0)) > 0, 1).otherwise(2)
    return F.when(F.col(quality).isNotNull(), F.when(F.col(quality) > 0, good).otherwise(0))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordFeatures()
    for batch in batches:
        found = [features(t, cache) for t in batch["text"]]
        yield pd.DataFrame({
            "grade": batch["grade"].to_numpy(),
            "cols": [np.fromiter(f.keys(), np.int32, len(f)).tobytes() for f in found],
            "vals": [np.fromiter(f.values(), np.float32, len(f)).tobytes() for f in found],
        })


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, seed: int = 5) -> OrdinalModel:
    """Fit on a bounded sample of labelled rows: about `sample` of them, chosen by a hash of doc_id.

    This bound is the only one in the operator; it keeps what the driver gathers (hashed features
    of the sample) the same at every size.
    """
    rated = labels.select("doc_id", grade_of().alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    n = rated.count()
    if n > sample:
        share = int(sample / n * (1 << 30))
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < share)
    rated = materialize(rated.groupBy("doc_id").agg(F.min("grade").alias("grade")), "quality-sample")
    # A rated id that many rows repeat is one document: its least text.
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), "doc_id")
    joined = joined.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")
    got = materialize(small_batches(joined).mapInPandas(_extract, "grade int, cols binary, vals binary"), "quality-features")
    got = got.toPandas()  # of the sample
    cols = [np.frombuffer(x, np.int32) for x in got["cols"]]
    vals = [np.frombuffer(x, np.float32) for x in got["vals"]]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = lambda x: np.concatenate(x) if x else np.zeros(0)
    return fit_ordinal(rows, flat(cols).astype(np.int64), flat(vals).astype(float), got["grade"].to_numpy(int))


class WordWeights(WordFeatures):
    """word -> (bucket of the word, its weight, weight of its shape)."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def make(self, word: bytes) -> tuple[int, float, float]:
        w, s = super().make(word)
        return w, self.weights.get(w, 0.0), self.weights.get(s, 0.0)


def score_text(text: str | None, words: WordWeights) -> float:
    """The model's linear score of features(text), without building them."""
    tokens = text.encode("utf-8", "replace").split() if text else []
    if not tokens:
        return 0.0
    total, shapes, seen = 0.0, 0.0, set()
    for word, n in Counter(tokens).items():
        bucket, weight, shape = words[word]
        if weight and bucket not in seen:
            seen.add(bucket)
            total += weight
        shapes += n * shape
    total += 8.0 * shapes / len(tokens)
    if line := words.weights.get(BUCKETS):
        lines = [x for x in text.split("\n") if x]
        total += line * 8.0 * (1 - len(set(lines)) / len(lines)) if lines else 0.0
    return total


def _scorer(model: OrdinalModel):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordWeights(model.table())
        for batch in batches:
            s = np.array([score_text(t, words) for t in batch["text"]], float)
            tails = model.tails(s)
            out = pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_readable": tails[:, 0], "p_good": tails[:, 1]})
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())[
                ["doc_id", "expected_grade", "p_readable", "p_good"]
            ]

    return score


def grade_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 8_000) -> DataFrame:
    """(doc_id, expected_grade, p_readable, p_good, kept) of every whole text.

    Grades are 0 poor, 1 toxic, 2 good; p_readable and p_good are the tail probabilities of grades
    of at least 1 and 2, expected_grade their sum; kept means p_good >= least. A null, empty or
    wordless text has no features, so the thresholds alone grade it; null ids stay null; repeated
    rows are graded each. Without labels, or with one grade only, everything is kept.
    """
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = small_batches(rows).mapInPandas(_scorer(model), "doc_id long, expected_grade double, p_readable double, p_good double")
    return out.withColumn("kept", F.col("p_good") >= least)


def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 8_000) -> DataFrame:
    """The rows that grade_documents keeps, with all their columns.

    Null, empty and wordless texts are judged by the thresholds alone; rows of null ids and repeated
    rows are judged each by their text; without labels, or with one grade only, all rows stay; an
    empty table gives an empty one. No helper column is added.
    """
    model = train(docs, labels, sample)

    @F.pandas_udf("double")
    def p_good(texts: pd.Series) -> pd.Series:
        words = WordWeights(model.table())
        s = np.array([score_text(t, words) for t in texts], float)
        return pd.Series(model.tails(s)[:, 1])

    return small_batches(docs).where(p_good(F.col("text")) >= least)
