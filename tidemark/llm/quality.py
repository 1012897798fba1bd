"""Quality classifier by Bradley-Terry pairwise ranking.

Documents labelled good are preferred to documents labelled bad. A linear score
over text features is learned by logistic loss on the feature differences of
such pairs, turned into a probability by a logistic fit of the labels on the
score, and can be cut at a quantile of the scores (``quantile_cut``).

Only the text feeds a score. Training uses a bounded sample of labelled rows
(``MAX_TRAIN`` of each class, those with the smallest hash of the id); scoring
is a map over all rows without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty

MAX_TRAIN = 10_000  # labelled rows of each class that train, at most
PAIRS = 60_000  # preference pairs drawn from them
STEPS = 400

_CLASSES = str.maketrans({**dict.fromkeys(map(chr, range(48, 58)), "0")})
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[.,;:!?'\"()\-]")
_END = re.compile(r"[.!?](?=\s|$)")


def features(text: str) -> list[float]:
    """Shares and shapes of one whole text; all bounded, zeros for an empty text."""
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    top = counts.most_common(1)[0][1]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    symbols = len(_SYMBOL.findall(text))
    marked = sum(not (w[-1].isalnum() or w[-1] in ".,;:!?'\")") for w in words)
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    return [
        1.0,
        np.log1p(n) / 10,
        min(size / n, 30) / 10,
        symbols / size,
        min(1.0, 10 * symbols / size),
        marked / n,
        upper / n,
        len(_UPPER.findall(text)) / size,
        len(_DIGIT.findall(text)) / size,
        len(_MARK.findall(text)) / size,
        min(2.0, len(_END.findall(text)) / n * 10),
        words.count("|") / n,
        len(counts) / n,
        min(1.0, (1 - len(counts) / n) * 2) ** 2,
        top / n,
        adjacent / n,
        min(1.0, adjacent / n * 5),
        1 - len(line_counts) / max(1, len(lines)),
        sum(c * len(x) for x, c in line_counts.items() if c > 1) / size,
        float(n < 5),
        float(n < 20),
        sum(len(w) > 25 for w in words) / n,
    ]


N_FEATURES = 22


def feature_matrix(column: pa.Array) -> np.ndarray:
    out = [features(x.as_py() or "") for x in column]
    return np.array(out, float).reshape(len(out), N_FEATURES)


class Ranker(NamedTuple):
    """Linear Bradley-Terry score and the logistic curve from it to a probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float
    cut: float = 0.0  # the quantile of the training scores at the share of bad labels

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.intercept, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ranker(x: np.ndarray, y: np.ndarray, base_rate: float, pairs: int = PAIRS, steps: int = STEPS, l2: float = 1e-4) -> Ranker:
    """Bradley-Terry weights from pairs (good, bad), then the probability curve.

    ``base_rate`` is the share of good labels over all training rows (the sample
    may hold the classes in another proportion). With one class only the score is
    that class's constant."""
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    scale = (x.std(0) if len(x) else np.ones(N_FEATURES)) + 1e-6
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        sure = 4.0 if len(good) else -4.0 if len(bad) else 0.0
        return Ranker(mean, scale, np.zeros(N_FEATURES), 0.0, sure)
    z = (x - mean) / scale
    rng = np.random.default_rng(9)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam on the full set of pairs
        g = -d.T @ (1 - _sigmoid(d @ w)) / pairs + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    share = np.where(y == 1, base_rate / max(1, len(good)), (1 - base_rate) / max(1, len(bad)))
    centre, spread = s.mean(), s.std() + 1e-9
    u, a, b = (s - centre) / spread, 1.0, 0.0
    for _ in range(60):  # Newton steps of a weighted logistic fit, slightly regularised
        p = _sigmoid(a * u + b)
        r, h = share * (p - y), share * p * (1 - p)
        grad = np.array([(r * u).sum() + 1e-4 * a, r.sum()])
        hess = np.array([[(h * u * u).sum() + 1e-4, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
    made = Ranker(mean, scale, w, float(a / spread), float(b - a * centre / spread))
    p = made.probability(x)
    order = np.argsort(p, kind="stable")
    below = np.searchsorted(np.cumsum(share[order]), 1 - base_rate)
    return made._replace(cut=float(p[order][min(below, len(p) - 1)]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id") -> Ranker:
    """Fit on rows of ``docs`` (``doc_id``, ``text``) with a label 0 or 1 in ``labels``
    (``doc_id``, ``quality``). Rows with a NULL id or label don't train; of several
    labels of an id the largest counts."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_lm_y"))
    totals = {r["_lm_y"]: r["n"] for r in marks.groupBy("_lm_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):  # the ids with the smallest hashes: the same bounded sample on every run
        part = marks.where(F.col("_lm_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        chosen = part if chosen is None else chosen.unionAll(part)
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty("text").alias("_lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["_lm_y", "x"]
            )

    # at most 2 * max_train ids, so this side is broadcast by a proven bound; repeated rows count once
    rows = (
        src.join(F.broadcast(chosen), "doc_id").select("_lm_y", "_lm_text", "doc_id").dropDuplicates(["doc_id"])
        .select("_lm_y", "_lm_text").mapInArrow(run, "_lm_y int, x array<double>").toArrow()
    )
    y = rows.column("_lm_y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    order = np.lexsort([*x.T, y])  # the same fit for any order of the rows
    total = sum(totals.values())
    return fit_ranker(x[order], y[order], totals.get(1, 0) / total if total else 0.5)


def add_score(docs: DataFrame, ranker: Ranker, name: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability of label 1 (empty and NULL texts too)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), N_FEATURES)
        return pd.Series(shared.value.probability(x))

    return docs.withColumn(name, score(text_or_empty("text")))


def quantile_cut(scored: DataFrame, share: float, name: str = "score") -> float:
    """The score below which about ``share`` of the rows lie (Spark's mergeable quantile summary)."""
    got = scored.select(F.percentile_approx(name, share, 10_000).alias("q")).first()["q"]
    return float("-inf") if got is None else float(got)


def is_held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds`` (NULL ids: not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
