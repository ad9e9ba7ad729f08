"""Quality by Bradley-Terry pairwise ranking.

From pairs of a preferred and a rejected labelled document the weights of a document's strength are
learned by logistic loss on the difference of their features; the strength is cut at the quantile
that parts the labelled documents best, and a logistic curve around that cut makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .runtime import text_or_empty
from .textstats import repeated_words, symbols, word_hashes, worded_lines

#: Labelled rows and preference pairs that a model is fitted on, at most.
SAMPLE, PAIRS, SEED = 8_000, 40_000, 7
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
FEATURES = ("symbols", "upper", "shouts", "bars", "repeats", "adjacent", "copied_lines", "open_lines", "variety", "word_length", "digits", "stops", "commas", "log_words", "few_words")


def features(text: str) -> list[float]:
    """FEATURES of a text, each bounded; of the text alone."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    h = word_hashes(words)
    lines = worded_lines(text)
    k = max(1, len(lines))
    upper = size - len(raw.translate(None, _UPPER)) if raw else 0
    per = lambda x: min(2.0, x / n)
    return [
        per(symbols(text)),
        min(1.0, 2 * upper / size),
        per(raw.count(b"!!") + raw.count(b"??")),
        per(raw.count(b"|")),
        repeated_words(h) / n,
        float((h[1:] == h[:-1]).sum()) / n if n > 1 else 0.0,
        (len(lines) - len(set(lines))) / k,
        sum(x.rstrip()[-1:] not in ".!?:;\"')" for x in lines) / k,
        len(np.unique(h)) / n / (1 + 0.05 * np.log(n)),
        min(2.0, size / n / 10),
        (size - len(raw.translate(None, _DIGITS))) / size if raw else 0.0,
        per(raw.count(b".")),
        per(raw.count(b",")),
        float(np.log1p(len(words)) / 10),
        1.0 if len(words) < 3 else 0.0,
    ]


@dataclass(frozen=True)
class Model:
    """Strength of a document: weights on its standardised features; cut and scale make a score of it."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) * self.scale, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3) -> Model:
    """Learn from features and labels. Without both labels there is nothing to rank: every score is then 0.5."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / spread
    rng = np.random.default_rng(SEED)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(25):  # Newton steps on the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + l2 * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + l2 * np.eye(d), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    quantiles = np.quantile(s, np.linspace(0, 1, 1001))
    right = [(np.mean((s >= q) == (y == 1)), -abs(i - 1000 * np.mean(y == 0))) for i, q in enumerate(quantiles)]
    i = max(range(len(right)), key=right.__getitem__)
    below = s[s < quantiles[i]]
    cut = float((quantiles[i] + below.max()) / 2) if len(below) else float(quantiles[i])
    return Model(mean, spread, w, cut, 1.0)


def _features(rows: DataFrame, carried: int) -> DataFrame:
    """rows' first columns and x, the features of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(carried).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:carried], pa.array(x, pa.list_(pa.float64()))], names)

    names = [*rows.columns[:carried], "x"]
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:carried]) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> Model:
    rows = learning.sample(docs, labels, "quality", at_most)
    got = sorted((r.doc_id, r.y, r.x) for r in _features(rows.select("doc_id", "y", "text"), 2).collect())  # at_most rows of a few numbers
    return fit(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row and whole text; null text counts as empty; extra columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.array([features(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, train(docs, labels))
    return got.select("doc_id", (learning.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
