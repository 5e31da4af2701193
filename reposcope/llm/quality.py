"""Quality classifier: Bradley-Terry ranking from preference pairs.

A pair says that a document labelled good is preferred to one labelled bad.
Scores are linear in a document's features, and the weights minimise the
logistic loss of the feature differences of the pairs. The cut is the
quantile of the sample's scores at the share of bad labels; the score
returned is logistic, 0.3 at the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .labelled import labelled_sample

#: Labelled rows at most that the ranking is fitted on, and preference pairs drawn from them.
SAMPLE = 20_000
PAIRS = 100_000
CUT = 0.3

_SYMBOLS = np.frombuffer(b"$%&*#@^~<>=+\\/_{}[]", dtype=np.uint8)
FEATURES = ("upper", "bang", "symbol", "bar", "digit", "stop", "repeat", "few_words", "line_copies", "length", "word_length", "space", "wide")


def features(text: str) -> list[float]:
    """Shares of kinds of characters, repetition and lengths; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = float(len(raw))
    upper, lower = float(c[65:91].sum()), float(c[97:123].sum())
    words = text.split()
    k = len(words)
    lines = text.split("\n")
    shares = [upper / max(1.0, upper + lower), c[33] / n, c[_SYMBOLS].sum() / n, c[124] / n, c[48:58].sum() / n,
              (c[44] + c[46]) / n, sum(map(eq, words, words[1:])) / max(1, k - 1), 1 - len(set(words)) / max(1, k),
              1 - len(set(lines)) / len(lines)]
    return [math.sqrt(x) for x in shares] + [math.log1p(k), min(4.0, math.log1p(n / max(1, k))), math.sqrt((n - sum(map(len, words))) / n), float(c[128:].sum()) / n]


@dataclass(frozen=True)
class Ranking:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.rank(x) - self.cut + math.log(CUT / (1 - CUT))
        # At the cut the score is CUT itself, whatever the rounding of exp.
        return np.where(self.rank(x) == self.cut, CUT, 1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton steps. Without both labels every document scores alike, above the cut."""
    d = len(FEATURES)
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(a) or not len(b):
        return Ranking((0.0,) * d, (0.0,) * d, (1.0,) * d, -1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    scale[x.std(axis=0) < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ (1 - p) / pairs - l2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + l2 * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    k = len(b)  # the quantile at the share of bad labels, half way to the next score
    return Ranking(tuple(w), tuple(mean), tuple(scale), float((s[k - 1] + s[k]) / 2))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else "") for t in texts]).reshape(-1, len(FEATURES))


def learn_ranking(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, pairs: int = PAIRS) -> Ranking:
    """Fit on a bounded sample of the labelled rows that ``learn`` admits (default: crc32 of the id modulo 5 is not 0)."""
    learn = crc_mod(F.col("doc_id"), 5) != 0 if learn is None else learn

    @F.pandas_udf("array<double>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(s)))

    got = labelled_sample(docs, labels, "quality", learn, sample).select("doc_id", "label", of("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_ranking(x, got["label"].to_numpy(dtype=int), pairs)


def quality_udf(model: Ranking):
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(s)), dtype="float64")
    return score


def quality_scores(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    The whole text is scored; a null text counts as empty, and an empty text
    has the score of zero features. held_out: crc32 of the id modulo 5 is 0
    (a null id counts as the empty text). Only the text goes into a score.
    """
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
            .withColumn("score", quality_udf(model)("_text"))
            .select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")))
