"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability of being toxic is
logistic in the grams (words and word beginnings) that it holds, and the
document's is the noisy-or of its sentences. Only documents are labelled:
the gradient of the document's likelihood decides which sentences are to
blame, so that the model can then locate them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, saved
from .labelled import labelled_sample

#: Bounds of what the model is fitted on: labelled rows, and grams that lean toxic.
SAMPLE = 20_000
GRAMS = 1024
LEAST_DOCS = 8  # sampled documents that a gram occurs in
LEAST_Z = 3.0
PREFIXES = (4, 5, 6, 7)
CUT = 0.3
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+")
_EDGE = "\"'`.,;:!?()[]{}<>|*&%$#@~^+=/\\-_…«»„“”‘’¡¿"


def grams(word: str) -> tuple[str, ...]:
    """The word itself (marked by a final blank) and its beginnings."""
    w = word.strip(_EDGE)
    return () if not w else (w + " ", *[w[:n] for n in PREFIXES if len(w) >= n])


@dataclass
class NoisyOr:
    bias: float
    weights: dict[str, float]
    _known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def weight(self, word: str) -> float:
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 300_000:
                self._known.clear()
            got = sum(self.weights.get(g, 0.0) for g in grams(word))
            if len(word) <= 64:
                self._known[word] = got
        return got

    def sentence(self, text: str) -> float:
        z = self.bias + sum(self.weight(w) for w in set(text.split()))
        return 1 / (1 + np.exp(-min(40.0, max(-40.0, z))))

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences; a text without any has 0."""
        if not text:
            return 0.0
        low = text.lower()
        hit = any(self.weight(w) for w in set(low.split()))
        parts = _SENTENCE.findall(low)
        base = 1 / (1 + np.exp(-self.bias))
        if not hit:
            return float(-np.expm1(len(parts) * np.log1p(-base)))
        return float(-np.expm1(sum(np.log1p(-min(self.sentence(p), 1 - 1e-12)) for p in parts)))


def _gram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for frame in frames:
        for text, label in zip(frame["text"], frame["label"]):
            found: set[str] = set()
            for w in set(text.lower().split()):
                found.update(grams(w))
            counts[int(label > 0)].update(found)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield _pairs(counts)
                counts[0].clear()
                counts[1].clear()
    yield _pairs(counts)


def _pairs(counts) -> pd.DataFrame:
    words = list(counts[0].keys() | counts[1].keys())
    return pd.DataFrame({"gram": words, "clean": [counts[0][w] for w in words], "toxic": [counts[1][w] for w in words]})


def _bags(known: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, ...]] = {}
        for frame in frames:
            out = []
            for doc, text, label in zip(frame["doc_id"], frame["text"], frame["label"]):
                parts = _SENTENCE.findall(text.lower())
                at, which = [], []
                for i, part in enumerate(parts):
                    hits: set[int] = set()
                    for w in set(part.split()):
                        if w not in memo:
                            if len(memo) > 300_000:
                                memo.clear()
                            memo[w] = tuple(known[g] for g in grams(w) if g in known)
                        hits.update(memo[w])
                    at += [i] * len(hits)
                    which += sorted(hits)
                out.append((doc, int(label > 0), len(parts), np.array(at, dtype=np.int32).tobytes(), np.array(which, dtype=np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "label", "n", "at", "which"])
    return run


def fit_noisy_or(label: np.ndarray, sentences: np.ndarray, doc_of: np.ndarray, row_of: np.ndarray, which: np.ndarray, names: list[str], steps: int = 300, l2: float = 1e-5) -> NoisyOr:
    """Adam on the mean log likelihood of the noisy-or.

    Sentences that hold no known gram differ only in number, so they enter as
    a count per document; ``row_of``/``which`` list the grams of the others
    and ``doc_of`` their documents.
    """
    docs, rows = len(label), len(doc_of)
    plain = sentences - np.bincount(doc_of, minlength=docs)
    x = np.concatenate([[-6.0], np.ones(len(names))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    y = label.astype(float)
    for t in range(1, steps + 1):
        z = x[0] + np.bincount(row_of, weights=x[1 + which], minlength=rows)
        soft, soft0 = np.logaddexp(0, z), np.logaddexp(0, x[0])  # -log(1 - p)
        total = np.bincount(doc_of, weights=soft, minlength=docs) + plain * soft0
        total = np.maximum(total, 1e-12)
        # d/d total of  y log(1 - e^-total) - (1 - y) total
        pull = y / np.expm1(np.minimum(total, 500)) - (1 - y)
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -500, 500))), 1 / (1 + np.exp(-x[0]))
        by_row = pull[doc_of] * p
        grad = np.concatenate([[by_row.sum() + (pull * plain).sum() * p0], np.bincount(which, weights=by_row[row_of], minlength=len(names))]) / max(1, docs) - l2 * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        x = x + 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return NoisyOr(float(min(x[0], 0.0)), {g: float(w) for g, w in zip(names, x[1:])})


def learn_noisy_or(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> NoisyOr:
    """Fit on a bounded sample of the labelled rows that ``learn`` admits (default: crc32 of the id modulo 4 is not 2).

    Grams are chosen by how far their count among toxic documents is above
    what their count among all would give. Without both labels the model
    finds no text toxic.
    """
    learn = crc_mod(F.col("doc_id"), 4) != 2 if learn is None else learn
    rows = saved(labelled_sample(docs, labels, "toxic", learn, sample), "toxic-sample")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.signum("label")), F.lit(0.0))).first()
    if not n or not toxic or toxic == n:
        return NoisyOr(-20.0, {})
    share = float(toxic) / n
    counts = (rows.mapInPandas(_gram_counts, "gram string, clean long, toxic long").groupBy("gram")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("n", F.col("clean") + F.col("toxic"))
              .filter(F.col("n") >= min(LEAST_DOCS, max(4, n // 100)))
              .withColumn("z", (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))))
    names = [r["gram"] for r in counts.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "gram").limit(GRAMS).collect()]
    if not names:
        return NoisyOr(-20.0, {})
    bags = rows.mapInPandas(_bags({g: i for i, g in enumerate(names)}), "doc_id long, label int, n int, at binary, which binary").toPandas()
    bags = bags.sort_values(["doc_id", "n"], kind="stable").reset_index(drop=True)
    doc_of, row_of, which, seen = [], [], [], 0
    for i, (at, hit) in enumerate(zip(bags["at"], bags["which"])):
        at = np.frombuffer(at, dtype=np.int32)
        own, place = np.unique(at, return_inverse=True)
        doc_of.append(np.full(len(own), i))
        row_of.append(place + seen)
        which.append(np.frombuffer(hit, dtype=np.int32))
        seen += len(own)
    whole = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, dtype=np.int64)
    return fit_noisy_or(bags["label"].to_numpy(), bags["n"].to_numpy(dtype=float), whole(doc_of), whole(row_of), whole(which), names)


def toxicity_udf(model: NoisyOr):
    bias, weights = model.bias, dict(model.weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = NoisyOr(bias, weights)
        for s in texts:
            yield pd.Series([own.score(t if isinstance(t, str) else None) for t in s], dtype="float64")
    return score


def toxicity_scores(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    The whole text is scored; null and empty texts have no sentence and score
    0. held_out: crc32 of the id modulo 4 is 2 (a null id counts as the empty
    text). Only the text goes into a score.
    """
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
            .withColumn("score", toxicity_udf(model)("_text"))
            .select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")))


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences of probability ``least`` or more: doc_id, sentence (from 0), begin and end (code points), score, text."""
    bias, weights = model.bias, dict(model.weights)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = NoisyOr(bias, weights)
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                if not isinstance(text, str) or not any(own.weight(w) for w in set(text.lower().split())):
                    continue
                for i, m in enumerate(_SENTENCE.finditer(text)):
                    p = own.sentence(m[0].lower())
                    if p >= least:
                        out.append((doc, i, m.start(), m.end(), float(p), m[0]))
            yield pd.DataFrame(out, columns=["doc_id", "sentence", "begin", "end", "score", "text"])

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(find, f"doc_id {kind}, sentence int, begin int, end int, score double, text string"))
