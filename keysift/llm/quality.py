"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; every other text of the web table is merely unlabelled. A
text is described by the shape of its characters (``features``), and g(x) = w.x is fitted to the
non-negative unbiased risk with the squared loss l(z) = (1 - z)^2 / 4:

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

Each term is a quadratic form in w of second moments, so one pass over all texts gathers the moments
and the risk is minimised exactly on small matrices. The class prior p comes from the same table: a
first classifier tells positives from unlabelled texts, and p is the least ratio, over thresholds, of
the shares of unlabelled and positive texts above the threshold. The score is the posterior
p f_P(g) / f_U(g), from histograms of g, made monotone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import forget, small_batches

MAX_POSITIVES = 20_000
CUT = 0.3
RIDGE = 1e-3
STEPS = 200
BINS = 400

# Classes of bytes of UTF-8: those below have one of their own, the rest go by kind.
SINGLE = b" \n.,!|"


def byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.int64)
    for low, high, kind in ((0, 32, 0), (33, 127, 1), (128, 256, 2)):
        classes[low:high] = kind
    for kind, (low, high) in enumerate(((48, 58), (65, 91), (97, 123)), 3):
        classes[low:high] = kind
    for kind, byte in enumerate(SINGLE, 6):
        classes[byte] = kind
    return classes


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
N_MORE = 6
WIDTH = N_CLASSES + N_CLASSES * N_CLASSES + N_MORE + 1


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of character classes and of pairs of them; of repeated words and
    lines, the spread of words, their length, the length of lines and of the text; a constant."""
    value = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(WIDTH)
    x[-1] = 1.0
    if not value:
        return x
    kinds = CLASSES[np.frombuffer(value, np.uint8)]
    n = len(kinds)
    x[:N_CLASSES] = np.bincount(kinds, minlength=N_CLASSES) / n
    if n > 1:
        pairs = kinds[:-1] * N_CLASSES + kinds[1:]
        x[N_CLASSES : N_CLASSES * (N_CLASSES + 1)] = np.bincount(
            pairs, minlength=N_CLASSES * N_CLASSES
        ) / (n - 1)
    np.sqrt(x, out=x)
    words, lines = value.split(), value.split(b"\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    more = (
        1 - len(set(lines)) / n_lines,
        len(set(words)) / n_words,
        len(set(words)) / n_words**0.8,
        min(n / n_words, 40) / 10,
        np.log1p(n / n_lines) / 10,
        np.log1p(n) / 10,
    )
    x[-1 - N_MORE : -1] = more
    return x


def bounded_positives(labels: DataFrame, most: int, doc_id: str, label: str) -> DataFrame:
    """Ids of rows labelled 1 and never otherwise, at most ``most``, by hash order."""
    agreed = (
        labels.where(F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("pu_id"))
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low = 1 AND high = 1")
    )
    return agreed.select("pu_id").orderBy(F.xxhash64("pu_id"), "pu_id").limit(most)


def moments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Second moments of positives and of all texts of ``(text, positive)``.

    Each task sends one row per feature; their sums are aggregated by feature, so no task and not the
    driver sees more than a matrix.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        total = [np.zeros((WIDTH, WIDTH)), np.zeros((WIDTH, WIDTH))]
        for batch in batches:
            for first in range(0, len(batch), 512):
                piece = batch.iloc[first : first + 512]
                x = np.array([features(t) for t in piece["text"]])
                total[1] += x.T @ x
                own = x[piece["positive"].to_numpy(bool)]
                total[0] += own.T @ own
        for of, matrix in enumerate(total):
            rows = np.flatnonzero(matrix.any(axis=1))
            if len(rows):
                yield pd.DataFrame(
                    {"of_all": of, "feature": rows, "products": [row.tolist() for row in matrix[rows]]}
                )

    parts = texts.mapInPandas(run, "of_all int, feature int, products array<double>")
    sums = parts.groupBy("of_all", "feature").agg(
        Summarizer.sum(array_to_vector("products")).alias("total")
    )
    found = [np.zeros((WIDTH, WIDTH)), np.zeros((WIDTH, WIDTH))]
    for row in sums.collect():
        found[row.of_all][row.feature] = row.total.toArray()
    return tuple(matrix / max(1.0, matrix[-1, -1]) for matrix in found)


def fit_separator(positive: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Least squares of +1 on positives and -1 on unlabelled texts, equally weighted."""
    ridge = RIDGE * np.eye(WIDTH)
    return np.linalg.solve(positive + every + ridge, positive[-1] - every[-1])


def nn_risk(w, prior, positive, every) -> tuple[float, float]:
    """The two terms of the risk: on positives, and on what is left of the unlabelled texts."""

    def loss(m, sign):  # E[(1 - sign g)^2] / 4
        return (1 - 2 * sign * (w @ m[-1]) + w @ m @ w) / 4

    return prior * loss(positive, 1), loss(every, -1) - prior * loss(positive, -1)


def fit_nn(prior: float, positive: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Weights of least non-negative risk, by preconditioned descent.

    While the second term is not negative, a step goes down the whole risk; where it is, the step
    goes up that term alone, as overfitted positives should be forgotten first.
    """
    ridge = RIDGE * np.eye(WIDTH)
    inverse = np.linalg.inv(every + ridge)
    w = np.zeros(WIDTH)
    best, least = w, np.inf
    for _ in range(STEPS):
        ours, rest = nn_risk(w, prior, positive, every)
        risk = ours + max(0.0, rest) + RIDGE * (w @ w) / 4
        if risk < least:
            best, least = w, risk
        up = (positive[-1] + positive @ w) / 2
        rest_slope = (every[-1] + every @ w) / 2 - prior * up
        ours_slope = prior * (positive @ w - positive[-1]) / 2
        if rest >= 0:
            w = w - 0.5 * inverse @ (ours_slope + rest_slope + RIDGE * w / 2)
        else:
            w = w + 0.1 * inverse @ rest_slope
    return best


def score_udf(weights: np.ndarray):
    """g of a text column, kept within -4 and 4."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            scores = [float(features(t) @ weights) for t in texts]
            yield pd.Series(np.clip(scores, -4.0, 4.0))

    return run


def histograms(texts: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of positives and of all texts per bin of g, ``BINS`` bins over -2 to 2."""
    place = F.floor((score_udf(weights)("text") + 2) * (BINS / 4))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place))
    counted = texts.select(place.cast("int").alias("place"), F.col("positive").cast("int").alias("own"))
    counted = counted.groupBy("place").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    own, every = np.zeros(BINS), np.zeros(BINS)
    for row in counted.collect():
        own[row.place], every[row.place] = row.own, row.n
    return own, every


def estimate_prior(own: np.ndarray, every: np.ndarray) -> float:
    """Least upper bound, over thresholds, of the ratio of shares above a threshold."""
    if own.sum() == 0 or every.sum() == 0:
        return 0.5
    n, m = own.sum(), every.sum()
    p, u = np.cumsum(own[::-1])[::-1] / n, np.cumsum(every[::-1])[::-1] / m
    slack = np.sqrt(np.log(20) / 2 / n) + np.sqrt(np.log(20) / 2 / m)
    above = p > 0
    at = np.argmin((u[above] + slack) / p[above])
    return float(np.clip(u[above][at] / p[above][at], 0.01, 0.99))


def posterior(prior: float, own: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Per bin, p f_P / f_U, non-decreasing by pooling neighbours that are not."""
    n, m = max(1.0, own.sum()), max(1.0, every.sum())
    pools: list[list[float]] = []
    for p, u in zip(prior * own / n, every / m):
        if u == 0:
            continue
        pools.append([p, u])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, u2 = pools.pop()
            pools[-1][0] += p2
            pools[-1][1] += u2
    ends, total = [], 0.0
    for p, u in pools:
        total += u
        ends.append((total, min(1.0, p / u)))
    cumulative, values, k = np.cumsum(every / m), np.zeros(len(every)), 0
    for i, reached in enumerate(cumulative):
        while k < len(ends) - 1 and reached > ends[k][0] + 1e-12:
            k += 1
        values[i] = ends[k][1] if ends else prior
    return values


class Model(NamedTuple):
    """Weights of g, the class prior, and the posterior per bin of g."""

    weights: np.ndarray
    prior: float
    values: np.ndarray

    def to_json(self) -> str:
        return json.dumps([self.weights.tolist(), self.prior, self.values.tolist()])

    @classmethod
    def from_json(cls, stored: str) -> Model:
        weights, prior, values = json.loads(stored)
        return cls(np.array(weights), prior, np.array(values))

    def score(self, text: str | Column) -> Column:
        """The probability that a text is good; a null text is an empty one."""
        weights, values = self.weights, self.values

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                g = np.clip([float(features(t) @ weights) for t in texts], -4.0, 4.0)
                middle = (np.arange(BINS) + 0.5) * (4 / BINS) - 2
                yield pd.Series(np.interp(g, middle, values))

        return run(F.col(text) if isinstance(text, str) else text)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_positives: int = MAX_POSITIVES,
) -> Model:
    """Learn from all texts of ``docs`` as unlabelled ones and those with label 1 as positives.

    Up to ``max_positives`` labelled ids are used, chosen by hash; that bounds what is broadcast. All
    other labels are ignored. Ids that are null or labelled both ways are no positives. Three passes
    over the texts: moments, the histogram for the prior, the histogram for the posterior. Without
    positives or texts every score is the prior, 0.5.
    """
    small_batches(docs)
    positives = bounded_positives(labels, max_positives, doc_id, label)
    texts = docs.select(F.col(doc_id).cast("long").alias("pu_doc"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(positives), F.col("pu_doc") == F.col("pu_id"), "left").select(
        "text", F.col("pu_id").isNotNull().alias("positive")
    )
    positive, every = moments(texts)
    if positive[-1, -1] == 0:
        return Model(np.zeros(WIDTH), 0.5, np.full(BINS, 0.5))
    prior = estimate_prior(*histograms(texts, fit_separator(positive, every)))
    weights = fit_nn(prior, positive, every)
    own, all_ = histograms(texts, weights)
    return Model(weights, prior, posterior(prior, own, all_))


def with_quality(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Rows of ``docs`` with the probability that a text is good. A column named ``out`` is replaced."""
    small_batches(docs)
    return docs.withColumn(out, model.score(text))
