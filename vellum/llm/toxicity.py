"""Toxicity by a classifier chain over linear models.

Categories are predicted one after the other. Each has a logistic regression over the document's
word features and over the logits of the categories before it. In training these earlier
probabilities are out-of-fold: a document's are predicted by models that have not seen it, as
they will be for new documents. The decision threshold of the last category asked for is the one
with the best F1 on out-of-fold predictions.

A word gives itself and its first four and five letters, so that unseen forms of a known stem
count. Only presence counts, so a long document isn't diluted. The features kept are those most
associated with any category (log-likelihood ratio), counted by Spark over the sample.

The training sample is at most SAMPLE labelled rows, the first by a hash of their id. Scoring
reads every document and its whole text, as a pandas UDF over that one column.

Defined results: null and empty texts have no feature and get the intercepts' probabilities;
labels with a null category or without document are left out; of labels that repeat an id each
category's greatest value counts, so that one vote for toxic is enough; without both classes a category's probability is its (smoothed) rate and nothing is
toxic; of documents that repeat a labelled id the least text is learned from, and each row is scored; very long texts are read whole; rows of equal
probability get the same decision; an empty table gives no rows; other columns are carried, and one that has the new column's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Memo

#: Labelled rows that are learned from at most; features that are kept; folds.
SAMPLE, FEATURES, FOLDS = 8_000, 1_024, 5
#: Added to the squared weights' sum, for each training row.
RIDGE = 1e-4

_WORD = re.compile(r"[^\W_]+")


def features(token: str) -> tuple[int, ...]:
    """The features of what stands between white space."""
    found = []
    for w in _WORD.findall(token.lower()):
        found += [f"w {w}", *(f"{k} {w[:k]}" for k in (4, 5) if len(w) > k)]
    return tuple(xxhash.xxh3_64_intdigest(f) >> 1 for f in found)


def feature_sets(texts: pd.Series, memo: Memo) -> Iterator[set[int]]:
    get = memo.__getitem__
    for t in texts:
        yield set(chain.from_iterable(map(get, set(t.split())))) if isinstance(t, str) else set()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Ridge logistic regression by L-BFGS; the last weight is the intercept."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = logit(rate)
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return w

    def loss(w):
        z = x @ w[:-1].astype(x.dtype) + w[-1]
        value = np.mean(np.logaddexp(0, z) - y * z) + RIDGE * (w[:-1] @ w[:-1]) / 2
        r = (sigmoid(z) - y) / len(y)
        return value, np.append(x.T @ r.astype(x.dtype) + RIDGE * w[:-1], r.sum())

    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, d in reversed(past):
            alphas.append(a := (s @ q) / (s @ d))
            q -= a * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 10.0
        for (s, d), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step, slope = 1.0, grad @ q
        while step > 1e-6:
            new_value, new_grad = loss(w - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = -step * q, new_grad - grad
        w, done = w + s, value - new_value < 1e-7
        value, grad = new_value, new_grad
        if s @ d > 1e-12:
            past = [*past[-memory + 1 :], (s, d)]
        if done:
            break
    return w


@dataclass
class Chain:
    """columns: feature -> column; weights: for each category, of the features, the earlier logits and 1."""

    categories: list[str]
    columns: dict[int, int]
    weights: list[np.ndarray]
    threshold: float

    def probabilities(self, hits: list[list[int]]) -> np.ndarray:
        n = len(self.columns)
        margins = np.array([[w[h].sum() for w in (w[:n] for w in self.weights)] for h in hits]).reshape(len(hits), len(self.weights))
        logits = np.zeros_like(margins)
        for k, w in enumerate(self.weights):
            logits[:, k] = margins[:, k] + logits[:, :k] @ w[n:-1] + w[-1]
        return sigmoid(logits)


def fit_chain(x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> tuple[list[np.ndarray], np.ndarray]:
    """(weights for each category, out-of-fold probabilities); y: a column per category."""
    fold = np.arange(len(x)) % folds
    out = np.zeros(y.shape)
    weights = []
    for k in range(y.shape[1]):
        xk = np.hstack([x, logit(out[:, :k]).astype(x.dtype)])
        for f in range(folds):
            held = fold == f
            if held.any():
                w = logistic(xk[~held], y[~held, k])
                out[held, k] = sigmoid(xk[held] @ w[:-1].astype(x.dtype) + w[-1])
        weights.append(logistic(xk, y[:, k]))
    return weights, out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the scores where F1 is best; above 1 if there is nothing to find."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit = y[order].cumsum()
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    best = int(f1.argmax())
    return float(p[order][best] + (p[order][best + 1] if best + 1 < len(p) else 0)) / 2


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], target: str, sample: int = SAMPLE, width: int = FEATURES, seed: int = 5) -> Chain:
    """docs: doc_id, text. labels: doc_id and a 0/1 column for each category, in the chain's order."""
    spark = docs.sparkSession
    some = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    # At most `sample` rows are broadcast, and as many are left: of documents that repeat an id the least text.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))

    @F.pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        memo = Memo(features)
        return pd.Series([sorted(s) for s in feature_sets(texts, memo)])

    rows = rows.select("doc_id", *categories, found("text").alias("features")).persist()
    ones = [F.sum(c).alias(c) for c in categories]
    total = rows.agg(F.count("*").alias("n"), *ones).first()
    if not total["n"]:
        return Chain(categories, {}, [np.array([0.0] * k + [-20.0]) for k in range(len(categories))], 2.0)
    counts = rows.select(*categories, F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *ones).where("n >= 3")

    def association(c: str):
        """Log-likelihood ratio of the feature and the category."""
        n, hits, with_f, both = float(total["n"]), float(total[c] or 0), F.col("n"), F.col(c)
        cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        parts = [(both, with_f * hits / n), (with_f - both, with_f * (n - hits) / n), (hits - both, (n - with_f) * hits / n), (n - hits - with_f + both, (n - with_f) * (n - hits) / n)]
        return sum((cell(o, F.greatest(e, F.lit(1e-9))) for o, e in parts), F.lit(0.0))

    top = counts.select("f", F.greatest(*[association(c) for c in categories], F.lit(0.0)).alias("g")).orderBy(F.desc("g"), "f").limit(width)
    columns = {r["f"]: i for i, r in enumerate(top.collect())}

    @F.pandas_udf("array<int>")
    def kept(features: pd.Series) -> pd.Series:
        return features.map(lambda fs: [columns[f] for f in fs if f in columns])

    known = sorted(rows.select("doc_id", *categories, kept("features").alias("hits")).collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["hits"]))
    rows.unpersist()
    x, y = np.zeros((len(known), len(columns)), np.float32), np.array([[r[c] for c in categories] for r in known], float)
    for i, r in enumerate(known):
        x[i, r["hits"]] = 1
    weights, out = fit_chain(x, y)
    at = categories.index(target)
    return Chain(categories, columns, weights, best_threshold(out[:, at], y[:, at]) if y[:, at].min() < 1 else 2.0)


def score(docs: DataFrame, model: Chain, target: str = "toxic", into: str = "toxicity") -> DataFrame:
    """docs with a struct column: p_<category> for each category, and the decision under the target's name."""
    columns, at = model.columns, model.categories.index(target)
    schema = ", ".join([*(f"p_{c} double" for c in model.categories), f"{target} boolean"])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(lambda token: tuple(columns[f] for f in features(token) if f in columns))
        for texts in batches:
            p = model.probabilities([sorted(s) for s in feature_sets(texts, memo)])
            out = pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(model.categories)})
            out[target] = p[:, at] >= model.threshold
            yield out

    return docs.withColumn(into, run("text"))


#: The chain over the table `labels`: quality first, then toxicity of bad texts, then toxicity, which is fed both.
CATEGORIES = ["low_quality", "toxic_low_quality", "toxic"]


def categories_of(labels: DataFrame) -> DataFrame:
    low = 1 - F.col("quality")
    return labels.select("doc_id", low.alias("low_quality"), "toxic", (low * F.col("toxic")).alias("toxic_low_quality"))
