"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training text is unlabelled, whatever its label says.  A linear
classifier in numpy minimises the class-prior-corrected risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the
second part falls below zero, the step climbs it instead, so that the unlabelled toxic texts are not learned as clean.
The class prior is the toxic share of all labelled training rows.

Features are the presence of words and of beginnings of words.  They are selected by their document frequencies among
positives and unlabelled texts, so that the model is bounded and what it weighs is rare in ordinary text.  Scoring sums
the weights of a text's distinct features; a worker remembers the features of words.

The classifier is fitted on a bounded sample: at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, the first by a digest
of their id.  Texts are used whole.

Null and empty texts get the score of a text without features.  Without positives or prior every score is that of the
bias.  Rows are scored one by one; repeated rows of ``labels`` count as toxic if any is; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.text import scratch

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 9_000
MAX_FEATURES = 20_000
#: A feature is kept if it is so many times as frequent among positives as among unlabelled texts, and if that is no
#: accident: so many nats of evidence (Poisson), with the unlabelled count raised by ``SMOOTHING``.
MIN_LIFT, MIN_EVIDENCE, SMOOTHING = 2.0, 10.0, 3
BEGINNINGS = (5, 6, 7, 8)
STEPS, RATE, DECAY = 400, 0.05, 1e-4
REMEMBERED = 600_000
FLUSH = 400_000
SEED = 5
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings, as signed longs."""
    parts = ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) > k)]
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def text_features(text: str | None) -> set[int]:
    return {f for word in distinct_words(text) for f in word_features(word)}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(keys, pa.int64()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "p", "u"])

    for batch in batches:
        for positive, text in zip(batch.column("positive").to_pylist(), batch.column("_llm_text").to_pylist()):
            counts[0 if positive else 1].update(text_features(text))
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield out()
    yield out()


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def fit(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch steps on the non-negative risk with logistic loss; ``rows`` are feature numbers."""
    lengths = np.array([len(r) for r in rows])
    flat = np.array([f for r in rows for f in r], dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    n_p, n_u = positive.sum(), (~positive).sum()
    first, second, steps = np.zeros(n_features + 1), np.zeros(n_features + 1), 0
    for steps in range(1, STEPS + 1):
        z = bias + np.bincount(of, weights=w[flat], minlength=len(rows))
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        minus = np.logaddexp(0, z)  # loss of calling a text clean
        corrected = minus[~positive].mean() - prior * minus[positive].mean()
        slope = np.where(positive, -prior * chance / n_p, chance / n_u)  # of the corrected part
        if corrected < 0:
            slope = -slope
        else:
            slope = slope + np.where(positive, prior * (chance - 1) / n_p, 0.0)
        gradient = np.append(np.bincount(flat, weights=slope[of], minlength=n_features) + DECAY * w, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = RATE * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def _first(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """The model of the rows that ``allowed`` (over doc_id) lets in."""
    able = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_llm_text")).where(allowed)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(allowed & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = (toxic or 0) / n if n else 0.0
    if not 0 < prior < 1:
        return Model({}, -5.0 if prior < 1 else 5.0)
    chosen = _first(known.where("toxic = 1").select("doc_id"), MAX_POSITIVE).withColumn("positive", F.lit(True))
    others = _first(able.select("doc_id").distinct(), MAX_UNLABELLED).withColumn("positive", F.lit(False))
    picked = scratch(chosen.unionAll(others), "toxicity-ids")
    sample = scratch(able.join(F.broadcast(picked), "doc_id"), "toxicity-sample").select("positive", "_llm_text")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    counts = sample.mapInArrow(_frequencies, "feature bigint, p bigint, u bigint")
    counts = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, expected = F.col("p"), n_p * (F.col("u") + SMOOTHING) / n_u
    evidence = p * F.log(p / expected) - (p - expected)
    useful = counts.where((p >= MIN_LIFT * expected) & (evidence >= MIN_EVIDENCE))
    top = useful.orderBy(F.desc(evidence), "feature").limit(MAX_FEATURES)
    place = {r["feature"]: i for i, r in enumerate(top.select("feature").collect())}

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[f] for f in text_features(t.as_py()) if f in place) for t in batch.column("_llm_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"]
            )

    rows = sorted(sample.mapInArrow(design, "positive boolean, found array<int>").collect())
    weights, bias = fit([r["found"] for r in rows], np.array([r["positive"] for r in rows]), len(place), prior)
    return Model({f: float(weights[i]) for f, i in place.items()}, bias)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weighed(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(f for f in word_features(word) if f in self.model.weights)
            if len(self.known) < REMEMBERED:
                self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        features = {f for word in distinct_words(text) for f in self._weighed(word)}
        z = self.model.bias + sum(sorted(self.model.weights[f] for f in features))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column("_llm_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").alias("_llm_text"))
    return slim.mapInArrow(run, "doc_id bigint, score double")
