"""Toxicity: non-negative positive-unlabelled learning with a numpy classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read_table
from .language import fold, sampled, words_of

#: Bounds of the training sample: confirmed toxic texts, unlabelled texts, characters of a text.
SAMPLE_TOXIC, SAMPLE_UNLABELLED, SAMPLE_CHARS = 1500, 6000, 20_000
#: Bounds of the vocabulary: words, and toxic texts that a word must be in.
VOCABULARY, LEAST_TEXTS = 1000, 5
#: How far (in standard errors) a word's rate in toxic texts may have to differ from that in unlabelled
#: ones; train() takes what has the least risk on texts that were left out, VALIDATION times.
DISTINCT, VALIDATION, TRIAL_STEPS = (3.0, 4.0, 5.0, 6.0), 3, 150
#: Bounds of the class prior: the logarithm of its odds is where the bias starts.
PRIOR = (1e-3, 0.5)
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)


def bag(text: str | None) -> set[bytes]:
    """What a text has: its distinct words, and their beginnings of PREFIXES bytes."""
    words = set(words_of(text))
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))


@dataclass
class Toxicity:
    """A linear model over which words and beginnings of a bounded vocabulary a text has."""

    words: list[bytes]
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.index = {w: i for i, w in enumerate(self.words)}
        self.known = frozenset(self.words)

    def score(self, text: str | None) -> float:
        found = self.known.intersection(bag(text))
        value = self.bias + sum(self.weight[self.index[w]] for w in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def matrix(texts: list[set[bytes]], index: dict[bytes, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(index)), np.float32)
    for row, words in enumerate(texts):
        out[row, [index[w] for w in words if w in index]] = 1
    return out


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk estimate with the logistic loss, from values of toxic and of unlabelled texts."""
    return float(prior * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()))


def slope_at(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """The gradient of the part of the risk that a step goes along, and whether the risk on clean texts is not negative.

    If it is not, that is the whole risk's gradient; else it is that of the negative part, turned round.
    """
    narrow = theta.astype(np.float32)
    fp, fu = xp @ narrow[:-1] + theta[-1], xu @ narrow[:-1] + theta[-1]
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))

    def gradient(x: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(x.T @ each.astype(np.float32), each.sum()) / len(each)

    clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    slope = gradient(xu, su) - prior * gradient(xp, sp)
    return (prior * gradient(xp, sp - 1) + slope if clean >= 0 else -slope), bool(clean >= 0)


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, rate: float) -> np.ndarray:
    """Weights and bias after so many steps of Adam."""
    theta = np.zeros(xp.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope, _ = slope_at(theta, xp, xu, prior)
        slope[:-1] += 1e-4 * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def vocabulary(bags: list[list[set[bytes]]], distinct: float) -> list[bytes]:
    """Words of toxic texts whose rates there and in unlabelled texts differ by so many standard errors."""
    positive, rest = (Counter(w for words in x for w in words) for x in bags)
    n, m = len(bags[0]), len(bags[1])
    gain = {}
    for w, c in positive.items():
        if c >= min(LEAST_TEXTS, max(1, n // 10)):
            a, b = c / n, rest[w] / m
            pooled = (c + rest[w]) / (n + m)
            z = (a - b) / np.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n + 1 / m))
            if abs(z) >= distinct:
                gain[w] = abs(z)
    return sorted(gain, key=lambda w: (-gain[w], w))[:VOCABULARY]


def validated(bags: list[list[set[bytes]]], prior: float, rate: float) -> float:
    """The one of DISTINCT whose models have the least risk on the parts of the sample that they were not trained on."""
    if min(map(len, bags)) < 10 * VALIDATION:
        return DISTINCT[-2]
    totals = dict.fromkeys(DISTINCT, 0.0)
    for part in range(VALIDATION):
        inside = [[x for i, x in enumerate(b) if i % VALIDATION != part] for b in bags]
        outside = [b[part::VALIDATION] for b in bags]
        for distinct in DISTINCT:
            index = {w: i for i, w in enumerate(vocabulary(inside, distinct))}
            theta = descend(matrix(inside[0], index), matrix(inside[1], index), prior, TRIAL_STEPS, rate)
            fp, fu = (matrix(x, index) @ theta[:-1].astype(np.float32) + theta[-1] for x in outside)
            totals[distinct] += risk(fp, fu, prior)
    return min(DISTINCT, key=lambda d: (totals[d], d))


def train(toxic: list[str], unlabelled: list[str], prior: float, steps: int = 800, rate: float = 0.05) -> Toxicity:
    """Minimise the non-negative risk estimate of Kiryo et al. with the logistic loss, by Adam.

    With p the class prior, unlabelled texts are a mix of p toxic and 1 - p clean ones, so the risk
    on clean texts is U(-) - p P(-).  Where that turns negative (which no risk can be), the
    step instead goes back up along it.
    """
    if not toxic or not unlabelled:
        return Toxicity([], np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))) if prior else -30.0)
    bags = [[bag(x) for x in texts] for texts in (toxic, unlabelled)]
    words = vocabulary(bags, validated(bags, prior, rate))
    index = {w: i for i, w in enumerate(words)}
    theta = descend(matrix(bags[0], index), matrix(bags[1], index), prior, steps, rate)
    return Toxicity(words, theta[:-1].astype(np.float64), float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> Toxicity:
    """Train on bounded samples of the folds that are not held out.

    Labels give the confirmed toxic documents and the class prior (the toxic share of the labelled
    documents, within PRIOR); unlabelled texts are documents taken without a look at their labels.
    """
    free = fold("doc_id", parts) != held
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & free)
    counts = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    prior = min(PRIOR[1], max(PRIOR[0], (counts["toxic"] or 0) / counts["n"])) if counts["n"] else 0.0
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter(
        free & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)
    )
    toxic = sampled(marks.filter("toxic = 1").select("doc_id").distinct(), SAMPLE_TOXIC, 21)
    found = texts.join(F.broadcast(toxic), "doc_id", "left_semi")  # at most 2 * SAMPLE_TOXIC ids
    positive = sorted(r["text"] for r in found.limit(2 * SAMPLE_TOXIC).collect())
    unlabelled = sorted(r["text"] for r in sampled(texts, SAMPLE_UNLABELLED, 22).collect())
    return train(positive, unlabelled, prior)


def _scored(model) -> Callable[[], Callable[[dict], dict]]:
    def make() -> Callable[[dict], dict]:
        score = model.value.score

        def step(rows: dict) -> dict:
            values = list(map(score, rows["text"]))
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": values, "predicted": [int(x >= 0.5) for x in values]}

        return step

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Probability that each document is toxic, from positive-unlabelled training.

    Only labels of folds that are not held out are used, and no other column than the text is an
    input of a score.  Training sees bounded samples (SAMPLE_TOXIC, SAMPLE_UNLABELLED, SAMPLE_CHARS),
    scoring every whole text.  Null and empty texts get the score of a text with no known word;
    without any toxic label all scores are near 0; null ids and null labels are not learned from;
    repeated rows score alike; an empty table gives no rows; further columns are dropped.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, parts, held))  # at most VOCABULARY words
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", parts) == held).alias("held_out")
    )
    return map_texts(texts, _scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
