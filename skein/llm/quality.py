"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= g) = sigmoid(w . x - threshold_g), with one weight vector shared by all grades and
ordered thresholds (each is its predecessor plus a positive step).  x holds hashed token and
token-shape shares of the whole text and a few hashed features of its form.  From the tail
probabilities follow the expected grade and the selection.

The model is fitted on at most ``sample_rows`` rated rows and ``sample_chars`` characters, the first
by a hash of their id; scoring reads every text once, and each worker remembers what a token
contributes.

Defined cases: a null or empty text has only its form features; null ratings are not fitted;
fewer than two grades among the ratings give a constant model; equal texts get equal results;
rows are kept one for one.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small, worker_state
from .toxicity import in_training

BITS = 18
#: tokens a worker remembers (about 45 MB)
MEMO = 300_000
_RUNS = [(re.compile(p), r) for p, r in (("[A-ZÀ-ÖØ-Þ]{2,}", "AA"), ("[a-zß-öø-ÿ]+", "a"), ("[0-9]+", "0"), (r"([^\w\s])\1+", r"\1\1"))]


def shape(token: str) -> str:
    for pattern, by in _RUNS:
        token = pattern.sub(by, token)
    return token


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def token_features(token: str) -> tuple[int, int]:
    return bucket("t=" + token.lower()), bucket("s=" + shape(token))


def form_features(tokens: list[str], text: str) -> list[int]:
    n = len(tokens)
    again = sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, n - 1)
    distinct = len(set(tokens)) / max(1, n)
    letters = sum(map(len, tokens)) / max(1, n)
    return [
        bucket(f"length={min(12, n.bit_length())}"),
        bucket(f"again={math.ceil(10 * again)}"),
        bucket(f"distinct={min(12, n.bit_length())},{math.ceil(10 * distinct)}"),
        bucket(f"letters={min(20, round(letters))}"),
        bucket(f"lines={min(10, text.count(chr(10)).bit_length())}"),
    ]


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds
        self.memo: dict[str, float] = {}

    def value(self, text: str | None) -> float:
        text = text or ""
        tokens = text.split()
        total = float(sum(self.weights[i] for i in form_features(tokens, text)))
        if tokens:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo
            for t in {t for t in tokens if t not in known}:
                a, b = token_features(t)
                known[t] = float(self.weights[a] + self.weights[b])
            total += SCALE * sum(map(known.__getitem__, tokens)) / len(tokens)
        return total

    def tails(self, value: float) -> np.ndarray:
        """P(grade >= g) for every grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - value, -40, 40)))


#: token shares are multiplied by this, so that they learn as fast as the form features
SCALE = 8.0


def fit_rows(rows: list[tuple[str, int]], rounds: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Maximum penalised likelihood by Adam over the bounded sample."""
    grades = sorted({y for _, y in rows})
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(1 << BITS), np.zeros(0))
    index, feature, value = [], [], []
    for i, (text, _) in enumerate(rows):
        tokens = text.split()
        pairs = [x for t in tokens for x in token_features(t)]
        form = form_features(tokens, text)
        feature += pairs + form
        value += [SCALE / len(tokens)] * len(pairs) + [1.0] * len(form)
        index += [i] * (len(pairs) + len(form))
    used, feature = np.unique(np.array(feature), return_inverse=True)
    index, value = np.array(index), np.array(value)
    level = np.searchsorted(grades, [y for _, y in rows])
    k = len(grades) - 1
    w, low, steps = np.zeros(len(used)), np.zeros(1), np.zeros(k - 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, low, steps)]
    for step in range(1, rounds + 1):
        score = np.bincount(index, value * w[feature], minlength=len(rows))
        cuts = low[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        tail = 1 / (1 + np.exp(np.clip(cuts[None] - score[:, None], -40, 40)))
        padded = np.column_stack([np.ones(len(rows)), tail, np.zeros(len(rows))])
        chance = np.maximum(padded[np.arange(len(rows)), level] - padded[np.arange(len(rows)), level + 1], 1e-9)
        slope = padded * (1 - padded)
        upper, lower = slope[np.arange(len(rows)), level] / chance, slope[np.arange(len(rows)), level + 1] / chance
        by_score = (upper - lower) / len(rows)
        by_cut = np.zeros(k + 2)
        np.add.at(by_cut, level, -upper / len(rows))
        np.add.at(by_cut, level + 1, lower / len(rows))
        by_cut = by_cut[1:-1]
        up_sum = np.cumsum(by_cut[::-1])[::-1]
        gradients = [np.bincount(feature, value * by_score[index], minlength=len(used)) - ridge * w, np.array([up_sum[0]]), up_sum[1:] * np.exp(steps)]
        for p, g, (m, v) in zip((w, low, steps), gradients, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(grades, weights, low[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4_000, sample_chars: int = 24_000_000) -> Model:
    """The model of a sample bounded by ``sample_rows`` and ``sample_chars``."""
    rows = bounded_sample(docs, labels.filter(in_training(F.col("doc_id"))), label, sample_rows, sample_chars)
    return fit_rows([(t, y) for _, t, y in rows])


def _apply(shipped, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        model.memo = worker_state("quality", dict)
        model.memo.clear()  # another model may have filled it
        gaps = np.diff(model.grades)
        for b in small(batches):
            tails = [model.tails(model.value(t)) for t in b.column(1).to_pylist()]
            top = [float(t[-1]) if len(t) else 1.0 for t in tails]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(model.grades[0] + (t * gaps).sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64())), pa.array(top, pa.float64()), pa.array([t >= threshold for t in top], pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probabilities", "p_top", "keep"],
            )

    return run


def rate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probabilities, p_top, keep) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_apply(shipped, threshold), "doc_id long, expected_grade double, tail_probabilities array<double>, p_top double, keep boolean")
