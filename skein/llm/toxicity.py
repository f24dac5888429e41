"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

* Examples: labelled rows of the training folds, at most ``examples`` of them and at most
  ``example_chars`` characters together, the first by a hash of their id; toxic and clean alike.
* Terms: every word of every text.  Document frequencies for the IDF are counted over all
  documents: each term of the examples has its own counter; terms of no example, which can
  only lengthen a text's vector, share ``SPARE`` counters by hash.
* Weights: (1 + log count) * IDF * sqrt(1 + chi-squared), the last being the association of a
  term's presence with the label in the different examples (1 for terms of no example), so
  no term has weight zero.  Norms are those of whole texts.
* Index: postings of all terms of the examples, in blocks of ``BLOCK`` examples with the largest
  weight of each term in each block.  Queries go through it many at a time: a block whose
  bound is under a query's k-th best score so far is not opened.  Scores in single precision
  only find the candidates; those near the k-th best are scored again in double precision, so the k
  nearest are exact (ties: the smaller example number).
* Score: votes of the k nearest weighted by similarity, shrunk towards the examples' base rate
  by ``prior`` pseudo-votes, and calibrated: a logistic curve of the votes fitted on the examples
  themselves, each scored without itself and its copies.  ``neighbours`` gives the evidence.

The index is bounded by ``examples`` and ``example_chars``, whatever the corpus.  Labels are read
for examples only; scores use nothing but the text.

Defined cases: null, empty and term-free texts get the calibrated base rate; labels of null are not
examples; several labels of one document are several examples; a repeated doc_id gives each of its
texts as an example; equal texts get equal results; without examples every score is 0; rows are
kept one for one.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bounded_sample, small, worker_state
from .decontaminate import words

#: counters that the terms of no example share
SPARE = 1 << 18
#: counters in a row of the counting exchange
SLICE = 1 << 14
#: examples in a block of the index, terms whose postings are laid out as a matrix, queries answered at once
BLOCK, DENSE, QUERIES = 64, 600, 128
#: what single precision may be off
MARGIN = 1e-4
#: results a worker remembers
MEMO = 4_000

Vector = tuple[np.ndarray, np.ndarray]


def in_training(doc_id: F.Column, folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``, is not 0."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


class Numbers(dict):
    """term -> its number; terms of no example share the numbers after the last one."""

    def __missing__(self, term: bytes) -> int:
        return len(self) + zlib.crc32(term) % SPARE

    def of(self, terms: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), np.int64, n)


def association(examples: Iterable[tuple[np.ndarray, int]], n_terms: int) -> np.ndarray:
    """Chi-squared of the presence of each term and the label; equal examples count once."""
    present, n, seen = np.zeros((2, n_terms)), [0, 0], set()
    for terms, label in examples:
        terms = np.unique(terms)
        key = terms.tobytes(), label
        if key not in seen:
            seen.add(key)
            present[label, terms] += 1
            n[label] += 1
    a, b = present[1], present[0]
    c, d = n[1] - a, n[0] - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(spread > 0, (a + b + c + d) * (a * d - b * c) ** 2 / np.maximum(spread, 1), 0.0)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _vector(v: dict[int, float] | Vector) -> Vector:
    return (np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), float, len(v))) if isinstance(v, dict) else v


class BlockMaxIndex:
    def __init__(self, vectors: Iterable[dict[int, float] | Vector], labels: list[int], n_terms: int):
        self.labels, self.n_terms = np.array(labels, np.int64), n_terms
        self.base = float(self.labels.mean()) if len(labels) else 0.0
        vectors = [_vector(v) for v in vectors]
        self.sizes = np.array([len(t) for t, _ in vectors], np.int64)
        self.term = np.concatenate([np.empty(0, np.int32), *(t.astype(np.int32) for t, _ in vectors)])
        self.weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])

    #: what ships; the layout is made again where the index is used
    OWN = ("labels", "n_terms", "base", "sizes", "term", "weight")

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.OWN}

    def fold(self) -> None:
        """Forgets the layout."""
        self.__dict__ = self.__getstate__()

    def lay_out(self) -> None:
        """Blocks of examples that share their most widespread term and are of like length."""
        n = len(self.sizes)
        df = np.bincount(self.term, minlength=self.n_terms)
        row = np.repeat(np.arange(n), self.sizes)
        by_df = np.lexsort((-df[self.term], row))
        first = np.cumsum(self.sizes) - self.sizes
        top = np.full(n, -1)
        top[self.sizes > 0] = self.term[by_df][first[self.sizes > 0]]
        self.number = np.lexsort((self.sizes, top))  # example at each place
        place = np.empty(n, np.int64)
        place[self.number] = np.arange(n)
        self.n_blocks = max(1, -(-n // BLOCK))
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        frequent = frequent[df[frequent] > n // 100]
        self.slot = np.full(self.n_terms, -1)
        self.slot[frequent] = np.arange(len(frequent))
        at, slot = place[row], self.slot[self.term]
        dense = slot >= 0
        self.blocks = np.zeros((self.n_blocks, len(frequent), BLOCK), np.float32)
        self.blocks[at[dense] // BLOCK, slot[dense], at[dense] % BLOCK] = self.weight[dense]
        self.block_max = np.ascontiguousarray(self.blocks.max(2).T)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.posted, self.posted_weight = at[rare].astype(np.int32), self.weight[rare].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.term[rare], minlength=self.n_terms))])
        self.first = first
        self.scratch = np.zeros(self.n_terms)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k examples of highest positive similarity, best first, ties by number."""
        return self.search([_vector(query)], k)[0]

    def search(self, queries: list[Vector], k: int, without: list[np.ndarray] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of many queries; ``without`` names examples that a query may not find."""
        if not len(self.labels):
            return [[] for _ in queries]
        if "blocks" not in self.__dict__:
            self.lay_out()
        many, n_blocks = len(queries), self.n_blocks
        row = np.repeat(np.arange(many), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        slot = self.slot[term]
        dense, rare = slot >= 0, slot < 0
        common = np.zeros((many, self.block_max.shape[0]), np.float32)
        common[row[dense], slot[dense]] = weight[dense]
        size = self.start[term[rare] + 1] - self.start[term[rare]]
        posts = _ranges(self.start[term[rare]], size)
        places = np.repeat(row[rare] * (n_blocks * BLOCK), size) + self.posted[posts]
        seldom = np.bincount(places, np.repeat(weight[rare], size) * self.posted_weight[posts], many * n_blocks * BLOCK).astype(np.float32).reshape(many, n_blocks, BLOCK)
        bound = common @ self.block_max + seldom.max(2) + MARGIN
        score = np.full((many, n_blocks, BLOCK), -1, np.float32)
        gone = [(i, np.flatnonzero(np.isin(self.number, w))) for i, w in enumerate(without)] if without else []
        kth, flat = n_blocks * BLOCK - k, score.reshape(many, -1)

        def floor() -> np.ndarray:
            return np.partition(flat, kth, axis=1)[:, kth] if kth > 0 else np.full(many, -1, np.float32)

        best_first = np.argsort(-bound, axis=1)
        opened, least = np.zeros((many, n_blocks), bool), np.zeros(many, np.float32)
        for most in (4, n_blocks):
            wanted = np.zeros_like(opened)
            np.put_along_axis(wanted, best_first[:, :most], True, axis=1)
            wanted &= ~opened & (bound > np.maximum(least, 0)[:, None])
            for b in np.flatnonzero(wanted.any(0)):
                own = np.flatnonzero(wanted[:, b])
                score[own, b] = common[own] @ self.blocks[b] + seldom[own, b]
            for i, at in gone:
                flat[i, at] = -1
            opened |= wanted
            least = floor()
        return [self._exact(q, np.flatnonzero((flat[i] > 0) & (flat[i] >= least[i] - MARGIN)), k) for i, q in enumerate(queries)]

    def _exact(self, query: Vector, places: np.ndarray, k: int) -> list[tuple[float, int]]:
        found = np.sort(self.number[places[places < len(self.number)]])
        if not len(found):
            return []
        self.scratch[query[0]] = query[1]
        size = self.sizes[found]
        entries = _ranges(self.first[found], size)
        score = np.round(np.add.reduceat(self.weight[entries] * self.scratch[self.term[entries]], np.cumsum(size) - size), 12)
        self.scratch[query[0]] = 0
        best = [j for j in np.argsort(-score, kind="stable")[:k] if score[j] > 0]
        return list(zip(score[best].tolist(), found[best].tolist()))


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of P(y) = sigmoid(slope * x + shift) by Newton's method, targets smoothed."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0 or np.ptp(x) < 1e-9:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (target - p) - 1e-3 * (beta - [1.0, 0.0])
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


class Scorer:
    def __init__(self, number: Numbers, df: np.ndarray, n_docs: int, examples: list[tuple[int, str, int]], k: int, prior: float):
        self.number, self.k, self.prior = number, k, prior
        self.ids = [d for d, _, _ in examples]
        counts, labels = [self.counts(t) for _, t, _ in examples], [y for _, _, y in examples]
        chi2 = association(((t, y) for (t, _), y in zip(counts, labels)), len(number))
        self.weight = np.log((1 + n_docs) / (1 + df)) + 1
        self.weight[: len(number)] *= np.sqrt(1 + chi2)
        vectors = [self.weigh(*c) for c in counts]
        del counts
        self.index = BlockMaxIndex(vectors, labels, len(number))
        self.curve = 1.0, 0.0
        self.curve = self.calibrated(vectors, labels)
        self.index.fold()

    def calibrated(self, vectors: list[Vector], labels: list[int]) -> tuple[float, float]:
        """The curve of the votes of the examples, each without itself and its copies."""
        copies: dict[bytes, list[int]] = {}
        keys = [t.tobytes() + w.tobytes() for t, w in vectors]
        for i, key in enumerate(keys):
            copies.setdefault(key, []).append(i)
        votes = []
        for at in range(0, len(vectors), QUERIES):
            part = range(at, min(at + QUERIES, len(vectors)))
            near = self.index.search([vectors[i] for i in part], self.k, [np.array(copies[keys[i]]) for i in part])
            votes += map(self.votes, near)
        return logistic_fit(self.log_odds(np.array(votes)), np.array(labels)) if votes else (1.0, 0.0)

    @staticmethod
    def log_odds(votes: np.ndarray) -> np.ndarray:
        votes = np.clip(votes, 1e-4, 1 - 1e-4)
        return np.log(votes / (1 - votes))

    def counts(self, text: str | None) -> Vector:
        found = Counter(words(text))
        return self.number.of(found, len(found)).astype(np.int32), np.fromiter(found.values(), np.int32, len(found))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> Vector:
        """Terms of the examples and their weights; the norm is that of all terms."""
        w = (1 + np.log(counts)) * self.weight[terms]
        here = terms < len(self.number)
        return terms[here], w[here] / max(float(w @ w) ** 0.5, 1e-300)

    def votes(self, near: list[tuple[float, int]]) -> float:
        toxic = sum(s * int(self.index.labels[i]) for s, i in near)
        return (toxic + self.prior * self.index.base) / (sum(s for s, _ in near) + self.prior) if self.ids else 0.0

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids and similarities of the neighbours) of each text."""
        memo = worker_state("toxicity", dict)
        keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        new = {k: t for k, t in zip(keys, texts) if k not in memo}
        found = {k: memo[k] for k in keys if k in memo}
        near = self.index.search([self.weigh(*self.counts(t)) for t in new.values()], self.k) if new else []
        slope, shift = self.curve
        for key, own in zip(new, near):
            value = 1 / (1 + np.exp(-float(slope * self.log_odds(np.array(self.votes(own))) + shift))) if self.ids else 0.0
            found[key] = float(value), [self.ids[i] for _, i in own], [s for s, _ in own]
        if len(memo) > MEMO:
            memo.clear()
        memo.update((k, found[k]) for k in new)
        return [found[k] for k in keys]


def _apply(shipped, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        worker_state("toxicity", dict).clear()  # another scorer may have filled it
        for b in small(batches, QUERIES):
            ids = b.column(0).to_pylist()
            found = scorer.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([held_out(d) for d in ids], pa.bool_()),
                    pa.array([s for s, _, _ in found], pa.float64()),
                    pa.array([int(s >= threshold) for s, _, _ in found], pa.int32()),
                    pa.array([n for _, n, _ in found], pa.list_(pa.int64())),
                    pa.array([s for _, _, s in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "neighbours", "similarities"],
            )

    return run


def _frequencies(shipped):
    """(text) -> the task's counters of documents, packed in slices"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        counts = np.zeros(-(-(len(number) + SPARE) // SLICE) * SLICE, np.int64)
        for b in small(batches):
            for text in b.column(0).to_pylist():
                found = set(words(text))
                counts[number.of(found, len(found))] += 1
        used = np.flatnonzero(counts.reshape(-1, SLICE).any(1))
        packed = binary_column(counts.reshape(-1, SLICE)[used].ravel(), np.full(len(used), SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), packed], names=["slice", "df"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    df = sum(np.frombuffer(x, np.int64) for x in table.column("df").to_pylist())
    return pa.table({"slice": table.column("slice").slice(0, 1), "df": pa.array([df.tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = 6_000, k: int = 15, prior: float = 0.2, example_chars: int = 24_000_000) -> Scorer:
    """Examples, document frequencies and index; the sample is bounded by ``examples`` and ``example_chars``."""
    context = docs.sparkSession.sparkContext
    rows = [(i, t, int(y > 0)) for i, t, y in bounded_sample(docs, labels.filter(in_training(F.col("doc_id"))), label, examples, example_chars)]
    number = Numbers((t, i) for i, t in enumerate(sorted({w for _, text, _ in rows for w in words(text)})))
    df = np.zeros(-(-(len(number) + SPARE) // SLICE) * SLICE, np.int64)
    for r in docs.select("text").mapInArrow(_frequencies(context.broadcast(number)), "slice int, df binary").groupBy("slice").applyInArrow(_summed, "slice int, df binary").collect():
        df[r[0] * SLICE : (r[0] + 1) * SLICE] = np.frombuffer(r[1], np.int64)
    return Scorer(number, df, docs.count(), rows, k, prior)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, similarities) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    return texts.mapInArrow(_apply(shipped, threshold), "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>")
