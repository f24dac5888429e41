"""Language ID by Bayesian fusion of evidence.

posterior(l) ~ P(text | l)^temper * P(declared | l) * P(address suffix | l) * prior(l | host)

* Text: per-language likelihood of the letter trigrams of every word of the whole text.  The
  trigram model is fitted on a bounded sample of different texts of every declared language
  (``sample_rows`` in equal parts, at least ``LEAST_ROWS`` of each, by hash of the text, and
  ``sample_chars`` characters together).  ``temper`` discounts it, because trigrams of one word overlap
  and words repeat; unless it is given, it is the one of ``TEMPERS`` that gives every fifth text of the
  sample the likeliest declared language under a model of the other four.
* Background: one more class, under which all trigrams of the sample are equally likely.  Its
  text prior is ``background``; other evidence says nothing about it.  Text of another language or
  script, or gibberish, is likelier under it than under any language that the sample holds.
* Declared markup language and address suffix: how often each value goes with each language,
  by a grouped sum of the text posteriors over all rows, smoothed.
* Host prior: grouped sums by host and by registered domain, smoothed hierarchically: host
  towards domain towards corpus.  A row's own contribution is left out of its prior.

A row is rejected if the posterior of its best language is under ``threshold`` (the background's
share counts against it), or if it has no evidence at all (no letters, no known declaration,
no suffix).

Defined cases: null and empty texts have no text evidence; null declarations, addresses and
hosts count as no evidence; repeated rows get equal results; of languages with equal posteriors the
first by name is taken; without any declared row the result names no language and rejects all rows;
an empty table gives no rows.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO, cut, free_name, sized, small, worker_state

SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 24_000_000
TEMPERS = (0.02, 0.05, 0.1, 0.2, 0.5)
#: texts of each declared language in the sample at least
LEAST_ROWS = 20
#: steps of the hash by which texts are drawn
SCALE = 1 << 30
_LETTERS = bytes(c if c in range(0x61, 0x7B) or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters (any character beyond ASCII counts as one), lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def trigrams(word: bytes) -> list[str]:
    padded = f"^{word.decode('utf-8', 'replace')}$"
    return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]


class TextModel:
    """Add-one smoothed trigram likelihoods of each language."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        counts: dict[str, Counter] = {}
        for text, language in rows:
            own = counts.setdefault(language, Counter())
            for word, n in Counter(words(text)).items():
                for gram in trigrams(word):
                    own[gram] += n
        self.languages = sorted(counts)
        grams = sorted(set().union(*counts.values())) if counts else []
        totals = [sum(counts[x].values()) + len(grams) + 1 for x in self.languages]
        level = -math.log(len(grams) + 1)  # of the background
        self.unseen = [*(-math.log(t) for t in totals), level]
        self.seen = {g: [*(math.log((counts[x][g] + 1) / t) for x, t in zip(self.languages, totals)), level] for g in grams}

    def word(self, word: bytes) -> list[float]:
        """Log likelihoods of each language and of the background."""
        return [sum(v) for v in zip(*(self.seen.get(g, self.unseen) for g in trigrams(word)))]


def fit_temper(rows: list[tuple[str | None, str]]) -> float:
    """The discount under which every fifth text is likeliest to be in its declared language."""
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    model = TextModel([r for i, r in enumerate(rows) if i % 5])
    scores, totals = WordScores(model), []
    for text, language in held:
        found = words(text)
        if found and language in model.languages:
            totals.append((scores.of(found)[:-1], model.languages.index(language)))
    if not totals or len(model.languages) < 2:
        return 0.1

    def fitness(temper: float) -> float:
        """Mean log posterior, every text allowed to be declared wrongly once in a thousand."""
        out = 0.0
        for total, own in totals:
            p = np.exp(temper * (total - total.max()))
            out += math.log(0.999 * p[own] / p.sum() + 0.001 / len(total))
        return out

    return max(TEMPERS, key=lambda t: (round(fitness(t) / len(totals), 4), -t))


class WordScores(dict):
    """word -> row of a growing table of log likelihoods"""

    def __init__(self, model: TextModel):
        self.model, self.table, self.used = model, np.zeros((1024, len(model.languages) + 1)), 0

    def __missing__(self, word: bytes) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.model.word(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def of(self, found: list[bytes]) -> np.ndarray:
        if self.used > MEMO:
            self.clear()
            self.used = 0
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return self.table[rows].sum(0)


def _score(shipped, temper: float):
    """(doc_id, row, text, ...) -> the same without the text, with its tempered log posteriors, the background's last"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language", dict)
        model = shipped.value
        scores = WordScores(model)
        k = len(model.languages)
        for b in small(batches):
            out = np.zeros((b.num_rows, k + 1))
            n_words = np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column("text").to_pylist()):
                found = words(text)
                n_words[i] = len(found)
                if found:
                    total = temper * scores.of(found)
                    p = np.exp(total - total[:k].max())
                    out[i] = np.log(np.clip(p / p[:k].sum(), 1e-30, 1e30))
                elif k:
                    out[i] = -math.log(k)
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_words), *(pa.array(out[:, j]) for j in range(k + 1))], names=[*keep, "n_words", *(f"t{j}" for j in range(k)), "aside"])

    return run


def suffix_of(address: F.Column) -> F.Column:
    """The top-level domain and a two-letter first path segment of an address, as ``com/fr``."""
    top = F.regexp_extract(address, r"^(?:[a-z]+://)?[^/?#:]*\.([A-Za-z]+)(?=[/?#:]|$)", 1)
    path = F.regexp_extract(address, r"^(?:[a-z]+://)?[^/?#]*/([A-Za-z]{2})(?=[/?#]|$)", 1)
    return F.when(address.isNotNull() & ((top != "") | (path != "")), F.concat_ws("/", F.nullif(F.lower(top), F.lit("")), F.nullif(F.lower(path), F.lit(""))))


def host_of(address: F.Column) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(address, r"^(?:[a-z]+://)?([^/?#:]+)", 1)), F.lit(""))


def identify(
    rows: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    declared: str | None = "lang",
    address: str | None = None,
    host: str | None = "source",
    temper: float | None = None,
    strength: float = 20.0,
    threshold: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    background: float = 0.01,
) -> DataFrame:
    """(key, row, language, confidence, text_language, accepted) of every row; ``row`` is a hash of the text."""
    none = F.lit(None).cast("string")
    base = rows.select(
        F.col(key).cast("long").alias(key),
        F.xxhash64(F.col(text)).alias("row"),
        F.col(text).alias("text"),
        (F.col(declared).cast("string") if declared else none).alias("declared"),
        (suffix_of(F.col(address)) if address else none).alias("suffix"),
        (F.col(host).cast("string") if host else host_of(F.col(address)) if address else none).alias("host"),
    )
    labelled = base.filter("declared is not null and text is not null").select("row", "text", "declared")
    texts = cut(labelled.select("declared", "row").distinct())
    sizes = texts.groupBy("declared").agg(F.count("*").alias("n"))
    n_declared = max(1, sizes.count())
    quota = max(LEAST_ROWS, sample_rows // n_declared)
    # twice the quota passes by hash; the first of these, by hash again, are taken
    drawn = texts.join(F.broadcast(sizes), "declared").filter(F.pmod("row", F.lit(SCALE)) * F.col("n") <= F.lit(2 * quota * SCALE).cast("double"))
    order = Window.partitionBy("declared").orderBy(F.pmod("row", F.lit(SCALE)), "row")
    picked = drawn.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= quota).select("declared", "row")
    found = cut(labelled.join(F.broadcast(picked), ["declared", "row"]).dropDuplicates(["declared", "row"]))
    # shortest texts first within their language, so that long ones cannot use up the characters of all
    length = F.sum(F.length("text")).over(Window.partitionBy("declared").orderBy(F.length("text"), "row"))
    bounded = found.withColumn("upto", length).filter(F.col("upto") <= sample_chars // n_declared)
    sample = sorted(((r.row, r.text, r.declared) for r in bounded.select("row", "text", "declared").collect()), key=lambda r: (r[2], r[0]))
    sample = [(t, d) for _, t, d in sample]
    temper = fit_temper(sample) if temper is None else temper
    model = TextModel(sample)
    names = model.languages
    if not names:
        return base.select(key, "row", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), F.lit(False).alias("accepted"))

    t, p = [f"t{j}" for j in range(len(names))], [f"p{j}" for j in range(len(names))]
    schema = f"`{key}` long, row long, declared string, suffix string, host string, n_words long, " + ", ".join(f"{c} double" for c in [*t, "aside"])
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    scored = cut(base.mapInArrow(_score(shipped, temper), schema))
    # rows of the background's own kind say nothing about declarations and hosts
    weight = F.when(F.col("n_words") > 0, 1 / (1 + background * F.exp("aside"))).otherwise(0.0)
    soft = scored.select("*", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1).alias("domain"), *((F.exp(a) * weight).alias(b) for a, b in zip(t, p)))

    def sums(by: str, prefix: str) -> DataFrame:
        return soft.filter(F.col(by).isNotNull()).groupBy(by).agg(*(F.sum(c).alias(f"{prefix}{j}") for j, c in enumerate(p)))

    corpus = soft.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in p)).first()
    everything = sum(corpus) + len(names)
    prior = [(c + 1) / everything for c in corpus]
    joined = soft
    for by, prefix in (("declared", "d"), ("suffix", "s"), ("domain", "m"), ("host", "h")):
        joined = joined.join(sized(cut(sums(by, prefix))), by, "left")

    def less_own(prefix: str, j: int) -> F.Column:
        return F.greatest(F.coalesce(F.col(f"{prefix}{j}"), F.lit(0.0)) - F.col(p[j]), F.lit(0.0))

    def share_of(prefix: str, j: int, towards) -> F.Column:
        whole = sum((less_own(prefix, i) for i in range(len(names))), F.lit(0.0))
        return (less_own(prefix, j) + strength * towards) / (whole + strength)

    logs = []
    for j, a in enumerate(t):
        domain = share_of("m", j, F.lit(prior[j]))
        evidence = F.col(a) + F.log(share_of("h", j, domain))
        for by, prefix in (("declared", "d"), ("suffix", "s")):
            # P(value | l) is proportional to P(l | value) / P(l)
            evidence = evidence + F.when(F.col(by).isNull(), 0.0).otherwise(F.log(share_of(prefix, j, F.lit(prior[j])) / prior[j]))
        logs.append(evidence.alias(f"e{j}"))
    fused = joined.select(key, "row", "n_words", "declared", "suffix", "aside", *t, *logs)
    e = [F.col(f"e{j}") for j in range(len(names))]
    best, text_best = (F.greatest(*c) if len(names) > 1 else c[0] for c in (e, [F.col(c) for c in t]))

    def named(columns: list[F.Column], top: F.Column) -> F.Column:
        return F.coalesce(*(F.when(c == top, F.lit(n)) for c, n in zip(columns, names)))

    # the background has a text prior, no declaration, suffix or host of its own; its likelihood ratio is to the sum of all languages
    text_only = F.when(F.col("n_words") > 0, background * F.exp("aside")).otherwise(0.0)
    confidence = 1 / (sum((F.exp(c - best) for c in e), F.lit(0.0)) + text_only)
    known = (F.col("n_words") > 0) | F.col("declared").isin(names) | F.col("suffix").isNotNull()
    return fused.select(
        key,
        "row",
        named(e, best).alias("language"),
        confidence.alias("confidence"),
        F.when(F.col("n_words") > 0, named([F.col(c) for c in t], text_best)).alias("text_language"),
        (known & (confidence >= threshold)).alias("accepted"),
    )


def accepted_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with their columns as they were."""
    doc, row = free_name("doc", docs.columns), free_name("row", docs.columns)
    found = identify(docs, **options).filter("accepted").select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left_semi")
