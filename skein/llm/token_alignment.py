"""Alignment of two tokenizers over the same bytes.

Every text, with a blank before it, is encoded by a byte-level BPE (A) and a sentence-piece
model (B, which adds that blank itself).  Byte offsets where a token of A and a token of B both
end cut the tokens into groups; a token of A and one of B are linked if their bytes overlap.

1. The documents of a slice of an Arrow batch lie side by side, at known byte offsets.  The ends
   of all tokens of A, and those of B, are counted once per byte; where both occur is a cut.
   A stretch between two ends of either kind belongs to one token of A and one of B, and every
   overlap is one such stretch, so links are numbered by the ends; segmented prefix sums give
   the figures of each document.  Both sides encode each different word of a slice once: the
   pattern of A always cuts at a single blank, and no piece of B has a blank behind another character.
2. Each document's different links and how often it has them are stored, compressed, in the
   checkpoint folder; tasks add up which documents hold which link before Spark groups them.
3. The most frequent links, at most ``head`` of them by count, are sent to all tasks and settle
   nearly all links of all documents in one pass.  What is left, links of few documents each, meets its
   counts in a join by link.

Defined cases: a null or empty text, or one whose tokens do not join to its own bytes (B
normalises some characters), has no tokens, zeros and an empty digest; rows that repeat count
as documents of their own; a null doc_id is carried along; texts of any length are encoded in
stretches cut before single blanks; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Encoder, Vocabulary
from .common import by_volume, cut, worker_state

#: links that are sent to all tasks (16 bytes each)
HEAD = 2_000_000
#: links that a task adds up before it emits their counts
HELD = 2_000_000
#: bytes of texts side by side
VOLUME = 4_000_000
#: different words that are encoded as one text
BLOCK = 20_000
_BLANK = re.compile("(?<=[^ ]) (?=[^ ])")


@dataclass
class Pair:
    """Two tokenizers: the vocabulary of A, and the model file of B as bytes."""

    a: Vocabulary
    b: bytes = field(repr=False)

    @classmethod
    def of_files(cls, a: Vocabulary, path_b: str) -> Pair:
        with open(path_b, "rb") as f:
            return cls(a, f.read())


class Sides:
    """What a worker holds of a pair: encoders and the bytes of every token."""

    def __init__(self, pair: Pair):
        import sentencepiece

        self.encoder = Encoder(pair.a, together=True)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.begins = np.array([p.startswith("▁") for p in pieces])
        self.size_a = np.array([len(t) for t in pair.a.tokens], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        if len(self.size_a) * len(self.size_b) >= 1 << 32:
            raise ValueError("the product of the two vocabularies must fit into 32 bits")
        # words may be encoded one by one if no piece has a blank behind another character
        self.parts = self.bytes_b[self.model.encode("a")[0]][:1] == b" " and not any("▁" in p.lstrip("▁") for p in pieces)
        most = max(len(self.size_a), len(self.size_b))
        self.items = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
        self.most = most

    def words_of(self, text: str) -> list[str]:
        """``text`` cut at its single blanks, which begin the next word's first token."""
        if not self.parts:
            return [text]
        return _BLANK.split(text) if text[:1] == " " or text[-1:] == " " or "  " in text else text.split(" ")

    def _block(self, words: list[str], out: list[tuple[np.ndarray, ...]]) -> None:
        """Encode different words as one text on both sides.

        Adds to ``out`` their ids of A and how many each has, the same of B, and the bytes of each with its blank.
        Each word begins with the blank before it: in A where the bytes of its tokens say so, in B with a piece
        that has the blank.  Words that B does not give back as their own bytes, or that hold blanks of their own,
        are found by halving the block; a count of -1 in B stands for the former.
        """
        text = " ".join(words)
        raw = b" " + text.encode("utf-8", "surrogatepass")
        found = self.model.encode(text, num_threads=1)
        b = np.array(found, np.int64)
        whole = b"".join(map(self.bytes_b.__getitem__, found)) == raw
        one = len(words) == 1
        starts_b = np.zeros(1, np.int64) if one else np.flatnonzero(self.begins[b])
        starts = np.zeros(1, np.int64) if one else np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)
        if not one and not (whole and len(starts_b) == len(starts) == len(words) and "▁" not in text):
            middle = len(words) // 2
            self._block(words[:middle], out)
            self._block(words[middle:], out)
            return
        a = self.encoder.encode([" " + text])[0].astype(np.int64)
        starts_a = np.searchsorted(np.cumsum(self.size_a[a]), starts, side="right")
        counts_b = np.diff(starts_b, append=len(b)) if whole else np.array([-1])
        out.append((a, np.diff(starts_a, append=len(a)), b if whole else b[:0], counts_b, np.diff(starts, append=len(raw))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A of all texts side by side and how many each has, the same of B, and the bytes of each text.

        Each different word is encoded once.  Texts that do not join to their bytes have no ids and no bytes.
        """
        found = [self.words_of(t) if t else [] for t in texts]
        # words with blanks of their own come last, so that they do not break blocks of others
        words = sorted(dict.fromkeys(chain.from_iterable(found)), key=lambda w: " " in w or "▁" in w)
        number = {w: i for i, w in enumerate(words)}
        none = np.empty(0, np.int64)
        out: list[tuple[np.ndarray, ...]] = [(none,) * 5]
        for first in range(0, len(words), BLOCK):
            self._block(words[first : first + BLOCK], out)
        flat_a, count_a, flat_b, count_b, size = map(np.concatenate, zip(*out))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
        bounds = np.concatenate([[0], np.cumsum(lengths)])

        def in_each(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])

        good = np.repeat(in_each(count_b[code] < 0) == 0, lengths)
        sides = []
        for flat, count in ((flat_a, count_a), (flat_b, np.maximum(count_b, 0))):
            begins = np.cumsum(count) - count
            own = code[good]
            many = count[own]
            ends = np.cumsum(many)
            ids = flat[np.arange(int(many.sum())) + np.repeat(begins[own] - ends + many, many)]
            sides += [ids, in_each(np.where(good, count[code], 0))]
        return (*sides, in_each(np.where(good, size[code], 0)))


@dataclass
class Alignment:
    """Groups and links of documents side by side; tokens and links are numbered through."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sizes: np.ndarray) -> Alignment:
    """Align tokens of ``sizes_a`` and ``sizes_b`` bytes; document d has ``sizes[d]`` bytes, n_a[d] and n_b[d] tokens."""
    total = int(sizes.sum())
    at_a = np.bincount(np.cumsum(sizes_a), minlength=total + 1).astype(np.int8)
    at_b = np.bincount(np.cumsum(sizes_b), minlength=total + 1).astype(np.int8)
    ends = np.flatnonzero(at_a + at_b)
    in_a, in_b = at_a[ends].astype(np.int64), at_b[ends].astype(np.int64)
    cuts = in_a & in_b
    group = np.cumsum(cuts) - cuts
    bounds = np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes), side="right")])
    through = np.concatenate([[0], np.cumsum(cuts)])
    return Alignment(
        n_a, n_b, np.diff(through[bounds]), np.diff(bounds), np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b,
        cuts[in_a == 1], cuts[in_b == 1], group[in_a == 1], group[in_b == 1],
    )


def group_items(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, most: int) -> np.ndarray:
    """Numbers of the written items of all groups in order: A ids, then B ids of each, with the mark behind."""
    groups = int(found.n_groups.sum())
    of_a, of_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    before_b, through_a = np.cumsum(of_b) - of_b, np.cumsum(of_a)
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + before_b[found.group_a]] = ids_a + most * found.last_a
    out[np.arange(len(ids_b)) + through_a[found.group_b]] = ids_b + 2 * most * found.last_b
    return out


def pack_links(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted different keys and their counts in a few bytes each."""
    steps = np.diff(keys, prepend=keys[:1] * 0).astype("<u4")
    return zstandard.compress(steps.tobytes() + times.astype("<u4").tobytes(), 1)


def unpack_links(packed: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of several documents side by side, and how many each has."""
    parts = [np.frombuffer(zstandard.decompress(p), "<u4") if p else np.empty(0, "<u4") for p in packed]
    counts = np.array([len(p) // 2 for p in parts], np.int64)
    keys = [np.cumsum(p[: len(p) // 2], dtype=np.int64) for p in parts]
    times = [p[len(p) // 2 :].astype(np.int64) for p in parts]
    return np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *times]), counts


_FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_STORED = f"row long, doc_id long, {_FIGURES}, links binary"


def _sides(pair: Pair) -> Sides:
    return worker_state("token alignment", lambda: Sides(pair))


def aligned(docs: DataFrame, pair: Pair) -> DataFrame:
    """One row per document: its figures, the digest of its groups, and its packed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = _sides(pair), TaskContext.get().partitionId() << 36
        width = len(own.size_b)
        for b in by_volume(batches, 1, VOLUME, 1024):
            flat_a, n_a, flat_b, n_b, sizes = own.encode(b.column(1).to_pylist())
            found = align(own.size_a[flat_a], own.size_b[flat_b], n_a, n_b, sizes)
            items = group_items(flat_a, flat_b, found, own.most)
            doc = np.repeat(np.arange(b.num_rows), found.n_links)
            together, times = np.unique((doc << 32) | (flat_a[found.link_a] * width + flat_b[found.link_b]), return_counts=True)
            ends = np.searchsorted(together, np.arange(1, b.num_rows + 1) << 32)
            shas, links, at, item = [], [], 0, 0
            for n, end in zip((n_a + n_b).tolist(), ends.tolist()):
                text = "".join(map(own.items.__getitem__, items[item : item + n].tolist()))[:-1]
                shas.append(hashlib.sha256(text.encode()).hexdigest() if n else "")
                links.append(pack_links(together[at:end] & 0xFFFFFFFF, times[at:end]))
                at, item = end, item + n
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            figures = [pa.array(c, pa.int64()) for c in (n_a, n_b, found.n_groups, found.n_links)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0), *figures, pa.array(shas, pa.string()), pa.array(links, pa.binary())], names=[c.split()[0] for c in _STORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORED)


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task's documents with the number of documents, added up in parts of ``HELD``."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, place = np.unique(np.concatenate([keys, *held]), return_inverse=True)
        weights = np.concatenate([counts, np.ones(size, np.int64)])
        total = np.zeros(len(new), np.int64)
        np.add.at(total, place, weights)
        return new, total

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["link", "n"])

    for b in batches:
        own = unpack_links(b.column(0).to_pylist())[0]
        held.append(own)
        size += len(own)
        if size >= HELD:
            keys, counts = merged()
            held, size = [], 0
            if len(keys) >= HELD:
                yield emit()
                keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield emit()


def link_counts(stored: DataFrame, pair: Pair) -> DataFrame:
    """(link, a, b, n, best): in how many documents each link is, and whether no link of its A token is in more."""
    width = _width(pair)
    n = stored.select("links").mapInArrow(_local_counts, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    n = n.select("link", F.floor(F.col("link") / width).cast("int").alias("a"), (F.col("link") % width).cast("int").alias("b"), "n")
    n = cut(n)
    # one row for each token of A, so never more than its vocabulary holds
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "a").select("link", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _width(pair: Pair) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pair.b).get_piece_size()


def _frequent(counts: DataFrame, head: int) -> tuple[DataFrame, bool]:
    """The links of the highest counts, at most ``head`` of them, and whether these are all: by a histogram of the counts."""
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r.level, r.links) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("links")).collect()), reverse=True)
    least, taken = None, 0
    for at, links in bins:
        if taken + links > head:
            break
        least, taken = at, taken + links
    whole = taken == sum(links for _, links in bins)
    return (counts.filter(level >= least) if least is not None else counts.limit(0)), whole


def alignments(docs: DataFrame, pair: Pair, head: int = HEAD) -> DataFrame:
    """Every document's figures with ``n_best`` and ``count_sum``, see the module."""
    spark = docs.sparkSession
    stored = cut(aligned(docs, pair))
    counts = cut(link_counts(stored, pair))
    frequent, whole = _frequent(counts, head)
    table = frequent.select("link", "n", "best").toArrow()
    link = table.column("link").to_numpy().astype(np.uint32)
    order = np.argsort(link)
    known = spark.sparkContext.broadcast((link[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
    figures = [c.split()[0] for c in _FIGURES.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for b in batches:
            own, times, counts_of = unpack_links(b.column("links").to_pylist())
            at = np.minimum(np.searchsorted(keys, own.astype(np.uint32)), max(len(keys) - 1, 0))
            here = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            weight, good = (n[at], best[at]) if len(keys) else (np.zeros(len(own), np.int64), here)
            bounds = np.concatenate([[0], np.cumsum(counts_of)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(here, x, 0))])[bounds]) for x in (times * good, times * weight)]
            left = np.concatenate([[0], np.cumsum(~here)])[bounds].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~here])) for x in (own, times)]
            plain = [b.column(c) for c in ("row", "doc_id", *figures)]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *rest], names=["row", "doc_id", *figures, "n_best", "count_sum", "rest", "times"])

    settled = stored.mapInArrow(look_up, f"row long, doc_id long, {_FIGURES}, n_best long, count_sum long, rest array<long>, times array<long>")
    order_out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if whole:
        return settled.select(*order_out)
    settled = cut(settled)
    rest = settled.select("row", F.inline(F.arrays_zip(F.col("rest").alias("link"), F.col("times").alias("times"))))
    found = rest.join(counts.select("link", "n", "best"), "link")
    more = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = settled.join(more, "row", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*order_out)
