"""Byte-level BPE in two tiers: a minimal perfect hash for whole pieces, a heap for the rest.

A fixed pattern cuts a text into pieces (words with the blank before them, numbers, signs,
white space), and every piece is encoded by itself:

1. The vocabulary lies in a minimal perfect hash: as many slots as tokens, one displacement
   for each bucket of about three tokens.  The hash names the only token a piece can be, and
   a comparison of the bytes decides.  All different pieces of a slice of texts are looked up at once.
2. A piece that is no token is merged from its bytes: parts are linked to their neighbours, and
   a heap yields the pair of lowest rank, the leftmost of equals.  Merged pieces are remembered by
   the worker, at most twice ``MEMO_PIECES`` of them (about 230 bytes each).

The driver builds the hash once from the vocabulary; tasks get it with their closure (about
1 MB for 50,000 tokens).

Defined cases: a null or empty text has no tokens; a text of any length is encoded in stretches
of about ``LONG`` characters, cut before a single blank between other characters, where the pattern always
cuts; strings of special tokens are plain text; rows that repeat give repeated rows; a null
doc_id is carried along; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_volume, mix, worker_state

#: keys a bucket of the perfect hash on average
LOAD = 3
#: displacements tried at once
TRIES = 512
#: merged pieces of each of the two parts of a worker's memory, and the longest of them in bytes
MEMO_PIECES, MEMO_BYTES = 300_000, 64
#: pieces that are merged together at once
TOGETHER = 8192
#: the rank of a pair that does not merge
NO_PAIR = 1 << 40
#: characters of a text that are encoded at once, and of a slice of texts
LONG = 1_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CUT = regex.compile(r"(?<=\S)(?= \S)")


def hashes(keys: Iterable[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64)


class PerfectHash:
    """Minimal perfect hash of different byte strings by hash and displace.

    Buckets are placed from the fullest to the emptiest: the first displacement that sends all
    keys of the bucket to free slots is kept.  Buckets of one key come last and store their slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, -(-self.size // LOAD))
        self.seed = 0
        while not self._place(keys):
            self.seed += 1

    def _place(self, keys: list[bytes]) -> bool:
        h = hashes(keys, self.seed)
        if len(np.unique(h)) < self.size:
            if len(set(keys)) < self.size:
                raise ValueError("the keys of a perfect hash must differ")
            return False
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        begins = np.cumsum(sizes) - sizes
        self.displacement = np.zeros(self.buckets, np.int32)
        self.key_at = np.zeros(self.size, np.int32)
        taken = np.zeros(self.size, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[: np.count_nonzero(sizes > 1)]:
            own = order[begins[b] : begins[b] + sizes[b]]
            for first in range(0, 1 << 22, TRIES):
                tries = np.arange(first, first + TRIES, dtype=np.uint64)
                slots = (mix(h[own][None, :] + tries[:, None] * _GOLDEN) % np.uint64(self.size)).astype(np.int64)
                good = ~taken[slots].any(1)
                for row in np.flatnonzero(good):
                    if len(set(slots[row].tolist())) == len(own):
                        break
                else:
                    continue
                self.displacement[b] = first + row
                self.key_at[slots[row]] = own
                taken[slots[row]] = True
                break
            else:
                return False
        singles = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.displacement[singles] = -1 - free
        self.key_at[free] = order[begins[singles]]
        return True

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of the only key that each string can be."""
        h = hashes(keys, self.seed)
        d = self.displacement[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        moved = mix(h + np.maximum(d, 0).astype(np.uint64) * _GOLDEN) % np.uint64(self.size)
        return self.key_at[np.where(d < 0, -1 - d, moved.astype(np.int64))]


class Vocabulary:
    """Tokens (bytes) in the order of their ranks, which are their ids, and the pattern that cuts texts."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)

    @classmethod
    def of_ranks(cls, path: str, pattern: str) -> Vocabulary:
        """Of a file of lines ``base64 rank``."""
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must run from 0 without gaps")
        return cls([t for _, t in ranked], pattern)

    @classmethod
    def of_json(cls, path: str, pattern: str) -> Vocabulary:
        """Of a tokenizer file whose merges stand in the order of the ids they make; added tokens are left out."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        signs = byte_signs()
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = sorted((i, t) for t, i in model["vocab"].items() if set(t) <= signs.keys())
        base = len(ids) - len(merged)
        if [i for i, _ in ids] != list(range(len(ids))) or [t for _, t in ids[base:]] != merged:
            raise ValueError("merges must make the ids in their order")
        return cls([bytes(map(signs.__getitem__, t)) for _, t in ids], pattern)


def byte_signs() -> dict[str, int]:
    """sign -> byte of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for signs from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """What a worker holds: ranks, pattern and remembered pieces of one vocabulary.

    With ``together``, short pieces that are no tokens are not merged one by one by the heap but all
    of a slice at once, in numpy; the ids are the same.
    """

    def __init__(self, vocabulary: Vocabulary, together: bool = False):
        self.together = together
        self.tokens, self.hash = vocabulary.tokens, vocabulary.hash
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        self.pieces = regex.compile(vocabulary.pattern)
        find = self.ranks.get
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.first = [find(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        halves = ((find(t[:k]), find(t[k:]), r) for t, r in self.ranks.items() for k in range(1, len(t)))
        self.pairs = {a << 20 | b: r for a, b, r in halves if a is not None and b is not None}
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.ends = [list(range(1, n + 1)) for n in range(MEMO_BYTES + 1)]
        self.befores = [list(range(-1, n - 1)) for n in range(MEMO_BYTES + 1)]
        self.merged: dict[bytes, list[int]] = {}
        self.earlier: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece from its bytes: a heap of ranked pairs over linked parts."""
        n = len(piece)
        first, find = self.first, self.pairs.get
        rank = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        rank.append(-1)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        ids = [self.bytes[b] for b in piece]
        if n <= MEMO_BYTES:
            end, before = self.ends[n][:], self.befores[n][:]
        else:  # numbers side by side instead of objects
            ids, rank = array("q", ids), array("q", rank)
            end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, merged = entry & mask, entry >> shift
            if rank[i] != merged:  # the pair has changed since
                continue
            j = end[i]
            k = end[i] = end[j]
            ids[i] = merged
            ids[j] = rank[j] = rank[i] = -1
            if k < n:
                before[k] = i
                r = find(merged << 20 | ids[k], -1)
                if r >= 0:
                    rank[i] = r
                    push(heap, r << shift | i)
            p = before[i]
            if p >= 0:
                rank[p] = r = find(ids[p] << 20 | merged, -1)
                if r >= 0:
                    push(heap, r << shift | p)
        return [i for i in ids if i >= 0]

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of different pieces: those that are tokens by the perfect hash, others merged or remembered."""
        found, tokens, known = self.hash.find(pieces).tolist(), self.tokens, self.merged
        out = []
        for piece, token in zip(pieces, found):
            if tokens[token] == piece:
                out.append([token])
                continue
            ids = known.get(piece)
            if ids is None:
                ids = self.earlier.get(piece) or self.merge(piece)
                if len(piece) <= MEMO_BYTES:
                    if len(known) >= MEMO_PIECES:  # what is not met again while as many others come is forgotten
                        self.earlier, known = known, {}
                        self.merged = known
                    known[piece] = ids
            out.append(ids)
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids that pairs merge to, ``NO_PAIR`` where they do not or where ``b`` is negative."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (b >= 0), self.pair_ids[at], NO_PAIR)

    def _merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces side by side and how many each has: each round merges the lowest pair, the leftmost of equals, of every piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        ids = np.full(inside.shape, -1, np.int64)
        ids[inside] = np.array(self.bytes, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        done, lengths = np.full(inside.shape, -1, np.int64), sizes.copy()
        ranks = np.full(inside.shape, NO_PAIR, np.int64)
        ranks[:, :-1] = self._pairs(np.maximum(ids[:, :-1], 0), ids[:, 1:])
        left = np.arange(len(pieces))
        while len(left):
            at = ranks.argmin(1)
            rows = np.arange(len(left))
            merged = ranks[rows, at]
            over = merged == NO_PAIR
            if over.any():
                done[left[over], : ids.shape[1]] = ids[over]
                left, ids, ranks, at, merged = left[~over], ids[~over], ranks[~over], at[~over], merged[~over]
                rows = np.arange(len(left))
                if not len(left):
                    break
            # everything behind the pair moves up by one
            ids[rows, at] = merged
            moved = columns[: ids.shape[1] - 1] + (columns[: ids.shape[1] - 1] > at[:, None])
            ids, ranks = np.take_along_axis(ids, moved, 1), np.take_along_axis(ranks, moved, 1)
            lengths[left] -= 1
            behind = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[rows, at] = np.where(at + 1 < ids.shape[1], self._pairs(merged, ids[rows, behind]), NO_PAIR)
            before = at > 0
            ranks[rows[before], at[before] - 1] = self._pairs(ids[rows[before], at[before] - 1], merged[before])
        return done[columns < lengths[:, None]], lengths

    def _learn_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces, where those of each begin, and how many it has."""
        found = self.hash.find(pieces)
        tokens = self.tokens
        whole = np.fromiter((tokens[t] == p for t, p in zip(found.tolist(), pieces)), bool, len(pieces))
        begins, sizes, parts = np.cumsum(whole) - 1, np.ones(len(pieces), np.int64), [found[whole].astype(np.int64)]
        filled = int(whole.sum())
        rest = np.flatnonzero(~whole)
        lengths = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        rest = rest[np.argsort(lengths, kind="stable")]
        short = int((lengths <= MEMO_BYTES).sum())
        for first in range(0, short, TOGETHER):
            own = rest[first : min(first + TOGETHER, short)]
            ids, counts = self._merge_together([pieces[i] for i in own])
            begins[own], sizes[own] = filled + np.cumsum(counts) - counts, counts
            parts.append(ids)
            filled += len(ids)
        for i in rest[short:]:
            ids = np.array(self.merge(pieces[i]), np.int64)
            begins[i], sizes[i] = filled, len(ids)
            parts.append(ids)
            filled += len(ids)
        return np.concatenate(parts), begins, sizes

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts side by side, and how many each has."""
        found = [self.pieces.findall(t) for t in texts]
        number = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        pieces_of = np.fromiter(map(len, found), np.int64, len(found))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(pieces_of.sum()))
        pieces = [p.encode("utf-8", "surrogatepass") for p in number]
        if self.together and pieces:
            flat, begins, sizes = self._learn_together(pieces)
        else:
            ids = self._learn(pieces)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
        size = sizes[code]
        ends = np.cumsum(size)
        place = np.arange(int(size.sum())) + np.repeat(begins[code] - ends + size, size)
        through = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces_of)])]
        return flat[place].astype(np.uint32), np.diff(through)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text, whatever its length."""
        parts: list[tuple[int, str]] = [(n, s) for n, t in enumerate(texts) for s in stretches(t or "")]
        held: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            stop, volume = at, 0
            while stop < len(parts) and (stop == at or volume + len(parts[stop][1]) <= 2 * LONG):
                volume += len(parts[stop][1])
                stop += 1
            ids, counts = self._stretches([s for _, s in parts[at:stop]])
            for (n, _), own in zip(parts[at:stop], np.split(ids, np.cumsum(counts)[:-1])):
                held[n].append(own)
            at = stop
        return [own[0] if len(own) == 1 else np.concatenate(own) for own in held]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def stretches(text: str) -> list[str]:
    """``text`` in stretches of about ``LONG`` characters, cut where every token ends."""
    out, at = [], 0
    while len(text) - at > LONG:
        here = _CUT.search(text, at + LONG)
        if not here:
            break
        out.append(text[at : here.start()])
        at = here.start()
    return [*out, text[at:]] if at else [text]


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary."""
    return worker_state(f"byte bpe {len(vocabulary.tokens)} {vocabulary.pattern}", lambda: Encoder(vocabulary))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids): the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in by_volume(batches, 1, 4 * LONG, 2048):
            ids = own.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids): the bytes that the ids stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.tokens
        for b in batches:
            out = [b"".join(map(tokens.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        numerals = [str(i) for i in range(len(own.tokens))]
        for b in by_volume(batches, 1, 4 * LONG, 2048):
            counts, shas, decoded = [], [], []
            for ids in own.encode(b.column(1).to_pylist()):
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(numerals.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
