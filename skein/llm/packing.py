"""Best-fit packing of tokenised documents by a linear grouping scheme.

Every document becomes its token ids and one closing id, cut into pieces of at most
``capacity`` tokens.  How pieces share sequences depends on their lengths alone, and there
are at most ``capacity`` different lengths, so the plan is made from the histogram of
lengths, whose size no corpus can exceed:

1. Large lengths are divided into groups of equal cardinality and rounded up to the largest
   of their group, which leaves few sizes.
2. Configurations of these sizes are optimised as a linear programme by column generation;
   whole multiples of each configuration are taken.
3. The actual lengths of each group are substituted for its rounded size.
4. What is left over and the small lengths are placed best fit, longest first, whole runs
   of equal lengths at a time.

Spark numbers the pieces of each length across the cluster (salted row numbers plus running
offsets), and the plan maps (length, number) to a sequence and an offset.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed as
often as they occur; a null doc_id is carried along; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, small, worker_state

#: entries of a worker's memo of encoded pieces (about 40 bytes each) and of encoded words (about 230 each)
PIECES, WORDS = 1_200_000, 100_000
#: bytes of the longest piece that is remembered
SHORT = 64
#: characters of a text that are encoded in one go; a longer text is cut at blanks
LONG = 1_000_000
#: fixed values of the tokenizer: how its normalised text is cut into words
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_WORDS = regex.compile(_PATTERN)
#: beyond the basic plane, Unicode tables of different libraries disagree
_ODD = regex.compile(r"[\U00010000-\U0010ffff]|<\|(?:start|end)oftext\|>")
_CUTS = regex.compile(r"[ \n\t\r]+")


class PieceMemo:
    """Ids of short pieces, found by two 64-bit hashes: sorted numpy arrays instead of objects."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.size, self.ids = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.checks[at] == checks), at, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > PIECES:
            self.clear()
        begin = (np.cumsum(sizes) - sizes + len(self.ids)).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.checks = np.insert(self.hashes, at, hashes[order]), np.insert(self.checks, at, checks[order])
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, sizes[order].astype(np.int32))
        self.ids = np.concatenate([self.ids, ids])


class WordEncoder:
    """Encodes many texts at once, each distinct piece between blanks only once.

    The tokenizer normalises a text, cuts it into words by a fixed pattern that never joins
    characters across white space, and encodes each word by itself; the ids of a word end with
    a token that closes it.  So the distinct blank-separated pieces of a batch are looked up
    among those the worker remembers, new ones are cut into words, new words are encoded many
    at a time (closing tokens tell them apart), and numpy lays out the ids of all texts.
    Pieces that hold a special token's string or characters beyond the basic plane go to the
    tokenizer as they are.  A tokenizer of other rules than these encodes whole texts itself.
    """

    def __init__(self, tokenizer_path: str, cuts_words: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.cuts_words = _cuts_words(tokenizer_path) if cuts_words is None else cuts_words
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.memo = PieceMemo()

    @staticmethod
    def normalised(text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower().encode("utf-8", "surrogatepass")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces; words are remembered."""
        words = [_cut(p.decode("utf-8", "surrogatepass")) for p in pieces]
        if len(self.known) > WORDS:
            self.known.clear()
        ids_of = {w: self.known[w] for own in words for w in own if w in self.known}
        new = list({w for own in words for w in own if w not in ids_of})
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                flat, bounds = ids.tobytes(), (4 * ends).tolist()
                ids_of.update((w, flat[a:b]) for w, a, b in zip(part, [0, *bounds], bounds))
            else:
                ids_of.update((w, self.whole(w).tobytes()) for w in part)
        self.known.update((w, ids_of[w]) for w in new[:WORDS] if len(w) <= SHORT)
        return [b"".join(map(ids_of.__getitem__, own)) for own in words]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        if not self.cuts_words:
            return [self.whole(t or "") for t in texts]
        stretches, parts = [], []
        for text in texts:
            own = []
            for stretch, plain in _stretches(text or ""):
                own.append(len(stretches) if plain else self.whole(stretch))
                if plain:
                    stretches.append(stretch)
            parts.append(own)
        found = self.plain(stretches)
        return [np.concatenate([np.empty(0, "<u4"), *(found[x] if isinstance(x, int) else x for x in own)]) if len(own) != 1 or not isinstance(own[0], int) else found[own[0]] for own in parts]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        encoded = [self.normalised(t) for t in texts]
        buffer = b"\n".join([b"", *encoded, b""])
        data = np.frombuffer(buffer, np.uint8)
        inside = ~_BLANK[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        hashes, checks = _piece_hashes(buffer, data, starts, ends)
        unique, example, number = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks != checks[example][number]).any():  # two pieces of one hash: number the pairs of hashes
            _, example, number = np.unique(np.stack([hashes, checks], 1), axis=0, return_index=True, return_inverse=True)
            number = number.ravel()
            unique = hashes[example]
        at = self.memo.find(unique, checks[example])
        fresh = np.flatnonzero(at < 0)
        new = self.learn([buffer[a:b] for a, b in zip(starts[example[fresh]].tolist(), ends[example[fresh]].tolist())])
        sizes, begin = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        known = np.flatnonzero(at >= 0)
        sizes[known], begin[known] = self.memo.size[at[known]], self.memo.begin[at[known]]
        sizes[fresh] = np.fromiter(map(len, new), np.int64, len(new)) // 4
        added = np.frombuffer(b"".join(new), "<u4")
        begin[fresh] = np.cumsum(sizes[fresh]) - sizes[fresh] + len(self.memo.ids)
        flat = np.concatenate([self.memo.ids, added])
        length = sizes[number]
        place = np.cumsum(length) - length
        ids = flat[np.arange(int(length.sum())) + np.repeat(begin[number] - place, length)]
        keep = ends[example[fresh]] - starts[example[fresh]] <= SHORT
        self.memo.add(unique[fresh][keep], checks[example[fresh]][keep], sizes[fresh][keep], added[np.repeat(keep, sizes[fresh])])
        bounds = np.cumsum([1, *(len(e) + 1 for e in encoded)])  # where each text starts in the buffer
        cut = np.append(place, len(ids))[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ROWS = 1 << 15


def _powers(seed: int) -> np.ndarray:
    out = np.full(SHORT + 1, seed, np.uint64)
    out[0] = seed >> 7 | 1
    return np.multiply.accumulate(out)


_FIRST, _SECOND = _powers(0x9E3779B97F4A7C15), _powers(0xC2B2AE3D27D4EB4F)


def _cuts_words(tokenizer_path: str) -> bool:
    """Whether the file states the rules by which this module cuts words."""
    with open(tokenizer_path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (rules.get("normalizer") or {}).get("normalizers", ())]
    splits = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", ()) if p["type"] == "Split"]
    return steps == _NORMALISERS and splits == [_PATTERN] and rules["model"].get("end_of_word_suffix") == "</w>"


def _stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut at blanks: bounded stretches of plain pieces, and odd pieces by themselves."""
    odd = (not text.isascii() or "oftext|>" in text) and _ODD.search(text)
    if len(text) <= LONG and not odd:
        yield text, True
        return
    held, size = [], 0
    for piece in _CUTS.split(text):
        if odd and _ODD.search(piece):
            if held:
                yield " ".join(held), True
            yield piece, False
            held, size = [], 0
        elif piece:
            held.append(piece)
            size += len(piece) + 1
            if size > LONG:
                yield " ".join(held), True
                held, size = [], 0
    if held:
        yield " ".join(held), True


def _cut(piece: str) -> list[str]:
    if piece.isalpha():
        return [piece]
    if piece[-1] in ".,!" and piece[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return _WORDS.findall(piece)


def _piece_hashes(buffer: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece [start, end); pieces are taken ``_ROWS`` at a time."""
    first, second = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    size = ends - starts
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = xxhash.xxh3_128_digest(buffer[starts[i] : ends[i]])
        first[i], second[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    short = np.flatnonzero(size <= SHORT)
    for at in range(0, len(short), _ROWS):
        rows = short[at : at + _ROWS]
        n = size[rows]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        letters = data[inner + np.repeat(starts[rows], n)].astype(np.uint64) + np.uint64(1)
        for out, powers, salt in ((first, _FIRST, 0xD6E8FEB86659FD93), (second, _SECOND, 0xA0761D6478BD642F)):
            out[rows] = np.add.reduceat(letters * powers[inner], begin) + n.astype(np.uint64) * np.uint64(salt)
    return first, second


def encoder_of(tokenizer_path: str, cuts_words: bool | None = None) -> WordEncoder:
    """The worker's encoder, kept for its next tasks of the same kind."""
    return worker_state(f"encoder {tokenizer_path}", lambda: WordEncoder(tokenizer_path, cuts_words))


#: characters of text that are encoded at once
BATCH_CHARS = 1_500_000


def _pieces(tokenizer_path: str, closing_id: int, capacity: int, with_ids: bool):
    end = np.array([closing_id], "<u4")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    cuts_words = _cuts_words(tokenizer_path)  # read by the driver: no worker holds the parsed file

    def rows_of(docs: list, texts: list) -> pa.RecordBatch:
        rows = []
        for doc_id, ids in zip(docs, encoder_of(tokenizer_path, cuts_words).encode(texts)):
            ids = np.concatenate([ids, end])
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity].tobytes()
                rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield rows_of(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield rows_of(docs, texts)

    return run


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, whole multiple) of the best fractional packing, by column generation."""
    k = len(sizes)
    if not k:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    base = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(base.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            best[c] = best[c - 1]
            fits = np.flatnonzero(size <= c)
            value = best[c - size[fits]] + price[fits]
            if value.max() > best[c] + 1e-12:
                best[c], taken[c] = value.max(), fits[value.argmax()]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                column[taken[c]] += 1
                c -= size[taken[c]]
        amount, change = np.linalg.solve(base, need), np.linalg.solve(base, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(amount, 0) / change, np.inf)
        base[:, ratio.argmin()] = column
    amount = np.floor(np.linalg.solve(base, need) + 1e-6).astype(int)
    return [(base[:, i].astype(int), int(m)) for i, m in enumerate(amount) if m > 0]


def plan(counts: dict[int, int], capacity: int, groups: int = 64, small_share: float = 0.125, tolerances: tuple[float, ...] = (0.0025, 0.01, 0.03, 1.0)) -> list[tuple[int, int, int, int]]:
    """(length, first sequence, number of sequences, offset): where runs of equal pieces go.

    A configuration whose actual lengths leave more than a tolerance of the capacity empty is
    taken apart again and its pieces are placed best fit; the best of ``tolerances`` counts.
    """
    large = [(length, n) for length, n in sorted(counts.items()) if length > small_share * capacity and n > 0]
    quota = max(1, -(-sum(n for _, n in large) // groups))
    grouped: list[list[tuple[int, int]]] = []
    for length, n in large:
        if not grouped or sum(m for _, m in grouped[-1]) >= quota:
            grouped.append([])
        grouped[-1].append((length, n))
    chosen = configurations([g[-1][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
    plans = (_assemble(counts, capacity, chosen, [list(g) for g in grouped], small_share, t) for t in tolerances)
    return min(plans, key=lambda p: p[1])[0]


def _assemble(counts: dict[int, int], capacity: int, chosen: list[tuple[np.ndarray, int]], grouped: list[list[tuple[int, int]]], small_share: float, tolerance: float) -> tuple[list[tuple[int, int, int, int]], int]:
    """The placements under one tolerance, and the number of sequences."""
    placed: list[tuple[int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # residuals that have sequences, ascending
    next_sequence = 0

    def release(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in free:
            free[room] = []
            bisect.insort(rooms, room)
        free[room].append((first, n))

    rest: dict[int, int] = {length: n for length, n in counts.items() if length <= small_share * capacity}
    for column, multiple in chosen:
        runs: list[tuple[int, tuple[int, ...]]] = [(multiple, ())]
        for g in np.flatnonzero(column)[::-1]:
            for _ in range(column[g]):
                out = []
                for n, inside in runs:
                    while n and grouped[g]:
                        length, have = grouped[g].pop()
                        take = min(n, have)
                        if have > take:
                            grouped[g].append((length, have - take))
                        out.append((take, (*inside, length)))
                        n -= take
                    if n:
                        out.append((n, inside))
                runs = out
        for n, inside in runs:
            if capacity - sum(inside) > tolerance * capacity:
                for length in inside:
                    rest[length] = rest.get(length, 0) + n
                continue
            used = 0
            for length in inside:
                placed.append((length, next_sequence, n, used))
                used += length
            release(capacity - used, next_sequence, n)
            next_sequence += n

    for g in grouped:
        for length, n in g:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                whole, last = divmod(n, each)
                for copies, sequences in ((each, whole), (last, 1 if last else 0)):
                    if sequences:
                        placed += [(length, next_sequence, sequences, i * length) for i in range(copies)]
                        release(capacity - copies * length, next_sequence, sequences)
                        next_sequence += sequences
                break
            room = rooms[at]
            first, have = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
            take = min(n, have)
            placed.append((length, first, take, capacity - room))
            release(room - length, first, take)
            release(room, first + take, have - take)
            n -= take
    return placed, next_sequence


def _place(placed: list[tuple[int, int, int, int]]):
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {p[0] for p in placed}:
        own = np.array([p[1:] for p in placed if p[0] == length], np.int64)
        table[length] = np.concatenate([[0], np.cumsum(own[:, 1])[:-1]]), own[:, 0], own[:, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                start, first, used = table[int(one)]
                at = np.searchsorted(start, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[at] + rank[rows] - start[at], used[at]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0, groups: int = 64, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset where each lies."""
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = cut(texts.mapInArrow(_pieces(tokenizer_path, closing_id, capacity, with_ids), schema))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = plan(counts, capacity, groups)

    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_parts(spark))))
    inner = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)).cast("long") - 1)
    sums = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = inner.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")
    return ranked.mapInArrow(_place(placed), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of ``pack(..., with_ids=True)``, pieces in order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x.ids)).alias("ids"))
