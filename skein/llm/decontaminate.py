"""Benchmark decontamination over a distributed positional inverted index.

The index of the training texts is a stored table, partitioned by document as distributed search
engines do: ``positional_index`` turns every block of documents into one row that holds the
block's terms, their postings (ascending positions of all words) and where each document
starts.  Any number of benchmarks can be searched in it later without the texts.

A search takes the terms of each benchmark window, starts from the postings of the rarest one
and intersects the other lists, shifted by their offset, in order of rarity; all windows of a
slice go through a block together.  A proximity query keeps the starts from which a window holds
every term.  Postings never leave the block that they belong to, so the search needs no shuffle
and a frequent word costs no more than its list.

The benchmark is the stated query set.  It travels to the tasks in slices of at most
``slice_words`` words, which bounds what is shipped at once; a larger benchmark passes the same
blocks slice after slice.

Defined cases: null, empty or wordless texts have no words and no hits; an item without
words has no window; an item shorter than ``width`` is one window; equal items with
different ids are all reported, an item without an id as the empty string; rows are kept one for
one, so repeated rows repeat their result; a text longer than a block is a block of its own.  Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, worker_state

#: words of the documents of a block, and words of the benchmark that are shipped at once
BLOCK_WORDS, SLICE_WORDS = 500_000, 400_000
#: postings and windows that are intersected at once
AT_ONCE, WINDOWS = 2_000_000, 65_536

_SPACES = bytes(c if c in range(0x30, 0x3A) or c in range(0x61, 0x7B) or c >= 0x80 else 0x20 for c in range(256))
INDEX = "doc_ids array<long>, lengths binary, terms binary, bounds binary, places binary"
_NAMES = ["doc_ids", "lengths", "terms", "bounds", "places"]
#: what a search adds to a block: occurrences (start, length, window's number of owners) and their owners
FOUND = "spans binary, owners array<struct<doc: int, item: string>>"


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and returns the runs of digits, a-z and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


class Numbers(dict):
    """word -> its number, in order of appearance"""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _index_row(doc_ids: list, texts: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
    term = np.concatenate([*texts, np.empty(0, np.int32)])
    places = np.argsort(term, kind="stable").astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(numbers)))]).astype(np.int32)
    lengths = np.array([len(t) for t in texts], np.int32)
    values = [pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (lengths.tobytes(), b" ".join(numbers), bounds.tobytes(), places.tobytes()))]
    return pa.RecordBatch.from_arrays(values, names=_NAMES)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("decontamination", dict)
    doc_ids, texts, numbers, size = [], [], Numbers(), 0
    for b in small(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = words(text)
            if size and size + len(found) > BLOCK_WORDS:
                yield _index_row(doc_ids, texts, numbers)
                doc_ids, texts, numbers, size = [], [], Numbers(), 0
            doc_ids.append(doc_id)
            texts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            size += len(found)
    if doc_ids:
        yield _index_row(doc_ids, texts, numbers)


def positional_index(docs: DataFrame) -> DataFrame:
    """One row for each block of documents: ids, lengths, terms, and the positions of every word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, INDEX)


class Block:
    """A row of the index, read back."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        lengths, self.bounds, self.places = (np.frombuffer(row[c], np.int32) for c in ("lengths", "bounds", "places"))
        self.base = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        self.df = np.diff(self.bounds)
        self.total = len(self.places)
        #: (term, position) of every word as one ascending number
        self.keys = np.repeat(np.arange(len(self.df), dtype=np.int64) * (self.total + 1), self.df) + self.places

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.bounds[term] : self.bounds[term + 1]]

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position): where the terms of each row of ``terms`` follow each other in one document."""
        size = terms.shape[1]
        order = np.argsort(self.df[terms], axis=1, kind="stable")
        rarest = order[:, 0]
        lead = terms[np.arange(len(terms)), rarest]
        n = self.df[lead].astype(np.int64)
        rows_found, starts_found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto = np.cumsum(n)
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            own = n[at:to]
            inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            row = np.repeat(np.arange(at, to), own)
            start = self.places[np.repeat(self.bounds[lead[at:to]], own) + inner].astype(np.int64) - rarest[row]
            fits = (start >= 0) & (start + size <= self.total)
            row, start = row[fits], start[fits]
            for step in range(1, size):
                if not len(row):
                    break
                column = order[row, step]
                wanted = terms[row, column] * np.int64(self.total + 1) + start + column
                place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                same = self.keys[place] == wanted
                row, start = row[same], start[same]
            inside = self.document(start) == self.document(start + size - 1)
            rows_found.append(row[inside])
            starts_found.append(start[inside])
            at = to
        return np.concatenate(rows_found), np.concatenate(starts_found)

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Positions of a term from which ``span`` positions of one document hold every term, in any order."""
        distinct = np.unique(terms)
        starts = np.unique(np.concatenate([self.postings(t) for t in distinct])).astype(np.int64)
        ends = np.minimum(starts + span, self.base[self.document(starts) + 1])
        for t in distinct[np.argsort(self.df[distinct])]:
            list_ = self.postings(t)
            holds = np.searchsorted(list_, starts) < np.searchsorted(list_, ends)
            starts, ends = starts[holds], ends[holds]
        return starts


class Phrases:
    """A slice of the benchmark: vocabulary, distinct windows and the items of each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.vocabulary, self.names = Numbers(), ["" if i is None else str(i) for i, _ in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, (_, terms) in enumerate(items):
            if terms:
                ids = np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms))
                by_size.setdefault(min(width, len(terms)), []).append((item, ids))
        #: (windows, where each one's owners start, owners) of each size
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, own in sorted(by_size.items()):
            rows = [np.lib.stride_tricks.sliding_window_view(ids, size) for _, ids in own]
            windows, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            owner = np.repeat([item for item, _ in own], [len(r) for r in rows])
            pairs = np.unique(np.column_stack([number.ravel(), owner]), axis=0)
            self.by_size[size] = windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]

    def search(self, block: Block, slop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts, windows, owner bounds, owners) of the occurrences; with ``slop``, of the proximity matches."""
        there = np.full(len(self.vocabulary), -1, np.int64)
        ids = np.fromiter(map(self.vocabulary.get, block.terms, repeat(-1)), np.int64, len(block.terms))
        there[ids[ids >= 0]] = np.flatnonzero(ids >= 0)
        for size, (windows, bounds, owners) in self.by_size.items():
            for at in range(0, len(windows), WINDOWS):
                terms = there[windows[at : at + WINDOWS]]
                alive = np.flatnonzero((terms >= 0).all(1))
                if slop is None:
                    row, start = block.phrases(terms[alive])
                    yield size, start, at + alive[row], bounds, owners
                else:
                    for w in alive.tolist():
                        start = block.near(terms[w], size + slop)
                        yield size + slop, start, np.full(len(start), at + w), bounds, owners


def slices(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text", slice_words: int = SLICE_WORDS) -> Iterator[Phrases]:
    """The benchmark in slices of bounded volume; rows stream through, none is held twice."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        terms = words(text)
        if size and size + len(terms) > slice_words:
            yield Phrases(held, width)
            held, size = [], 0
        held.append((item, terms))
        size += len(terms)
    yield Phrases(held, width)


def _owned(phrases: Phrases, block: Block, slop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, starts of the occurrences, occurrence and item number of each pair of them)"""
    for size, start, window, bounds, owners in phrases.search(block, slop):
        n = bounds[window + 1] - bounds[window]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield size, start, np.repeat(np.arange(len(start)), n), owners[np.repeat(bounds[window], n) + inner]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in small(batches, 1):
        yield b.to_pylist()[0]


def _search(shipped):
    """Adds the occurrences of one slice to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontamination", dict)
        phrases: Phrases = shipped.value
        for row in _blocks(batches):
            block = Block(row)
            spans, owners = [np.frombuffer(row.get("spans") or b"", np.int32).reshape(-1, 2)], {(o["doc"], o["item"]) for o in row.get("owners") or ()}
            for size, start, occurrence, item in _owned(phrases, block):
                spans.append(np.column_stack([start, np.full(len(start), size)]).astype(np.int32))
                pairs = np.unique(np.column_stack([block.document(start[occurrence]), item]), axis=0)
                owners.update((d, phrases.names[i]) for d, i in pairs.tolist())
            hits = np.unique(np.concatenate(spans), axis=0)
            found = [pa.array([hits.tobytes()], pa.binary()), pa.array([[{"doc": d, "item": i} for d, i in owners]], pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.string())])))]
            kept = [pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(pa.array([row[c]], pa.binary()) for c in _NAMES[1:])]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*_NAMES, "spans", "owners"])

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up each document of the searched blocks."""
    nothing = hashlib.sha256(b"").hexdigest()
    for row in _blocks(batches):
        lengths = np.frombuffer(row["lengths"], np.int32)
        base = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        spans = np.frombuffer(row["spans"], np.int32).reshape(-1, 2).astype(np.int64)
        edge = np.bincount(spans[:, 0], minlength=base[-1] + 1) - np.bincount(spans.sum(1), minlength=base[-1] + 1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        hits = hit[base[1:]] - hit[base[:-1]]
        items: dict[int, list[str]] = {}
        for o in row["owners"]:
            items.setdefault(o["doc"], []).append(o["item"])
        digests = [hashlib.sha256(",".join(sorted(items[d])).encode("utf-8", "surrogatepass")).hexdigest() if d in items else nothing for d in range(len(lengths))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(lengths.astype(np.int64)),
                pa.array(hits.astype(np.int64)),
                pa.array([len(items.get(d, ())) for d in range(len(lengths))], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(hits > 0),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _summed(search):
    """The last slice's search and the sums in one step, so that a task needs one worker for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summary(search(batches))

    return run


def contamination(docs: DataFrame | None, benchmark: DataFrame, width: int = 10, slice_words: int = SLICE_WORDS, index: DataFrame | None = None) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, and the items hit.

    ``index`` is a stored ``positional_index``; without it, that of ``docs`` is made and stored.
    """
    rows = cut(positional_index(docs)) if index is None else index
    search = None
    for phrases in slices(benchmark, width, slice_words=slice_words):
        rows = rows if search is None else rows.mapInArrow(search, f"{INDEX}, {FOUND}")
        search = _search(benchmark.sparkSession.sparkContext.broadcast(phrases))
    return rows.mapInArrow(_summed(search), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def matches(docs: DataFrame | None, benchmark: DataFrame, width: int = 10, slop: int | None = None, slice_words: int = SLICE_WORDS, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, start, length): each occurrence of a window, word positions from 0.

    With ``slop``, proximity matches instead: starts from which width + slop words hold all
    words of the window, in any order.
    """

    def finder(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases: Phrases = shipped.value
            for row in _blocks(batches):
                block = Block(row)
                for size, start, occurrence, item in _owned(phrases, block, slop):
                    if len(occurrence):
                        document = block.document(start[occurrence])
                        names = pa.array([phrases.names[i] for i in item.tolist()], pa.string())
                        ids = pa.array([block.doc_ids[d] for d in document.tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, names, pa.array(start[occurrence] - block.base[document]), pa.array(np.full(len(item), size, np.int64))], names=["doc_id", "item_id", "start", "length"])

        return run

    rows = cut(positional_index(docs)) if index is None else index
    out = None
    for phrases in slices(benchmark, width, slice_words=slice_words):
        part = rows.mapInArrow(finder(benchmark.sparkSession.sparkContext.broadcast(phrases)), "doc_id long, item_id string, start long, length long")
        out = part if out is None else out.unionAll(part)
    return out
