"""Line dedup by a segment-partition edit join.

Lines are the pieces of a text between newlines, stripped.  Two lines are linked when they
are equal, or when their edit distance (insert, delete, replace of code points) is at most
``edits`` and at most a tenth of the longer line.  Lines shorter than ``shortest`` code points
are linked only if they are equal and of ``equal_from`` code points at least (``shortest``, if
it is not given); empty lines are never linked.  ``dedup_lines`` leaves short lines in the
texts.  The first line of a component, by (doc_id, line number), is kept.

1. Equal lines meet by a 128-bit hash in a grouped minimum, pre-aggregated on the map side.
2. Every line is cut into ``edits + 1`` even segments and files each under (length, segment
   number, segment).  It probes, for its own and the ``edits`` shorter lengths, the substrings
   that can still line up with a segment (the multi-match-aware window).  A pair within
   the distance shares at least one segment, so no link is missed.  An entry also carries the
   parities of the line's letter pairs in 32 cells; an edit changes at most four of them, so
   pairs that differ in more than 4 * ``edits`` cells are ruled out where they meet.
   Entries of a key that more than ``CROWD`` different lines share are dealt into chunks, and
   each pair of chunks meets in a task of its own.
3. Candidate pairs are verified by a banded bit-parallel edit distance on the whole lines.
4. Components of the links give each line its class.

Candidates are named by 63 bits of their hash; verified links, and the classes, by all 128.

Defined cases: a null text has no lines; an empty text has one empty line; rows that repeat
doc_id and text repeat their result; a null doc_id counts as the smallest.  Only ``doc_id``
and ``text`` are read by the join; ``dedup_lines`` passes all other columns on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packer, components, cut, free_name, packed_schema, sized, slices_for, small, unpack

#: ids of candidate lines that may be shipped to all tasks (8 bytes each); beyond it they are joined
SHIPPED_IDS = 1_000_000
#: different lines of one segment key that one task compares; a key of more is dealt into chunks of as many
CROWD = 4_096
#: lines a task remembers so as not to file a repeated line again
SEEN = 150_000


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else [line.strip() for line in text.split("\n")]


def line_hash(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_WORD = (1 << 64) - 1


def edit_distance_within(s: str, t: str, limit: int) -> bool:
    """Whether the edit distance of s and t is at most ``limit`` (at most 31).

    A banded bit-parallel computation: the diagonals around the main one are the bits of one
    64-bit word, which slides down the matrix as the columns advance.
    """
    if len(s) < len(t):
        s, t = t, s
    if len(s) - len(t) > limit:
        return False
    if s == t:
        return True
    head = _common(s, t, len(t))
    tail = _common(s[::-1], t[::-1], len(t) - head)
    s, t = s[head : len(s) - tail], t[head : len(t) - tail]
    if len(s) <= limit:
        return True
    if len(t) <= limit:
        return _full_distance(s, t) <= limit
    places: dict[str, int] = {}
    for i, c in enumerate(s):
        places[c] = places.get(c, 0) | 1 << i
    up, down = _WORD << (63 - limit) & _WORD, 0
    distance, worst = limit, 2 * limit + len(t) - len(s)
    edge, diagonal = 1 << 62, 1 << 63
    for j, c in enumerate(t):
        shift = limit - 63 + j
        match = places.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & _WORD
        zero = ((((match & up) + up) ^ up) | match | down) & _WORD
        right_up = (down | ~(zero | up)) & _WORD
        right_down = zero & up
        if j < len(s) - limit:
            distance += not zero & diagonal
        else:
            distance += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        if distance > worst:
            return False
        up = (right_down | ~(zero >> 1 | right_up)) & _WORD
        down = zero >> 1 & right_up
    return distance <= limit


def _common(s: str, t: str, most: int) -> int:
    """Length of the common prefix, at most ``most``: doubling strides, then bisection."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if s[low:mid] == t[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _full_distance(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments; the last ones are longer by one."""
    short, longer = divmod(length, edits + 1)
    sizes = [short + (i > edits - longer) for i in range(edits + 1)]
    return [(sum(sizes[:i]), z) for i, z in enumerate(sizes)]


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, size) of the substrings to probe with."""
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        extra = length - other
        for i, (start, size) in enumerate(segments(other, edits)):
            low = max(0, start - i, start + extra - (edits - i))
            high = min(length - size, start + i, start + extra + (edits - i))
            out += [(other, i, at, size) for at in range(low, high + 1)]
    return out


def _may_link(length: int, edits: int) -> int:
    return min(edits, length // 10)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) -> a row for each line"""
    for b in small(batches):
        rows = []
        for doc_id, row, text in zip(*(c.to_pylist() for c in b.columns)):
            rows += [(doc_id, row, n, len(line), *line_hash(line)) for n, line in enumerate(lines_of(text))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
            names=["doc_id", "row", "line_no", "n_chars", "a", "b"],
        )


_CELLS = 2 ** np.arange(32, dtype=np.int64)


def pair_parities(raw: bytes) -> int:
    """Parities, in 32 cells, of how often the pairs of neighbouring code points occur."""
    points = np.frombuffer(raw, np.uint32)
    cells = ((points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(27)
    return int((np.bincount(cells, minlength=32) & 1) @ _CELLS)


def _keys(edits: int, shortest: int, parts: int):
    """(text) -> the segment index and its probes, packed by key; bit 0 of an id tells a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, plans, seen = Packer(parts, ["key", "id", "cells"]), {}, {}
        file = xxhash.xxh3_64_intdigest

        def plan(length: int):
            own = [(4 * at, 4 * (at + size), (length << 6) + i) for i, (at, size) in enumerate(segments(length, edits))]
            ask = [(4 * at, 4 * (at + size), (other << 6) + i) for other, i, at, size in probes(length, edits)]
            return own + ask, np.array([0] * len(own) + [1] * len(ask), np.int64)

        for b in small(batches):
            for text in b.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) < shortest or not _may_link(len(line), edits):
                        continue
                    a, more = line_hash(line)
                    if seen.get(a) == more:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen[a] = more
                    if len(line) not in plans:
                        if len(plans) > 5_000:
                            plans.clear()
                        plans[len(line)] = plan(len(line))
                    cuts, role = plans[len(line)]
                    raw = line.encode("utf-32-le", "surrogatepass")
                    key = np.fromiter((file(raw[x:y], seed) for x, y, seed in cuts), np.uint64, len(cuts))
                    if packer.add(key, (np.full(len(cuts), a, np.int64) & ~1) | role, np.full(len(cuts), pair_parities(raw), np.uint32)):
                        yield packer.flush()
        if (x := packer.flush()) is not None:
            yield x

    return run


def _candidates(edits: int, crowd: int):
    def run(table: pa.Table) -> pa.Table:
        return _meetings(table, 4 * edits, crowd)

    return run


def _meetings(table: pa.Table, most: int, crowd: int) -> pa.Table:
    """Distinct pairs of lines of which one probes what the other has filed, alike in all but ``most`` cells.

    Lines of a key that more than ``crowd`` share are given back with their role, key and cells instead.
    """
    key, ident, cells = unpack(table, "key", np.uint64), unpack(table, "id", np.int64), unpack(table, "cells", np.uint32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    key, ident, cells = unpack(table, "key", np.uint64)[order], ident[order], cells[order]
    order = np.lexsort((ident, key))
    key, ident, cells = key[order], ident[order], cells[order]
    line, role = ident & ~1, 1 << (ident & 1)
    found: list[np.ndarray] = []
    crowded = np.zeros(0, np.int64)
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])]))
        role = np.bitwise_or.reduceat(role, first)
        key, line, cells = key[first], line[first], cells[first]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        ends = np.repeat(starts + sizes, sizes)
        many = np.repeat(sizes > crowd, sizes)
        crowded = np.flatnonzero(many)
        at, step, held = np.flatnonzero(~many), 1, 0
        while len(at := at[at + step < ends[at]]):
            to = at + step
            meet = ((role[at] | role[to]) == 3) & (np.bitwise_count(cells[at] ^ cells[to]) <= most)
            found.append(np.stack([line[at[meet]], line[to[meet]]], 1))
            held += len(found[-1])
            if held > 4_000_000:
                found, held = [_distinct(found)], 0
            step += 1
    pairs = _distinct(found)
    return pa.table(
        {
            "a": np.concatenate([pairs[:, 0], line[crowded]]),
            "b": np.concatenate([pairs[:, 1], role[crowded]]),
            "key": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[crowded].view(np.int64))]),
            "cells": np.concatenate([np.zeros(len(pairs), np.int64), cells[crowded].astype(np.int64)]),
        }
    )


def _across(most: int):
    """(line, role, cells, chunk) of two chunks of one key -> the pairs that meet between them; of one chunk, within it"""

    def run(table: pa.Table) -> pa.Table:
        line, role, cells, chunk = (table.column(c).to_numpy() for c in ("line", "role", "cells", "chunk"))
        left = np.flatnonzero(chunk == chunk.min())
        right = np.flatnonzero(chunk != chunk.min())
        within = table.column("i")[0] == table.column("j")[0]
        found = []
        for n, x in enumerate(left):
            to = left[n + 1 :] if within else right
            to = to[((role[x] | role[to]) == 3) & (np.bitwise_count(cells[x] ^ cells[to]) <= most)]
            found.append(np.stack([np.minimum(line[x], line[to]), np.maximum(line[x], line[to])], 1))
        pairs = _distinct(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _crowded_pairs(met: DataFrame, edits: int) -> DataFrame:
    """(a, b) of the crowded keys: each line goes to every pair of chunks that holds its own."""
    crowds = met.filter("key is not null").select("key", F.col("a").alias("line"), F.col("b").alias("role"), "cells")
    chunks = cut(crowds.groupBy("key").agg(F.ceil(F.count("*") / CROWD).alias("chunks")))
    dealt = crowds.join(sized(chunks), "key").withColumn("chunk", F.pmod(F.xxhash64("line"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "line", "role", "cells", "chunk")
    return dealt.groupBy("key", "i", "j").applyInArrow(_across(4 * edits), "a long, b long")


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs


def _texts(edits: int, shortest: int, wanted: np.ndarray | None):
    """(text) -> (id, h, g, line) of the wanted lines, or of all that may be linked; (h, g) is the whole hash"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = {}
            for text in b.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) >= shortest and _may_link(len(line), edits):
                        rows[line_hash(line)] = line
            whole = np.array(list(rows), np.int64).reshape(-1, 2)
            keep = np.ones(len(whole), bool)
            if wanted is not None:
                ids = whole[:, 0] & ~1
                keep = wanted[np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)] == ids if len(wanted) else ~keep
            whole = whole[keep]
            lines = pa.array([rows[h, g] for h, g in whole.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(whole[:, 0] & ~1), pa.array(whole[:, 0]), pa.array(whole[:, 1]), lines], names=["id", "h", "g", "line"])

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [edit_distance_within(s, t, _may_link(max(len(s), len(t)), edits)) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield b.select(["h", "g", "h2", "g2"]).filter(pa.array(keep, pa.bool_()))

    return run


def line_links(docs: DataFrame, edits: int = 2, shortest: int = 10) -> DataFrame:
    """(h, g, h2, g2): the 128-bit hashes of different lines within the distance, each pair once."""
    texts = docs.select("text").filter("text is not null")
    parts = slices_for(texts)
    packed = texts.mapInArrow(_keys(edits, shortest, parts), packed_schema(["key", "id", "cells"]))
    met = cut(packed.groupBy("part").applyInArrow(_candidates(edits, CROWD), "a long, b long, key long, cells long"))
    pairs = met.filter("key is null").select("a", "b")
    if not met.filter("key is not null").isEmpty():
        pairs = pairs.unionAll(_crowded_pairs(met, edits))
    pairs = cut(pairs.distinct())
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    few = ids.limit(SHIPPED_IDS + 1).toPandas().id.to_numpy(np.int64)
    if len(few) <= SHIPPED_IDS:
        lines = texts.mapInArrow(_texts(edits, shortest, np.sort(few)), "id long, h long, g long, line string")
    else:
        lines = texts.mapInArrow(_texts(edits, shortest, None), "id long, h long, g long, line string").join(ids, "id", "left_semi")
    lines = lines.dropDuplicates(["id", "h", "g"])
    left = lines.select(F.col("id").alias("a"), "h", "g", F.col("line").alias("s"))
    right = lines.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("t"))
    both = pairs.join(left, "a").join(right, "b").select("s", "t", "h", "g", "h2", "g2")
    return both.mapInArrow(_verify(edits), "h long, g long, h2 long, g2 long")


def _linked(links: DataFrame) -> DataFrame:
    """(a, b, component) of every line that has a link, by its whole hash: lines are numbered, so that none shares a number."""
    links = cut(links)
    ends = links.select(F.col("h").alias("a"), F.col("g").alias("b")).unionAll(links.select(F.col("h2").alias("a"), F.col("g2").alias("b"))).distinct()
    numbers = cut(ends.withColumn("node", F.monotonically_increasing_id()))
    one = numbers.toDF("h", "g", "one")
    two = numbers.toDF("h2", "g2", "two")
    edges = links.join(one, ["h", "g"]).join(two, ["h2", "g2"]).select(F.col("one").alias("a"), F.col("two").alias("b"))
    return numbers.join(components(edges), "node").select("a", "b", "component")


def _row(docs: DataFrame) -> F.Column:
    """Tells rows of one doc_id and different texts apart."""
    return F.xxhash64(F.col("text"))


def line_classes(docs: DataFrame, edits: int = 2, shortest: int = 10, equal_from: int | None = None) -> DataFrame:
    """(doc_id, line_no, n_chars, class_doc_id, class_line_no, duplicate) of every line."""
    return _classes(docs, edits, shortest, shortest if equal_from is None else equal_from).drop("row")


def _classes(docs: DataFrame, edits: int, shortest: int, equal_from: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("row"), F.col("text"))
    lines = cut(rows.mapInArrow(_hashes, "doc_id long, row long, line_no int, n_chars int, a long, b long"))
    place = F.struct("doc_id", "line_no", "row")
    own = lines.filter(F.col("n_chars") >= max(1, equal_from)).groupBy("a", "b").agg(F.min(place).alias("first"))
    known = own.join(_linked(line_links(docs, edits, shortest)), ["a", "b"], "left")
    heads = known.filter("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    classes = known.join(heads, "component", "left").select("a", "b", F.coalesce("head", "first").alias("head"))
    here = F.struct("doc_id", "line_no", "row")
    head = F.coalesce(F.when(F.col("n_chars") >= max(1, equal_from), F.col("head")), here)
    return (
        lines.join(classes, ["a", "b"], "left")
        .withColumn("head", head)
        .select("doc_id", "row", "line_no", "n_chars", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), (~F.col("head").eqNullSafe(here)).alias("duplicate"))
    )


def dedup_lines(docs: DataFrame, edits: int = 2, shortest: int = 10) -> DataFrame:
    """``docs`` without duplicate lines; a document of which no line is left goes.

    Lines under ``shortest`` code points stay, equal or not.
    A document without duplicate lines keeps its text as it was; so do null texts.
    """
    doc, row, gone_, left = (free_name(c, docs.columns) for c in ("doc", "row", "gone", "left"))
    gone = _classes(docs, edits, shortest, shortest).filter("duplicate").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone_))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_row(docs) == F.col(row)), "left")
    pieces = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(F.transform(pieces, lambda x, i: F.when(~F.array_contains(gone_, i), x)), lambda x: x.isNotNull()), "\n")
    out = joined.withColumn(left, F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept))
    out = out.filter(F.col(gone_).isNull() | (F.trim(left) != ""))
    return out.select([F.col(left).alias(c) if c == "text" else F.col(c) for c in docs.columns])
