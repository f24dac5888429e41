"""Shared pieces of the corpus operators: checkpoints, packed exchanges, components.

Rows that would be one (key, id) pair each travel as packed arrays: a task gathers a few
million pairs, deals them by key into ``parts`` slices and emits one row per slice.  Spark
shuffles those rows by slice number, and numpy reads each slice back.  The pairs, their
placement and the grouping are those of an ordinary shuffle; only the row overhead goes.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: pairs gathered by a task before it emits its slices
FLUSH = 750_000
#: entries of a per-worker memo before it starts afresh (about 15 MB)
MEMO = 100_000
#: rows of a batch that are turned into Python objects at once
SMALL = 512


def shuffle_parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_checkpoints(spark: SparkSession) -> None:
    """Use the session's shared folder for checkpoints."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a single local JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="skein-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of a table of a few numbers each that may be broadcast; beyond it Spark joins by shuffle
BROADCAST_ROWS = 400_000


def sized(df: DataFrame) -> DataFrame:
    """Mark a materialised narrow table for broadcast if a count shows that it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: bits of an id filter for each id and probes of an id (one of 400 other ids passes), and the 64-bit words of a filter at most (16 MB; fuller ones pass more)
FILTER_BITS = 16
FILTER_PROBES = 4
FILTER_WORDS = 1 << 21


def _places(value: F.Column, words: int) -> list[F.Column]:
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(64 * words)) for i in range(FILTER_PROBES)]


def id_filter(ids: DataFrame, name: str, words: int, bits: str) -> DataFrame:
    """One row: a Bloom filter of the column ``name`` as an array ``bits`` of ``words`` 64-bit words."""
    at = ids.select(F.explode(F.array(*_places(F.col(name), words))).alias("at"))
    ones = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")).alias("bit"))
    none = ids.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    filled = ones.unionAll(none).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias(bits))


def narrow_join(wide: DataFrame, narrow: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """``wide`` joined with a materialised narrow table on wide.left = narrow.right, ``how`` being inner, left, left_semi or left_anti.

    A small table is broadcast.  Of a larger one a filter of its ids is, and only the wide rows that
    pass it are shuffled; the others, which surely meet nothing, are left where they are.  Unless
    ``how`` is inner or left_semi, ``wide`` is read twice then.
    """
    rows = narrow.count()
    on = wide[left] == narrow[right]
    if rows <= BROADCAST_ROWS:
        return wide.join(F.broadcast(narrow), on, how)
    words = min(-(-rows * FILTER_BITS // 64), FILTER_WORDS)
    bits = free_name("bits", wide.columns)
    marks = cut(id_filter(narrow, right, words, bits))
    may = reduce(lambda x, y: x & y, (F.getbit(marks[bits][F.shiftright(at, 6)], at.bitwiseAND(63).cast("int")) == 1 for at in _places(wide[left], words)))
    met = wide.join(F.broadcast(marks), may, "left_semi").join(narrow, on, how)
    if how in ("inner", "left_semi"):
        return met
    rest = wide.join(F.broadcast(marks), may, "left_anti")
    return met.unionAll(rest if how == "left_anti" else rest.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in narrow.schema)))


#: narrow rows that are worth a task of their own
ROWS_A_TASK = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows in no more tasks than they are worth: without a shuffle, and untouched where they are many."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def free_name(stem: str, columns: list[str]) -> str:
    """``stem`` with as many underscores behind it as tell it from all ``columns``."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small(batches: Iterator[pa.RecordBatch], rows: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of ``rows`` at most, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def by_volume(batches: Iterator[pa.RecordBatch], column: int, volume: int, rows: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``volume`` bytes of the column and ``rows`` rows, or one row where it is larger."""
    for b in small(batches, rows):
        sizes = b.column(column).cast(pa.large_binary() if pa.types.is_large_string(b.column(column).type) else pa.binary())
        ends = np.cumsum(np.nan_to_num(np.array(pc.binary_length(sizes).fill_null(0))))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + volume, side="right")))
            yield b.slice(at, stop - at)
            at = stop


#: what a Python worker keeps between tasks: the state of one operator at a time
_STATE: dict[str, object] = {}


def worker_state(name: str, make: Callable[[], object]) -> object:
    """The worker's state of that name, made anew if another operator ran last.

    Freed blocks go back to the system at once, so idle workers do not hold what they once used.
    """
    if name not in _STATE:
        _STATE.clear()
        pa.default_memory_pool().release_unused()
        try:  # options -1 and -3 of the C library: thresholds of trimming and of mapped blocks
            libc = ctypes.CDLL(None)
            libc.mallopt(-1, 1 << 20)
            libc.mallopt(-3, 1 << 20)
            libc.malloc_trim(0)
        except (OSError, AttributeError):
            pass
        _STATE[name] = make()
    return _STATE[name]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered within a worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    """The worker's memo, kept for its next tasks of the same kind."""
    return worker_state("word hashes", WordHashes)


def slices_for(texts: DataFrame, text: str = "text", chars: int = 4_000_000) -> int:
    """Slices of a packed exchange: four for each shuffle partition, more if ``texts`` holds over ``chars`` characters for each."""
    volume = texts.agg(F.sum(F.length(text))).first()[0] or 0
    return max(4 * shuffle_parts(texts.sparkSession), -(-volume // chars))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binary_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``data`` cut into binary values of ``counts`` items each, without copies."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * data.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Packer:
    """Gathers aligned arrays and emits them dealt by key into ``parts`` slices."""

    def __init__(self, parts: int, names: list[str]):
        self.parts, self.names = parts, names
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.held.append(arrays)
        self.size += len(arrays[0])
        return self.size >= FLUSH

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        part = ((columns[0] >> np.uint64(20)) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=self.parts)
        used = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(binary_column(c[order], counts[used]) for c in columns)],
            names=["part", *self.names],
        )


    def table(self) -> pa.Table:
        batch = self.flush()
        schema = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in self.names)])
        return schema.empty_table() if batch is None else pa.Table.from_batches([batch])


def packed_schema(names: list[str]) -> str:
    return "part int, " + ", ".join(f"{n} binary" for n in names)


def unpack(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, component = smallest node).

    Alternates large-star and small-star steps; each step is a grouped minimum and an
    equi-join, so a node of many links is pre-aggregated on the map side and its join
    partition can be split.  Every round is checkpointed, in as many tasks as its
    links are worth, and nothing but two numbers (count and checksum of the links) comes to the driver.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    last = None
    while True:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == last or row.n == 0:
            break
        last = (row.n, row.s)
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = few(e, row.n).select(F.inline(ends))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), row.n)
        large = few(both.filter("v > u").join(least, "u"), row.n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = few(large.distinct(), row.n)
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), row.n)
        small = few(large.join(least, "u"), row.n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = cut(few(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), row.n))
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of labelled rows: the first by a hash of the id, ``rows`` of them and ``chars`` characters at most.

    Labels and lengths of the first rows come to the driver before any text does; a text that
    does not fit into what is left of ``chars`` is passed over.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    first = known.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")
    chosen = texts.join(F.broadcast(first), "id")
    sizes = chosen.select("id", "hash", "n").distinct().orderBy(F.xxhash64("id"), "id", "hash").limit(rows).collect()
    taken, left = [], chars
    for r in sizes:
        if r.n <= left:
            left -= r.n
            taken.append((r.id, r.hash))
    if not taken:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, "id long, hash long"))
    return sorted((r[0], r[1] or "", r[2]) for r in chosen.join(wanted, ["id", "hash"]).dropDuplicates(["id", "hash", "y"]).select("id", "text", "y").collect())
