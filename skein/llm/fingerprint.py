"""Exact fingerprints of canonical texts.

Canonical form: Unicode NFKC, case folded, NFKC again, runs of white space as one space,
trimmed.  The fingerprint is the 128-bit xxHash of its UTF-8 bytes.  ``exact_groups`` groups by
fingerprint and compares the canonical bytes themselves inside every bucket of more than
one row, so even a collision cannot join different texts.

Defined cases: a null text is empty; repeated rows are repeated; the rows of ``edited`` are
ordered by (doc_id, hash of the text, text), null ids first, so rows of one id lie in a defined order;
a single row is followed by itself; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, sized, small


def canonical(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        forms = [canonical(t).encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        packed = [zstandard.compress(f, 1) for f in forms]  # equal bytes stay equal, different ones different
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_hexdigest(f) for f in forms], pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "fingerprint", "form"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_canonical_rows, "doc_id long, fingerprint string, form binary").drop("form")


def exact_groups(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, group_id, copies): group_id is the smallest doc_id of equal canonical texts.

    Only texts of buckets of several rows are compared; equal ones meet on the map side first.
    ``known`` gives the (doc_id, fingerprint) rows of ``docs`` where they are stored already.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = cut(fingerprints(docs)) if known is None else known
    several = cut(narrow.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"))
    bucket = sized(several)
    suspects = narrow.join(bucket, "fingerprint", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    suspects = sized(cut(suspects))
    compared = texts.join(suspects, texts.doc_id.eqNullSafe(suspects.id), "left_semi").mapInArrow(_canonical_rows, "doc_id long, fingerprint string, form binary")
    groups = cut(compared.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")))
    alike = groups.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.first("group_id").alias("group_id"), F.first("copies").alias("copies"))
    # a bucket of one form is settled by its fingerprint; different forms in a bucket are told apart by their bytes
    settled = narrow.join(bucket, "fingerprint", "left_semi").join(alike.filter("forms = 1").drop("forms"), "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")
    clashes = groups.join(alike.filter("forms > 1").select("fingerprint"), "fingerprint", "left_semi")
    told = compared.join(clashes, ["fingerprint", "form"]).select("doc_id", "fingerprint", "group_id", "copies")
    alone = narrow.join(bucket, "fingerprint", "left_anti").select("doc_id", "fingerprint", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies"))
    return settled.unionByName(told).unionByName(alone)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


_EDGE = "part int, first_text string, last_id long, last_text string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_EDGE_KINDS = [pa.int32(), pa.string(), pa.int64(), pa.string()]


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)]


def compare(doc_id: int | None, text: str, following: str) -> tuple:
    """One row of ``edited``: the text, and the text whose last quarter the next text replaces."""
    cut = len(text) // 4
    changed = text[: len(text) - cut] + following[:cut]
    own, other, after = fingerprint(text), fingerprint(changed), fingerprint(following)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, float(own == other), float(own == after)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition the results of all rows but the last, and one row with its two ends."""
    names = [*_NAMES, *(c.split()[0] for c in _EDGE.split(", "))]
    part = first = held = None
    for b in small(batches):
        rows = []
        for number, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
            if held is None:
                part, first = number, text or ""
            else:
                rows.append(compare(held[0], held[1], text or ""))
            held = doc_id, text or ""
        yield pa.RecordBatch.from_arrays([*_columns(rows, _KINDS), *(pa.nulls(len(rows), k) for k in _EDGE_KINDS)], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in _KINDS), *_columns([(part, first, *held)], _EDGE_KINDS)], names=names)


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(_columns([compare(d, t or "", f or "") for d, t, f in zip(*(c.to_pylist() for c in b.columns))], _KINDS), names=_NAMES)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to it and to the next document.

    Texts are range-partitioned and sorted once, and read once: the same pass writes the results
    of neighbours within a partition and the partition's two ends to the checkpoint folder.  A
    partition's last row then meets the first row of the next partition that has rows in a small
    join of one row for each partition, so nothing depends on how often Spark runs the sort.
    """
    parts = shuffle_parts(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    sorted_ = texts.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    done = cut(sorted_.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_within, f"{_OUT}, {_EDGE}"))
    edges = done.filter("part is not null").select("part", "first_text", "last_id", "last_text")
    # one narrow row for each partition: which partition comes next, the first one after the last
    places = edges.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    first = edges.select(F.col("part").alias("to"), F.col("first_text").alias("following"))
    bridged = edges.select("part", "last_id", "last_text").join(places, "part").join(first, "to").select("last_id", "last_text", "following").mapInArrow(_bridge, _OUT)
    return done.filter("part is null").select(*_NAMES).unionAll(bridged)
