"""A repetition log: per bucket at most ``keep`` decaying medoids, on one sequence clock over all buckets.

The clock counts accepted utterances of all buckets; a row of number ``seq`` is scored at
``seq - 1`` and observed at ``seq``.  Its cost is the likeness to the nearest live medoid (the
first of equals) times that medoid's decayed weight, between 0 and 1.  Only an exact repeat
strengthens a medoid: same items, weight decayed and one more.  Anything else becomes a medoid
of its own, and while there are too many the lightest, of equals the one seen earliest, goes.
Medoids under the floor are not scored against, but stay until ``swept``.

``replay`` runs over tables, ``score_stream`` over streams with ``transformWithState``, a list
state for each bucket; ``medoids`` and ``forked`` give the log itself, from either, to start another run from.

Defined cases: two empty item sets are equal; null items are empty; a null bucket is a bucket; rows of equal
``seq`` in a bucket follow their ids; a half-life of zero or less means no decay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "id long, bucket string, seq long, nearest double, weight double, cost double, repeated boolean, hits int, medoids int"
#: a medoid as a row: its place in the bucket's order, its items, undecayed weight, when it was seen last, how often
MEDOID = "place int, items array<string>, weight double, last_seen long, hits int"
LOG = f"bucket string, {MEDOID}"
#: the provider of state stores that list states need
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distance(a: frozenset, b: frozenset) -> float:
    return 1 - len(a & b) / len(a | b) if a or b else 0.0


def decayed(weight: float, last_seen: int, now: int, half_life: float) -> float:
    return weight if half_life <= 0 else weight * 0.5 ** ((now - last_seen) / half_life)


class Bucket:
    """Medoids as [items, weight, last seen, hits], in the order in which ties are broken."""

    def __init__(self, medoids: list | None = None):
        self.medoids = medoids or []

    def score(self, items: frozenset, now: int, half_life: float, floor: float) -> tuple[float | None, float | None, float]:
        """(distance of the nearest live medoid, its weight, cost)."""
        best = None
        for m in self.medoids:
            w = decayed(m[1], m[2], now, half_life)
            if w >= floor:
                d = distance(items, m[0])
                if best is None or d < best[0]:
                    best = d, w
        return (None, None, 0.0) if best is None else (*best, max(0.0, min(1.0, best[1] * (1 - best[0]))))

    def observe(self, items: frozenset, seq: int, keep: int, half_life: float) -> int:
        """Fold a row in; how often its medoid has been seen."""
        for m in self.medoids:
            if m[0] == items:
                m[1:] = decayed(m[1], m[2], seq, half_life) + 1.0, seq, m[3] + 1
                return m[3]
        self.medoids.append([items, 1.0, seq, 1])
        while len(self.medoids) > keep:
            self.medoids.sort(key=lambda m: (decayed(m[1], m[2], seq, half_life), m[2]))
            self.medoids.pop(0)
        return 1


def _rows(bucket: Bucket, rows: pd.DataFrame, keep: int, half_life: float, floor: float) -> pd.DataFrame:
    out = []
    for own, seq in zip(rows["items"], rows["seq"]):
        items = frozenset(own if own is not None else ())
        scored = bucket.score(items, seq - 1, half_life, floor)
        hits = bucket.observe(items, seq, keep, half_life)
        out.append((*scored, hits > 1, hits, len(bucket.medoids)))
    names = ["nearest", "weight", "cost", "repeated", "hits", "medoids"]
    scores = pd.DataFrame(out, columns=names, index=rows.index).astype({"nearest": "float64", "weight": "float64"})
    return pd.concat([rows[["id", "bucket", "seq"]], scores], axis=1)


def _replayed(df: DataFrame, start: DataFrame | None, run, schema: str) -> DataFrame:
    """Rows and the log that they start from, bucket by bucket, the log first, in sorted partitions."""
    rows = df.select("bucket", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("items").cast("array<string>").alias("items"), F.lit(0.0).alias("weight"), F.lit(0).alias("hits"))
    if start is not None:
        rows = rows.unionAll(start.select("bucket", F.lit(0), "place", F.lit(None).cast("long"), "last_seen", "items", "weight", "hits"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "place", "seq", "id").mapInPandas(run, schema)


def _by_bucket(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Bucket, pd.DataFrame, bool]]:
    """Key and bucket, with what a frame starts it from, its new rows, and whether the bucket is a new one."""
    key, bucket = object(), Bucket()
    for frame in frames:
        for k, part in frame.groupby("bucket", sort=False, dropna=False):
            k = None if pd.isna(k) else k
            fresh = k != key
            if fresh:
                key, bucket = k, Bucket()
            old = part[part["kind"] == 0]
            bucket.medoids += [[frozenset(i), w, s, h] for i, w, s, h in zip(old["items"], old["weight"], old["seq"], old["hits"])]
            yield key, bucket, part[part["kind"] == 1], fresh


def replay(df: DataFrame, keep: int = 8, half_life: float = 64.0, floor: float = 0.02, start: DataFrame | None = None) -> DataFrame:
    """Scores of rows (id, bucket, seq, items) in the order of the clock, from an empty log or from ``start``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, bucket, rows, _ in _by_bucket(frames):
            if len(rows):
                yield _rows(bucket, rows, keep, half_life, floor)

    return _replayed(df, start, run, OUT)


def medoids(df: DataFrame, keep: int = 8, half_life: float = 64.0, floor: float = 0.02, start: DataFrame | None = None) -> DataFrame:
    """The log (``LOG``) after all rows."""

    def log(key: str | None, bucket: Bucket) -> pd.DataFrame:
        return pd.DataFrame([(key, i, sorted(m[0]), m[1], m[2], m[3]) for i, m in enumerate(bucket.medoids)], columns=["bucket", "place", "items", "weight", "last_seen", "hits"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for key, bucket, rows, fresh in _by_bucket(frames):
            if fresh and held:
                yield log(*held)
            held = key, bucket
            for own, seq in zip(rows["items"], rows["seq"]):
                bucket.observe(frozenset(own if own is not None else ()), seq, keep, half_life)
        if held:
            yield log(*held)

    return _replayed(df, start, run, LOG)


def decayed_weight(now: Column | int, half_life: float = 64.0) -> Column:
    """A medoid's weight at a time of the clock."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.col("weight") if half_life <= 0 else F.col("weight") * F.pow(F.lit(0.5), (now - F.col("last_seen")) / F.lit(half_life))


def swept(log: DataFrame, now: Column | int, half_life: float = 64.0, floor: float = 0.02) -> DataFrame:
    """The log without medoids under the floor at that time."""
    return log.filter(decayed_weight(now, half_life) >= floor)


class Processor(StatefulProcessor):
    """The same rule as a stateful processor: a list state of medoids for each bucket."""

    def __init__(self, keep: int, half_life: float, floor: float):
        self.options = dict(keep=keep, half_life=half_life, floor=floor)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("medoids", MEDOID)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("place")
        self._put([[frozenset(i), w, s, h] for i, w, s, h in zip(rows["items"], rows["weight"], rows["last_seen"], rows["hits"])])

    def _put(self, medoids: list) -> None:
        self.state.put([(i, sorted(m[0]), float(m[1]), int(m[2]), int(m[3])) for i, m in enumerate(medoids)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [[frozenset(m[1]), *m[2:]] for m in self.state.get()] if self.state.exists() else []
        bucket = Bucket(held)
        out = _rows(bucket, pd.concat(list(rows)).sort_values(["seq", "id"]), **self.options)
        self._put(bucket.medoids)
        yield out

    def close(self) -> None:
        pass


def score_stream(df: DataFrame, keep: int = 8, half_life: float = 64.0, floor: float = 0.02, start: DataFrame | None = None) -> DataFrame:
    """``replay`` over a streaming frame whose batches arrive in the order of the clock; ``start`` is a log to start from.

    The session must name ``PROVIDER`` in spark.sql.streaming.stateStore.providerClass.
    """
    initial = start.groupBy("bucket") if start is not None else None
    return df.select("id", "bucket", "seq", "items").groupBy("bucket").transformWithStateInPandas(Processor(keep, half_life, floor), OUT, "Append", "None", initialState=initial)


def forked(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The log (``LOG``) that a stream left in its checkpoint: a copy to start other runs from, the original untouched."""
    kept = spark.read.format("statestore").option("stateVarName", "medoids").load(checkpoint)
    element = next(c for c in kept.columns if c in ("list_element", "value"))
    return kept.select("key.bucket", F.col(element).alias("m")).select("bucket", "m.*")
