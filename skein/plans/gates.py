"""Refusals, item digests and guarded comparisons.

A gate is an action: it computes, and raises ``Refusal`` where a comparison is not valid,
rather than return an empty or a guessed result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refusal(ValueError):
    """A comparison or publication that its preconditions do not allow."""


def digest(df: DataFrame, key: str, by: list[str] = []) -> DataFrame:
    """(.., n, n_distinct, digest): order-free digest of the item keys of each group.

    Keys are hashed row by row and the hashes are summed, so a group of any size is one
    partial sum for each task.
    """
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct"), F.sum(h).cast("string").alias("digest"))


@dataclass(frozen=True)
class Measurement:
    name: str
    value: float | None
    n: int
    digest: str
    facets: tuple[tuple[str, str], ...] = ()


def measure(df: DataFrame, name: str, key: str, value: Column, **facets: str) -> Measurement:
    """An aggregate over the items of ``df``; refuses empty or repeated items."""
    d = digest(df, key).first()
    if not d.n or d.n != d.n_distinct:
        raise Refusal(f"{name}: {d.n} items, {d.n_distinct} distinct")
    return Measurement(name, df.agg(value).first()[0], d.n, d.digest, tuple(sorted(facets.items())))


def delta(a: Measurement, b: Measurement, contrast: str) -> float:
    """b - a, if both cover the same items and differ in the one facet ``contrast``."""
    x, y = dict(a.facets), dict(b.facets)
    differing = {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    if (a.n, a.digest) != (b.n, b.digest):
        raise Refusal("the item sets differ")
    if differing != {contrast}:
        raise Refusal(f"facets that differ: {sorted(differing)}, expected only {contrast}")
    if a.value is None or b.value is None:
        raise Refusal("a value is missing")
    return b.value - a.value


def paired(a: DataFrame, b: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, a, b) outcomes of the same items; refuses unequal item sets."""
    left, right = a.select(key, F.col(outcome).alias("a")), b.select(key, F.col(outcome).alias("b"))
    if left.join(right, key, "full_outer").filter("a is null or b is null").limit(1).count():
        raise Refusal("the item sets differ")
    return left.join(right, key)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(violation, n): how many rows break each constraint; unknown (null) is no violation."""
    row = df.agg(*(F.count_if(~c).alias(n) for n, c in checks.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in checks)))).select("col.*")


def require_none(found: DataFrame) -> None:
    bad = {r.violation: r.n for r in found.filter("n > 0").collect()}
    if bad:
        raise Refusal(f"constraints broken: {bad}")


def shares(df: DataFrame, kind: str, expected: list[str]) -> DataFrame:
    """(kind, n, share) of every expected kind, zero where it is missing."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in expected], f"{kind} string")
    n = df.groupBy(kind).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return wanted.join(F.broadcast(n), kind, "left").crossJoin(total).select(kind, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("share"))
