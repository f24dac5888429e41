"""Choosing whole items up to a budget of rows, in a seeded order, from one pool or from two mixed to a dose.

The rule is greedy and sequential: an item that still fits is taken, one that would overshoot is
skipped, never cut, and a later smaller one may close the gap.  It is computed by prefix sums:
everything before the first overshoot is taken at once, and from there on only items within what
is left matter, so the next pass sums those alone.  Each pass lowers the largest size that can still fit, so there are
as many passes as there are sizes at most, and a handful in practice; a pass returns a few numbers to the driver.

Two pools are mixed item by item: the next one comes from the first pool while its rows are below ``dose`` of
all rows and one more.  Before an overshoot that is a merge: an item of the first pool, with A of the pool's rows before it, goes ahead of an
item of the second, with B before it, if A (1 - dose) < dose (B + 1).  So each pass is two prefix sums and a sort by that key.

Defined cases: null sizes and sizes under one are refused; ties of the order follow the id; a budget of zero takes nothing; without items nothing is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.gates import Refusal

#: rows of a range of a prefix sum
RANGE = 1_000_000


def seeded(key: str | Column, seed: int) -> Column:
    """A number under 2^48 by the md5 of seed and key: the order of a seeded shuffle."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key) if isinstance(key, str) else key)), 1, 12), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: str, tie: str, value: str, by: list[str] = [], name: str = "before", rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of ``by`` that come earlier by a numeric ``order`` and then ``tie``.

    Rows are dealt to ranges by approximate quantiles of the order and summed within them; the totals of earlier ranges, one row
    for each range and group, are joined.
    """
    ranges = max(1, -(-df.count() // (rows or RANGE)))
    bounds = sorted({b for b in df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)}) if ranges > 1 else []
    dealt = df.withColumn("_range", F.expr(f"aggregate(array({', '.join(f'{float(b)!r}D' for b in bounds)}), 0, (n, b) -> n + if({order} > b, 1, 0))") if bounds else F.lit(0))
    earlier = lambda *cs: Window.partitionBy(*cs).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(F.sum(value).alias("_total"))
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_total").over(earlier(*by).orderBy("_range")), F.lit(0)).alias("_offset"))
    within = F.coalesce(F.sum(value).over(earlier(*by, "_range").orderBy(order, tie)), F.lit(0))
    return dealt.withColumn(name, within).join(F.broadcast(offsets), [*by, "_range"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")


def _checked(items: DataFrame, id_: str, size: str, seed: int) -> DataFrame:
    if items.filter(F.col(size).isNull() | (F.col(size) < 1)).limit(1).count():
        raise Refusal("sizes must be one or more")
    return items.withColumn("_o", seeded(F.col(id_).cast("string"), seed)).withColumn("_n", F.col(size).cast("long")).withColumn("_id", F.col(id_))


def _beyond(o: int | None, i) -> Column:
    """Whether an item comes after a place of the order."""
    return F.lit(True) if o is None else (F.col("_o") > o) | ((F.col("_o") == o) & (F.col("_id") > i))


def take(items: DataFrame, id_: str, size: str, budget: int, seed: int = 0) -> DataFrame:
    """The items of the greedy choice."""
    df = _checked(items, id_, size, seed)
    kept, left, at = [], budget, (None, None)
    while left > 0:
        rest = df.filter(_beyond(*at) & (F.col("_n") <= left)).select("_id", "_o", "_n")
        summed = prefix_sums(rest, "_o", "_id", "_n")
        over = F.col("before") + F.col("_n") > left
        row = summed.agg(F.min(F.when(over, F.struct("_o", "_id", "before"))).alias("first")).first()
        within = _beyond(*at) & (F.col("_n") <= left)
        if row.first is None:
            kept.append(within)
            break
        o, i, used = row.first
        kept.append(within & ((F.col("_o") < o) | ((F.col("_o") == o) & (F.col("_id") < i))))
        left, at = left - used, (o, i)
    chosen = reduce(Column.__or__, kept, F.lit(False))
    return df.filter(chosen).drop("_o", "_n", "_id")


def mix(items: DataFrame, id_: str, size: str, first: Column, budget: int, dose: float, seed: int = 0) -> DataFrame:
    """The items of the greedy choice from two pools, ``first`` telling them apart, mixed to ``dose`` of the first."""
    df = _checked(items, id_, size, seed).withColumn("_first", first)
    kept, left, got, at = [], budget, {True: 0, False: 0}, {True: (None, None), False: (None, None)}
    while left > 0:
        within = F.when(F.col("_first"), _beyond(*at[True])).otherwise(_beyond(*at[False])) & (F.col("_n") <= left)
        rest = prefix_sums(df.filter(within).select("_id", "_o", "_n", "_first"), "_o", "_id", "_n", ["_first"], "own")
        # whole numbers of millionths, so both keys are compared exactly
        share = round(dose * 1_000_000)
        key = F.when(F.col("_first"), (F.col("own") + got[True]) * (1_000_000 - share) - share).otherwise((F.col("own") + got[False]) * share)
        # of equal keys the second pool goes first, then the pool's own order
        merged = rest.withColumn("_k", key.cast("long")).withColumn("_t", F.struct("_first", "_o", "_id"))
        summed = prefix_sums(merged, "_k", "_t", "_n")
        row = summed.agg(F.min(F.when(F.col("before") + F.col("_n") > left, F.struct("_k", "_t"))).alias("stop")).first()
        if row.stop is None:
            kept.append(within)
            break
        k, t = row.stop
        own = (F.col("_o") < t[1]) | ((F.col("_o") == t[1]) & (F.col("_id") < t[2]))
        ahead = (F.col("_k") < k) | ((F.col("_k") == k) & ((F.col("_first") < t[0]) | ((F.col("_first") == t[0]) & own)))
        ends = summed.filter(ahead).groupBy("_first").agg(F.max(F.struct("_o", "_id")).alias("last"), F.sum("_n").alias("n")).collect()
        for e in ends:
            o, i = e.last
            side = F.col("_first") == e._first
            kept.append(within & side & ~_beyond(o, i))
            got[e._first] += e.n
            at[e._first] = (o, i)
            left -= e.n
        at[t[0]] = (t[1], t[2])
    chosen = reduce(Column.__or__, kept, F.lit(False))
    return df.filter(chosen).drop("_o", "_n", "_id", "_first")


def held_out(items: DataFrame, trained: DataFrame, id_: str, length: str, least: int, count: int, seed: int = 0) -> DataFrame:
    """The first ``count`` items, in the seeded order, that are not trained on and have ``least`` turns."""
    free = items.join(trained.select(id_).distinct(), id_, "left_anti").filter(F.col(length) >= least)
    return free.orderBy(seeded(F.col(id_).cast("string"), seed), id_).limit(count)
