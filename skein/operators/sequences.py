"""Ordered turns and events: lags, transitions, windows, runs, splits.

All are window functions or grouped sums over a sequence key, so a sequence is sorted once
and no sequence joins itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_profile(df: DataFrame, key: str, order: list[str], items: str, lags: int = 4) -> DataFrame:
    """(lag, mean_overlap, n_pairs): mean size of the overlap of the item sets k turns apart."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = [F.struct(F.lit(k).alias("lag"), F.size(F.array_intersect(items, F.lead(items, k).over(w))).alias("overlap"), F.lead(items, k).over(w).isNotNull().alias("pair")) for k in range(1, lags + 1)]
    return df.select(F.array(*pairs).alias("_p")).select(F.inline("_p")).filter("pair").groupBy("lag").agg(F.avg("overlap").alias("mean_overlap"), F.count("*").alias("n_pairs"))


def successors(df: DataFrame, key: str, order: list[str], value: str, steps: int = 1) -> DataFrame:
    """Adds s1..s<steps>: the values that follow in the sequence."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *(F.lead(value, k).over(w).alias(f"s{k}") for k in range(1, steps + 1)))


def transitions(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(prior, following, n, share): counts of adjacent pairs and their share of the prior's row."""
    pairs = successors(df, key, order, value).filter("s1 is not null")
    n = pairs.groupBy(F.col(value).alias("prior"), F.col("s1").alias("following")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("prior")))


def transition_grid(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Transitions with zero-filled cells, the row mass and the share under independence."""
    t = transitions(df, key, order, value).select("prior", "following", "n")
    values = df.select(F.col(value)).distinct()
    grid = values.select(F.col(value).alias("prior")).crossJoin(values.select(F.col(value).alias("following")))
    full = grid.join(t, ["prior", "following"], "left").fillna(0, ["n"])
    row, column, all_ = (F.sum("n").over(w) for w in (Window.partitionBy("prior"), Window.partitionBy("following"), Window.partitionBy()))
    return full.select("prior", "following", "n", row.alias("row_n"), F.try_divide("n", row).alias("share"), F.try_divide(column, all_).alias("independent"), F.try_divide(row, all_).alias("mass"))


def last_turns(df: DataFrame, key: str, turn: str, n: int) -> DataFrame:
    """Rows of the last n distinct turns of each sequence."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(turn)))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def role_pivot(df: DataFrame, key: str, turn: str, role: str, value: str, roles: list[str]) -> DataFrame:
    """One row for each turn with a column for each role."""
    return df.groupBy(key, turn).agg(*(F.max(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles))


def context(df: DataFrame, key: str, order: list[str], value: str, depth: int, alias: str = "context") -> DataFrame:
    """Adds the array of the previous ``depth`` values, oldest first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-depth, -1)
    return df.withColumn(alias, F.collect_list(value).over(w))


def held(df: DataFrame, key: str, order: list[str], items: str) -> DataFrame:
    """Adds the items shared by the two turns before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("held", F.array_intersect(F.lag(items, 1).over(w), F.lag(items, 2).over(w)))


def own_items(df: DataFrame, key: str, order: list[str], items: str, turns: int) -> DataFrame:
    """Adds the union of the items 2, 4, .. 2 * turns rows back: a speaker's own turns."""
    w = Window.partitionBy(key).orderBy(*order)
    empty = F.array().cast("array<string>")
    return df.withColumn("own", reduce(F.array_union, (F.coalesce(F.lag(items, 2 * j).over(w), empty) for j in range(1, turns + 1))))


def parts(df: DataFrame, key: str, order: list[str], k: int = 4) -> DataFrame:
    """Adds ``part`` 0..k-1 of contiguous splits at round-half-even(i * n / k)."""
    w = Window.partitionBy(key)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    edge = [F.bround(F.lit(float(i)) * F.col("_n") / k) for i in range(1, k)]
    return numbered.withColumn("part", sum(((F.col("_i") >= e).cast("int") for e in edge), F.lit(0))).drop("_i", "_n")


def longest_cycle(df: DataFrame, key: str, order: list[str], value: str, period: int = 3) -> DataFrame:
    """(key, period, longest): rows of the longest run in which a value equals the one ``period`` back."""
    w = Window.partitionBy(key).orderBy(*order)
    out = []
    for p in range(1, period + 1):
        same = df.select(key, F.row_number().over(w).alias("_i"), (F.col(value) == F.lag(value, p).over(w)).alias("_same")).filter("_same")
        island = same.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy("_i")))
        runs = island.groupBy(key, "_g").agg(F.count("*").alias("run"))
        out.append(runs.groupBy(key).agg(F.max("run").alias("longest")).withColumn("period", F.lit(p)))
    return reduce(DataFrame.unionByName, out).select(key, "period", "longest")


def take_while(df: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """The leading rows of each sequence before the first that is not ok."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_bad", F.sum(F.when(ok, 0).otherwise(1)).over(w)).filter("_bad = 0").drop("_bad")


def half_movement(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n, movement): |mean of the second half - mean of the first half|; the first has floor(n / 2) rows."""
    w = Window.partitionBy(key)
    numbered = df.select(key, F.col(value).alias("_v"), F.row_number().over(w.orderBy(*order)).alias("_i"), F.count("*").over(w).alias("n"))
    first = F.col("_i") <= F.floor(F.col("n") / 2)
    return numbered.groupBy(key, "n").agg(F.abs(F.avg(F.when(~first, F.col("_v"))) - F.avg(F.when(first, F.col("_v")))).alias("movement"))


def crossings(df: DataFrame, key: str, order: list[str], value: str, target: float) -> DataFrame:
    """Rows at which the value reaches the target that the row before had not."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_b", before).filter((F.col(value) >= target) & (F.col("_b") < target)).drop("_b")


def numbered(df: DataFrame, order: str, ties: list[str] = [], name: str = "seq", rows: int = 1_000_000) -> DataFrame:
    """``df`` with the number of each row, from 1, by a numeric column and then by ``ties``.

    Rows are dealt to ranges of about ``rows`` rows (bounds from approximate quantiles) and numbered
    within them; the counts of earlier ranges, one row for each, are joined.  Null orders come first.
    """
    ranges = max(1, -(-df.count() // rows))
    bounds = sorted({b for b in df.approxQuantile(order, [i / ranges for i in range(1, ranges)], min(0.01, 0.25 / ranges))}) if ranges > 1 else []
    dealt = df.withColumn("_range", F.expr(f"aggregate(array({', '.join(f'{b!r}D' for b in bounds)}), 0, (n, b) -> n + if({order} > b, 1, 0))") if bounds else F.lit(0))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first(), *ties))
    # one row for each range of a million rows
    return dealt.withColumn(name, within).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
