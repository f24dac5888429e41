"""Sets, exposure, co-occurrence, leakage, dedupe and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exposure(forms: DataFrame, seen: DataFrame, group: str, form: str) -> DataFrame:
    """Per group: least and greatest count over all its forms, zeros included, and how many occur."""
    n = seen.groupBy(group, form).agg(F.count("*").alias("_n"))
    full = forms.select(group, form).distinct().join(n, [group, form], "left").fillna(0, ["_n"])
    return full.groupBy(group).agg(F.min("_n").alias("least"), F.max("_n").alias("most"), F.sum((F.col("_n") > 0).cast("long")).alias("covered"), F.count("*").alias("total"), F.try_divide(F.min("_n"), F.avg("_n")).alias("fairness"))


def overlapping_pairs(df: DataFrame, key: str, items: str) -> DataFrame:
    """(a, b, overlap) of pairs that share an item: multiset intersection over the longer length.

    Pairs meet on a shared item, so rows without one never meet; meant for sets such as
    benchmarks or batteries, whose items are few.
    """
    n = df.select(key, F.size(items).alias("_size"), F.explode(items).alias("_item")).groupBy(key, "_size", "_item").agg(F.count("*").alias("_n"))
    a = n.select(F.col(key).alias("a"), F.col("_size").alias("_sa"), "_item", F.col("_n").alias("_na"))
    b = n.select(F.col(key).alias("b"), F.col("_size").alias("_sb"), "_item", F.col("_n").alias("_nb"))
    met = a.join(b, "_item").filter("a < b")
    return met.groupBy("a", "b", "_sa", "_sb").agg(F.sum(F.least("_na", "_nb")).alias("_m")).select("a", "b", (F.col("_m") / F.greatest("_sa", "_sb")).alias("overlap"))


def keep_first(df: DataFrame, canonical, order: list[str]) -> DataFrame:
    """One row for each canonical form, the first by ``order``; a grouped minimum, so hot forms pre-aggregate."""
    row = F.struct(*order, F.struct(*(c for c in df.columns if c not in order)).alias("rest"))
    kept = df.groupBy(F.sha2(canonical, 256).alias("_form")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return kept.select(*(F.col("_row")[c].alias(c) if c in order else F.col("_row")["rest"][c].alias(c) for c in df.columns))


def cooccurrence(df: DataFrame, key: str, items: str, least: int = 2) -> DataFrame:
    """(a, b, n): items a < b in how many rows both occur, at least ``least``."""
    one = df.select(key, F.explode(F.array_distinct(items)).alias("a"))
    return one.join(one.select(key, F.col("a").alias("b")), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def inverted(df: DataFrame, key: str, items: str) -> DataFrame:
    """(item, n, keys): how many rows hold the item, and which, ascending."""
    return df.select(key, F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))


def purity(df: DataFrame, items: str, label: str, least: int = 5) -> DataFrame:
    """(item, modal, purity, n): an item's most frequent label (ties: the smallest) and its share."""
    n = df.select(F.explode(F.array_distinct(items)).alias("item"), label).groupBy("item", label).agg(F.count("*").alias("_n"))
    best = n.groupBy("item").agg(F.max_by(label, F.struct("_n", F.lit(0))).alias("_any"), F.max("_n").alias("_top"), F.sum("_n").alias("n")).filter(F.col("n") >= least)
    modal = n.join(best, "item").filter("_n = _top").groupBy("item", "_top", "n").agg(F.min(label).alias("modal"))
    return modal.select("item", "modal", (F.col("_top") / F.col("n")).alias("purity"), "n")


def leakage(probes: DataFrame, corpus: DataFrame, on: str) -> DataFrame:
    """(leaked, total, rate): distinct probes whose key occurs in the corpus."""
    p = probes.select(on).distinct()
    hit = p.join(corpus.select(on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    return hit.agg(F.count("_hit").alias("leaked"), F.count("*").alias("total")).withColumn("rate", F.try_divide("leaked", "total"))


def carried(df: DataFrame, key: str, order: list[str], items: str) -> DataFrame:
    """Adds what a turn carries over from the turn before, and what it adds; null at a first turn."""
    before = F.lag(items).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_b", before).withColumn("carried", F.array_intersect("_b", items)).withColumn("added", F.when(F.col("_b").isNotNull(), F.array_except(items, "_b"))).drop("_b")


def unpaired(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(key, side) of keys that only one of the two tables has."""
    left, right = a.select(on).distinct(), b.select(on).distinct()
    return left.join(right, on, "left_anti").withColumn("side", F.lit("a")).unionAll(right.join(left, on, "left_anti").withColumn("side", F.lit("b")))
