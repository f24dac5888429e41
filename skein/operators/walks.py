"""Random walks over observed successors, with a ladder of fallbacks and without replaying their own source.

A walk stands on a surface and goes on to one that followed it in some chain; where the surface
has no successor, to one that followed any surface of the same roots; where there is none either, to
the first surface of a chain.  With ``exclude``, a step never takes a successor from the chain that supplied the
last one, so no walk replays its source.

The successors of each level and key are numbered once, the successors of one chain side by side, so
a step is a handful of equi-joins: how many there are, where the own chain's lie, and the one
that is drawn.  A key that much follows is numbered in ``BUCKETS`` parts.  Draws are hashes of seed, walk and
step, so lost tasks repeat theirs, and walks of any number and replicate are rows.

Defined cases: chains of one turn have no successors but begin walks; null surfaces break a chain's
steps; without chains there are no walks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .drift import drawn

#: parts in which the successors of one key are numbered, by the chain's number
BUCKETS = 64
#: levels of the ladder
EXACT, ROOTS, AGAIN = 1, 2, 3


@dataclass
class Kernel:
    """Numbered successors: ``steps`` (level, key, place, chain, next), ``sizes`` (level, key, n) and ``blocks`` (level, key, chain, start, size)."""

    steps: DataFrame
    sizes: DataFrame
    blocks: DataFrame
    roots: Callable[[Column], Column]


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (level, key, chain, pos, next) numbered within level and key, chain by chain."""
    key = ["level", "key"]
    sizes = rows.groupBy(*key, "chain").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.col("chain"), F.lit(BUCKETS)))
    parts = sizes.groupBy(*key, "bucket").agg(F.sum("size").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(earlier(*key).orderBy("bucket")), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("size").over(earlier(*key, "bucket").orderBy("chain")), F.lit(0))
    blocks = sizes.withColumn("within", within).join(offsets, [*key, "bucket"]).select(*key, "chain", (F.col("offset") + F.col("within")).alias("start"), "size")
    own = F.row_number().over(Window.partitionBy(*key, "chain").orderBy("pos")) - 1
    steps = rows.withColumn("own", own).join(blocks, [*key, "chain"]).select(*key, (F.col("start") + F.col("own")).alias("place"), "chain", "next")
    return steps, parts.groupBy(*key).agg(F.sum("n").alias("n")), blocks


def kernel(chains: DataFrame, roots: Callable[[Column], Column], seeds: DataFrame | None = None) -> Kernel:
    """The kernel of chains (chain, pos, surface); walks begin, and begin again, at the first surfaces of ``seeds`` (the same chains)."""
    turn = Window.partitionBy("chain").orderBy("pos")
    follows = chains.select("chain", "surface", F.lead("surface").over(turn).alias("next"), F.row_number().over(turn).alias("pos")).filter("surface is not null and next is not null")
    exact = follows.select(F.lit(EXACT).alias("level"), F.col("surface").alias("key"), "chain", "pos", "next")
    alike = follows.select(F.lit(ROOTS).alias("level"), roots(F.col("surface")).alias("key"), "chain", "pos", "next")
    first = (seeds if seeds is not None else chains).filter("surface is not null").groupBy("chain").agg(F.min_by("surface", "pos").alias("next"))
    again = first.select(F.lit(AGAIN).alias("level"), F.lit("").alias("key"), "chain", F.lit(0).alias("pos"), "next")
    rows = exact.unionAll(alike.select(*exact.columns)).unionAll(again)
    return Kernel(*_numbered(rows.select("level", "key", F.col("chain").cast("long").alias("chain"), "pos", "next")), roots)


def _draw(w: DataFrame, k: Kernel, step: int, seed: int, exclude: bool) -> DataFrame:
    """The same walks, one surface on."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("walk").cast("string"), F.lit(str(step)))
    if step == 0:
        w = w.withColumns({"level": F.lit(AGAIN), "key": F.lit(""), "start": F.lit(None).cast("long"), "size": F.lit(0).cast("long")}).join(k.sizes, ["level", "key"])
    else:
        w = w.withColumn("roots", k.roots(F.col("surface")))
        for level, on in ((EXACT, "surface"), (ROOTS, "roots")):
            sizes = k.sizes.filter(F.col("level") == level).select(F.col("key").alias(on), F.col("n").alias(f"n{level}"))
            blocks = k.blocks.filter(F.col("level") == level).select(F.col("key").alias(on), F.col("chain").alias("source"), F.col("start").alias(f"start{level}"), F.col("size").alias(f"size{level}"))
            w = w.join(sizes, on, "left")
            w = w.join(blocks, [on, "source"], "left") if exclude else w.withColumns({f"start{level}": F.lit(None).cast("long"), f"size{level}": F.lit(0).cast("long")})
        w = w.join(F.broadcast(k.sizes.filter(F.col("level") == AGAIN).select(F.col("n").alias("n3"))))  # one row
        left = {x: F.coalesce(F.col(f"n{x}"), F.lit(0)) - F.coalesce(F.col(f"size{x}"), F.lit(0)) for x in (EXACT, ROOTS)}
        level = F.when(left[EXACT] > 0, EXACT).when(left[ROOTS] > 0, ROOTS).otherwise(AGAIN)
        pick = lambda c, last: F.when(F.col("level") == EXACT, F.col(f"{c}{EXACT}")).when(F.col("level") == ROOTS, F.col(f"{c}{ROOTS}")).otherwise(last)
        w = w.withColumn("level", level)
        w = w.withColumns({"key": F.when(F.col("level") == EXACT, F.col("surface")).when(F.col("level") == ROOTS, F.col("roots")).otherwise(F.lit("")), "n": pick("n", F.col("n3")), "start": pick("start", F.lit(None)), "size": F.coalesce(pick("size", F.lit(0)), F.lit(0))})
    at = drawn(key, F.col("n") - F.col("size"))
    w = w.withColumn("place", at + F.when(at >= F.col("start"), F.col("size")).otherwise(0))
    met = w.select("walk", "path", "levels", "level", "key", "place").join(k.steps, ["level", "key", "place"])
    return met.select("walk", F.col("next").alias("surface"), F.col("chain").alias("source"), F.array_append("path", F.col("next")).alias("path"), F.array_append("levels", F.col("level")).alias("levels"))


def walk(k: Kernel, walks: DataFrame, turns: int, seed: int = 1, exclude: bool = True) -> DataFrame:
    """(walk, path, levels): for each row (walk) ``turns`` surfaces, and by which level of the ladder each was found."""
    w = walks.select("walk", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("levels"))
    for step in range(turns):
        w = _draw(w, k, step, seed, exclude)
    return w.select("walk", "path", "levels")


def ladder(walked: DataFrame) -> DataFrame:
    """(level, n, share) of the steps behind the first."""
    n = walked.select(F.explode(F.slice("levels", F.lit(2), F.size("levels"))).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # three rows at most


def lag_overlaps(walked: DataFrame, items: Callable[[Column], Column], lags: int, by: Column) -> DataFrame:
    """(read, lag, overlap): mean number of shared items of surfaces k apart, over the walks of each read."""
    sets = F.transform("path", items)

    def apart(lag: int) -> Column:
        places = F.sequence(F.lit(0), F.size("sets") - lag - 1)
        return F.transform(places, lambda i: F.struct(F.lit(lag).alias("lag"), F.size(F.array_intersect(F.get("sets", i), F.get("sets", i + lag))).alias("x")))

    pairs = F.flatten(F.array(*map(apart, range(1, lags + 1))))
    rows = walked.select(by.alias("read"), sets.alias("sets")).filter(F.size("sets") > lags).select("read", F.inline(pairs))
    return rows.groupBy("read", "lag").agg(F.avg("x").alias("overlap"))
