"""Generators: seeded chains over a transition map, and balanced corpora by quota.

Every row is made from its own number and seed, so a corpus of any size is one pass over
``spark.range`` and any lost part is made again as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from the hash of its parts."""
    return F.pmod(F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)), F.lit(1 << 30)).cast("double") / (1 << 30)


def chains(spark: SparkSession, n: int, turns: int, moves: dict[str, dict[str, float]], seed: int = 0) -> DataFrame:
    """(chain_id, turn_idx, prior, force): order-1 chains; every row of ``moves`` is a distribution."""
    states = sorted(moves)

    def following(prior: Column, u: Column) -> Column:
        out = None
        for s in states:
            total, pick = 0.0, None
            for t, p in sorted(moves[s].items()):
                total += p
                pick = F.when(u < total, F.lit(t)) if pick is None else pick.when(u < total, F.lit(t))
            pick = pick.otherwise(F.lit(max(moves[s])))
            out = F.when(prior == s, pick) if out is None else out.when(prior == s, pick)
        return out

    first = F.element_at(F.array(*map(F.lit, states)), (F.floor(uniform(F.col("chain_id"), seed) * len(states)) + 1).cast("int"))
    steps = F.sequence(F.lit(1), F.lit(turns - 1)) if turns > 1 else F.array().cast("array<int>")
    walk = F.aggregate(steps, F.array(first), lambda a, i: F.concat(a, F.array(following(F.element_at(a, -1), uniform(F.col("chain_id"), i, seed + 1)))))
    rows = spark.range(n).select(F.col("id").alias("chain_id")).withColumn("walk", walk)
    long = rows.select("chain_id", "walk", F.posexplode("walk").alias("turn_idx", "force"))
    return long.select("chain_id", "turn_idx", F.get("walk", F.col("turn_idx") - 1).alias("prior"), "force")


def balanced(spark: SparkSession, n: int, forms: list[str], seed: int = 0) -> DataFrame:
    """(id, form): every form equally often, up to one, in an order that the seed decides."""
    k = len(forms)
    block, place = F.floor(F.col("id") / k), F.pmod("id", F.lit(k))
    # inside each block of k rows the forms are rotated by a hash of the block
    turn = F.pmod(place + F.xxhash64(block, F.lit(seed)), F.lit(k))
    return spark.range(n).select("id", F.element_at(F.array(*map(F.lit, forms)), (turn + 1).cast("int")).alias("form"))
