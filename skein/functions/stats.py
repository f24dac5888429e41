"""Statistics as column expressions; a rate over nothing is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate; null where n = 0."""
    hits, n = hits.cast("double"), n.cast("double")
    p = F.try_divide(hits, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    middle = p + F.try_divide(F.lit(z * z / 2), n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    return (middle - spread) / scale, (middle + spread) / scale


def order_stat(values: Column, q: float, mode: str = "floor") -> Column:
    """An order statistic of an array.

    floor: sorted[floor(q (n - 1))]; index: sorted[min(floor(q n), n - 1)]; round: half-to-even index.
    """
    n = F.size(values)
    at = {"floor": F.floor(q * (n - 1)), "index": F.least(F.floor(q * n), n - 1), "round": F.bround(q * (n - 1))}[mode]
    return F.get(F.sort_array(values), at.cast("int"))


def sign_test_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of discordant counts b and c, summed in log space."""
    n, low = (b + c).cast("double"), F.least(b, c)
    first = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        following = F.when(i < n, acc["term"] + F.log(n - i) - F.log(i + 1.0)).otherwise(acc["term"])
        return F.struct(following.alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total"))

    return F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), first, add, lambda x: x["total"]))


def welch(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom; null where a variance term is missing."""
    a, b = F.try_divide(var_a, n_a), F.try_divide(var_b, n_b)
    t = F.try_divide(mean_a - mean_b, F.sqrt(a + b))
    return t, F.try_divide((a + b) * (a + b), F.try_divide(a * a, n_a - 1) + F.try_divide(b * b, n_b - 1))


def total_variation(p: Column, q: Column) -> Column:
    """Half the L1 distance, as an aggregate over the cells of a distribution."""
    return 0.5 * F.sum(F.abs(p - q))
