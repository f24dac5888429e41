"""Choices within a budget against the sequential rule."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import budget
from skein.plans.gates import Refusal


def order(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16), i


def one_by_one(items, target, seed):
    kept, total = set(), 0
    for i, n in sorted(items, key=lambda x: order(seed, x[0])):
        if total + n <= target:
            kept.add(i)
            total += n
    return kept


def two_pools(items, target, dose, seed):
    pools = {p: sorted(((i, n) for i, n in items if (i % 3 == 0) == p), key=lambda x: order(seed, x[0])) for p in (True, False)}
    got, total, kept = {True: 0, False: 0}, 0, set()
    while total < target:
        want = got[True] * 1_000_000 < round(dose * 1_000_000) * (total + 1)
        for pool in (want, not want):
            while pools[pool] and total + pools[pool][0][1] > target:
                pools[pool].pop(0)
            if pools[pool]:
                i, n = pools[pool].pop(0)
                kept.add(i)
                got[pool] += n
                total += n
                break
        else:
            break
    return kept


@pytest.fixture(params=[1, 2])
def items(request):
    rng = random.Random(request.param)
    return [(i, rng.choice([1, 2, 3, 5, 8, 13, 40])) for i in range(120)]


def frame(spark, items):
    return spark.createDataFrame(items, "id long, n long").repartition(4)


@pytest.mark.parametrize("share", [0.1, 0.63, 2])
def test_greedy_choice(spark, items, share, monkeypatch):
    monkeypatch.setattr(budget, "RANGE", 25)
    target = int(share * sum(n for _, n in items))
    got = budget.take(frame(spark, items), "id", "n", target, 7)
    assert {r.id for r in got.collect()} == one_by_one(items, target, 7) and got.columns == ["id", "n"]


@pytest.mark.parametrize("dose", [0.25, 1.0])
def test_two_pools_to_a_dose(spark, items, dose, monkeypatch):
    monkeypatch.setattr(budget, "RANGE", 25)
    for target in (37, int(0.6 * sum(n for _, n in items))):
        got = budget.mix(frame(spark, items), "id", "n", F.col("id") % 3 == 0, target, dose, 9)
        assert {r.id for r in got.collect()} == two_pools(items, target, dose, 9)


def test_refusals_and_empty_pools(spark):
    for bad in (None, 0, -1):
        with pytest.raises(Refusal):
            budget.take(frame(spark, [(1, bad)]), "id", "n", 5)
    assert budget.take(frame(spark, []), "id", "n", 5).count() == 0
    assert budget.mix(frame(spark, [(3, 2), (6, 2)]), "id", "n", F.col("id") % 3 == 0, 3, 0.0).count() == 1


def test_held_out(spark):
    items = [(i, i % 5) for i in range(40)]
    got = budget.held_out(frame(spark, items), spark.createDataFrame([(4,), (9,)], "id long"), "id", "n", 3, 6, 2)
    want = sorted((i for i, n in items if n >= 3 and i not in (4, 9)), key=lambda i: order(2, i))[:6]
    assert [r.id for r in got.collect()] == want
