"""Walks over successors against a plain walk with the same draws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import walks

KIND = lambda c: F.substring(c, 1, 1)


def place(seed, walk, step, among):
    return int(hashlib.md5(f"{seed}:{walk}:{step}".encode()).hexdigest()[:8], 16) % among


def restated(chains, seeds, count, turns, seed, exclude):
    order = lambda c: (c % walks.BUCKETS, c)
    follows = [(c, a, b) for c in sorted(chains, key=order) for a, b in zip(chains[c], chains[c][1:]) if a and b]
    first = [(c, next(x for x in seeds[c] if x)) for c in sorted(seeds, key=order) if any(seeds[c])]
    out = {}
    for w in range(count):
        source, now = first[place(seed, w, 0, len(first))]
        path, levels = [now], [3]
        for step in range(1, turns):
            ladder = [[(c, b) for c, a, b in follows if a == now and not (exclude and c == source)], [(c, b) for c, a, b in follows if a[0] == now[0] and not (exclude and c == source)], first]
            level = next(i for i, x in enumerate(ladder) if x)
            source, now = ladder[level][place(seed, w, step, len(ladder[level]))]
            path.append(now)
            levels.append(level + 1)
        out[w] = (path, levels)
    return out


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("split", [True, False])
def test_walks_follow_the_ladder(spark, exclude, split):
    rng = random.Random(3)
    chains = {c * 7: [rng.choice(["a1", "a2", "b1", "b2", "c" + str(c), "d" + str(c % 3)]) for _ in range(rng.randrange(1, 7))] for c in range(30)}
    chains[5] = ["z9", None, "a1"]
    seeds = {c: v for c, v in chains.items() if c % 2} if split else chains
    row = lambda own: spark.createDataFrame([(c, i, x) for c, v in own.items() for i, x in enumerate(v)], "chain long, pos int, surface string").repartition(3)
    k = walks.kernel(row(chains), KIND, row(seeds) if split else None)
    got = walks.walk(k, spark.range(60).withColumnRenamed("id", "walk"), 6, 11, exclude)
    want = restated(chains, seeds, 60, 6, 11, exclude)
    assert {r.walk: (r.path, r.levels) for r in got.collect()} == want
    steps = [x for _, levels in want.values() for x in levels[1:]]
    assert {r.level: r.n for r in walks.ladder(got).collect()} == {x: steps.count(x) for x in set(steps)}
    if exclude:
        assert {1, 2} <= set(steps)
    overlap = {(r.read, r.lag): r.overlap for r in walks.lag_overlaps(got, lambda s: F.array_distinct(F.split(s, "")), 2, F.col("walk") % 4).collect()}
    for (read, lag), x in overlap.items():
        own = [len(set(p[i]) & set(p[i + lag])) for w, (p, _) in want.items() if w % 4 == read for i in range(6 - lag)]
        assert x == pytest.approx(sum(own) / len(own))
    assert len(overlap) == 8


def test_no_chains_no_walks(spark):
    none = spark.createDataFrame([], "chain long, pos int, surface string")
    assert walks.walk(walks.kernel(none, KIND), spark.range(3).withColumnRenamed("id", "walk"), 3).count() == 0
