"""Covariance distances, arms, dyadic intervals and clustered power against numpy and plain loops."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import drift


def md5_place(text, among):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % among


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    return {(arm, name): rng.normal(i, 1 + i / 3, (40 + i, 6)) @ rng.normal(0, 1, (6, 6)) for i, name in enumerate("pqrs") for arm in ("live", "yoked")}


def plain_w2(a, b, scale):
    """Squared distance terms by the eigenvalues of the product of the covariances."""
    a, b = a / scale, b / scale
    ca, cb = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    cross = np.sqrt(np.clip(np.linalg.eigvals(ca @ cb).real, 0, None)).sum()
    return ((a.mean(0) - b.mean(0)) ** 2).sum(), np.trace(ca) + np.trace(cb) - 2 * cross


def test_moments_distances_and_deltas(spark, clouds):
    rows = [(arm, name, p.tolist()) for (arm, name), own in clouds.items() for p in own]
    rows += [("live", "thin", [1.0] * 6)] * 2 + [("live", "p", None), ("live", "p", [1.0]), ("live", "q", [1.0] * 5 + [None]), ("live", "q", [1.0] * 5 + [float("nan")])]
    points = spark.createDataFrame(rows, "arm string, name string, v array<double>").repartition(7)
    got = drift.moments(points, ["arm", "name"], "v", 6).cache()
    found = {(r.arm, r.name): r for r in got.collect()}
    assert set(found) == set(clouds)
    for key, own in clouds.items():
        assert found[key].n == len(own)
        assert np.allclose(found[key].mean, own.mean(0)) and np.allclose(found[key].cov, np.cov(own, rowvar=False).ravel())
    live, yoked = (got.filter(F.col("arm") == a) for a in ("live", "yoked"))
    scale = drift.axis_scale(live)
    unit = np.stack([clouds["live", n].mean(0) for n in "pqrs"]).std(0, ddof=1)
    assert np.allclose(scale.first().scale, unit)
    pairs = spark.createDataFrame([*itertools.combinations("pqrs", 2), ("p", "thin")], "a string, b string")
    out = drift.arm_delta(*(drift.pair_distances(c, pairs, scale, "name") for c in (live, yoked))).collect()
    assert len(out) == 6
    for r in out:
        terms = {arm: plain_w2(clouds[arm, r.a], clouds[arm, r.b], unit) for arm in ("live", "yoked")}
        for arm, (mean, spread) in terms.items():
            assert (r[f"{arm}_mean_term"], r[f"{arm}_spread_term"], r[f"{arm}_w2"]) == pytest.approx((mean, spread, (mean + spread) ** 0.5))
        assert r.delta == pytest.approx(sum(terms["live"]) ** 0.5 - sum(terms["yoked"]) ** 0.5)
        assert r.delta_spread_term == pytest.approx(terms["live"][1] - terms["yoked"][1])


def test_one_axis_and_equal_clouds(spark):
    rows = [(n, [float(x * k)]) for n, k in (("a", 1), ("b", 1), ("c", 3)) for x in range(10)]
    got = drift.moments(spark.createDataFrame(rows, "name string, v array<double>"), ["name"], "v", 1)
    scale = spark.createDataFrame([([1.0],)], "scale array<double>")
    out = {(r.a, r.b): r for r in drift.pair_distances(got, spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), scale, "name").collect()}
    s = np.arange(10).std(ddof=1)
    assert out["a", "b"].w2 == pytest.approx(0, abs=1e-6) and out["a", "c"].w2 == pytest.approx((81 + 4 * s**2) ** 0.5)


def test_dyadic_interval_resamples_members(spark):
    rng = random.Random(4)
    pairs = [(a, b, rng.random()) for a, b in itertools.combinations("abcdef", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, x double")
    want = {}
    for r in range(60):
        times = dict.fromkeys("abcdef", 0)
        for k in range(6):
            times["abcdef"[md5_place(f"9:{r}:{k}", 6)]] += 1
        w = [times[a] * times[b] for a, b, _ in pairs]
        if sum(w):
            want[r] = pytest.approx(sum(x * y for x, (_, _, y) in zip(w, pairs)) / sum(w))
    assert {r.replicate: r["mean"] for r in drift.dyadic_replicates(df, "x", 60, 9).collect()} == want
    row = drift.dyadic_interval(df, "x", 60, 9).first()
    means = sorted(float(v.expected) for v in want.values())
    assert (row.low, row.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))) and row.n_pairs == 15 and row.replicates == len(want)
    # pairs of one member move together, so the interval is wider than one over independent pairs
    shared = spark.createDataFrame([(a, b, float(a == "a")) for a, b, _ in pairs], "a string, b string, x double")
    row = drift.dyadic_interval(shared, "x", 200, 2).first()
    assert row.high - row.low > 2 * 1.96 * (np.std([a == "a" for a, _, _ in pairs]) / 15**0.5)
    assert drift.dyadic_interval(df.limit(0), "x", 10).first().low is None


def test_power_by_trials(spark):
    rates = [0.1, 0.3, 0.35, 0.6, 0.5]
    df = spark.createDataFrame(list(enumerate(rates)), "place long, rate double")
    got = {(r["size"], r.delta): r.power for r in drift.cluster_power(df, [3, 10], [0.0, 0.4], 10, 25, 6).collect()}
    for size, delta in got:
        found = 0
        for trial in range(25):
            share = {}
            for arm in "ab":
                own = []
                for unit in range(size):
                    key = f"6:{arm}:{size}:{trial}:{unit}"
                    p = rates[md5_place(key, 5)]
                    p = min(1.0, max(0.0, p + delta)) if arm == "b" else p
                    own.append(sum(md5_place(f"{key}:{i}", 1 << 32) / (1 << 32) < p for i in range(1, 11)) / 10)
                share[arm] = own
            v = sum(np.var(x, ddof=1) / size for x in share.values())
            found += v > 0 and abs(np.mean(share["a"]) - np.mean(share["b"])) / v**0.5 > 2.0
        assert got[size, delta] == pytest.approx(found / 25)
    assert got[10, 0.4] > 0.8 > 0.3 > got[10, 0.0]
    power = spark.createDataFrame([(4, 0.1, 0.9), (8, 0.1, 0.7), (16, 0.1, 0.8), (32, 0.1, 0.95), (4, 0.0, 0.1), (8, 0.0, 0.0)], "size int, delta double, power double")
    assert {r.delta: r.required for r in drift.required_size(power).collect()} == {0.1: 16, 0.0: None}


def test_replicates_add_up_over_batches_and_ranges(spark):
    """AUCs of drawn groups against a plain count, with scores that go on from one batch to the next."""
    from skein.operators.drift import draw_lists, draw_members
    from skein.operators.measures import auc_replicates

    rng = random.Random(6)
    rows = [(m, rng.randrange(2), float(rng.randrange(9))) for m in range(12) for _ in range(15)]
    df = spark.createDataFrame(rows, "m long, y long, s double")
    members = df.select(F.col("m").alias("member")).distinct()
    times = {(r.replicate, r.member): r.times for r in draw_members(members, 5, 11).collect()}
    lists = {(k, r.member): r.drawn.count(k) for r in draw_lists(members, 5, 11).collect() for k in set(r.drawn)}
    assert lists == times
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 3)
    try:
        got = {r.replicate: r.auc for r in auc_replicates(df, "m", "y", "s", 5, 11).collect()}
    finally:
        spark.conf.unset(key)
    for k in range(5):
        drawn = [(y, s) for m, y, s in rows for _ in range(times.get((k, m), 0))]
        p, n = [s for y, s in drawn if y], [s for y, s in drawn if not y]
        assert got[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)))


def test_pairs_of_sources_read_no_text_again(spark, sf):
    from skein.drift_queries import document_pairs

    plan = document_pairs(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan
