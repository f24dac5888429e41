"""Measurements that SQL cannot state, against brute force; refusals and edge cases of the others."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.grammar import ASPECT_KIND, ASPECT_STEP, FIELD, FORCE, MISSING, ORIENT, RELATOR, ROOT, Lexicon, nodes, parse, scene_distance, tree_distance
from skein.operators import carry, inference, measures

LEXICON = Lexicon({"R": ("mo", "ta", "re"), "O": ("un", "ap"), "L": ("fe", "wo"), "A": ("zi",), "M": ("ma",), "D": ("da",), "Q": ("qu",), "T": ("ti",), "F": ("ka", "ki")}, closer="sa")


def test_stems_stack_and_stop_words_go(spark):
    words = spark.createDataFrame([(w,) for w in ("darkening", "stuckness", "rolled", "stirring", "houses", "the", "is", "seeing", "buzz")], "w string")
    got = {r.w: r.stem for r in carry.stems(words).collect()}
    assert got == {"darkening": "dark", "stuckness": "stuck", "rolled": "rol", "stirring": "stir", "houses": "hou", "seeing": "see", "buzz": "buzz"}


def test_gate_keeps_the_prefix(spark):
    turns = [(1, 0, "user", "the wind darkening"), (1, 1, "assistant", "dark water"), (1, 2, "user", "rain"), (1, 3, "assistant", "sun"), (1, 4, "user", "sun"), (1, 5, "assistant", "suns rising"), (2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "user", "echo here"), (3, 1, "assistant", "echo")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.i): (r.reason, r.kept) for r in carry.gate(carry.exchanges(df, "conv_id", ["turn"], "user", "assistant")).collect()}
    assert got == {(1, 2): ("ok", True), (1, 4): ("nothing carried", False), (1, 6): ("ok", False), (2, 2): ("nothing carried", False), (3, 2): ("echo", False)}


def test_transience_tells_planted_chains(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        carried = [f"w{rng.randrange(400)}" for _ in range(6)]
        for i in range(8):
            own = [f"w{rng.randrange(400)}" for _ in range(6)]
            rows.append((c, i, sorted({*own, *carried[:3]})))
            carried = own
    df = spark.createDataFrame(rows, "c long, i long, x array<string>")
    got = {r.lag: r for r in inference.transience(df, "c", ["i"], "x", 4, 20).collect()}
    assert got[1].verdict == "content-transient" and got[1].z > 6 and all(got[k].z < 3 for k in (2, 3, 4)) and not got[1].persistent
    still = inference.transience(df.withColumn("x", F.array(F.concat(F.lit("k"), "c"))), "c", ["i"], "x", 4, 20).first()
    assert still.verdict == "content persists" and still.persistent
    assert inference.transience(df.limit(0), "c", ["i"], "x", 4, 5).count() == 0


def grid(spark, m):
    n = len(m)
    rows = [(f"k{i}", f"k{j}", int(m[i][j]), float(m[i][j] / max(1, sum(m[i])))) for i, j in itertools.product(range(n), range(n))]
    return spark.createDataFrame(rows, "prior string, following string, n long, share double")


def test_fidelity_tells_map_from_independence(spark):
    map_ = [[0, 90, 10], [10, 0, 90], [90, 10, 0]]
    whole = lambda m: {r.prior: r.verdict for r in inference.fidelity(grid(spark, map_), grid(spark, m)).collect()}[None]
    assert whole([[0, 181, 19], [21, 0, 179], [182, 18, 0]]) == "FIDELITY"
    assert whole([[67, 66, 67], [66, 67, 67], [67, 67, 66]]) == "CHANCE"
    assert whole([[200, 0, 0], [0, 200, 0], [0, 0, 200]]) == "THIRD THING"
    assert whole([[1, 2, 0], [0, 1, 1], [1, 0, 0]]) == "UNDERPOWERED"
    st = {r.kind: r for r in inference.stationary(grid(spark, [[1, 1], [3, 1]])).collect()}
    assert st["k0"].mass == pytest.approx(0.6) and st["k0"].separation == pytest.approx(0.6 * 0.1 + 0.4 * 0.15)


def test_contrast_equals_enumerated_shuffles(spark):
    rows = [(True, 1)] * 4 + [(True, 0)] * 2 + [(False, 1)] * 2 + [(False, 0)] * 5
    got = inference.contrast(spark.createDataFrame(rows, "pivot boolean, hit int")).first()
    hits = [h for _, h in rows]
    seen = abs(4 / 6 - 2 / 7)
    each = [abs(sum(hits[i] for i in s) / 6 - (sum(hits) - sum(hits[i] for i in s)) / 7) >= seen - 1e-12 for s in itertools.combinations(range(13), 6)]
    assert got.p == pytest.approx(np.mean(each), abs=1e-6)
    none = inference.contrast(spark.createDataFrame([(True, 1)], "pivot boolean, hit int")).first()
    assert none.p is None and none.other_rate is None
    sample = spark.createDataFrame([(200, 200, 0.3)], "pivot_n long, other_n long, other_rate double")
    mde = inference.smallest_detectable(sample).first().mde
    assert 0.11 < mde < 0.17  # 2.8 standard errors of the difference are 0.13


def test_running_sums_and_order_statistics(spark):
    rng = random.Random(3)
    values = [rng.randrange(500) / 4 for _ in range(3000)]
    got = measures.running_sums(spark.createDataFrame([(v, 1) for v in values], "v double, n int"), "v", ["n"]).collect()
    assert {r.v: (r.n, r.n_before) for r in got} == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
    df = spark.createDataFrame([("a", int(4 * v)) for v in values] + [("b", 7)], "g string, v long")
    got = {r.g: r.m for r in measures.order_statistics(df, "g", "v", {"m": lambda n: F.floor(0.9 * (n - 1))}).collect()}
    assert got == {"a": sorted(int(4 * v) for v in values)[math.floor(0.9 * 2999)], "b": 7}


def test_too_many_differences_are_refused(spark):
    df = spark.createDataFrame([(float(i),) for i in range(21)], "d double")
    for f in (inference.sign_band, measures.sign_flip):
        with pytest.raises(Exception, match="over 20 differences"):
            f(df, "d").collect()
    assert inference.sign_band(df.filter("d < 3"), "d").first().mde == pytest.approx(1.0)


def brute(a, b):
    cost = ROOT * (a["root"] != b["root"]) + sum(FIELD * (a.get(k) != b.get(k)) for k in ("degree", "modal", "tense", "quant"))
    x, y = a.get("aspect"), b.get("aspect")
    if x != y:
        cost += ASPECT_STEP * abs(x[1] - y[1]) if x and y and x[0] == y[0] else ASPECT_KIND
    s, t = set(a.get("orient", ())), set(b.get("orient", ()))
    cost += ORIENT * len(s ^ t) / max(1, len(s | t))
    p, q = a.get("edges", []), b.get("edges", [])
    slots = max(len(p), len(q))
    best = math.inf
    for order in itertools.permutations(range(slots)):
        total = 0.0
        for i, j in enumerate(order):
            one, two = (p[i] if i < len(p) else None), (q[j] if j < len(q) else None)
            if one and two:
                total += RELATOR * (one[0] != two[0]) + brute(one[1], two[1])
            elif one or two:
                total += MISSING * sum(1 for _ in nodes((one or two)[1]))
        best = min(best, total)
    return cost + (best if slots else 0.0)


def test_tree_distance_equals_brute_force():
    rng = random.Random(5)
    scenes = []
    while len(scenes) < 40:
        tokens = [rng.choice(("qu", "")), rng.choice(("ma", "")), rng.choice(("un", "ap", ""))]
        for _ in range(rng.randrange(3)):
            tokens += [rng.choice(("fe", "wo")), rng.choice(("un", "")), rng.choice(("mo", "ta", "re")), rng.choice(("zisa", "zizisa", ""))]
        tokens += [rng.choice(("mo", "ta", "re")), rng.choice(("zisa", "zizisa", "")), rng.choice(("da", "")), rng.choice(("ka", "ki"))]
        if scene := parse(" ".join(t for t in tokens if t), LEXICON):
            scenes.append(scene)
    for a, b in itertools.product(scenes, scenes):
        want = brute(a["node"], b["node"])
        assert tree_distance(a["node"], b["node"]) == pytest.approx(want)
        whole, share = scene_distance(a, b)
        assert whole == pytest.approx(want + FORCE * (a["force"] != b["force"])) and 0 <= share <= 1


def test_stationary_masses_of_a_forced_cycle(spark):
    """A map of period two has masses, though its powers never settle."""
    cycle = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "a", 1.0)] + [(x, y, 0.0) for x, y in ("aa", "bb", "bc", "cb", "cc")], "prior string, following string, share double")
    got = {r.kind: r.mass for r in inference.stationary(cycle).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.25})


def test_shuffled_p_is_exact_and_its_work_bounded():
    import time
    from math import comb

    for a, an, b, bn in ((3, 10, 1, 12), (0, 5, 5, 5), (0, 4, 0, 9), (7, 7, 2, 3), (40, 90, 25, 80)):
        seen = abs(a / an - b / bn) - 1e-12
        want = sum(comb(an, k) * comb(bn, a + b - k) for k in range(max(0, a + b - bn), min(an, a + b) + 1) if abs(k / an - (a + b - k) / bn) >= seen) / comb(an + bn, a + b)
        assert inference.shuffled_p(a, an, b, bn) == pytest.approx(want)
    began = time.time()
    assert 0.03 < inference.shuffled_p(500_048_000, 10**9, 500_000_000, 10**9) < 0.035
    assert time.time() - began < 2


def test_residues_unknown_on_one_side_are_refused(spark):
    from pyspark.sql import functions as F

    from skein.functions.grammar import residue

    df = spark.createDataFrame([([1, 2], [3, 0], 4), (None, None, 0)], "a array<long>, b array<long>, d long")
    assert df.filter(residue(F.col("a"), F.col("b")) != F.col("d")).count() == 0
    for bad in (([1], None), (None, [1]), ([1], [1, 2])):
        with pytest.raises(Exception, match="residue"):
            spark.createDataFrame([bad], "a array<long>, b array<long>").select(residue(F.col("a"), F.col("b"))).collect()


def test_turns_are_re_paired_by_their_rank_in_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(inference, "CELL", 7)
    rng = random.Random(4)
    turns = {(c, i): {f"w{rng.randrange(12)}" for _ in range(4)} for c in range(20) for i in range(1, 6)}
    df = spark.createDataFrame([(c, i, sorted(x)) for (c, i), x in turns.items()], "c long, i long, x array<string>")
    got = {r.lag: r for r in inference.transience(df, "c", ["i"], "x", 2, 6).collect()}
    for lag in (1, 2):
        means = []
        for rep in range(6):
            place = lambda side, own: sorted(own, key=lambda t: hashlib.md5(f"{side}:{rep}:{lag}:{t[0]}.{t[1]}".encode()).hexdigest())  # noqa: B023, E731
            pairs = list(zip(place("a", [t for t in turns if t[1] + lag <= 5]), place("b", turns)))
            means.append(sum(len(turns[a] & turns[b]) for a, b in pairs) / len(pairs))
        assert got[lag].null_mean == pytest.approx(np.mean(means), abs=1e-6) and got[lag].null_sd == pytest.approx(np.std(means, ddof=1), abs=1e-6)


def test_no_copies_of_turns_are_broadcast(spark, tmp_path, monkeypatch):
    """Rows multiplied by replicates look as small as the file they come from."""
    monkeypatch.setattr(inference, "SENT_ITEMS", -1)
    spark.createDataFrame([(1, i, ["a"]) for i in range(4)], "c long, i long, x array<string>").write.parquet(f"{tmp_path}/t")
    plan = inference.transience(spark.read.parquet(f"{tmp_path}/t"), "c", ["i"], "x", 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3


def test_gate_joins_no_words(spark):
    turns = spark.createDataFrame([(1, 0, "user", "dark"), (1, 1, "assistant", "darkening")], "conv_id long, turn long, role string, text string")
    plan = carry.gate(carry.exchanges(turns, "conv_id", ["turn"], "user", "assistant"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_attested_roots_come_from_settled_counts(spark):
    words, roots = (spark.createDataFrame([(i, x) for i in range(9) for x in "pq"], f"o long, {c} string") for c in ("word", "root"))
    held = carry.attested(words, roots, "o", support=8, turns=8, purity=0.2, share=0.15)
    assert "o#" not in held._jdf.queryExecution().executedPlan().toString()
    assert sorted(held.collect()) == [(w, r, 9) for w in "pq" for r in "pq"]
