"""The mask automaton against a plain stack of predications, and patterns over scene trees against all assignments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import automaton as am
from skein.functions.grammar import Lexicon, nodes, parse, scene_nodes
from skein.operators import matching
from skein.plans.gates import Refusal

LEXICON = Lexicon({"R": ("mo", "ta"), "O": ("un",), "L": ("fe",), "A": ("zi",), "M": ("ma",), "D": ("da",), "Q": ("qu",), "T": ("ti",), "F": ("ka",)}, closer="sa", most=9)
MASK = am.Automaton(LEXICON)
TOKENS = list(LEXICON.table)


def completes(tokens):
    """Whether some continuation within the length makes a legal surface: one root for each open predication, then a force."""
    import re

    pattern = re.compile(LEXICON.pattern())
    letters = "".join(LEXICON.table.get(t, ("?", 0))[0] for t in tokens)
    cost = sum(LEXICON.table.get(t, ("?", 99))[1] for t in tokens)
    if pattern.match(letters) and cost <= LEXICON.most:
        return True
    return any(pattern.match(letters + "R" * k + "F") and cost + k + 1 <= LEXICON.most for k in range(LEXICON.depth + 2))


def test_walk_and_next_classes_are_sound_and_complete(spark):
    rng = random.Random(1)
    rows = [[]]
    for _ in range(400):
        own = []
        for _ in range(rng.randrange(12)):
            legal = [t for t in TOKENS if completes([*own, t])]
            own.append(rng.choice(legal) if legal and rng.random() < 0.93 else rng.choice([*TOKENS, "xx"]))
        rows.append(own)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, tokens array<string>").withColumn("at", am.walk(F.col("tokens"), MASK))
    out = df.select("i", "at.*", am.legal_next(F.col("at"), MASK).alias("next"), am.legal_forms(am.legal_next(F.col("at"), MASK), LEXICON).alias("forms"), am.accepted(F.col("tokens"), MASK).alias("ok")).collect()
    closed = 0
    for r in out:
        tokens = rows[r.i]
        read = max(n for n in range(len(tokens) + 1) if all(completes(tokens[:m]) for m in range(n + 1)))
        assert r.read == read and r.used == sum(LEXICON.table[t][1] for t in tokens[:read])
        assert r.forms == sorted(t for t in TOKENS if completes([*tokens[:read], t]))
        done = read == len(tokens) and bool(tokens) and tokens[-1] == "ka"
        assert r.ok == done and (not done or r.next == [])
        closed += done
    assert closed > 20


def test_states_are_derived_from_the_caps():
    assert MASK.states[0] == am.Open() and MASK.due[0] == 2 and len(MASK.table) == 9 * len(MASK.states)
    assert len(am.Automaton(Lexicon(LEXICON.classes, depth=1)).states) < len(MASK.states)


def test_blank_surfaces_and_permits(spark):
    row = spark.range(1).select(*(am.walk(am.tokens_of(F.lit(x)), MASK).alias(n) for n, x in (("a", None), ("b", "  \t")))).first()
    assert tuple(row.a) == tuple(row.b) == (0, 0, 0)
    cases = [("ka", None, "ma", None, True), ("ka", [], None, None, False), ("ka", ["ka"], "ma", [], False), ("ka", ["ka"], None, [], True), (None, ["ka"], None, None, False), ("ki", ["ka"], "ma", ["ma"], False)]
    df = spark.createDataFrame(cases, "f string, fs array<string>, m string, ms array<string>, ok boolean")
    assert df.filter(am.permits(F.col("f"), F.col("fs"), F.col("m"), F.col("ms")) != F.col("ok")).count() == 0


ONE = dict(roots=["mo"], orients=None, aspects=None, relators=None, via=None, at_depth=None, residues=None)


def referent(name, contains, forbid=(), matrix=None, **more):
    row = dict(id=name, family="f", status="REVIEWED", seed=True)
    row.update(more)
    full = lambda p: {**ONE, **p}
    return (row["id"], row["family"], row["status"], row["seed"], [full(p) for p in contains], [full(p) for p in forbid], full(matrix) if matrix else None)


REFERENTS = [
    referent("one", [{}]),
    referent("two", [{}, {"roots": ["mo", "ta"]}]),
    referent("three", [{}, {}, {"roots": ["ta"], "via": ["fe"]}]),
    referent("deep", [{"roots": ["mo", "ta"]}, {"at_depth": 2}], forbid=[{"roots": ["ta"], "orients": ["un"]}]),
    referent("top", [{"roots": ["mo", "ta"], "relators": ["fe"]}, {"roots": ["mo", "ta"], "aspects": ["zi"]}], matrix={"roots": ["ta"]}),
]
SURFACES = ["mo ka", "ta ka", "fe mo mo ka", "fe ta mo ka", "fe mo ta ka", "fe fe mo mo ta ka", "fe fe ta mo mo ka", "un ta ka", "fe un ta mo ka", "fe mo zisa ta ka", "fe mo zizisa ta zisa ka", "fe fe mo zisa ta mo ka"]


def plain_fits(node, p, path, relator):
    edges = [r for r, _ in node.get("edges", [])]
    own = dict(orients=node.get("orient", []), aspects=[node["aspect"][0]] if "aspect" in node else [], relators=edges)
    return node["root"] in p["roots"] and all(not p[k] or set(p[k]) & set(v) for k, v in own.items())


def plain(surface, ref):
    """(states in full, still possible) by all assignments."""
    _, _, _, _, contains, forbid, top = ref
    pool = list(nodes(parse(surface, LEXICON)["node"]))
    if any(plain_fits(n, p, *x) for *x, n in pool for p in forbid) or (top and not plain_fits(pool[0][2], top, *pool[0][:2])):
        return False, False
    ok = lambda p, x: plain_fits(x[2], p, *x[:2]) and (not p["via"] or (len(x[0]) == 1 and x[1] in p["via"])) and (p["at_depth"] is None or len(x[0]) == p["at_depth"])
    stated = any(all(ok(p, x) for p, x in zip(contains, chosen)) for chosen in itertools.permutations(pool, len(contains)))
    possible = len(pool) <= len(contains) and any(all(ok(p, x) for p, x in zip(chosen, pool)) for chosen in itertools.permutations(contains, len(pool)))
    return stated, possible


def test_matching_and_its_dual_by_all_assignments(spark):
    scenes = scene_nodes(spark.createDataFrame([(s, s) for s in SURFACES], "id string, said string"), "id", "said", LEXICON)
    patterns = matching.patterns_of(matching.load(spark.createDataFrame(REFERENTS, matching.REFERENT), LEXICON))
    stated = {tuple(r) for r in matching.matching(scenes, patterns).collect()}
    possible = {tuple(r) for r in matching.consistent(scenes, patterns).collect()}
    want = {(s, r[0]): plain(s, r) for s in SURFACES for r in REFERENTS}
    assert stated == {k for k, v in want.items() if v[0]} and possible == {k for k, v in want.items() if v[1]}
    assert len(stated) > 8 and len(possible) > 8
    pairs = {(r.a, r.b): r.n for r in matching.colliding(matching.matching(scenes, patterns), spark.createDataFrame([(s, 2) for s in SURFACES], "id string, n long")).collect()}
    assert pairs == {(a, b): n for a, b in itertools.combinations(sorted(r[0] for r in REFERENTS), 2) if (n := 2 * sum((s, a) in stated and (s, b) in stated for s in SURFACES))}
    bare = matching.bare_heads(scenes)
    assert bare.count() == len(SURFACES) and bare.filter("aspect_root is not null").count() == 0
    assert matching.without_aspects(scenes).filter("depth = 0 and aspect_root is not null").count() == 0


def test_residue_that_was_not_transmitted_breaks_nothing(spark):
    rows = spark.createDataFrame([("spoken", "1,0"), ("other", "0,1"), ("heard", None)], "id string, residue string").withColumn("said", F.lit("mo ka"))
    scenes = scene_nodes(rows, "id", "said", LEXICON).join(rows.select("id", "residue"), "id")
    refs = spark.createDataFrame([referent("a", [{"residues": ["1,0"]}]), referent("b", [{"residues": ["0,1"]}])], matching.REFERENT)
    got = {tuple(r) for r in matching.matching(scenes, matching.patterns_of(matching.load(refs, LEXICON, residues=True))).collect()}
    assert got == {("spoken", "a"), ("other", "b"), ("heard", "a"), ("heard", "b")}


@pytest.mark.parametrize(
    "bad, said",
    [
        ([referent("a", [{}], status="UNREVIEWED")], "not reviewed"),
        ([referent("a", [{}], status="odd")], "status"),
        ([referent("a", [{}]), referent("a", [{}])], "twice"),
        ([referent("a", [{}]), referent("b", [{}], family="g")], "families"),
        ([referent("a", [])], "clauses"),
        ([referent("a", [{}] * 5)], "clauses"),
        ([referent("a", [{"roots": []}])], "without roots"),
        ([referent("a", [{"via": ["fe"], "at_depth": 2}])], "depth 1"),
        ([referent("a", [{"orients": ["mo"]}])], "outside"),
        ([referent("a", [{}])], "residue"),
        ([referent("a", [{"residues": ["1"]}]), referent("b", [{"residues": ["1"]}])], "share a residue"),
    ],
)
def test_sets_that_may_not_run_are_refused(spark, bad, said):
    with pytest.raises(Refusal, match=said):
        matching.load(spark.createDataFrame(bad, matching.REFERENT), LEXICON, residues="residue" in said)


def test_seeds_and_unions(spark):
    one, two = ([referent(n, [{}], seed=s)] for n, s in (("a", True), ("b", False)))
    sets = [spark.createDataFrame(x, matching.REFERENT) for x in (one, two)]
    assert [r.id for r in matching.load_all(sets, LEXICON).collect()] == ["a"]
    assert matching.load_all(sets, LEXICON, seeds_only=False).count() == 2
    with pytest.raises(Refusal):
        matching.load_all([sets[0], sets[0]], LEXICON)
