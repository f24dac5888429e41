"""Scene trees as text, level by level, against a walk over each tree."""

import pytest
from pyspark.sql import functions as F

from skein.functions.grammar import Lexicon, parse, scene_nodes
from skein.operators import gloss

LEXICON = Lexicon({"R": ("mo", "ta", "re"), "O": ("un", "ap"), "L": ("fe", "wo"), "A": ("zi",), "M": ("ma",), "D": ("da",), "Q": ("qu",), "T": ("ti",), "F": ("ka", "ki")}, closer="sa")
WORDS = gloss.Glosses({"R": {"mo": "rains", "ta": "stops"}, "O": {"un": "up", "ap": "apart"}, "L": {"fe": "after", "wo": "beside"}, "A": {"zi": "again"}, "M": {"ma": "told"}, "D": {"da": "bright"}, "Q": {"qu": "often"}, "T": {"ti": "once"}}, {"ki": "?"})
SURFACES = ["mo ka", "re ki", "qu ti ma un ap fe mo zizisa da ta zisa da ki", "fe fe mo wo un re ta wo ma re mo ka", "wo ta fe mo re ka", "fe fe fe mo ta re mo ki"]


def plain(node):
    w = lambda k, f: WORDS.words[k].get(f, f)
    out = [w(k, node[c]) for k, c in (("Q", "quant"), ("T", "tense"), ("M", "modal")) if c in node]
    out += [w("O", o) for o in node.get("orient", [])]
    out += [f"{w('L', r)} [{t}]" for r, t in sorted((r, plain(c)) for r, c in node.get("edges", []))]
    out.append(w("R", node["root"]))
    if "aspect" in node:
        out.append(w("A", node["aspect"][0]) + (f" x{node['aspect'][1]}" if node["aspect"][1] > 1 else ""))
    if "degree" in node:
        out.append(w("D", node["degree"]) + "ly")
    return ", ".join(out)


@pytest.fixture(scope="module")
def scenes(spark):
    assert all(parse(s, LEXICON) for s in SURFACES)
    return scene_nodes(spark.createDataFrame([(s, s) for s in SURFACES], "id string, said string"), "id", "said", LEXICON).cache()


def test_gloss_says_every_part(scenes):
    got = {r.id: r.text for r in gloss.gloss(scenes, WORDS, LEXICON.depth).collect()}
    assert got == {s: plain(parse(s, LEXICON)["node"]) + WORDS.codas.get(parse(s, LEXICON)["force"], ".") for s in SURFACES}


def test_prose_marks_where_embedded_parts_end(scenes):
    got = {r.id: r.text for r in gloss.prose(scenes, WORDS, LEXICON.depth).collect()}
    assert got["mo ka"] == "It rains." and got["wo ta fe mo re ka"] == "After a raining, beside a stopping, it re."
    assert got["fe fe fe mo ta re mo ki"] == "After a ring - after a stopping - after a raining - -, it rains?".replace("-, ", "- ")
    assert len(set(got.values())) == len(got)


def test_gerunds(spark):
    words = {"rains": "raining", "stops": "stopping", "flies": "flying", "makes": "making", "sees": "seeing", "goes": "going", "dies": "dying", "passes": "passing", "glows": "glowing", "opens": "opening"}
    df = spark.createDataFrame(list(words.items()), "w string, want string").withColumn("got", gloss.gerund(F.col("w")))
    assert {r.w: r.got for r in df.collect()} == words


def test_impressions_leave_decoration_aside(spark):
    rows = ["un mo ka", "qu un mo zisa ki", "un mo zizisa ka", "mo ka", "fe mo wo ta re ka", "wo ta fe ti mo da re ka"]
    nodes = scene_nodes(spark.createDataFrame([(s, s) for s in rows], "id string, said string"), "id", "said", LEXICON)
    got = {r.id: (r.first, r.n) for r in gloss.compatible(nodes).collect()}
    assert got == {"un mo ka": ("un mo ka", 1), "qu un mo zisa ki": ("qu un mo zisa ki", 2), "un mo zizisa ka": ("qu un mo zisa ki", 2), "mo ka": ("mo ka", 1), "fe mo wo ta re ka": ("fe mo wo ta re ka", 2), "wo ta fe ti mo da re ka": ("fe mo wo ta re ka", 2)}
