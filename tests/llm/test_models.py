"""Quality, toxicity and language ID: planted signals, brute force for the search, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import quality, toxicity
from skein.llm.language_id import accepted_rows, host_of, identify, suffix_of


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = [{int(t): float(w) for t, w in zip(rng.choice(40, 4, False), rng.random(4).round(1))} for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, [int(x) for x in rng.integers(0, 2, 500)], 40)
    for _ in range(100):
        q = {int(t): float(w) for t, w in zip(rng.choice(40, 3, False), rng.random(3))}
        every = sorted((-round(sum(q.get(t, 0) * w for t, w in v.items()), 12), i) for i, v in enumerate(vectors))
        want = [(-s, i) for s, i in every if s < 0][:7]
        got = index.nearest(q, 7)
        assert np.allclose([s for s, _ in got], [s for s, _ in want]) and len(got) == len(want)


def labelled(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(30)] + (["scum", "vile"] if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "nothing known here")]
    labels += [(3, None, None), (5000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_rows_and_leaves_clean_ones(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(rows) == 403
    held = [r for r in rows.values() if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(toxicity.held_out(n) is False for r in held for n in r.neighbours)
    assert 0 < rows[1000].score == rows[1001].score == rows[1002].score < 0.5
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_quality_orders_grades(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(("ok" if rng.random() < 0.2 + 0.3 * (i % 3) else "bad") + str(rng.randrange(20)) for _ in range(60))) for i in range(450)] + [(900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", F.pmod("doc_id", F.lit(3)).cast("int").alias("quality")).filter("doc_id < 450")
    model = quality.fit(d, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = quality.rate(d, model).collect()
    assert all(r.tail_probabilities[0] >= r.tail_probabilities[1] for r in rows) and len(rows) == 452
    mean = [np.mean([r.expected_grade for r in rows if r.doc_id % 3 == g and r.doc_id < 450]) for g in range(3)]
    assert mean[0] + 0.4 < mean[1] < mean[2] - 0.4
    constant = quality.fit(d, labels.filter("quality = 1"))
    assert {(r.expected_grade, r.keep) for r in quality.rate(d, constant).collect()} == {(1.0, True)}


def test_language_evidence_is_fused(spark):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "with", "thing", "house"], "de": ["der", "schön", "nicht", "haus"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(20)), x, f"{x}.example") for i in range(80) for x in [("en", "de")[i % 2]]]
    rows += [(100, "the house with the thing", None, "de.example"), (101, None, "de", None), (102, "123 !!", None, "en.example"), (103, "", None, None), (104, "haus nicht schön der nicht", "en", "de.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(got[i].language == ("en", "de")[i % 2] and got[i].accepted for i in range(80))
    assert got[100].text_language == "en" and got[101].language == "de" and got[101].accepted and got[104].language == "de"
    assert not got[102].accepted and not got[103].accepted
    kept = accepted_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert identify(docs.limit(0)).count() == 0
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.accepted for r in identify(blank).collect()} == {False}


def test_addresses(spark):
    urls = ["http://www.a.example.com/fr/8?x=1", "HTTPS://b.de", None, "x", "http://c.org:80/long/path"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(suffix_of(F.lower("u")), host_of(F.lower("u"))).collect()
    assert [tuple(r) for r in rows] == [("com/fr", "www.a.example.com"), ("de", "b.de"), (None, None), (None, "x"), ("org", "c.org")]


def test_toxicity_keeps_rare_terms_and_whole_norms(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20)) + (" seldomword" if i in (1, 3) else "")) for i in range(400)]
    labels = [(i, int(i in (1, 3))) for i in range(400) if not toxicity.held_out(i)]
    docs += [(1000, "seldomword"), (1001, "seldomword unseen"), (1002, "seldomword unseen other")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    seldom = [i for i in (1, 3) if not toxicity.held_out(i)]
    assert seldom and sorted(rows[1000].neighbours) == seldom and rows[1000].predicted == 1
    assert rows[1000].similarities[0] > rows[1001].similarities[0] > rows[1002].similarities[0] > 0


def test_rare_languages_are_named_beside_many_copies(spark):
    copies = [(i, "the house with the thing", "en") for i in range(3000)]
    others = [(10_000 + i, f"der schöne nicht haus {'abcdefghij'[i % 10]}", "de") for i in range(30)] + [(20_000, "il était une fois la maison", "fr")]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    got = {r.doc_id: r.text_language for r in identify(docs, sample_rows=60).filter("doc_id >= 2999").collect()}
    assert got[2999] == "en" and got[10_000] == "de" and got[20_000] == "fr"
