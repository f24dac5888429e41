import hashlib
import random
import re

from skein.llm.decontaminate import contamination, matches


def brute(docs, items, width=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = {}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            q = words(t)
            k = min(width, len(q))
            for i in range(len(q) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == q[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def setup(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "béta", "GAMMA", "d3lta", "eps"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 10, 14])))) for i in range(12)] + [(90, None), (91, " ... "), (11, "alpha eps")]
    docs = []
    for i in range(40):
        text = [rng.choice(vocabulary + ["zeta", "eta,theta"]) for _ in range(rng.choice([0, 3, 60]))]
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = (items[rng.randrange(12)][1] or "").split()
        docs.append((i, " - ".join(text)))
    docs += [(100, None), (101, "")]
    d, b = setup(spark, docs, items)
    want = brute(docs, items)
    for slice_words in (2_000_000, 20):
        got = {r.doc_id: tuple(r)[1:] for r in contamination(d, b, slice_words=slice_words).collect()}
        assert got == want


def test_occurrences_and_proximity(spark):
    d, b = setup(spark, [(1, "x the quick brown fox y"), (2, "quick z the fox brown"), (3, "the quick"), (4, "brown fox")], [(7, "The quick, brown fox")])
    assert [tuple(r) for r in matches(d, b).collect()] == [(1, "7", 1, 4)]
    near = {(r.doc_id, r.start, r.length) for r in matches(d, b, slop=1).collect()}
    assert near == {(1, 1, 5), (2, 0, 5)}


def test_empty_tables(spark):
    d, b = setup(spark, [(1, "a b")], [])
    assert [tuple(r)[:4] for r in contamination(d, b).drop("items_sha256").collect()] == [(1, 2, 0, 0)]
    assert contamination(d.limit(0), b).count() == 0


def test_search_and_sums_share_a_worker(spark, docs_of):
    """Two Python steps in one task would be two workers, each with memory of its own."""
    items = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    found = contamination(docs_of([(1, "z a b c")]), items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r.n_words, r.n_hit, r.contaminated) for r in found.collect()] == [(4, 3, True)]
