"""Spelling variants against all pairs of words, with crowded letters, halves and chunks, and against the SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from skein.llm import spelling
from skein.llm.queries import op13_spelling_variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts):
    """word -> (form, root, n, n_near, form_n) from a dict of counts, by all pairs."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def results(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def made_words(seed, count=500, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(count)}
    return {w: rng.choice([5, 6, 30, 200, 1000, 5000]) for w in sorted(words)}


def test_one_edit_is_distance_one():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("crowd, few, shard", [(20_000, 12, 20_000), (20_000, 0, 50), (30, 12, 50), (4, 2, 10), (1, 0, 10)])
def test_every_split_gives_all_near_words(spark, monkeypatch, crowd, few, shard):
    counts = made_words(7)
    for name, value in (("CROWD", crowd), ("FEW", few), ("SHARD", shard)):
        monkeypatch.setattr(spelling, name, value)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(words).collect()}
    want = {}
    for w in counts:
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), counts[best], best)
    assert got == want and len(got) > 300


def test_forms_and_roots_follow_long_paths(spark):
    chain = {"aaaaaa" + "b" * k: 5 * 5**k for k in range(9)}
    text = " ".join(" ".join([w] * n) for w, n in list(chain.items())[:6])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert results(spelling.variants(docs)) == brute(dict(list(chain.items())[:6]))
    forms = spark.createDataFrame([(w, "aaaaaa" + "b" * (k + 1) if k < 8 else None, n) for k, (w, n) in enumerate(chain.items())], "word string, form string, n long")
    assert {r.root for r in spelling.roots(forms).collect()} == {"aaaaaa" + "b" * 8}


def documents():
    rng = random.Random(11)
    words = [w for w in made_words(3, 120, "abcÉ×")]
    rows = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else words[min(rng.randrange(len(words)), rng.randrange(len(words)))] for _ in range(200))) for i in range(150)]
    return [*rows, rows[4], (None, rows[5][1]), (500, None), (501, ""), (502, "12 ... \n")]


def test_whole_operator_and_sql_agree_with_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = results(spelling.variants(docs, slip=spelling.crc_slips()))
    assert got == brute(counts) and any(v[0] for v in got.values())
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert {r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in base.execute(spelling.SQL).fetchall()} == got


def test_long_text_is_read_in_stretches(monkeypatch):
    text = "wörter einer langen Zeile " * 50
    whole = spelling._runs(text)
    monkeypatch.setattr(spelling, "LONG", 17)
    assert spelling._runs(text) == whole


def test_empty_table_and_short_words(spark, docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of(["kurz " * 20])).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("abc", 5)], "word string, n long"), 3)


def test_query_equals_its_sql(spark, sf):
    got = results(op13_spelling_variants(spark, sf))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        assert {r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in base.execute(spelling.SQL).fetchall()} == got
