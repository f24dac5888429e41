"""Rows of one doc_id, nulls, empty tables and clashing columns in the stages of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.fingerprint import edited
from skein.llm.language_id import identify

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, _doc int, _row int, _gone int, key int, doc int, row int, gone int, left int"


def text(i, n=60):
    return " ".join(f"wort{(i * 31 + k * 7) % 997}x" + "abc"[k % 3] for k in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [
        (1, text(1), "en"), (1, text(2), "en"), (1, text(3) + " " + bench, "en"), (2, text(4), "en"), (2, text(4), "en"), (3, text(4), "en"),
        (None, text(5), "en"), (None, text(5) + " und mehr", "en"), (4, None, "en"), (5, "", "en"), (6, text(6), None),
    ]
    docs = spark.createDataFrame([(*r, "s", 1, *range(8)) for r in rows], FIELDS)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, str(tmp_path)


def test_stages_tell_rows_of_one_id_apart(spark, tables):
    docs, sf = tables
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [g for g in got if g[0] == 1] == sorted([(1, text(1)), (1, text(2)), (1, got[[g[0] for g in got].index(1) + 2][1])])
    assert (2, text(4)) in got and (3, text(4)) not in got and len([g for g in got if g[0] == 0]) == 1 and len([g for g in got if g[1] == ""]) == 2
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert sorted(r.text for r in clean.filter("doc_id = 1").collect()) == sorted([text(1), text(2)])


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_and_empty_tables(spark, tables, number):
    docs, sf = tables
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, docs, sf).columns == docs.columns
    assert stage(spark, docs.limit(0), sf).count() == 0
    assert stage(spark, docs, sf).filter(F.col("text") == text(1)).count() == 1


def test_neighbours_do_not_need_a_reused_exchange(spark, docs_of):
    docs = docs_of([(i % 150, f"text {i} " * 4) for i in range(300)]).repartition(7)
    first = sorted(map(tuple, edited(docs).collect()))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        again = sorted(map(tuple, edited(docs).collect()))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert first == again and len(first) == 300 and len({r[0] for r in first}) == 150


def test_other_scripts_and_gibberish_are_rejected(spark):
    import random

    rng = random.Random(5)
    vocabulary = {"en": "the with thing house and water other about would these people".split(), "de": "der schön nicht haus und wasser andere über würde diese leute".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(40)), x, None) for i in range(200) for x in [("en", "de")[i % 2]]]
    odd = ["".join(rng.choice("абвгдежзиклмнопрсту ") for _ in range(400)), "".join(rng.choice("qxzjkvwpy") + " " * (i % 6 == 0) for i in range(400)), " ".join(rng.choice(["katt", "grön", "jag", "mycket", "också", "själv"]) + str(i) for i in range(80))]
    docs = spark.createDataFrame(rows + [(1000 + i, t, "en", None) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(got[i].accepted and got[i].language == ("en", "de")[i % 2] for i in range(200))
    assert not got[1000].accepted and not got[1001].accepted
