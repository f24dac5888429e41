import random
from collections import Counter

import corpus_pipeline
from skein.llm import common
from skein.llm.queries import QUERIES


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = [(i, " ".join(f"wort{(i * 31 + k * 7) % 997}x" + "abc"[k % 3] for k in range(80)), "en", "s", 1) for i in range(1, 20)]
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    quoting = " ".join(f"wort{(50 * 31 + k * 7) % 997}x" + "abc"[k % 3] for k in range(80))
    rows = clean + [
        (100, clean[0][1], "en", "s", 1),
        (101, clean[1][1] + " extra", "en", "s", 1),
        (102, clean[2][1].replace("wort", "Wort", 3) + "\n" + clean[3][1], "en", "s", 1),
        (103, quoting + " " + bench + " wort1xa", "en", "s", 1),
        (104, "12345 !!", None, None, 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    ids = {r[0] for r in clean}
    assert left[0] == ids | {100, 101, 102, 103}
    assert 100 not in left[1] and ids <= left[1]
    assert 101 not in left[2] and ids <= left[2]
    assert left[3] == left[4] == left[2] - {103} and ids <= left[3]


def test_near_duplicates_shuffle_only_what_goes_or_repeats(spark, monkeypatch, shuffled):
    """At 6 GB the rows that stay pass the broadcast limit; they are nearly all, so none of them is to be shuffled."""
    rng = random.Random(17)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(200)) for _ in range(150)]
    single = [(i, t, "k", "r", "b") for i, t in enumerate(texts)]
    more = [(200 + i, t + " end", "k", "r", "b") for i, t in enumerate(texts[:4])]  # near copies go
    more += [(300, texts[5], "k", "r", "b"), (None, texts[6], "k", "r", "b"), (8, texts[8] + " end", "k", "r", "b")]  # equal text, no id, one id twice
    again = [(9, texts[9], "other", "r", "b"), (10, texts[10], "k", "r", "b"), (10, texts[10], "k", "r", "b"), (None, texts[11] + " end", "k", "r", "b"), (None, None, "k", "r", "b"), (None, None, "k", "r", "b"), (7, "", "k", "r", "b")]
    docs = spark.createDataFrame(single + more + again, "doc_id long, text string, key string, row string, bits string").cache()
    docs.count()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    before = shuffled()
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert shuffled() - before < sum(map(len, texts))
    assert out.columns == docs.columns
    eight = got.pop((8, texts[8]), 0), got.pop((8, texts[8] + " end"), 0)
    assert sorted(eight) == [0, 1]  # equal ids: either stays
    expected = {(i, t): 1 for i, t in enumerate(texts) if i != 8}
    assert got == Counter(expected | {(None, None): 1, (7, ""): 1})


def test_every_operator_is_registered_once():
    numbers = sorted(int(q.split("_")[0][2:]) for q in QUERIES)
    assert numbers == list(range(1, 14))
