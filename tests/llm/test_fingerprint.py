from skein.llm.fingerprint import canonical, compare, edited, exact_groups, fingerprint, fingerprints


def test_canonical_form():
    assert canonical("  Ａ Straße\n\tﬁ ") == "a strasse fi" and canonical(None) == ""
    assert fingerprint("É x") == fingerprint("é  X") != fingerprint("é y")


def test_edited_equals_brute_force_over_partitions(spark, docs_of):
    texts = ["abcdefgh", "", None, "same text", "Same  TEXT", "x" * 1000, "é" * 9] + [f"t{i} " * i for i in range(40)]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    want = [compare(d, t or "", rows[(i + 1) % len(rows)][1] or "") for i, (d, t) in enumerate(rows)]
    got = edited(docs_of(rows[::-1])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_edited_edges(docs_of):
    one = edited(docs_of([(3, "abcdefgh")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)] and tuple(one[0]) == compare(3, "abcdefgh", "abcdefgh")
    assert edited(docs_of([])).count() == 0
    twice = edited(docs_of([(1, "aaaa"), (1, "bbbb"), (2, "cccc")])).collect()
    assert len(twice) == 3


def test_groups(docs_of):
    rows = docs_of([(5, "A b"), (2, "a  B"), (9, "c"), (None, "c"), (4, None), (3, " ")])
    got = {r.doc_id: (r.group_id, r.copies) for r in exact_groups(rows).collect()}
    assert got == {5: (2, 2), 2: (2, 2), 9: (9, 2), None: (9, 2), 4: (3, 2), 3: (3, 2)}
    assert exact_groups(docs_of([])).count() == 0 and fingerprints(rows).count() == 6


def test_query_keeps_every_row_once(spark, tmp_path):
    import hashlib
    import unicodedata

    from skein.llm.queries import op9_document_fingerprints

    texts = ["Alpha beta gamma delta", "alpha  BETA gamma delta", "", None, "Straße", "STRASSE", "unlike all others"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_document_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == 7
    form = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % 7] or ""
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        same = [j for j in range(7) if form(texts[j]) == form(text)]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[i].near_edited, got[i].near_next) == (float(form(text) == form(changed)), float(form(text) == form(after)))
        assert (got[i].group_id, got[i].copies) == (min(same), len(same))
        assert {j for j in range(7) if got[j].fingerprint == got[i].fingerprint} == set(same)
