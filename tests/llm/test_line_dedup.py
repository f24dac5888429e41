import random

from skein.llm.line_dedup import dedup_lines, edit_distance_within, line_classes, probes, segments


def distance(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def changed(rng, s, times, letters="abc"):
    s = list(s)
    for _ in range(times):
        at = rng.randint(0, len(s))
        kind = rng.random()
        if kind < 0.3:
            s.insert(at, rng.choice(letters))
        elif at < len(s):
            s[at : at + 1] = rng.choice(letters) if kind < 0.6 else ""
    return "".join(s)


def test_distance_and_segments_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(5000):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        t = changed(rng, s, rng.randint(0, 5))
        for k in (1, 2, 3):
            near = distance(s, t) <= k
            assert edit_distance_within(s, t, k) == near
            a, b = (s, t) if len(s) >= len(t) else (t, s)
            if near and len(b) > k:
                filed = {(len(b), i): b[at : at + n] for i, (at, n) in enumerate(segments(len(b), k))}
                assert any(filed.get((other, i)) == a[at : at + n] for other, i, at, n in probes(len(a), k))


def brute(rows, edits=2, shortest=10):
    lines = [(d, n, x.strip()) for d, t in sorted(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, _, s) in enumerate(lines):
        for j, (_, _, t) in enumerate(lines[:i]):
            if min(len(s), len(t)) >= shortest and (s == t or distance(s, t) <= min(edits, max(len(s), len(t)) // 10)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(d, n): lines[find(i)][:2] for i, (d, n, _) in enumerate(lines)}


def test_classes_equal_brute_force(docs_of):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([4, 9, 11, 19, 25, 60, 200]))) for _ in range(14)]
    rows = [(i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4]), "abcd ") for _ in range(5))) for i in range(30)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_classes(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_dedup_keeps_clean_documents_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a line that is long enough\nshort\nunique words here", "x"), (2, "short\nA line that is long enough\nother words entirely", "y"), (3, "unique words here", "z"), (4, None, "n"), (5, "", "e"), (6, "tab\tkept  as is ", "k")],
        "doc_id long, text string, a string",
    )
    got = {r.doc_id: (r.text, r.a) for r in dedup_lines(docs).collect()}
    assert got == {1: ("a line that is long enough\nshort\nunique words here", "x"), 2: ("short\nother words entirely", "y"), 4: (None, "n"), 5: ("", "e"), 6: ("tab\tkept  as is ", "k")}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_one_id_with_two_texts(docs_of):
    got = sorted(tuple(r) for r in dedup_lines(docs_of([(1, "the very same line"), (1, "the very same line"), (2, "the very same line"), (2, "another line of two")])).collect())
    assert got == [(1, "the very same line"), (1, "the very same line"), (2, "another line of two")]


def test_query_classes_equal_short_lines(spark, tmp_path):
    from skein.llm.queries import op1_line_dedup

    spark.createDataFrame([(1, "menu\nhome\n"), (2, "menu \nmenus\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.duplicate) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    own = [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert got == {x: (*x, False) for x in own} | {(2, 0): (1, 0, True)}


def templated(rng, n):
    """Lines of one template, so that very many share a segment, some of them near copies."""
    return [(i, f"posted on the {rng.randint(0, 40):02d} by the user {rng.choice('abcdef') * rng.randint(1, 9)}\n{rng.randint(0, 9)}") for i in range(n)]


def test_crowded_segments_and_lines_that_are_not_shipped(docs_of, monkeypatch):
    from skein.llm import line_dedup

    rows = templated(random.Random(9), 120)
    monkeypatch.setattr(line_dedup, "CROWD", 7)
    monkeypatch.setattr(line_dedup, "SHIPPED_IDS", 3)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_classes(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_very_long_lines_null_ids_and_clashing_columns(spark):
    long = "word " * 20_000
    docs = spark.createDataFrame([(1, long + "one", 1, 2), (2, long + "two", 3, 4), (None, long + "ore", 5, 6), (3, None, 7, 8)], "doc_id long, text string, key int, line int")
    got = {tuple(r) for r in dedup_lines(docs).collect()}
    assert got == {(None, long + "ore", 5, 6), (2, long + "two", 3, 4), (3, None, 7, 8)}
