"""Alignment of two tokenizers against a plain comparison of byte ranges by the public libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from skein.llm import byte_bpe, token_alignment
from skein.llm.queries import op11_token_alignment, tokenizer_path

A = byte_bpe.Vocabulary.of_json(tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
PAIR = token_alignment.Pair.of_files(A, tokenizer_path("piece_bpe_32k.model"))


def brute(rows):
    """Rows (doc_id, text) -> sorted results, by the libraries and all pairs of overlapping ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    signs = byte_bpe.byte_signs()
    found, count = [], Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            ids_a, ids_b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            bytes_a = [bytes(signs[c] for c in a_side.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                for ids, parts, out in ((ids_a, bytes_a, a), (ids_b, bytes_b, b)):
                    at = 0
                    for i, p in zip(ids, parts):
                        out.append((i, at, at + len(p)))
                        at += len(p)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(set(links))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [[[str(t[0]) for t in side if lo < t[2] <= hi] for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        text_of = ";".join(",".join(g[0]) + "|" + ",".join(g[1]) for g in groups)
        found.append((doc_id, a, b, groups, links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(
        (d or 0, len(a), len(b), len(g), len(ls), sum(count[x] == most[x[0]] for x in ls), sum(count[x] for x in ls), sha) for d, a, b, g, ls, sha in found
    )


def results(df):
    return sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def sample():
    rng = random.Random(6)
    words = "the house wortreich éléphant 日本 naïve 12345 don't ▁odd <|endoftext|> <s> \t\n    ﬁn x́ \U0001f600".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    return [*rows, (3, rows[3][1]), (None, "plain words here"), (70, None), (71, ""), (72, " "), (73, "a  b   c"), (74, " lead"), (75, "trail ")]


@pytest.mark.parametrize("head", [token_alignment.HEAD, 40, 0])
def test_every_head_gives_the_plain_result(spark, head):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, links string, n_a int").repartition(3)
    assert results(token_alignment.alignments(docs, PAIR, head=head)) == brute(rows)


def test_words_one_by_one_and_small_parts_change_nothing(spark, monkeypatch):
    rows = [(i, t * 5 if t else t) for i, t in sample()] + [(i, t) for i, t in enumerate(["a  b", " a", "a ", "  a  ", "a\n b", "x\t y", "x \n\n y \n", " \n\t z\r\n q", "\n a", "a \u00a0 b", "▁ a ▁", "a" * 90])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(byte_bpe, "LONG", 40)
    monkeypatch.setattr(token_alignment, "BLOCK", 7)
    own = token_alignment.Sides(PAIR)
    assert own.parts
    flat_a, n_a, flat_b, n_b, sizes = own.encode([t for _, t in rows])
    at_a = at_b = 0
    for (_, text), a, b, size in zip(rows, n_a, n_b, sizes):
        ids_a, ids_b = flat_a[at_a : at_a + a].tolist(), flat_b[at_b : at_b + b].tolist()
        at_a, at_b = at_a + a, at_b + b
        whole = own.model.encode(text or "")
        if text and b"".join(map(own.bytes_b.__getitem__, whole)) == (" " + text).encode():
            assert ids_b == whole and ids_a == own.encoder.encode([" " + text])[0].tolist() and size == len((" " + text).encode())
        else:
            assert a == b == size == 0
    monkeypatch.setattr(token_alignment, "HELD", 10)
    assert results(token_alignment.alignments(docs, PAIR)) == brute(rows)


def test_links_are_packed_without_loss():
    import numpy as np

    keys, times = np.array([0, 5, 1 << 31, (1 << 32) - 1]), np.array([1, 70_000, 2, 3])
    got = token_alignment.unpack_links([token_alignment.pack_links(keys, times), None, token_alignment.pack_links(keys[:0], times[:0]), token_alignment.pack_links(keys[1:2], times[1:2])])
    assert got[0].tolist() == [*keys.tolist(), 5] and got[1].tolist() == [*times.tolist(), 70_000] and got[2].tolist() == [4, 0, 0, 1]


def test_empty_table_and_one_long_text(spark, docs_of):
    assert token_alignment.alignments(docs_of([]), PAIR).count() == 0
    long = "long words of one text " * 40_000
    row = token_alignment.alignments(docs_of([long]), PAIR).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 100_000 and row.n_best == row.n_links


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000").collect()]
    got = results(op11_token_alignment(spark, sf))
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    want = {r[0]: r for r in brute(rows)}
    # counts run over the whole table, all other columns over one document
    assert all((*want[r[0]][:5], want[r[0]][7]) == (*r[:5], r[7]) for r in got if r[0] in want)
