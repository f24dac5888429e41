"""Byte-level BPE against the public library of the same vocabulary, and the perfect hash."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import byte_bpe
from skein.llm.queries import op12_byte_bpe, tokenizer_path

VOCABULARY = byte_bpe.Vocabulary.of_ranks(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ENCODER = byte_bpe.Encoder(VOCABULARY)
TOGETHER = byte_bpe.Encoder(VOCABULARY, together=True)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@pytest.mark.parametrize("count", [1, 2, 7, 1000])
def test_perfect_hash_is_minimal_and_finds_every_key(count):
    keys = [f"key {i}".encode() for i in range(count)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.key_at.tolist()) == list(range(count)) and table.find(keys).tolist() == list(range(count))
    assert set(table.find([b"", b"other"]).tolist()) <= set(range(count))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"b", b"a"])


def test_both_files_give_the_same_vocabulary():
    other = byte_bpe.Vocabulary.of_json(tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert other.tokens == VOCABULARY.tokens


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_as_the_library_encodes_it(text):
    ids = ENCODER.encode([text])[0]
    assert ids.tolist() == TOGETHER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text) and ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 6000, "ab" * 3000, " " * 6000, "\n \t" * 2000, "é日本" * 2000, "<|endoftext|>", "don't  stop\r\n\r\n 12345"])
def test_long_pieces_and_odd_texts(text):
    assert ENCODER.encode([text])[0].tolist() == TOGETHER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_stretches_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n'sé1!") for _ in range(rng.randrange(600))) for _ in range(60)]
    assert any(len(byte_bpe.stretches(t)) > 2 for t in texts)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 7)
    for own in (ENCODER, TOGETHER):
        assert [i.tolist() for i in own.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_memo_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    own = byte_bpe.Encoder(VOCABULARY)
    texts = [f"xqz{i} wvk{i % 5}qq" for i in range(40)]
    assert [i.tolist() for i in own.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, "ein Wort", "x", 5), (1, "ein Wort", "y", 6), (None, "two words", "z", 7), (2, None, None, None), (3, "", "", 0), (4, "w " * 100_000, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, VOCABULARY).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    assert byte_bpe.digests(docs.limit(0), VOCABULARY).count() == 0
    encoded = byte_bpe.encode(docs, VOCABULARY)
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in byte_bpe.decode(encoded, VOCABULARY).collect()) == sorted((i or 0, (t or "").encode()) for i, t, _, _ in rows)


def test_query_on_the_whole_table(spark, sf):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = LIBRARY.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
