import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm.packing import WordEncoder, pack, plan, sequences

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["one", "large", "mixed", "small"])
def test_plan_is_whole_gapless_and_tight(kind):
    rng = np.random.default_rng(1)
    lengths = {"one": np.array([7]), "large": rng.integers(500, 1100, 300), "mixed": np.clip(rng.lognormal(6.8, 0.9, 20000).astype(int), 1, 2048), "small": rng.integers(1, 90, 3000)}[kind]
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    inside, placed = {}, {}
    for length, first, n, offset in plan(counts, 2048):
        placed[length] = placed.get(length, 0) + n
        for s in range(first, first + n):
            inside.setdefault(s, []).append((offset, length))
    assert placed == counts
    for parts in inside.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(inside) <= 1.06 * -(-int(lengths.sum()) // 2048) + 1


def test_words_give_the_ids_of_whole_texts():
    texts = ["Hello, wörld! it's 123 <|endoftext|> x", "é ́a b c\x1cd", "ΣΑΣ " + "x" * 300, "", None, "a\u0085b  c\n\nd", "İI ß ½² x\u0301 don't WE'LL ...!? 日本語 a_b\x1fc Ⅷ ٣", "<|endoftext|", "tail\u200b\ufeffx\xa0y"]
    encoder = WordEncoder(PATH)
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_round_trip(docs_of):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "Béta", "12", "x-y"]) for _ in range(rng.choice([0, 3, 50, 900, 5000]))) for _ in range(30)] + [None, ""]
    docs = docs_of(texts)
    rows = pack(docs, PATH, with_ids=True).collect()
    encoder = WordEncoder(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 <= 2048
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == encoder.encode([t])[0].tobytes() + b"\0\0\0\0"
        assert [r.start for r in own] == [2048 * k for k in range(len(own))]
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    whole = {r.sequence_id: len(r.ids) // 4 for r in sequences(pack(docs, PATH, with_ids=True)).collect()}
    assert sum(whole.values()) == sum(r.length for r in rows) and max(whole.values()) <= 2048


def test_empty_table_and_repeated_rows(docs_of):
    assert pack(docs_of([]), PATH).count() == 0
    assert [(r.doc_id, r.length) for r in pack(docs_of([(1, "a"), (1, "a")]), PATH).collect()] == [(1, 2), (1, 2)]


def test_workers_do_not_parse_the_tokenizer_file(monkeypatch):
    """The driver reads the rules once; a worker that parsed them would hold the whole file as objects."""
    from skein.llm import packing

    run = packing._pieces(PATH, 0, 2048, False)
    monkeypatch.setattr(packing, "_cuts_words", None)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["two words"])], names=["doc_id", "text"])
    assert [b.num_rows for b in run(iter([batch]))] == [1]
