"""Token ids of columns: every plain word goes to the library once, whatever stands behind it and however batches are cut."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from test_llm import TEXTS, VOCAB, docs, tokenizer, unpacked  # noqa: F401

from sparsewell.llm import packing, tokens


def test_a_word_goes_to_the_library_once():
    own = tokens.ChunkEncoder(VOCAB, True)
    library, asked = own._tokenizer, []

    def merge(word):
        asked.append(word)
        return library.model.tokenize(word)

    own._tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=merge), encode_batch_fast=library.encode_batch_fast)
    text = "go where there is, and there is. And there\nis where, where\nthere. where"
    got = own.encode([text, text])
    assert got[0] == got[1] and unpacked(got[0]) == library.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted({"go", "is", "there", ",", ".", "Ċ", "Ġwhere", "Ġthere", "Ġis", "Ġand", "ĠAnd"})
    assert not own.encode([]) and own.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("limit", [None, 3])
def test_columns_equal_library(tokenizer, monkeypatch, limit):  # noqa: F811
    if limit:  # halves of the memory change all the time
        monkeypatch.setattr(tokens, "KNOWN_CHUNKS", limit)
        monkeypatch.setattr(tokens, "KNOWN_LENGTH", limit)
    rnd = random.Random(5)
    parts = [*"aaBé日😀ſ²Ⅷ1.,'!\n\t\r\x0b\x1c\x1f\x85", *[" ", " ", " ", " ", "　", " the", "  ", " ", " ", " ", "'s", "word", "<|endoftext|>", "\r\n", "\n ", " \n"]]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    own = tokens.ChunkEncoder(VOCAB, True)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 7, 500, len(texts)):
        column = pa.array(texts, pa.string())
        got = [x for at in range(0, len(texts), size) for x in own.encode_column(column.slice(at, size)).to_pylist()]
        assert [unpacked(x) for x in got] == want
    plain = tokens.ChunkEncoder(VOCAB, False)
    tokenizer.encode_special_tokens = True
    try:
        assert [unpacked(x) for x in plain.encode(texts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    finally:
        tokenizer.encode_special_tokens = False


def test_batches_of_a_share_are_gapless(spark, tokenizer):  # noqa: F811
    texts = [*TEXTS[:5], *(f"text {i} of some,  more\nor few words " * (i % 40) for i in range(2500))]
    df = docs(spark, texts).where("doc_id is not null").repartition(2)
    pieces = sorted(packing.pack_documents(df, VOCAB).collect(), key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in pieces:
        assert (p.sequence_id, p.offset) == divmod(at, packing.WINDOW)
        at += p.length
    for i in (0, 1, 3, 4, 5, 600, 1033, 2504):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in unpacked(p.ids)] == [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
    assert len({p.doc_id for p in pieces}) == len(texts) - 1
