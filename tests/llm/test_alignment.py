"""Token alignment against a plain walk over all tokens, and the chunked encoder against the library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparsewell.llm import alignment, tokens
from sparsewell.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
rnd = random.Random(11)
WORDS = "the thing ing naïve ñandú 日本語 😀 Hello, it's foo\nbar\t 1234 e e e <|endoftext|> <s> <0x41> ▁ zzzzqq".split(" ")
TEXTS = [None, "", " ", "x", "▁", "a▁b", "\n", "   two  spaces ", "\x00", "ab" * 4000, "日本" * 500, "<|endoftext|> </s>", "the " * 3000] + [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))) for _ in range(80)]


def token_bytes():
    import json

    import sentencepiece

    from sparsewell.llm.bpe import _byte_alphabet

    alphabet = _byte_alphabet()
    vocab = json.load(open(A, encoding="utf-8"))["model"]["vocab"]
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return {i: bytes(alphabet.get(c, 0) for c in t) for t, i in vocab.items()}, b, piece


def spans(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(size[i])))
        at += len(size[i])
    return out


def brute(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    bytes_a, sp, piece = token_bytes()
    docs, held = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        bytes_b = {i: piece(sp.id_to_piece(i)) for i in b}
        if not text or b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            docs.append(None)
            continue
        sa, sb = spans(a, bytes_a), spans(b, bytes_b)
        cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, k, m = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while k < len(sa) and sa[k][2] <= cut:
                ga.append(sa[k])
                k += 1
            while m < len(sb) and sb[m][2] <= cut:
                gb.append(sb[m])
                m += 1
            groups.append((ga, gb))
        links = [(x[0], y[0]) for ga, gb in groups for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        held.update(set(links))
        docs.append((len(a), len(b), groups, links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(y[0]) for y in gb) for ga, gb in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("groups", [1 << 18, 50])
def test_rows(spark, monkeypatch, groups):
    monkeypatch.setattr(alignment, "SHARE_GROUPS", groups)
    monkeypatch.setattr(alignment, "TOGETHER_BYTES", 2000 if groups == 50 else 1 << 20)
    texts = TEXTS + TEXTS[3:20] + TEXTS[3:5]
    ids = [i if i not in (5, 30) else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, key string, n long").repartition(3)
    got = alignment.align_documents(df)
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is None, x or 0) for x in r if not isinstance(x, str)) + (r[-1],)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, *r) for i, r in zip(ids, brute(texts), strict=True)), key=key)


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in alignment.align_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_hashes_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "_mixed", lambda x, seed: x & np.uint64(3 if seed % 2 else 0xFFFFFFFF) if seed == 0x243F6A8885A308D3 else x * np.uint64(2654435761))
    ids = np.arange(8)
    x = alignment._Aligned(ids, ids + 1, ids, ids + 1)
    first, number = x.numbered()
    assert len(first) == 8 and (ids[first][number] == ids).all()


@pytest.mark.parametrize("special", [True, False])
def test_chunked_encoder_equals_library(monkeypatch, special):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KNOWN_CHUNKS", 100)
    monkeypatch.setattr(tokens, "CALL_CHUNKS", 7)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = not special
    alphabet = list("aaabttheé \n'sdl01.,!ñ日 ſ²\x1c\x85\xa0\x00\t\r ") + ["<|endoftext|>", " the", "ing", "\r\n", "'re", " <|endoftext|> ", "  "]
    texts = [*TEXTS, " " * 100_000, "\n" * 100_000 + "x", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(2000))]
    own = tokens.ChunkEncoder(A, special)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], own.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
