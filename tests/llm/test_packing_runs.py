"""Texts with very long white space runs are packed like any other."""

import numpy as np
import pytest
from test_llm import VOCAB, docs, tokenizer, unpacked  # noqa: F401

from sparsewell.llm import packing
from sparsewell.llm.tokens import encoder

RUN = 1 << 16
LONG = "a\n" + "\n" * 1_200_000 + "b <|endoftext|> c"


@pytest.mark.parametrize("text", [LONG, " " * (RUN - 1) + "x", "\t" * RUN, "x \r" + " \n" * RUN + "y"], ids=["newlines", "below", "at", "mixed"])
def test_ids_of_long_runs(tokenizer, text):  # noqa: F811
    assert unpacked(encoder(VOCAB, True).encode([text])[0]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_run_is_packed_whole(spark, tokenizer):  # noqa: F811
    pieces = sorted(packing.pack_documents(docs(spark, [LONG]), VOCAB).collect(), key=lambda p: p.start)
    assert np.array_equal([x for p in pieces for x in unpacked(p.ids)], [*tokenizer.encode(LONG, add_special_tokens=False).ids, 0])
