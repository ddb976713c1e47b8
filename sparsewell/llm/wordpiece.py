"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two entrances: pieces that start a word and
pieces that continue one.  Every trie node has a failure link and the number
of pieces that are popped when the link is followed, both precomputed breadth
first, so that a word's number of greedy longest-match pieces comes from one
pass over its bytes: neither pieces nor candidate substrings are built.

The vocabulary comes from a byte-level vocabulary file: labels that begin with
a space start a word, all other labels continue one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Bounded, _byte_alphabet
from .common import bounded_batches, tokenizer_path

#: Entries of the word cache of a worker.
CACHE_ENTRIES = 1 << 18


class LongestMatchAutomaton:
    """Piece counts of words over ``starting`` and ``continuing`` pieces.

    A word that the pieces do not cover counts as one unknown piece.
    """

    def __init__(self, starting: Iterable[bytes], continuing: Iterable[bytes]):
        # node 0: entrance of words, node 1: entrance of continuations
        self.step: dict[int, int] = {}
        ends: list[bool] = [False, False]
        depth_order: list[list[tuple[int, int, int]]] = []  # by depth: (parent, byte, node)
        for entrance, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = entrance
                for d, b in enumerate(piece):
                    nxt = self.step.get(node << 8 | b)
                    if nxt is None:
                        nxt = self.step[node << 8 | b] = len(ends)
                        ends.append(False)
                        if d == len(depth_order):
                            depth_order.append([])
                        depth_order[d].append((node, b, nxt))
                    node = nxt
                if piece:
                    ends[node] = True
        self.fail = [-1] * len(ends)
        self.pops = [0] * len(ends)
        for level in depth_order:
            for parent, b, node in level:
                if ends[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                popped, z = self.pops[parent], self.fail[parent]
                while z >= 0 and (z << 8 | b) not in self.step:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.pops[node] = self.step[z << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of ``word``."""
        step, fail, pops = self.step.get, self.fail, self.pops
        node, n = 0, 0
        for b in word:
            nxt = step(node << 8 | b)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = step(node << 8 | b)
            node = nxt
        while node > 1:
            n += pops[node]
            node = fail[node]
        return n if node == 1 else 1


@lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatchAutomaton:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    labels = [bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)]
    return LongestMatchAutomaton([t for t in labels if t[:1] == b" "], [t for t in labels if t[:1] != b" "])


@lru_cache(maxsize=2)
def _counter(path: str) -> _Bounded:
    automaton = _automaton(path)
    return _Bounded(lambda word: automaton.count(b" " + word), CACHE_ENTRIES // 2)


def token_counts(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word-piece length of every whole text.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r.  Returns one row
    per input row: the id as ``doc_id``, ``n_words`` and ``n_tokens`` (long).
    Null and blank texts count 0 words and 0 tokens; a null id stays null;
    repeated rows give repeated results; words of any length are counted in
    full; other columns are ignored; an empty table gives an empty table.
    """
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(path)
        for b in batches:
            n_words, n_tokens = [], []
            for text in b.column(1).to_pylist():
                words = text.encode().split() if text else []
                n_words.append(len(words))
                n_tokens.append(sum([counts[w] for w in words]))
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
