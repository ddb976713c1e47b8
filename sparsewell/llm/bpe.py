"""Byte-level BPE by a tokenization automaton.

A merge list is compiled into a deterministic automaton over *tokens*.  The
start is one state with a loop for every byte.  Each merge ``(u, v) -> uv``
then applies one gadget, in rank order:

* the state behind ``u`` is copied without its arc ``v``; arcs ``u`` lead to the copy;
* every state that could read ``u v`` gets an arc ``uv`` to the state behind ``v``.

The state behind a token depends on that token alone, so a gadget adds exactly
one state: ``(state it was copied from, removed label, rank)``.  After all
merges the automaton accepts exactly one token sequence per byte string: the
one BPE yields.  For table-driven runs over bytes it is made deterministic in
bytes as well: a row stands for the arcs under way together with the states
they left from, and exactly one arc ends at every byte.  Rows are filled in on
first use and forgotten together when there are too many.  Encoding follows
one transition per byte, then reads the ended arcs backwards; decoding emits
the label of each arc.

Pre-splitting cuts texts at spaces between two non-space characters first (a
pattern match never reaches over such a place), so most work is one dictionary
lookup per chunk; both caches are bounded.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tokenizer_path

#: Fixed value: the pre-split pattern that byte-level BPE vocabularies of this kind are defined with.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries a worker keeps in each of its caches (about 100 MB in all).
CACHE_ENTRIES = 1 << 18

#: Rows of the byte transition table a worker keeps (about 150 MB).
TABLE_ROWS = 200_000

_NO_RANK = 1 << 40


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic token automaton of a merge list.

    ``tokens`` maps a token's bytes to its id, ``merges`` lists pairs of token
    bytes in rank order.  State 0 reads every byte; state ``k`` is what the
    gadget of the merge with rank ``k`` adds: a copy of ``parent[k]`` without
    the arc ``removed[k]``.  ``behind[t]`` is the state that arcs ``t`` lead to.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        top = max(tokens.values()) + 1
        self.parent, self.removed = [0], [-1]
        self.behind = [0] * top
        self.left, self.right, self.born = [-1] * top, [-1] * top, [0] * top
        self._vanishes: dict[int, int] = {}
        # tokens that no sequence of merges reaches get no arc and are never emitted
        self.ids = {t: i for t, i in tokens.items() if len(t) == 1}
        for rank, (u, v) in enumerate(merges, 1):
            self._gadget(rank, u, v, tokens)
        self._build_trie()
        self._start_over()

    def _gadget(self, rank: int, u_label: bytes, v_label: bytes, tokens: dict[bytes, int]) -> None:
        u, v, uv = tokens[u_label], tokens[v_label], tokens[u_label + v_label]
        reached = u_label in self.ids and v_label in self.ids and self._reads(u, v)
        self.behind[uv] = self.behind[v]
        self.parent.append(self.behind[u])
        self.removed.append(v)
        self.behind[u] = rank
        self._vanishes[u << 20 | v] = rank
        self.left[uv], self.right[uv], self.born[uv] = u, v, rank
        if reached:
            self.ids[u_label + v_label] = uv

    def _reads(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc ``token``.

        The states on the way from 0 to ``behind[last]`` stem from merges whose
        left part is ``last``, or before its birth the right part of ``last``,
        and so on.  An arc of a merged token was added where its left part's
        arc was there at that rank, so a removal of the left part counts if it
        came no later.
        """
        vanishes, left, right, born = self._vanishes.get, self.left, self.right, self.born
        x, until_x = last, _NO_RANK
        while x >= 0:
            y, until_y = token, _NO_RANK
            while y >= 0:
                k = vanishes(x << 20 | y)
                if k is not None and k < until_x and k <= until_y:
                    return False
                y, until_y = left[y], born[y]
            x, until_x = right[x], born[x]
        return True

    def _build_trie(self) -> None:
        """Bytes of all labels as a trie, to follow the arcs that are under way."""
        step: dict[int, int] = {}
        token_at: list[int] = [-1]
        for label, i in self.ids.items():
            node = 0
            for b in label:
                nxt = step.get(node << 8 | b)
                if nxt is None:
                    nxt = step[node << 8 | b] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        self._step, self._token_at = step, token_at
        self._size = {i: len(t) for t, i in self.ids.items()}

    def _start_over(self) -> None:
        self._known: dict[tuple, _Row] = {}
        self._last_of: dict[int, int] = {}
        self._start = _Row(self, ((0, -1),), -1, 0)

    def _row_after(self, row: _Row, b: int) -> _Row:
        """Table row reached from ``row`` by byte ``b``."""
        step, token_at, reads = self._step.get, self._token_at, self._reads
        under_way, ends = [], -1
        for node, last in row.under_way:
            nxt = step(node << 8 | b)
            if nxt is None:
                continue
            under_way.append((nxt, last))
            token = token_at[nxt]
            # the prefix has one accepted sequence, so at most one arc ends here
            if ends < 0 and token >= 0 and (last < 0 or reads(last, token)):
                ends = token
        if ends < 0:
            raise ValueError("the vocabulary does not cover all bytes")
        under_way.append((0, self._last_of.setdefault(self.behind[ends], ends)))
        key = (tuple(under_way), ends)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = _Row(self, key[0], ends, self._size[ends])
        row[b] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted token sequence whose labels concatenate to ``word``."""
        if len(self._known) > TABLE_ROWS:
            self._start_over()
        rows = list(accumulate(word, getitem, initial=self._start))
        i, out = len(word), []
        while i:
            row = rows[i]
            out.append(row.token)
            i -= row.size
        out.reverse()
        return out


class _Row(dict):
    """One row of the byte transition table: next row by byte, filled in on first use.

    ``under_way`` lists arcs begun but not ended as (trie node, token before),
    ``token`` is the arc that ends here, ``size`` its length in bytes.
    """

    __slots__ = ("automaton", "under_way", "token", "size")

    def __init__(self, automaton: MergeAutomaton, under_way: tuple, token: int, size: int):
        super().__init__()
        self.automaton, self.under_way, self.token, self.size = automaton, under_way, token, size

    def __missing__(self, b: int) -> _Row:
        return self.automaton._row_after(self, b)


class _Bounded(dict):
    """Dictionary that computes missing values and keeps the two latest generations of entries."""

    def __init__(self, make, limit: int = CACHE_ENTRIES // 2):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:  # long chunks rarely come twice
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BpeCodec:
    """Encoder and decoder of one vocabulary file (byte-level BPE in JSON form)."""

    _TIGHT = re.compile(r"\s | \s")
    _SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(vocab, [(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.added = added
        self._added_re = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.n_ids = max([*vocab.values(), *added.values()]) + 1
        self._labels = [b""] * self.n_ids
        for label, i in vocab.items():
            self._labels[i] = label
        for label, i in added.items():
            self._labels[i] = label.encode()
        self._split = regex.compile(PRE_SPLIT).findall
        self._word = _Bounded(lambda w: self._pack(self.automaton.encode_word(w.encode())))
        self._first = _Bounded(self._chunk)
        self._later = _Bounded(lambda c: self._chunk(" " + c))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return self._pack(self.automaton.encode_word(chunk.encode()))
        word = self._word
        return b"".join([word[w] for w in self._split(chunk)])

    def _ordinary(self, text: str) -> bytes:
        chunks = text.split(" ") if self._TIGHT.search(text) is None else self._SAFE.split(text)
        first = self._first[chunks[0]]
        later = self._later
        return first + b"".join([later[c] for c in chunks[1:]])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._added_re is None or not any(a in text for a in self.added):
            return self._ordinary(text)
        out = []
        for part in self._added_re.split(text):
            out.append(self._pack([self.added[part]]) if part in self.added else self._ordinary(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Concatenated arc labels of packed ids as text (malformed UTF-8 becomes U+FFFD)."""
        labels = self._labels
        return b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """One codec per vocabulary and Python process."""
    return BpeCodec(path)


def encode_documents(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per input row: the id column as ``doc_id``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``.  A null text
    counts as empty (no ids, decoded ''); a null id stays null; repeated rows
    give repeated results; other input columns are ignored whatever their
    names; an empty table gives an empty table.  Texts are read whole.
    """
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([c.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def bpe_digests(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """Digest form of ``encode_documents``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken where ids and texts are made, so neither leaves the
    Python worker.  Edge cases are those of ``encode_documents``.
    """
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
