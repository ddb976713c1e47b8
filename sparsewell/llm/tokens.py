"""Token ids of whole texts by the tokenizers library, which sees every distinct chunk once.

Texts are cut at single spaces between two characters that are no white space.
The pre-split of byte-level vocabularies never reaches over such a place, so a
text's ids are those of its chunks in a row.  Arrow cuts a batch, finds its
distinct chunks and puts their ids in a row; words that a worker has seen come
from its memory, which is bounded; all others go to the library.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import _byte_alphabet

#: Words and chunks in each of the two halves of a worker's memory and their characters (about 200 MB of a worker as measured), and chunks of one call of the library.
KNOWN_CHUNKS, KNOWN_CHARACTERS, CALL_CHUNKS = 1 << 18, 1 << 24, 1 << 12

_STAND_INS = {b: c for c, b in _byte_alphabet().items()}
_SPACE, _LINE = _STAND_INS[0x20], _STAND_INS[0x0A]
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]

#: Characters of the longest chunk that is kept in memory.
KNOWN_LENGTH = 1 << 10

#: ASCII marks without the apostrophe, which begins words of its own.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def _is_word(text: str) -> bool:
    """Whether a text is letters, perhaps behind one space."""
    return text.isalpha() or text[:1] == " " and text[1:].isalpha()


def _plain_words(chunk: str) -> list[str] | None:
    """Words of the pre-split of a chunk that is lines of letters, each perhaps behind one space and before marks; None for others."""
    out = []
    for k, line in enumerate(chunk.split("\n")):
        letters = line.rstrip(_MARKS)
        if not _is_word(letters):
            return None
        if k:
            out.append("\n")
        out.append(letters)
        if len(letters) < len(line):
            out.append(line[len(letters) :])
    return out


def _spelled(word: str) -> str:
    """A plain word in the letters that stand for its bytes; those of ASCII letters and marks are themselves."""
    if word.isascii():
        return word.replace(" ", _SPACE).replace("\n", _LINE)
    return word.encode().decode("latin-1").translate(_STAND_INS)


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class ChunkEncoder:
    """Encoder of one vocabulary file; ``special``: strings of added tokens in a text are those tokens, else they are plain text."""

    # a space beside white space (what Python and Unicode take for it), in Arrow's syntax
    _BLANK = r"[\t-\r\x1c-\x1f\x{85}\pZ]"
    _BESIDE = f" {_BLANK}|{_BLANK} "
    _SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = not special
        # what is still met moves from the old half of the memory to the new one, the rest goes with the old half
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._characters = 0

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
        """The chunks of texts, all but the first without the space before them, and the places of the texts in these lists if they moved."""
        odd = pc.match_substring_regex(texts, self._BESIDE)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " "), None
        cut = pa.array(map(self._SAFE.split, texts.filter(odd).to_pylist()), pa.list_(pa.string()))
        lists = pa.concat_arrays([pc.split_pattern(texts.filter(pc.invert(odd)), " "), cut])
        return lists, np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))

    def _remember(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= KNOWN_LENGTH:
            self._known[chunk] = ids
            self._characters += len(chunk)

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; those whose pre-split is plain to see are put together from words, which go to the library's merge model."""
        if len(self._known) > KNOWN_CHUNKS or self._characters > KNOWN_CHARACTERS:
            self._old, self._known, self._characters = self._known, {}, 0
        merge, known, old, remember = self._tokenizer.model.tokenize, self._known, self._old, self._remember

        def word_ids(word: str) -> bytes:
            ids = known.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = _packed([t.id for t in merge(_spelled(word))])
                remember(word, ids)
            return ids

        out = list(map(known.get, chunks))
        others = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            c = chunks[k]
            ids = old.get(c)
            if ids is not None:
                remember(c, ids)
                out[k] = ids
            elif _is_word(c):
                out[k] = word_ids(c)
            elif words := _plain_words(c):
                out[k] = b"".join(map(word_ids, words))
                # several lines in one chunk hardly come again
                if len(words) == 2:
                    remember(c, out[k])
            else:
                others.append(k)
        for at in range(0, len(others), CALL_CHUNKS):
            part = others[at : at + CALL_CHUNKS]
            for k, e in zip(part, self._tokenizer.encode_batch_fast([chunks[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
                remember(chunks[k], out[k])
        return out

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of whole texts as little-endian unsigned 32-bit integers; none for null and empty texts."""
        lists, order = self._chunks(texts.cast(pa.string()).fill_null(""))
        flat, bounds = lists.flatten(), np.asarray(lists.offsets)
        # no list is empty; a first chunk has no space before it
        later = np.ones(len(flat), bool)
        later[bounds[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        distinct = pc.binary_join_element_wise(" ", coded.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        at = np.empty(len(flat), np.int64)
        at[later] = coded.indices.to_numpy()
        at[~later] = np.arange(len(lists)) + len(distinct)
        ids = self._look_up(distinct + flat.filter(pa.array(~later)).to_pylist())
        row = pa.array(ids, pa.binary()).take(pa.array(at))
        _, ends, data = row.buffers()
        ends = np.frombuffer(ends, np.int32, len(row) + 1, 4 * row.offset) if len(row) else np.zeros(1, np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[bounds]), data or pa.py_buffer(b"")])
        return out if order is None else out.take(pa.array(order))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """``encode_column`` for a list."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=4)
def encoder(path: str, special: bool) -> ChunkEncoder:
    """One encoder per vocabulary and Python process."""
    return ChunkEncoder(path, special)
