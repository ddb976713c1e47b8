"""Cross-tokenizer alignment through a dictionary of groups.

Two tokenizers cut the same bytes.  Offsets at which tokens of both end cut a
text into groups of A ids and B ids; inside a group every pair of tokens that
share bytes is a link.  A group's links follow from its ids alone, so:

1. Each task encodes its documents and interns their groups in a share's
   dictionary: a document becomes a list of group numbers with frequencies, the
   dictionary one row per distinct group with the documents that hold it.
2. The shares' dictionaries are summed by group, and every distinct group is
   expanded into its links once.  An id pair's documents are those of its groups,
   less those that hold it in several groups, which tasks count while they see
   a document whole.
3. Links meet their counts and the highest count of their A id (one row for each
   A id: bounded by the vocabulary) and are summed by group.
4. These results go back by group to the shares' dictionaries, and to the documents
   share by share.  A group as common as a blank stands once in each share,
   so it is no hot key, and no share's dictionary exceeds a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, tokenizer_path
from .tokens import encoder

#: Groups of a share's dictionary, and bytes of the group lists of its documents.
SHARE_GROUPS, SHARE_BYTES = 1 << 18, 32 << 20
#: Bytes of texts that are aligned together (more only if one text is larger).
TOGETHER_BYTES = 2 << 20
_DOCUMENT, _GROUP, _AGAIN = 0, 1, 2
_SPACE_MARK = "▁"
_U = np.uint64
_FIELDS = "kind int, share long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, places binary, times binary, place long, key binary, n long"


@lru_cache(maxsize=2)
def _tables(path_a: str, path_b: str) -> tuple:
    """Both tokenizers, the bytes of their tokens and the lengths of these."""
    import json

    import sentencepiece

    from .bpe import _byte_alphabet

    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    labels = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added} | added
    bytes_a = [labels.get(i, b"") for i in range(max(labels) + 1)]
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
    if max(len(bytes_a), len(bytes_b)) > 1 << 16:
        raise ValueError("ids are packed into 16 bits")
    return encoder(path_a, False), b, bytes_a, bytes_b, np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])


@lru_cache(maxsize=2)
def _strings(n_a: int, n_b: int) -> np.ndarray:
    """Decimal ids with what follows them: A ids before ',' and '|', B ids before ',' and ';' and nothing."""
    a, b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
    return np.array([*(x + "," for x in a), *(x + "|" for x in a), *(x + "," for x in b), *(x + ";" for x in b), *b], object)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ _U(seed)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class _Aligned:
    """Groups and links of texts in a row, given the ids and the ends (in bytes) of their tokens; the last ends are equal."""

    def __init__(self, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        # ends are marked byte by byte, which takes no search
        in_a, in_b = np.zeros((2, int(ends_a[-1]) + 1), bool)
        in_a[ends_a], in_b[ends_b] = True, True
        self.last_a, self.last_b = np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b])
        self.first_a = np.concatenate([[0], self.last_a[:-1] + 1])
        self.first_b = np.concatenate([[0], self.last_b[:-1] + 1])
        self.n_a, self.n_b = self.last_a - self.first_a + 1, self.last_b - self.first_b + 1
        # every stretch between two ends of either side lies in one token of each: that is one link
        cuts = np.flatnonzero(in_a | in_b)
        token_a, token_b = (np.cumsum(x) - x for x in (in_a[cuts].astype(np.int64), in_b[cuts].astype(np.int64)))
        self.pairs = ids_a[token_a].astype(np.int64) << 16 | ids_b[token_b].astype(np.int64)
        self.n_links = self.n_a + self.n_b - 1

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token in its group."""
        return (np.arange(len(i)) - np.repeat(first, n) for i, first, n in ((self.ids_a, self.first_a, self.n_a), (self.ids_b, self.first_b, self.n_b)))

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence of each distinct group, and the number of each group among them (128-bit hashes)."""
        at_a, at_b = self.inside()
        code_a = self.ids_a.astype(_U) | at_a.astype(_U) << _U(32)
        code_b = self.ids_b.astype(_U) | at_b.astype(_U) << _U(32) | _U(1 << 63)
        one, two = (np.add.reduceat(_mixed(code_a, s), self.first_a) + np.add.reduceat(_mixed(code_b, s), self.first_b) for s in (0x243F6A8885A308D3, 0x13198A2E03707344))
        _, first, number = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][number] != two).any():
            _, first, number = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
        return first, number.ravel()


def _written(x: _Aligned, closes: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Places in ``_strings`` of all tokens, A before B in each group; ``closes``: groups that end a document."""
    at_a, at_b = x.inside()
    base = np.cumsum(x.n_a + x.n_b) - x.n_a - x.n_b
    out = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
    kind_a = np.zeros(len(x.ids_a), np.int64)
    kind_a[x.last_a] = n_a
    out[np.repeat(base, x.n_a) + at_a] = x.ids_a + kind_a
    kind_b = np.full(len(x.ids_b), 2 * n_a)
    kind_b[x.last_b] += n_b
    kind_b[x.last_b[closes]] += n_b
    out[np.repeat(base + x.n_a, x.n_b) + at_b] = x.ids_b + kind_b
    return out


def _key(n_a: int, ids_a: bytes, ids_b: bytes) -> bytes:
    return n_a.to_bytes(4, "little") + ids_a + ids_b


class _Share:
    """Dictionary of one share: numbers of groups, documents by group, and documents that hold an id pair in several groups."""

    def __init__(self, share: int):
        self.share, self.number, self.bytes = share, {}, 0
        self.documents = np.zeros(1 << 12, np.int64)
        self.again: list[tuple[np.ndarray, np.ndarray]] = []

    def intern(self, x: _Aligned, first: np.ndarray) -> np.ndarray:
        """Numbers in this share of the groups at ``first``."""
        a, b = x.ids_a.astype("<u2"), x.ids_b.astype("<u2")
        spans = zip(x.first_a[first].tolist(), (x.last_a[first] + 1).tolist(), x.first_b[first].tolist(), (x.last_b[first] + 1).tolist(), strict=True)
        number = self.number
        out = np.array([number.setdefault(_key(j - i, a[i:j].tobytes(), b[k:m].tobytes()), len(number)) for i, j, k, m in spans], np.int64)
        if len(number) > len(self.documents):
            self.documents = np.concatenate([self.documents, np.zeros(max(len(number), len(self.documents)), np.int64)])
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The dictionary and the pairs to take off."""
        if self.number:
            yield _batch(len(self.number), kind=_GROUP, share=self.share, place=np.arange(len(self.number)), key=list(self.number), n=self.documents[: len(self.number)])
        if self.again:
            pairs, at = np.unique(np.concatenate([p for p, _ in self.again]), return_inverse=True)
            yield _batch(len(pairs), kind=_AGAIN, share=self.share, place=pairs, n=np.bincount(at.ravel(), np.concatenate([n for _, n in self.again])).astype(np.int64))


def _batch(size: int, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrays, names = [], []
    for name, kind in (x.split() for x in _FIELDS.split(", ")):
        value = columns.get(name)
        if value is None or isinstance(value, int):
            arrays.append(pa.nulls(size, kinds[kind]) if value is None else pa.array(np.full(size, value), kinds[kind]))
        else:
            arrays.append(pa.array(value, kinds[kind]))
        names.append(name)
    return pa.record_batch(arrays, names=names)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows, in pieces of about TOGETHER_BYTES."""
    for b in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or "")
            if held >= TOGETHER_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _encoded(texts: list[str | None], tables: tuple) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """A and B ids of each text; none where they do not spell a space and the text."""
    a, b, bytes_a, bytes_b, _, _ = tables
    there = [k for k, t in enumerate(texts) if t]
    out: list = [None] * len(texts)
    for k, ids_a, ids_b in zip(there, a.encode([" " + texts[k] for k in there]), b.encode([texts[k] for k in there], num_threads=1), strict=True):
        ids_a, want = np.frombuffer(ids_a, "<u4"), b" " + texts[k].encode()
        if b"".join([bytes_b[i] for i in ids_b]) == want and b"".join([bytes_a[i] for i in ids_a.tolist()]) == want:
            out[k] = (ids_a, np.array(ids_b, "<u4"))
    return out


def _shares(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents as lists of groups, with their shares' dictionaries; see ``_FIELDS``."""
    bounded_batches(docs.sparkSession)

    def aligned(ids: list, texts: list, share: _Share, tables: tuple) -> Iterator[pa.RecordBatch]:
        found = _encoded(texts, tables)
        none = [i for i, f in zip(ids, found, strict=True) if f is None]
        if none:
            yield _batch(len(none), kind=_DOCUMENT, share=share.share, doc_id=none, n_a=0, n_b=0, n_groups=0, groups_sha256=[""] * len(none), places=[b""] * len(none), times=[b""] * len(none))
        ids, found = [i for i, f in zip(ids, found, strict=True) if f], [f for f in found if f]
        if not ids:
            return
        n_a, n_b = (np.array([len(f[side]) for f in found]) for side in (0, 1))
        ids_a, ids_b = (np.concatenate([f[side] for f in found]).astype(np.int64) for side in (0, 1))
        x = _Aligned(ids_a, np.cumsum(tables[4][ids_a]), ids_b, np.cumsum(tables[5][ids_b]))
        first, number = x.numbered()
        local = share.intern(x, first)
        closes = np.searchsorted(x.last_a, np.cumsum(n_a) - 1)  # a text's last token ends a group
        n_groups = np.diff(closes, prepend=-1)
        doc = np.repeat(np.arange(len(ids)), n_groups)
        held, times = np.unique(doc * len(first) + number, return_counts=True)
        which = local[held % len(first)]
        share.documents += np.bincount(which, minlength=len(share.documents))
        # pairs of a document that stand in more than one of its distinct groups
        names, pair = np.unique(x.pairs, return_inverse=True)
        stands = np.unique((np.repeat(doc, x.n_links) * len(names) + pair.ravel()) * len(first) + np.repeat(number, x.n_links)) // len(first)
        pairs, groups = np.unique(stands, return_counts=True)
        if (groups > 1).any():
            more, at = np.unique(pairs[groups > 1] % len(names), return_inverse=True)
            share.again.append((names[more], np.bincount(at.ravel(), groups[groups > 1] - 1)))
        strings = _strings(len(tables[2]), len(tables[3]))[_written(x, closes, len(tables[2]), len(tables[3]))]
        ends = np.cumsum(n_a + n_b)
        sha = [hashlib.sha256("".join(strings[e - n : e].tolist()).encode()).hexdigest() for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
        bounds = np.searchsorted(held, np.arange(len(ids) + 1) * len(first))
        lists = [[v[i:j].astype("<u4").tobytes() for i, j in zip(bounds, bounds[1:], strict=False)] for v in (which, times)]
        share.bytes += 8 * len(held)
        yield _batch(len(ids), kind=_DOCUMENT, share=share.share, doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=sha, places=lists[0], times=lists[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(path_a, path_b)
        begun, task = 0, TaskContext.get().partitionId()
        share = _Share(task << 24)
        for ids, texts in _together(batches):
            yield from aligned(ids, texts, share, tables)
            if len(share.number) >= SHARE_GROUPS or share.bytes >= SHARE_BYTES:
                yield from share.rows()
                begun += 1
                share = _Share(task << 24 | begun)
        yield from share.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _FIELDS)


def _links(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, pair, m, n): the distinct id pairs of each group (A id << 16 | B id), how often the group links them, and its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, _, len_a, len_b = _tables(path_a, path_b)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            n_a = np.array([int.from_bytes(k[:4], "little") for k in keys])
            n = np.array([len(k) // 2 - 2 for k in keys])
            ids = np.frombuffer(b"".join([k[4:] for k in keys]), "<u2").astype(np.int64)
            is_a = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n_a, n)
            ids_a, ids_b = ids[is_a], ids[~is_a]
            x = _Aligned(ids_a, np.cumsum(len_a[ids_a]), ids_b, np.cumsum(len_b[ids_b]))
            # groups have no inner common ends, so they come back as they were
            group = np.repeat(np.arange(len(keys)), x.n_links)
            names, pair = np.unique(x.pairs, return_inverse=True)
            both, m = np.unique(group * len(names) + pair.ravel(), return_counts=True)
            group = both // len(names)
            yield pa.record_batch([b.column(0).take(pa.array(group)), pa.array(names[both % len(names)]), pa.array(m.astype(np.int64)), b.column(1).take(pa.array(group))], names=["key", "pair", "m", "n"])

    return groups.select("key", "n").mapInArrow(run, "key binary, pair long, m long, n long")


def _summed(rows: DataFrame) -> DataFrame:
    """Documents with n_links, n_best and count_sum; ``rows`` holds, by share, dictionary rows with results before documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, results = None, [], None
        for b in batches:
            shares, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.ones(b.num_rows, bool)
            change[1:] = (shares[1:] != shares[:-1]) | (kinds[1:] != kinds[:-1])
            bounds = [*np.flatnonzero(change).tolist(), b.num_rows]
            for start, end in zip(bounds, bounds[1:], strict=False):
                part = b.slice(start, end - start)
                if shares[start] != share:
                    share, held, results = shares[start], [], None
                if kinds[start] == _GROUP:
                    held.append(np.stack([part.column(c).to_numpy() for c in (2, 3, 4, 5)]))
                    continue
                if results is None:
                    got = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
                    results = np.zeros((3, int(got[0].max()) + 1 if got.size else 0), np.int64)
                    results[:, got[0]] = got[1:]
                sums = []
                for places, times in zip(part.column(10).to_pylist(), part.column(11).to_pylist(), strict=True):
                    sums.append((results[:, np.frombuffer(places, "<u4")] * np.frombuffer(times, "<u4").astype(np.int64)).sum(axis=1))
                sums = np.array(sums).reshape(-1, 3)
                yield pa.record_batch([part.column(6), part.column(7), part.column(8), part.column(9), *(pa.array(sums[:, c]) for c in range(3)), part.column(12)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Alignment of two tokenizers' tokens in every whole text.

    Returns one row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose count is the highest of their A id), count_sum (of all
    links) and groups_sha256.  A link's count is the number of rows whose text
    holds its id pair linked.  Null and empty texts, and those that a tokenizer
    does not spell out byte by byte, have no tokens: zeros and ''.  A null
    doc_id stays null; repeated rows give repeated results and count each;
    equal counts share the highest place; other columns are ignored; an empty
    table gives an empty table.
    """
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    shares = materialize(_shares(docs, path_a, path_b), "alignment-shares")
    entries = shares.where(F.col("kind") == _GROUP).select("share", "place", "key", "n")
    groups = entries.groupBy("key").agg(F.sum("n").alias("n"))
    links = materialize(_links(groups, path_a, path_b), "alignment-links")
    again = shares.where(F.col("kind") == _AGAIN).select(F.col("place").alias("pair"), (-F.col("n")).alias("n"))
    counts = materialize(links.select("pair", "n").unionAll(again).groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    # one row for each id of A
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("best"))
    ranked = counts.join(F.broadcast(best), F.shiftright("pair", 16) == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"))
    results = links.join(ranked, "pair").groupBy("key").agg(F.sum("m").alias("n_links"), F.sum(F.col("m") * F.col("is_best")).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    results = materialize(results, "alignment-results")
    none = F.lit(None)
    front = entries.join(results, "key").select("share", F.lit(_GROUP).alias("kind"), "place", "n_links", "n_best", "count_sum", *(none.cast("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(none.cast("binary").alias(c) for c in ("places", "times")), none.cast("string").alias("groups_sha256"))
    rows = shares.where(F.col("kind") == _DOCUMENT).select("share", F.lit(_DOCUMENT).alias("kind"), *(none.cast("long").alias(c) for c in ("place", "n_links", "n_best", "count_sum")), "doc_id", "n_a", "n_b", "n_groups", "places", "times", "groups_sha256")
    dealt = front.unionAll(rows).repartition("share").sortWithinPartitions("share", F.desc("kind"))
    discard(links)
    discard(counts)
    return _summed(dealt)
