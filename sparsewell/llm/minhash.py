"""Near-duplicate documents by MinHash.

1. Every text's set of word shingles is hashed to 64-bit values; the minima of
   many universal hash functions are its signature.
2. Texts with equal sets collapse to one numbered set.
3. Bands of the signature are bucket keys.  Each set is compared
   with one leader of each of its buckets, which a hash chooses anew for every
   bucket: first by signature agreement, then on the full sets.
4. Components come from alternating large-star and small-star.
5. Buckets that still hold several components are finished exactly.  Their rows
   are unsettled: in small buckets those with an agreeing partner in another
   component, in larger ones all.  Unsettled sets meet by a prefix join: their
   shingles are ordered by rarity, and two sets can only be similar if they share
   a shingle among their rarest, at places that leave enough in common.  What a
   template shares comes last in this order, so texts that differ in a few words of
   their own never meet.  Such pairs of different components are compared by
   signature and then on their full sets.

Only connectivity is asked for, so the pairs of a group are never all listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded_batches, discard, materialize, sorted_groups
from .components import connected_components

SHINGLE_WORDS = 5
#: Link if PERCENT_DEN * intersection >= PERCENT * union.
PERCENT, PERCENT_DEN = 75, 100
BANDS, ROWS = 32, 4
#: Least share of equal minima.  At similarity 0.75 the share of 128 minima falls below it once in ten thousand pairs.
LEAST_AGREEMENT = 0.60
#: Rows of a bucket whose signatures are compared with each other; sets of larger buckets go to the prefix join.
SMALL_BUCKET = 64
#: Bits of a filter of ids for each id, and in all.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27

_U = np.uint64
_random = np.random.default_rng(0x5EED)
_BYTE = _random.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_MIX = _random.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=_U) * _U(2) + _U(1)
_MUL = _random.integers(1, 2**63, BANDS * ROWS, dtype=_U) * _U(2) + _U(1)
_ADD = _random.integers(0, 2**63, BANDS * ROWS, dtype=_U)
_BAND = _random.integers(1, 2**63, (BANDS, ROWS + 1), dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's k-word shingles (A-Z lower-cased).

    Fewer than k words form one shingle; no words or no text, none.
    """
    if not text:
        return np.zeros(0, _U)
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return np.zeros(0, _U)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=total[1:])
    words = _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    width = min(k, n)
    out = words[: n - width + 1] * _MIX[0]
    for j in range(1, width):
        out += words[j : n - width + 1 + j] * _MIX[j]
    return np.unique(_mixed(out + np.full(1, width, _U) * _MIX[-1:]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes (a x + b mod 2**64, upper half) over a non-empty set."""
    least = None
    for at in range(0, len(hashes), 1024):
        block = np.multiply.outer(_MUL, hashes[at : at + 1024])
        block += _ADD[:, None]
        m = block.min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return (least >> _U(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough."""
    if not len(a) or not len(b) or PERCENT_DEN * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return PERCENT_DEN * common >= PERCENT * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (digest of the full set) and sig of every row; the last two null for empty sets.

    ``text_key`` tells the texts of one doc_id apart.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sigs = [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, sig binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BANDS * ROWS)


def _band_rows(reps: DataFrame) -> DataFrame:
    """One row per set and band: bucket key, band and sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1)).reshape(-1, BANDS, ROWS).astype(_U)
                keys = _mixed((m * _BAND[None, :, :ROWS]).sum(axis=2, dtype=_U) + _BAND[None, :, ROWS])
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "band", "sid"])

    return reps.select("sid", "sig").mapInArrow(run, "bucket long, band int, sid long")


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""
    sig = lambda side: reps.select(F.col("sid").alias(side), F.col("sig").alias(f"sig_{side}"))
    rows = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                share = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(share >= LEAST_AGREEMENT))

    return rows.mapInArrow(run, "a long, b long")


def _among(keys: DataFrame, key: Column) -> Column:
    """Whether a row's 64-bit hash may be one of ``keys`` (h): a bitmap of two bits each, which is bounded, read by every scan.

    It lets through all of them and, as long as it is not full, few others.
    """
    spark = keys.sparkSession
    words = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * max(1, keys.count()) - 1).bit_length())) // 64
    places = lambda h: (F.shiftrightunsigned(h, 38).bitwiseAND(F.lit(64 * words - 1)), h.bitwiseAND(F.lit(64 * words - 1).cast("long")))
    word, bit = lambda p: F.shiftright(p, 6).cast("int"), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    set_bits = keys.select(F.explode(F.array(*places(F.col("h")))).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(bit(F.col("p"))).alias("b"))
    full = spark.range(words).select(F.col("id").cast("int").alias("w")).join(set_bits, "w", "left").select(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("e"))
    # one array of at most MOST_FILTER_BITS
    bits = full.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.b).alias("bits")).scalar()
    one, two = places(key)
    return (F.get(bits, word(one)).bitwiseAND(bit(one)) != 0) & (F.get(bits, word(two)).bitwiseAND(bit(two)) != 0)


def _texts_of(sids: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sid, doc_id, text) once for each of ``sids``, however many rows repeat that text; other texts stay where they are."""
    needed = materialize(sids.distinct().join(reps.select("sid", "doc_id", "text_key"), "sid"), "minhash-needed")
    hashed = F.xxhash64("doc_id", "text_key")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where(_among(needed.select(hashed.alias("h")), hashed))
    found = materialize(texts.join(needed.hint("merge"), ["doc_id", "text_key"]).select("sid", "doc_id", "text"), "minhash-texts")
    discard(needed)
    once = found.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    once._sparsewell_path = found._sparsewell_path
    return once


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) of doc_ids: the pairs of sets whose full sets are similar enough."""
    side = lambda s: texts.select(F.col("sid").alias(s), F.col("doc_id").alias(f"doc_{s}"), F.col("text").alias(f"text_{s}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "doc_a", "doc_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for b in batches:
            keep = []
            for a, text_a, text_b in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if a != last:
                    last, last_set = a, shingle_set(text_a)
                keep.append(similar(last_set, shingle_set(text_b)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long")


def _unsettled(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """(sid, comp) of sets in open buckets that may link another component."""
    placed = reps.select("sid", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("sid", F.coalesce("component_id", "doc_id").alias("comp"))
    rows = materialize(members.join(placed.hint("merge"), "sid").select("bucket", "n", "sid", "comp"), "minhash-placed")
    open_buckets = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    still = rows.join(open_buckets.hint("merge"), "bucket")
    large = still.where(F.col("n") > SMALL_BUCKET).select("sid", "comp")
    small = still.where(F.col("n") <= SMALL_BUCKET).join(reps.select("sid", "sig"), "sid").select("bucket", "sid", "comp", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, 1):
            comp, sig = t.column(2).to_numpy(), _matrix(t.column(3))
            agree = (sig[:, None] == sig[None]).mean(axis=2) >= LEAST_AGREEMENT
            wanted = (agree & (comp[:, None] != comp[None])).any(axis=1)
            yield from t.select(["sid", "comp"]).filter(pa.array(wanted)).to_batches()

    agreeing = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sid long, comp long")
    out = agreeing.unionAll(large).distinct()
    out._sparsewell_path = rows._sparsewell_path
    return out


def _shingles(unsettled: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, comp, n, shingle): the full sets of the unsettled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, comp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle_set(text)
                yield pa.record_batch([pa.array(np.full(len(s), x, np.int64)) for x in (sid, comp, len(s))] + [pa.array(s.view(np.int64))], names=["sid", "comp", "n", "shingle"])

    return unsettled.join(texts, "sid").select("sid", "comp", "text").mapInArrow(run, "sid long, comp long, n long, shingle long")


def _rare(sets: DataFrame) -> DataFrame:
    """(sid, comp, n, shingle, at): the rarest shingles of each set by which a similar set can be met, ``at`` their places from 1 on.

    In a common order of all shingles, two sets with c in common share one that
    leaves c - 1 behind it in both.
    """
    stats = sets.groupBy("shingle").agg(F.count("*").alias("c"), (F.min("comp") < F.max("comp")).alias("open"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy("c", "shingle"))
    rows = sets.join(stats.hint("merge"), "shingle").select("sid", "comp", "n", "shingle", "open", place.alias("at"))
    return rows.where(F.col("open") & (PERCENT * F.col("n") <= PERCENT_DEN * (F.col("n") - F.col("at") + 1))).drop("open")


def _meeting(rare: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a rare shingle and can be similar enough by size and place.

    Pairs within the largest component of a shingle are not looked at.
    """
    main = rare.groupBy("shingle", "comp").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1")
    rows = materialize(rare.join(main.hint("merge"), "shingle"), "minhash-meeting")
    x = rows.where("comp <> main").select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("sid", "comp", "n", "at")))
    y = rows.select("shingle", "main", *(F.col(c).alias(f"{c}_y") for c in ("sid", "comp", "n", "at")))
    once = (F.col("comp_y") == F.col("main")) | (F.col("sid_x") < F.col("sid_y"))
    sizes = PERCENT_DEN * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y")
    behind = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    enough = (PERCENT_DEN + PERCENT) * (behind + 1) >= PERCENT * (F.col("n_x") + F.col("n_y"))
    pairs = x.join(y.hint("merge"), "shingle").where((F.col("comp_x") != F.col("comp_y")) & once & sizes & enough)
    out = pairs.select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b")).distinct()
    out._sparsewell_path = rows._sparsewell_path
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of whole texts.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id that links reach) and kept (doc_id = component_id).  Null, empty and
    blank texts have an empty set and link with nothing.  A row with a null
    doc_id has no name that others could reach: it is linked with nothing, its
    component is null and it is kept.  Repeated rows of one doc_id are one
    document; if their texts differ, its links are those of all of them.
    Texts of any length are compared whole.  Other columns are ignored; an empty
    table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = materialize(signatures(docs), "minhash-signatures")
    named = sigs.where("doc_id is not null and set_key is not null")
    first = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("sig").alias("sig"))
    # sid numbers the distinct sets; it is fixed once the table is written
    reps = materialize(first.select(F.monotonically_increasing_id().alias("sid"), "set_key", "r.*", "sig"), "minhash-reps")
    bands = materialize(_band_rows(reps), "minhash-bands")
    buckets = bands.groupBy("bucket").agg(F.min_by("sid", F.xxhash64("bucket", "sid")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(buckets.hint("merge"), "bucket").select("bucket", "band", "sid", "leader", "n"), "minhash-buckets")
    discard(bands)
    stars = members.where("sid <> leader").select(F.least("leader", "sid").alias("a"), F.greatest("leader", "sid").alias("b")).distinct()
    agreeing = materialize(_agreeing(stars, reps), "minhash-pairs")
    texts = _texts_of(agreeing.select(F.col("a").alias("sid")).unionAll(agreeing.select("b")), docs, reps)
    edges = materialize(_confirmed(agreeing, texts), "minhash-edges")
    discard(texts)
    discard(agreeing)
    # a doc_id with several texts has several sets: they are one document
    again = named.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select(F.col("doc_id").alias("u"))
    same = named.select(F.col("doc_id").alias("u"), "set_key").join(again, "u").join(reps.select("set_key", F.col("doc_id").alias("v")), "set_key").select("u", "v")
    labels = connected_components(edges.unionAll(same), "minhash-components")
    found = _unsettled(members, labels, reps)
    unsettled = materialize(found, "minhash-unsettled")
    discard(found)
    discard(members)
    if unsettled.limit(1).count():
        texts = _texts_of(unsettled.select("sid"), docs, reps)
        sets = materialize(_shingles(unsettled, texts), "minhash-sets")
        rare = materialize(_rare(sets), "minhash-rare")
        discard(sets)
        met = _meeting(rare)
        pairs = materialize(met, "minhash-pairs")
        discard(met)
        more = materialize(_confirmed(pairs, texts), "minhash-edges")
        # what is known already is one edge from each node to its component
        labels = connected_components(labels.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionAll(more), "minhash-components")
        discard(pairs)
        discard(more)
        discard(texts)
        discard(rare)
    discard(unsettled)
    discard(edges)
    rep_of = reps.select("set_key", F.col("doc_id").alias("id")).join(labels, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("component"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(rep_of, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``documents`` with one document of each near-duplicate group: its smallest doc_id.

    Repeated rows of one doc_id count as one document and leave one row, the
    smallest by text, lang, source and n_chars (nulls first); rows with a null
    doc_id stay.  Other columns than those of ``documents`` are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *DOCUMENT_COLUMNS[1:])
    ids = near_duplicates(rows).where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    taken = materialize(ids.where("not kept or n > 1"), "minhash-taken")
    left = rows.join(taken, "doc_id", "left_anti")
    again = taken.where("kept").select("doc_id")
    if not again.limit(1).count():
        return left
    one = rows.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*DOCUMENT_COLUMNS[1:])).alias("r"))
    return left.unionByName(one.select("doc_id", "r.*"))
