"""Near-duplicate embeddings by a pivot-permutation index.

For every vector length a bounded sample of vectors, none near another, serves
as reference points (pivots).  Directions are taken from the sample's mean, since
embeddings tend to lie in a narrow cone, seen from whose tip all of them are
alike.  Every vector is described by its nearest pivots in order and stands in
their inverted lists.  Two vectors of one list are
candidates if their descriptions share enough pivots; candidates are verified by
their cosine in double precision.  Each pair is looked at in the list of the
lowest pivot it shares, so links can be counted without listing pairs, and a
vector need not stand in the lists of its last ``SHARED - 1`` pivots.  Long lists
are cut into parts, and each pair of parts is one block of bounded size:
nothing is capped.

The index holds ids; vectors are fetched once for the lists of a vector and sent
to its blocks.  Pivots meet the vectors they describe in a join, whatever the
number of lengths.  Equal vectors collapse to one row with a multiplicity first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import bounded_batches, discard, materialize, sorted_groups
from .components import connected_components

COSINE = 0.93
#: Pivots of a description, and how many two descriptions must share.
NEAREST, SHARED = 12, 2
#: Pivots of a length grow with the square root of its rows between these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
#: Pivots are at most this close to each other: which of several near copies is nearest is noise and tells nothing about a vector.
#: The first that leaves ``ENOUGH`` pivots counts, as short vectors have little room.
SPREADS, ENOUGH = (0.8, 0.9, 0.95, 0.98, 0.99, 0.999), 64
#: Sampled vectors for each pivot wanted, so that large groups of near copies leave enough others.
SAMPLED = 4
#: Vectors that one copy of the pivots describes, for each pivot.
DESCRIBED = 4
#: Cosines of whole blocks come from one matrix product; those this near to the threshold are computed again pair by pair.
ROUNDING = 1e-9
#: Rows of one side of a block.
BLOCK_ROWS = 1024

_MEAN, _LAST = -1, 2**31 - 1


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, dim, key (digest) and vec (packed floats, or doubles if the input has other numbers; null if it links with nothing)."""
    bounded_batches(table.sparkSession)
    kind, code = ("float", "<f4") if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else ("double", "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(code, copy=False)  # nulls become NaN
            ends, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            vec: list[bytes | None] = []
            for i in range(b.num_rows):
                v = flat[ends[i] : ends[i + 1]]
                vec.append((v + 0.0).astype(code).tobytes() if there[i] and np.isfinite(v).all() and v.any() else None)
            keys = [hashlib.blake2b(v, digest_size=16).digest() if v else None for v in vec]
            dims = [len(v) // int(code[2]) if v else 0 for v in vec]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "dim", "key", "vec"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, key binary, vec binary")


def _matrix(values: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _units(values: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    m = _matrix(values, f"<f{len(values[0]) // dim}").astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # keeps the squares in range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _seen_from(mean: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Directions of unit vectors from ``mean``; zero for a vector that is no further from it than rounding."""
    m = units - mean
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 1e-9)


def _spread(sample: np.ndarray, size: int, spread: float) -> np.ndarray:
    """Places of the first ``size`` rows of the sample that are not within ``spread`` of an earlier one."""
    kept = np.zeros(0, np.int64)
    for at in range(0, len(sample), 256):
        chunk = np.arange(at, min(at + 256, len(sample)))
        if len(kept):
            chunk = chunk[(sample[chunk] @ sample[kept].T < spread).all(axis=1)]
        near, chosen = sample[chunk] @ sample[chunk].T >= spread, []
        for i in range(len(chunk)):
            if not near[i, chosen].any():
                chosen.append(i)
        kept = np.concatenate([kept, chunk[chosen]])
        if len(kept) >= size:
            break
    return kept[:size]


def _pivots(reps: DataFrame, counts: DataFrame) -> DataFrame:
    """(dim, pivot, vec) of each length: its sample's mean (_MEAN, doubles) and the pivots."""
    share = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 30)) / (1 << 30)
    sample = reps.join(counts, "dim").where(share < SAMPLED * F.col("size") / F.col("n")).select("dim", "size", "sid", "rep", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), t in sorted_groups(batches, 1):  # about SAMPLED * size vectors
            vec, size = t.column(4).to_pylist(), t.column(1)[0].as_py()
            units = _units(vec, dim)
            mean = units.mean(axis=0)
            seen = _seen_from(mean, units)
            for spread in SPREADS:
                at = _spread(seen, size, spread)
                if len(at) >= min(ENOUGH, len(vec)):
                    break
            yield pa.record_batch([pa.array(np.full(len(at) + 1, dim, np.int32)), pa.array(np.arange(_MEAN, len(at), dtype=np.int32)), pa.array([mean.astype("<f8").tobytes(), *(vec[i] for i in at)], pa.binary())], names=["dim", "pivot", "vec"])

    return sample.repartition("dim").sortWithinPartitions("dim", F.xxhash64("rep"), "rep").mapInArrow(run, "dim int, pivot int, vec binary")


def _describe(reps: DataFrame, pivots: DataFrame, counts: DataFrame, nearest: int, shared: int) -> DataFrame:
    """``reps`` with ``nearest`` (pivots by nearness, packed) and ``lists`` (those whose lists the vector stands in).

    The vectors of a length are dealt into shares, each with its own copy of the
    mean and the pivots in front.
    """
    none = F.lit(None)
    front = pivots.join(counts, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "pivot", none.cast("long").alias("sid"), none.cast("long").alias("rep"), none.cast("string").alias("label"), none.cast("long").alias("m"), "vec")
    rows = reps.join(counts, "dim").select("dim", F.pmod(F.xxhash64("sid"), "shares").alias("share"), F.lit(_LAST).alias("pivot"), "sid", "rep", "label", "m", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packed, points = None, [], None
        for b in batches:
            dims, shares, pivot = (b.column(c).to_numpy() for c in range(3))
            change = np.ones(b.num_rows, bool)
            change[1:] = (dims[1:] != dims[:-1]) | (shares[1:] != shares[:-1]) | ((pivot[1:] == _LAST) != (pivot[:-1] == _LAST))
            bounds = [*np.flatnonzero(change).tolist(), b.num_rows]
            for start, end in zip(bounds, bounds[1:], strict=False):
                if (dims[start], shares[start]) != current:
                    current, packed, points = (dims[start], shares[start]), [], None
                dim, part = int(dims[start]), b.slice(start, end - start)
                if pivot[start] != _LAST:
                    packed += part.column(7).to_pylist()
                    continue
                if points is None:
                    mean = np.frombuffer(packed[0], "<f8")
                    points = _seen_from(mean, _units(packed[1:], dim))
                order = np.argsort(-(_seen_from(mean, _units(part.column(7).to_pylist(), dim)) @ points.T), axis=1, kind="stable")[:, :nearest].astype("<u2")
                lists = np.sort(order, axis=1)[:, : order.shape[1] + 1 - min(shared, order.shape[1])].astype(np.int32)
                places = pa.array(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32))
                yield pa.record_batch([*(part.column(c) for c in (3, 4, 5, 0, 6, 7)), pa.array([o.tobytes() for o in order], pa.binary()), pa.ListArray.from_arrays(places, pa.array(lists.ravel()))], names=["sid", "rep", "label", "dim", "m", "vec", "nearest", "lists"])

    dealt = front.unionAll(rows).repartition("dim", "share").sortWithinPartitions("dim", "share", "pivot")
    return dealt.mapInArrow(run, "sid long, rep long, label string, dim int, m long, vec binary, nearest binary, lists array<int>")


def _linked_within(links: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Smallest id that links reach inside a block."""
    low = rep.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def _block_links(vec: np.ndarray, near: np.ndarray, part: np.ndarray, pivot: int, across: bool, cosine: float, shared: int) -> np.ndarray:
    """Which rows of a block link: pairs that share enough pivots, ``pivot`` as the lowest, and whose cosine is high enough.

    ``across``: the block is one of two parts, and pairs inside a part belong to that part's own block.
    """
    names, at = np.unique(near, return_inverse=True)
    hot = np.zeros((len(vec), len(names)), np.float32)
    hot[np.arange(len(vec))[:, None], at.reshape(near.shape)] = 1
    ok = hot @ hot.T >= min(shared, near.shape[1])
    lower = hot[:, names < pivot]
    ok &= lower @ lower.T == 0
    np.fill_diagonal(ok, False)
    if across:
        ok &= part[:, None] != part[None, :]
    cosines = vec @ vec.T  # of one block: any number of its pairs may be candidates
    ok &= cosines >= cosine - ROUNDING
    at, to = np.nonzero(ok & (cosines < cosine + ROUNDING))
    for k in range(0, len(at), BLOCK_ROWS):
        a, b = at[k : k + BLOCK_ROWS], to[k : k + BLOCK_ROWS]
        ok[a, b] = np.einsum("ij,ij->i", vec[a], vec[b]) >= cosine
    return ok


def _verify(blocks: DataFrame, cosine: float, shared: int) -> DataFrame:
    """Links of each vector per block (sid, rep, links) and the smallest id its links reach there (root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, pivot, i, j), t in sorted_groups(batches, 5):
            part, sid, rep, m = (t.column(c).to_numpy() for c in (5, 6, 7, 8))
            ok = _block_links(_units(t.column(9).to_pylist(), dim), _matrix(t.column(10).to_pylist(), "<u2"), part, pivot, i != j, cosine, shared)
            n = ok @ m
            has = n > 0
            if has.any():
                root = _linked_within(ok, rep)
                yield pa.record_batch([pa.array(sid[has]), pa.array(rep[has]), pa.array(n[has].astype(np.int64)), pa.array(root[has])], names=["sid", "rep", "links", "root"])

    keys = ("label", "dim", "pivot", "i", "j")
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "sid long, rep long, links long, root long")


def near_vectors(table: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Links and groups of near-equal vectors with equal labels.

    Returns one row per input row: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id that links reach) and kept (vec_id =
    component_id).  Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do rows without a label or
    vectors of different lengths.  A row with a null vec_id links with nothing,
    has a null component and is kept.  Repeated rows of one vec_id are one
    vector; if their vectors or labels differ, each row counts its own links and
    the component is that of all of them.  Other columns are ignored; an empty
    table gives an empty table.  Links below ``cosine`` are never made; a link is
    found if the descriptions share ``shared`` of ``nearest`` pivots (recall is
    measured in the tests).  Of pivots that are equally near, the one sampled
    first comes first.  A length whose vectors have no more than ``nearest``
    directions apart has all its pairs as candidates, most of which link.
    """
    vectors = materialize(_vectors(table), "pivot-vectors")
    valid = vectors.where("vec_id is not null and label is not null and vec is not null")
    key = ["label", "dim", "key"]
    copies = valid.select(*key, "vec_id").distinct().groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    reps = copies.join(valid.groupBy(*key).agg(F.first("vec").alias("vec")), key)
    # sid numbers the distinct vectors; it is fixed once the table is written
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("sid"), *key, "rep", "m", "vec"), "pivot-reps")
    size = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(LEAST_PIVOTS), F.ceil(2 * F.sqrt("n")))).cast("int")
    counts = reps.groupBy("dim").agg(F.count("*").alias("n")).withColumn("size", size)
    counts = materialize(counts.withColumn("shares", F.ceil(F.col("n") / (DESCRIBED * F.col("size"))).cast("long")), "pivot-counts")
    pivots = materialize(_pivots(reps, counts), "pivot-points")
    described = materialize(_describe(reps, pivots, counts, nearest, shared), "pivot-described")
    place = ["label", "dim", "pivot"]
    index = described.select("sid", "label", "dim", F.explode("lists").alias("pivot"))
    sizes = index.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("parts"))
    stands = index.join(sizes, place).select("sid", "pivot", "parts")
    rows = stands.join(described, "sid").withColumn("part", F.pmod(F.xxhash64("sid"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = rows.select(*place, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", "rep", "m", "vec", "nearest")
    found = materialize(_verify(blocks, cosine, shared), "pivot-links")
    discard(described)
    discard(pivots)
    # a vec_id with several vectors is one node
    again = valid.groupBy("vec_id").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("label").alias("first"), F.max("label").alias("last")).where("low < high or first < last").select("vec_id")
    same = valid.select("vec_id", *key).join(again, "vec_id").join(reps.select(*key, "rep"), key).select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionAll(same), "pivot-components")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    per_rep = reps.select("sid", *key, "rep", "m").join(links, "sid", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    per_rep = per_rep.select(*key, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    out = vectors.select("vec_id", "label", "dim", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(per_rep, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
