"""Links of embeddings when a large part of the table is near copies of one vector."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sparsewell.llm import pivots


def test_recall_in_a_hot_third(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, dim = 51000, 64
    base = rng.normal(size=(n // 3, dim))
    hot = rng.normal(size=dim) + rng.normal(size=(n // 3, dim)) * 0.143  # cosines around 0.98
    near = base + rng.normal(size=base.shape) * 0.36  # cosines around 0.93 to 0.95
    v = np.concatenate([hot, base, near])
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.zeros(n, np.int32), "embedding": pa.array(list(v))}), tmp_path / "e.parquet")
    rows = pivots.near_vectors(spark.read.parquet(f"file://{tmp_path}/e.parquet")).toPandas().set_index("vec_id").sort_index()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.93).sum(1) - 1 for k in range(0, n, 1000)])
    found = rows.n_links.to_numpy()
    third = n // 3
    assert (found <= want).all()
    assert found[:third].sum() >= 0.99 * want[:third].sum()
    assert found[third:].sum() >= 0.9 * want[third:].sum()
    assert (rows.component_id.to_numpy()[:third] == 0).all()


def test_block_of_near_copies_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    v = rng.normal(size=768) + rng.normal(size=(2048, 768)) * 0.1  # all pairs are candidates and link
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.tile(np.arange(8, dtype="<u2"), (2048, 1))
    tracemalloc.start()
    ok = pivots._block_links(v, near, np.repeat([0, 1], 1024), 0, True, 0.93, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = v @ v.T >= 0.93
    want[:1024, :1024] = want[1024:, 1024:] = False
    assert (ok == want).all() and peak < 200e6


def test_spread_keeps_only_what_is_far_from_earlier_rows():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = []
    for i in range(len(v)):
        if len(kept) < 20 and (not kept or (v[kept] @ v[i]).max() < 0.8):
            kept.append(i)
    assert pivots._spread(v, 20, 0.8).tolist() == kept


def test_ids_with_several_vectors_and_equal_pivot_distances(spark):
    e = np.eye(12)
    rows = [(k, e[k].tolist(), 1) for k in range(12)] + [(0, e[5].tolist(), 1), (0, e[0].tolist(), 1), (20, e[5].tolist(), 1), (21, e[5].tolist(), 2), (3, e[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    # 5, 20 and a row of 0 are equal: one node with 0
    assert got == {(k, 0, k) for k in range(12) if k != 5} | {(0, 2, 0), (5, 2, 0), (20, 2, 0), (21, 0, 21)}
