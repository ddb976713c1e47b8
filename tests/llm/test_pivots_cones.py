"""Recall and number of candidates where embeddings lie in a cone, and for very short and long vectors."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparsewell.llm import pivots


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cone(n, dim, mean_cosine, seed=1):
    """n unit vectors around one direction; a tenth of them has a partner at cosines from 0.93 to 1."""
    rng = np.random.default_rng(seed)
    tip = np.zeros(dim)
    tip[0] = 1
    v = unit(np.sqrt(mean_cosine) * tip + np.sqrt(1 - mean_cosine) * unit(rng.normal(size=(n - n // 10, dim))))
    a = v[: n // 10]
    o = rng.normal(size=a.shape)
    o = unit(o - (o * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9301, 1, (len(a), 1))
    return np.concatenate([v, c * a + np.sqrt(1 - c * c) * o])


def run(spark, tmp_path, monkeypatch, v):
    shared = []
    keep = pivots.materialize

    def spy(df, tag):
        out = keep(df, tag)
        if tag == "pivot-described":
            near = np.array([np.frombuffer(r.nearest, "<u2") for r in out.select("sid", "nearest").orderBy("sid").limit(3000).collect()])
            marks = np.zeros((len(near), near.max() + 1), np.float32)
            marks[np.arange(len(near))[:, None], near] = 1
            shared.append(((marks @ marks.T >= pivots.SHARED).sum() - len(near)) / (len(near) * (len(near) - 1)))
        return out

    monkeypatch.setattr(pivots, "materialize", spy)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "label": np.zeros(len(v), np.int32), "embedding": pa.array(list(v))}), tmp_path / "e.parquet")
    rows = pivots.near_vectors(spark.read.parquet(f"file://{tmp_path}/e.parquet")).toPandas().set_index("vec_id").sort_index()
    want = np.concatenate([(v[k : k + 1000] @ v.T >= 0.93).sum(1) - 1 for k in range(0, len(v), 1000)])
    found = rows.n_links.to_numpy()
    assert (found <= want).all()
    return found.sum() / max(1, want.sum()), shared[0]


@pytest.mark.parametrize(("mean_cosine", "n"), [(0.0, 30_000), (0.5, 30_000), (0.83, 50_000)])
def test_cones(spark, tmp_path, monkeypatch, mean_cosine, n):
    recall, candidates = run(spark, tmp_path, monkeypatch, cone(n, 64, mean_cosine))
    assert recall >= 0.9 and candidates <= 0.1


@pytest.mark.parametrize(("dim", "n"), [(2, 1500), (3, 2500), (768, 4000)])
def test_short_and_long_vectors(spark, tmp_path, monkeypatch, dim, n):
    recall, candidates = run(spark, tmp_path, monkeypatch, cone(n, dim, 0.83 if dim > 3 else 0.0))
    assert recall >= 0.9 and candidates <= 0.7


def test_one_direction_and_two_vectors(spark):
    rows = [(i, [float(i + 1), 0.0, 0.0], 1) for i in range(30)] + [(100, [1.0, 1.0], 1), (101, [1.0, 0.9], 1), (102, [-1.0, 1.0], 1), (200, [5.0], 1)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(i, 29, 0) for i in range(30)} | {(100, 1, 100), (101, 1, 100), (102, 0, 102), (200, 0, 200)}
