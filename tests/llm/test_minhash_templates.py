"""Near misses on a template are not compared pair by pair, planted links are found, and unrelated texts stay where they are."""

import random

import pytest
from test_llm import brute_groups  # noqa: F401

from sparsewell.llm import minhash


def words(rnd, n):
    return [f"{rnd.getrandbits(40):x}" for _ in range(n)]


def templated(n, links, seed=1):
    """n texts of 150 shared and 39 own words (similarity 0.65, no links), then pairs that link at 0.75 to 0.8 with one of them."""
    rnd = random.Random(seed)
    shared = words(rnd, 150)
    texts = [" ".join(shared + words(rnd, 39)) for _ in range(n)]
    twins = []
    for k in range(links):
        at = k * (n // links)
        w = texts[at].split()
        for cut in range(5, 40):
            new = w[: len(w) - cut] + words(rnd, cut)
            a, b = minhash.shingle_set(texts[at]), minhash.shingle_set(" ".join(new))
            if minhash.similar(a, b) and cut >= 18:
                twins.append((at, " ".join(new)))
                break
    return texts, twins


def test_near_misses_do_not_meet(spark, monkeypatch):
    compared = []
    keep = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, texts: compared.append(pairs.count()) or keep(pairs, texts))
    texts, twins = templated(1500, 30)
    assert len(twins) == 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + k, t) for k, (_, t) in enumerate(twins)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: i for i in range(len(texts))} | {10_000 + k: at for k, (at, _) in enumerate(twins)}
    assert got == want
    assert len(compared) == 2 and sum(compared) < 20 * len(rows)
    assert compared[1] < len(rows)  # after the leaders, hardly any pair is left


def test_two_families_and_strays(spark):
    """Two large families whose copies differ a little, not similar to each other, and single texts between them."""
    rnd = random.Random(3)
    base = words(rnd, 120)
    other = base[:75] + words(rnd, 45)
    rows = []
    for k in range(400):
        w = list(base if k % 2 else other)
        w[rnd.randrange(len(w))] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:90] + words(rnd, 30))) for k in range(5)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets = {i: minhash.shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b) and minhash.similar(sets[a], sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [2, 64])
def test_rare_pairs_lose_nothing(spark, monkeypatch, limit):
    """Every similar pair of different components is among the pairs, whatever the bucket sizes."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", limit)
    rnd = random.Random(8)
    pool = words(rnd, 60)
    texts = []
    for _ in range(60):
        start = rnd.randrange(30)
        texts.append(" ".join(pool[start : start + rnd.randrange(5, 30)] + words(rnd, rnd.randrange(3))))
    sets = [minhash.shingle_set(t) for t in texts]
    rows = [(i, i, len(s), int(x)) for i, s in enumerate(sets) for x in s.view("int64")]
    rare = minhash._rare(spark.createDataFrame(rows, "sid long, comp long, n long, shingle long"))
    found = {(r.a, r.b) for r in minhash._meeting(rare).collect()}
    linked = {(a, b) for a in range(60) for b in range(a + 1, 60) if minhash.similar(sets[a], sets[b])}
    assert linked <= found and len(linked) > 10


def test_only_compared_texts_are_shuffled(spark, monkeypatch):
    kept = []
    keep = minhash.materialize

    def spy(df, tag):
        if tag == "minhash-texts":
            kept.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(minhash, "materialize", spy)
    rnd = random.Random(4)
    rows = [(i, " ".join(words(rnd, 30))) for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs)
    assert got.where("component_id <> doc_id").count() == 20
    assert kept and all("scalar-subquery" in p for p in kept)  # a bounded filter stands before the join that moves texts
    needed = spark.createDataFrame([(i,) for i in range(0, 3000, 100)], "d long")
    from pyspark.sql import functions as F

    passed = {r.d for r in spark.range(3000).select(F.col("id").alias("d")).where(minhash._among(needed.select(F.xxhash64("d").alias("h")), F.xxhash64("d"))).collect()}
    assert set(range(0, 3000, 100)) <= passed and len(passed) < 60
