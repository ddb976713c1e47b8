"""The quality classifier's parts counted and solved a second, plain way."""

import math
import random

import numpy as np

from sparsewell.llm import quality

MASK = 0xFFFFFFFF


def hashed(code, salt):
    code = ((code ^ (salt * 0x9E3779B1 & MASK)) * 0x85EBCA6B) & MASK
    code ^= code >> 15
    return ((code * 0xC2B2AE35) & MASK) >> (32 - 18)


def naive_buckets(text):
    """Buckets of all runs of one to four bytes and of one to three word shapes, by the definition."""
    data, out = (text or "").encode(), set()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            out.add(hashed(sum(data[i + k] << 8 * k for k in range(n)), n))
    shapes, before = [], None
    for w in data.split():
        kinds = {1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 16 if b >= 128 else 8 for b in w}
        again = before is not None and (len(w), sum(w), w[0]) == (len(before), sum(before), before[0])
        shapes.append(sum(kinds) | again << 5 | min(len(w), 3) << 6)
        before = w
    for n in range(1, 4):
        for i in range(len(shapes) - n + 1):
            out.add(hashed(sum(shapes[i + k] << 8 * k for k in range(n)), 16 + n))
    return out


def corpus(n=240):
    rnd = random.Random(4)
    good = [f"word{k}" for k in range(60)]
    bad = [f"SPAM{k}!!" for k in range(60)]
    texts, labels = [], []
    for k in range(n):
        label = int(rnd.random() < 0.7)
        words = [rnd.choice(good if rnd.random() < (0.8 if label else 0.3) else bad) for _ in range(rnd.randrange(5, 40))]
        texts.append(" ".join(words))
        labels.append(label)
    return texts, np.array(labels)


def test_buckets_equal_naive_sets():
    rnd = random.Random(9)
    texts = [None, "", "x", " a\tb ", "A b1 é! aa aa", "Ab" * 3, "\x1c\x85 nul\x00"] + ["".join(rnd.choice("aB1 é!\n") for _ in range(rnd.randrange(80))) for _ in range(300)]
    for t in texts:
        got = quality.gram_buckets(t)
        assert len(got) == len(set(got.tolist())) and set(got.tolist()) == naive_buckets(t), t


def test_buckets_of_a_long_text():
    text = "Long words here, and more of them. " * 60_000
    assert set(quality.gram_buckets(text).tolist()) == naive_buckets("Long words here, and more of them. " * 4)


def test_ratios_equal_naive_counts():
    texts, labels = corpus(60)
    sets = [naive_buckets(t) for t in texts]
    ratio = quality._log_count_ratios([np.array(sorted(s)) for s in sets], np.where(labels > 0, 1.0, -1.0))
    count = [{}, {}]
    for s, y in zip(sets, labels, strict=True):
        for b in s:
            count[y][b] = count[y].get(b, 0) + 1
    total = [quality.BUCKETS + sum(c.values()) for c in count]
    for b in random.Random(1).sample(range(quality.BUCKETS), 500) + sorted(sets[0])[:200]:
        want = math.log((1 + count[1].get(b, 0)) / total[1]) - math.log((1 + count[0].get(b, 0)) / total[0])
        assert abs(ratio[b] - want) < 1e-12


def test_fit_closes_the_duality_gap():
    texts, labels = corpus()
    rows = [quality.gram_buckets(t) for t in texts]
    y = np.where(labels > 0, 1.0, -1.0)
    ratio = quality._log_count_ratios(rows, y)
    w, bias, alpha = quality._dual_coordinate_descent(rows, y, ratio)
    most = quality._penalties(y)
    assert (alpha >= 0).all() and (alpha <= most + 1e-12).all()
    x = [(r, ratio[r] / np.sqrt((ratio[r] ** 2).sum())) for r in rows]
    plane = np.zeros(quality.BUCKETS)
    for (r, v), a, s in zip(x, alpha, y, strict=True):
        plane[r] += a * s * v
    assert np.allclose(plane, w) and abs(bias - (alpha * y).sum()) < 1e-9
    norm = (w @ w + bias * bias) / 2
    margins = np.array([w[r] @ v + bias for r, v in x])
    primal = norm + (most * np.maximum(0, 1 - y * margins)).sum()
    dual = alpha.sum() - norm
    assert 0 <= primal - dual + 1e-9 and primal - dual < 0.02 * primal
    assert np.mean((margins > 0) == (labels > 0)) > 0.9


def test_sample_bounds(spark):
    texts, labels = corpus(80)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3 + [(0, "another text")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "doc_id long, quality int")
    every = quality._sample(docs, y, 1000, 1 << 25).collect()
    assert len({r.doc_id for r in every}) == len(every) < 80 and all(r.n == len(r.grams) // 4 for r in every)
    assert quality._sample(docs, y, 10, 1 << 25).count() == 10
    few = quality._sample(docs, y, 1000, 3000).collect()
    assert 0 < len(few) < len(every) and sum(r.n for r in few) <= 3000
    again = quality.train(docs, y)
    once = quality.train(docs.dropDuplicates(["doc_id", "text"]), y)
    assert np.array_equal(again.weights, once.weights) and again.bias == once.bias
