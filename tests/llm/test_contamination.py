"""Decontamination against a plain search for every window at every place."""

import hashlib
import random
import re

import pytest

from sparsewell.llm import contamination

PASSAGE = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [
    (1, PASSAGE), (1, PASSAGE), (2, "one two three"), (10, "one, TWO! three"), (3, None), (4, "..."), (5, "x"), (None, "a b a b a b a b a b a b"), (6, "a b a b a b a b a b a b"),
    (7, "É é Ñ日本 7 8 9 10 11 12 13"), (8, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (9, "never seen in any of these documents at all but rather long"),
]
TEXTS = [
    None, "", " \n", PASSAGE, PASSAGE.upper() + " " + PASSAGE, "before " + PASSAGE + ", after; one-two-three", " ".join(PASSAGE.split()[:9]), " ".join(PASSAGE.split()[1:11]),
    "a b " * 40, "b a b a b a b a b a", "é É Ñ日本 7 8 9 10 11 12 13", "É é ñ日本 7 8 9 10 11 12 13", "É é Ñ日本\x007/8[9`10{11\x7f12\n13", "one two four three", "x", "y x", "word " * 30_000 + PASSAGE + " end" * 20_000,
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key] - {None}
        listed = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, rows, items, window=10, shingle=5):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, item_id string, words int")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    got = contamination.contaminated_documents(docs, bench, window, shingle)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows, items, window), key=key)


def test_windows_of_all_lengths(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    check(spark, rows + [(3, PASSAGE), (3, PASSAGE), (3, "other text"), (None, PASSAGE)], ITEMS)


@pytest.mark.parametrize("limit", [1, 4])
def test_benchmark_in_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", limit)
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("ab c dd e f".split()) for _ in range(n))
    check(spark, [(i, text(rnd.randrange(60))) for i in range(40)], [(i, text(rnd.randrange(1, 9))) for i in range(5)], window=6, shingle=3)


def test_empty_tables(spark):
    check(spark, [(1, PASSAGE), (2, None)], [])
    check(spark, [], ITEMS)
    check(spark, [(1, PASSAGE)], [(3, None), (4, "-")])


def test_no_python_in_the_plan(spark, monkeypatch):
    plans = []
    keep = contamination.materialize
    monkeypatch.setattr(contamination, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, tag))
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    out = contamination.contaminated_documents(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", p) for p in plans)
    scan = next(p for p in plans if "BroadcastHashJoin" in p and "Generate" in p)
    assert "SortMergeJoin" not in scan and "hashpartitioning" not in scan
