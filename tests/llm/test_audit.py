"""The filter audit against a simulation of all orders, document by document."""

import re
from collections import Counter
from itertools import permutations

from sparsewell.llm import audit

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", "", " \n", LONG, LONG, LONG, "# " + LONG, "a a a", LONG + " " + LONG, LONG.upper(), LONG.upper(), "ÉÀ " + LONG, "$ " + "A b " * 200,
    "x " * 50_000, "x\x0by\x1cz", "Word word", "|", "é" * 9 + "A", "é" * 8 + "A",
]


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(rows, labels):
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    judged = []
    for i, text, lang in rows:
        f = fails(text or "") | {"E": i is not None and i > smallest[text or ""]}
        good = any(d == i and q == 1 for d, q, _ in labels) and i is not None
        toxic = any(d == i and t == 1 for d, _, t in labels) and i is not None
        judged.append((lang or "", {k for k, v in f.items() if v}, good, toxic))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in judged}:
        mine = [x[1:] for x in judged if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                removed_by[part, k] += len(gone)
                redundant = sum(k in x[0] for x in mine) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x[0] == {k} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {(*key, *v, removed_by[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, "clash", 1) for i, t, g in rows], "doc_id long, text string, lang string, A string, digest long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def test_all_orders(spark):
    rows = [(i if i != 8 else None, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [(4, LONG, "en"), (4, LONG, "fr"), (5, LONG, "fr"), (5, LONG, "fr"), (-1, "only one", "es"), (None, LONG, "en"), (None, "", "en")]
    labels = [(0, 1, 0), (4, 1, 0), (4, 1, 1), (5, None, 1), (6, 0, None), (7, 1, 1), (None, 1, 1), (99, 1, 1), (10, 1, 0), (13, 0, 1)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_shared_text_and_empty_tables(spark):
    rows = [(i, "same words" if i % 3 else f"own {i}", "en") for i in range(600)]
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [], [(1, 1, 1)]) == set()
