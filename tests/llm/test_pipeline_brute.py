"""The pipeline's rows against plain-Python versions of its stages."""

import re
import unicodedata
import zlib
from math import comb

import numpy as np
from test_llm import SF, VOCAB, brute_groups, tokenizer  # noqa: F401
from test_quality_brute import naive_buckets
from test_secret_forms import literal_spans

from sparsewell.llm import quality, rules, secrets


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeated = {p for at in grams.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    shares = {
        "symbol_share": share(sum(c in "#*$%&|<>" for c in text), chars),
        "capital_share": share(sum(unicodedata.category(c) == "Lu" for c in text), chars),
        "repeat_share": share(len(repeated), len(w)),
        "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
    }
    severity = max(sum(shares[name] > cut for cut in cuts) for name, cuts in rules.PATH.items())
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w), severity


def safe_levels(trials):
    """Least rejected severity by stratum from (stratum, severity) of distinct good documents."""
    out = {}
    for stratum in {s for s, _ in trials}:
        own = [v for s, v in trials if s == stratum]
        n, level = len(own), 0
        while level < rules.LEVELS:
            k = sum(v > rules.LEVELS - level - 1 for v in own)
            tail = sum(comb(n, j) * rules.RISK**j * (1 - rules.RISK) ** (n - j) for j in range(k + 1))
            if k > n * rules.RISK or tail > rules.ERROR / (len(rules.STRATA) + 1):
                break
            level += 1
        if level:
            out[stratum] = rules.LEVELS + 1 - level
    return out


def masked(text):
    """All spans of the base kinds replaced, runs of overlapping ones together."""
    out, at = [], 0
    for a, _, b in literal_spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def test_pipeline_equals_plain_stages(spark, tokenizer):  # noqa: F811
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = {r.doc_id: (r.text or "", r.lang) for r in table.collect()}
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        b = sorted(naive_buckets(text))
        norm = sum(float(model.squares[k]) for k in b) ** 0.5
        margin = sum(float(model.weights[k]) for k in b) / norm + model.bias if norm else model.bias
        return 1 / (1 + np.exp(-(model.slope * margin + model.shift)))

    docs = {i: d for i, d in docs.items() if score(d[0]) >= quality.THRESHOLD}
    found = {i: statistics(t) for i, (t, _) in docs.items()}
    stratum = {i: lang if lang in rules.STRATA else rules.OTHER for i, (_, lang) in docs.items()}
    levels = safe_levels([(stratum[i], found[i][1]) for i in docs if labels.get(i) == 1 and not held_out(i) and not found[i][0]])
    docs = {i: d for i, d in docs.items() if not found[i][0] and found[i][1] < levels.get(stratum[i], rules.LEVELS + 1)}
    leaders = {i for i, _, c in brute_groups([(i, t) for i, (t, _) in docs.items()]) if i == c}
    docs = {i: d for i, d in docs.items() if i in leaders}
    assert not any(s.order >= len(secrets.BASE_KINDS) for t, _ in docs.values() for s in secrets.find_secrets(t))
    ids = {i: tokenizer.encode(masked(t), add_special_tokens=False).ids + [0] for i, (t, _) in docs.items()}

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids) and len(ids) > 50
    total = sum(map(len, ids.values()))
    assert sorted((p.sequence_id, p.offset + k) for p in pieces for k in range(p.length)) == [(k // 1024, k % 1024) for k in range(total)]
    for i, want in ids.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) == len(want)
        for p in own:
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
