"""Repeated rows, long texts and broken files."""

import json
from math import exp, lgamma, log

import pytest
from pyspark.sql import functions as F
from test_llm import SF, VOCAB, brute_groups, docs, tokenizer, unpacked  # noqa: F401

from sparsewell.llm import bpe, minhash, quality, rules, secrets, tokens, urls, warc, wordpiece


def good_documents(spark, n=300):
    words = [f"word{k}" for k in range(80)]
    rows = [(i, " ".join(words[(i * 7 + k * k) % 80] + str((i * k) % 13) for k in range(70)) + (" #" * (i % 9)), "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")


def test_repeated_rows_change_no_cutoff(spark):
    for n in (30, 300):
        d, y = good_documents(spark, n)
        once = rules.judge_documents(d, y).select("doc_id", "kept").distinct().collect()
        many = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k")
        again = rules.judge_documents(many, y).select("doc_id", "kept").distinct().collect()
        assert sorted(once) == sorted(again)
        stats = rules.with_severity(rules.with_statistics(many))
        assert rules.choose_levels(stats, y).collect() == rules.choose_levels(rules.with_severity(rules.with_statistics(d)), y).collect()
        if n == 30:
            assert not rules.choose_levels(stats, y).collect()  # too few to be sure of anything


def test_binomial_tail_of_large_holdouts(spark):
    rows = [(k, n) for n in (5_000, 200_000, 4_000_000) for k in (0, 1, int(n * rules.RISK * 0.9), int(n * rules.RISK * 0.99), int(n * rules.RISK))]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", rules._binomial_tail(F.col("k"), F.col("n")))
    for r in df.collect():
        terms = [lgamma(r.n + 1) - lgamma(j + 1) - lgamma(r.n - j + 1) + j * log(rules.RISK) + (r.n - j) * log(1 - rules.RISK) for j in range(max(0, r.k - 40_000), r.k + 1)]
        top = max(terms)
        want = exp(top) * sum(exp(t - top) for t in terms) if top > -700 else 0.0
        assert r.p == pytest.approx(want, rel=1e-5, abs=1e-250), (r.k, r.n)


def test_a_document_of_many_equal_rows(spark):
    text = " ".join(f"w{k}" for k in range(200))
    near = text + " end"
    rows = [(1, text)] * 1500 + [(2, near)] * 1500 + [(3, "other words here " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sigs = minhash.materialize(minhash.signatures(df), "t")
    first = sigs.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "weight")).alias("r"), F.first("sig").alias("sig"))
    reps = minhash.materialize(first.select(F.monotonically_increasing_id().alias("sid"), "set_key", "r.*", "sig"), "t")
    assert reps.count() == 3
    texts = minhash._texts_of(reps.select("sid"), df, reps)
    assert texts.count() == 3  # one row to compare, whatever the number of rows
    got = minhash.near_duplicates(df)
    assert got.count() == 3001 and {(r.doc_id, r.component_id) for r in got.distinct().collect()} == {(1, 1), (2, 1), (3, 3)}


def test_repeated_ids_leave_their_smallest_row(spark):
    rows = [(5, "b b", "en", "s", 1), (5, "a a", None, "s", 1), (5, "a a", "en", "s", 1), (6, "c", "en", "s", 1), (None, "c", "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = minhash.drop_near_duplicates(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, "a a", None, "s", 1), (6, "c", "en", "s", 1), (None, "c", "en", "s", 1), (None, None, None, None, None)]))


def test_ids_with_several_texts_join_groups(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(9, a), (9, b), (4, a + " end"), (7, b + " end"), (1, "alone")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 7: 4, 1: 1}


def test_long_texts_in_one_bucket(spark):
    base = [f"word{k}" for k in range(150_000)]  # 1.4 MB each
    rows = []
    for i in range(6):
        w = list(base)
        for k in range(0, len(w), 60 if i < 4 else 9):
            w[k + i] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_every_operator_takes_very_long_texts(spark, tokenizer):  # noqa: F811
    texts = ["spaces" + " " * 2_000_000 + "x", "\n" * 1_000_000 + "x", "a" * 1_000_000, "many words of a text, and more. " * 60_000]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    pieces = packing.pack_documents(df, VOCAB).collect()
    for i, ids in enumerate(want):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in unpacked(p.ids)] == [*ids, 0]
    assert {(r.doc_id, r.n_tokens) for r in bpe.bpe_digests(df, VOCAB).collect()} == {(i, len(ids)) for i, ids in enumerate(want)}
    counts = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(df, VOCAB).collect()}
    assert [counts[i][0] for i in range(4)] == [2, 1, 1, 420_000] and counts[2][1] > 1000
    y = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    assert quality.score_documents(df, quality.train(df, y)).count() == 4
    stats = {r.doc_id: r for r in rules.judge_documents(df, y).collect()}
    assert stats[3].n_words == stats[3].n_repeat_words == 420_000 and stats[1].n_words == 1
    assert {r.spans for r in secrets.scan_secrets(df).collect()} == {"", "hex:0:1000000"}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://e.com/").alias("url"), F.col("text").alias("html"))
    assert {(r.page_id, r.payload_bytes) for r in warc.archive_round_trip(pages).collect()} == {(i, len(t)) for i, t in enumerate(texts)}
    assert urls.judge_urls(pages.select("page_id", F.concat(F.lit("http://e.com/"), "html").alias("url"))).count() == 4


def test_word_pieces_of_a_long_word():
    with open(VOCAB, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = bpe._byte_alphabet()
    labels = {bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
    longest = max(map(len, labels))
    for word in (b" " + b"a" * 300_000, b" " + b"thequick" * 30_000):
        n = at = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in labels)
            n += 1
        assert wordpiece._automaton(VOCAB).count(word) == n


def test_ids_equal_over_all_code_points(tokenizer):  # noqa: F811
    """Pre-splitting depends on the class of each code point alone, so each is tried next to letters, digits, marks and spaces."""
    own = tokens.encoder(VOCAB, True)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}. {chr(c)}'s" for c in points[at : at + 4096]]
        if at > 0x20000 and at % (4096 * 16):  # beyond the planes with letters, some blocks will do
            continue
        for text, e, ids in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
            assert unpacked(ids) == e.ids, ascii(text)


def test_broken_archives_raise(spark, tmp_path):
    records = [warc.format_record(i, f"http://a/{i}", "x" * 50 * i, warc.payload_digest(b"x" * 50 * i), None) for i in range(1, 9)]
    for name, data in {"cut": "".join(records)[:-20], "behind": "".join(records) + "garbage", "before": "garbage" + "".join(records), "inside": "".join(records[:4]) + records[4].replace("Content-Length: ", "Content-Length: 9", 1) + "".join(records[5:])}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text(data, newline="")
        with pytest.raises(ValueError, match="broken record"):
            warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.warc").write_text("".join(records), newline="")
    (tmp_path / "whole" / "empty.warc").write_text("")
    got = warc.read_archives(spark, f"file://{tmp_path}/whole", payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload), r.url, r.intact) for r in got) == [(i, b"x" * 50 * i, f"http://a/{i}", True) for i in range(1, 9)]


def test_digests_and_references_are_checked(spark, tmp_path):
    good = warc.payload_digest(b"page")
    records = [warc.format_record(1, "u", "page", "WRONG", None), warc.format_record(2, "u", "page", good, None), warc.format_record(3, "u", "page", good, 2), warc.format_record(4, "u", "page", good, 77), warc.format_record(5, "u", "", "OTHER", 2)]
    (tmp_path / "a.warc").write_text("".join(records), newline="")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.intact) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {1: (4, good, False), 2: (4, good, True), 3: (4, good, True), 4: (None, None, False), 5: (None, None, False)}
