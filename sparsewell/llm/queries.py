"""Driver queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audit, bpe, contamination, minhash, packing, pivots, quality, rules, secrets, urls, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (op1_quality_classifier, op2_quality_rules, op3_embedding_dedup, op4_bpe_codec, op5_token_counts, op6_minhash_dedup, op7_warc, op8_secret_scan, op9_url_filter, op10_packing, op11_decontamination, op12_filter_audit, op13_alignment)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _rules_sql() -> str:
    over = {
        "symbol_share": "n_symbols / nullif(word_chars, 0)",
        "capital_share": "n_capitals / nullif(word_chars, 0)",
        "repeat_share": "n_repeat_words / nullif(n_words, 0)",
        "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    }
    severity = "greatest(" + ", ".join(" + ".join(f"CAST(coalesce({over[name]}, 0.0) > CAST({cut} AS DOUBLE) AS INT)" for cut in cuts) for name, cuts in rules.PATH.items()) + ")"
    strata = ", ".join(f"'{s}'" for s in rules.STRATA)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY r),
counts AS (SELECT w.r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_capitals,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN repeated USING (r)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN lang IN ({strata}) THEN lang ELSE '{rules.OTHER}' END AS stratum, {severity} AS severity FROM counts),
crc AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS c FROM s),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
trials AS (SELECT doc_id, stratum, max(severity) AS severity FROM crc JOIN good USING (doc_id) WHERE NOT base_failed AND xor(c, 4294967295) % 5 <> 0 GROUP BY ALL),
seen AS (SELECT stratum, severity, count(*) AS c FROM trials GROUP BY ALL),
tested AS (SELECT stratum, level, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (severity > {rules.LEVELS} - level), 0)::BIGINT AS k FROM seen, range(1, {rules.LEVELS + 1}) AS q(level) GROUP BY ALL),
safe AS (SELECT *, k <= n * {rules.RISK}::DOUBLE AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({rules.RISK}::DOUBLE) + (n - j) * ln({1 - rules.RISK}::DOUBLE)))) <= {rules.ERROR / (len(rules.STRATA) + 1)}::DOUBLE AS safe FROM tested),
chosen AS (SELECT stratum, {rules.LEVELS + 1} - (coalesce(min(level) FILTER (NOT safe), {rules.LEVELS + 1}) - 1) AS reject_from FROM safe GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT coalesce(reject_from <= {rules.LEVELS} AND severity >= reject_from, false) AS kept, stratum, severity::INT AS severity
FROM s LEFT JOIN chosen USING (stratum)"""


_EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {pivots.COSINE}::DOUBLE),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
low AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""

_MINHASH_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE {minhash.PERCENT_DEN} * c >= {minhash.PERCENT} * (a.n + b.n - c)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
low AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d"""


def _url_sql() -> str:
    ranked = sorted(urls.RULES, key=lambda r: -len(r.name))
    fit = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    names = " ".join(f"{fit(r)} THEN '{r.name}'" for r in ranked)
    verdicts = " ".join(f"{fit(r)} THEN '{r.verdict}'" for r in ranked)
    part = {"**": ".*", "*": "[^/]*"}
    globs = "|".join("".join(part.get(p) or re.escape(p).replace("\\-", "-") for p in re.findall(r"\*\*|\*|[^*]+", g)) for g in urls.BLOCK_GLOBS)
    return rf"""
WITH s AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS p FROM pages),
u AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(url, p + 3), '^[^/?#]*') END AS h, CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(url, p + 3), '(?s)^[^/?#]*([^?#]*)', 1) END AS path FROM s),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS bare,
  array_to_string(list_transform(regexp_extract_all(path, '(?s)%[0-9A-Fa-f][0-9A-Fa-f]|.'), lambda x: CASE WHEN length(x) = 3 AND regexp_full_match(chr(('0x' || substr(x, 2))::INT), '[A-Za-z0-9._~-]') THEN chr(('0x' || substr(x, 2))::INT) ELSE x END), '') AS plain FROM c)
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {verdicts} WHEN regexp_full_match('.' || bare || plain, '(?s)({globs})') THEN 'block' ELSE 'allow' END AS verdict FROM k"""

_CONTAMINATION_SQL = rf"""
WITH w AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
s AS (SELECT kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM w),
items AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT id, w, least(len(w), {contamination.WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {contamination.WINDOW}) + 2)) AS i FROM s WHERE kind = 'b' AND len(w) > 0)),
found AS (SELECT r, i, g.n, items.id AS item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n)) g JOIN items ON g.s = items.s AND g.n = items.n),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item::VARCHAR)) AS l FROM found GROUP BY r)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM s LEFT JOIN hit USING (r) LEFT JOIN named USING (r) WHERE kind = 'd'"""

_AUDIT_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
  (len(w) < {audit.LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {audit.LEAST_DISTINCT} * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.MOST_CAPITALS} * length(t))::INT
  + 8 * regexp_matches(t, '{audit.SYMBOLS}')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS m FROM d LEFT JOIN marks USING (doc_id)),
pattern AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
steps AS (SELECT o, s::INT AS step, 1 << (ascii(o[s]) - 65) AS mine, list_sum([CASE WHEN k < s THEN 1 << (ascii(o[k]) - 65) ELSE 0 END for k in range(1, 6)])::INT AS before
  FROM (SELECT a || b || c || d || e AS o FROM (SELECT unnest(['A','B','C','D','E']) AS a), (SELECT unnest(['A','B','C','D','E']) AS b), (SELECT unnest(['A','B','C','D','E']) AS c), (SELECT unnest(['A','B','C','D','E']) AS d), (SELECT unnest(['A','B','C','D','E']) AS e)
    WHERE len(list_distinct([a, b, c, d, e])) = 5), range(1, 6) AS q(s)),
r AS (SELECT part, o AS filter_order, step, mine, coalesce(sum(n) FILTER (m & (before | mine) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & mine <> 0), 0) AS removed, coalesce(sum(n) FILTER (m & before <> 0 AND m & mine <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (m = mine), 0) AS unique_fails, coalesce(sum(good) FILTER (m & before = 0 AND m & mine <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (m & before = 0 AND m & mine <> 0), 0) AS toxic_lost
  FROM pattern, steps GROUP BY part, o, step, mine)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": _rules_sql(),
        "op3_embedding_dedup": _EMBEDDINGS_SQL,
        "op6_minhash_dedup": _MINHASH_SQL,
        "op7_warc": _WARC_SQL,
        "op9_url_filter": _url_sql(),
        "op11_decontamination": _CONTAMINATION_SQL,
        "op12_filter_audit": _AUDIT_SQL,
    }
