"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of consecutive words, every window into
shingles.  A document holds a window exactly if it holds all its shingles at
their places, so one shingle of each window, the rarest, is a sufficient prefix:

1. Shingles of all documents meet the benchmark's shingles by hash and then word
   for word; each hit is a document, a place and the number of a shingle.  Only
   hits leave the scan, with one row for each document.
2. Hits are counted by shingle over all documents.  A window with a shingle that
   occurs nowhere is dropped; of each other window the rarest shingle is kept.
3. Hits of kept shingles are candidates.  Their place in the window must leave
   room for it in the document: before its start and within its length.
4. A candidate is confirmed if the document also holds, at their places, those
   shingles of the window that cover all its words.

Benchmark shingles are sent to the documents in blocks of bounded size; a larger
benchmark takes more scans.  All other joins are between hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

WINDOW = 10
SHINGLE_WORDS = 5
#: Shingles of one block, and bytes of their text.
BLOCK_SHINGLES, BLOCK_BYTES = 1 << 20, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ("doc_id", "text_key")


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _WORD_BREAK), "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as stored values instead of computing them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _hash(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(width)))


def _joined(words: str, at: Column, width: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, width), " ")


def _benchmark(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: named (wid, item_id), placed (wid, n, at, sid, of words) and shingles (sid, width, shingle)."""
    rows = _once(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), words=_words("text")).where(F.size("words") > 0)
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = materialize(rows.select("item_id", "words", F.explode(places).alias("at")).select("item_id", _joined("words", F.col("at"), window).alias("window")).distinct(), "contamination-windows")
    numbered = materialize(windows.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window"), "contamination-numbered")
    named = materialize(windows.join(numbered, "window").select("wid", "item_id"), "contamination-items")
    split = numbered.select("wid", F.split("window", " ").alias("words")).select("*", F.size("words").alias("n"), F.least(F.size("words"), F.lit(shingle)).alias("width"))
    pieces = split.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("at")).select("wid", "n", "width", "at", _joined("words", F.col("at"), F.col("width")).alias("shingle"))
    shingles = materialize(pieces.select("width", "shingle").distinct().select(F.monotonically_increasing_id().alias("sid"), "width", "shingle"), "contamination-shingles")
    placed = materialize(pieces.join(shingles.select("sid", "shingle"), "shingle").select("wid", "n", "width", "at", "sid"), "contamination-placed")
    discard(windows)
    discard(numbered)
    return named, placed, shingles


def _hits(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n_words, at, sid): one with null ``at`` for every document, and one for each benchmark shingle at each place."""
    widths = [r[0] for r in shingles.select("width").distinct().orderBy("width").collect()]  # as many as a shingle has words at most
    many = shingles.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("shingle")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-many.n // BLOCK_SHINGLES), -(-many.bytes // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = _once(rows, words=_words("text")).select(*_DOC, "words", F.size("words").alias("n_words"))
    own = rows.select(*_DOC, "n_words", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("sid"))
    if not widths:
        return own
    split = F.split("shingle", " ")
    keyed = shingles.withColumn("words", split).withColumn("hash", reduce(lambda rest, w: F.when(F.col("width") == w, _hash("words", F.lit(0), w)).otherwise(rest), widths, F.lit(None).cast("long")))
    keyed = materialize(keyed.select("hash", "sid", "width", "shingle"), "contamination-keyed")
    found = []
    for block in range(blocks):
        # place -1 carries the document itself through the join
        first = -1 if block == 0 else 0
        at = rows.select("*", F.explode(F.sequence(F.lit(first), F.greatest(F.col("n_words") - 1, F.lit(first)))).alias("at"))
        if len(widths) == 1:
            at = at.select("*", F.when(F.col("at") >= 0, _hash("words", F.col("at"), widths[0])).alias("hash"))
        else:
            each = F.when(F.col("at") >= 0, F.array(*(_hash("words", F.col("at"), w) for w in widths)))
            at = at.select("*", F.explode(F.coalesce(each, F.array(F.lit(None).cast("long")))).alias("hash"))
        mine = keyed.where(F.pmod("hash", F.lit(blocks)) == block).select(F.col("hash").alias("key"), "sid", "width", "shingle")
        # a block is bounded by BLOCK_SHINGLES and BLOCK_BYTES
        same = (F.col("hash") == F.col("key")) & (F.col("at") + F.col("width") <= F.col("n_words")) & (_joined("words", F.col("at"), F.col("width")) == F.col("shingle"))
        met = at.join(F.broadcast(mine), same, "left" if block == 0 else "inner").where(F.col("sid").isNotNull() | (F.col("at") < 0))
        found.append(met.select(*_DOC, "n_words", F.when(F.col("at") >= 0, F.col("at")).alias("at"), "sid"))
    return reduce(DataFrame.unionAll, found)


def _prefixes(placed: DataFrame, hits: DataFrame) -> DataFrame:
    """For each window that can occur its rarest shingle (sid, wid, at, n) and ``cover``: the other shingles that hold all its words."""
    counts = hits.groupBy("sid").agg(F.count("*").alias("c"))
    each = placed.join(counts, "sid", "left")
    covers = (F.col("at") % F.col("width") == 0) | (F.col("at") == F.col("n") - F.col("width"))
    rarest = each.groupBy("wid", "n").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "sid", "at")).alias("r"),
        F.collect_list(F.when(covers, F.struct("at", "sid"))).alias("cover"),  # as many as a window has words at most
    )
    others = F.filter("cover", lambda x: x["at"] != F.col("r.at"))
    return rarest.where("r.c > 0").select(F.col("r.sid").alias("sid"), "wid", "n", F.col("r.at").alias("offset"), others.alias("cover"))


def _occurrences(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, text_key, begin, n, wid) of every window in every document."""
    begin = F.col("at") - F.col("offset")
    candidates = hits.join(prefixes, "sid").where((begin >= 0) & (begin + F.col("n") <= F.col("n_words"))).select(*_DOC, begin.alias("begin"), "n", "wid", "cover")
    whole = candidates.where(F.size("cover") == 0).drop("cover")
    asked = candidates.select(*_DOC, "begin", "n", "wid", F.size("cover").alias("wanted"), F.explode("cover").alias("c")).select(*_DOC, "begin", "n", "wid", "wanted", (F.col("begin") + F.col("c.at")).alias("at"), F.col("c.sid").alias("sid"))
    there = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("at").alias("a"), F.col("sid").alias("s"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("at") == F.col("a")) & (F.col("sid") == F.col("s"))
    met = asked.join(there, same, "left_semi").groupBy(*_DOC, "begin", "n", "wid", "wanted").agg(F.count("*").alias("met")).where("met = wanted")
    return whole.unionAll(met.select(*_DOC, "begin", "n", "wid"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Windows of benchmark items in whole texts.

    Returns three written tables: documents (doc_id, text_key, n_words), one row
    for each input row; occurrences (doc_id, text_key, begin, n, wid), the places
    in words at which each distinct window occurs in each distinct document; and
    the items of each window (wid, item_id).
    """
    named, placed, shingles = _benchmark(items, window, shingle)
    found = materialize(_hits(docs, shingles), "contamination-hits")
    hits = materialize(found.where("sid is not null").distinct(), "contamination-distinct")
    prefixes = materialize(_prefixes(placed, hits), "contamination-prefixes")
    occurrences = materialize(_occurrences(hits, prefixes), "contamination-found")
    for done in (hits, prefixes, placed, shingles):
        discard(done)
    return found.where("at is null").select(*_DOC, "n_words"), occurrences, named


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """How much of every whole text stands in benchmark items.

    Returns one row per input row: doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items (items with occurring windows),
    items_sha256 (of those item_ids, sorted as strings, comma-joined) and
    contaminated (n_hit > 0).  An item with fewer words than a window is one
    window; without words, or null, it has none.  Null and empty documents have
    no words; a null doc_id stays null; repeated rows give repeated results;
    items without an id hit words but are not counted; repeated items count
    once.  Texts of any length are compared whole; other columns are ignored; an
    empty table of documents gives an empty table, and without items nothing is
    contaminated.
    """
    rows, occurrences, named = find_contamination(docs, items, window, shingle)
    end = F.col("begin") + F.col("n")
    before = F.max(end).over(Window.partitionBy(*_DOC).orderBy("begin", "n").rowsBetween(Window.unboundedPreceding, -1))
    covered = occurrences.select(*_DOC, "begin", end.alias("end"), F.coalesce(before, F.lit(0)).alias("before"))
    words = covered.groupBy(*_DOC).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "before"))).alias("n_hit"))
    # as many as the benchmark has items at most
    ids = occurrences.select(*_DOC, "wid").distinct().join(named, "wid").groupBy(*_DOC).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    both = words.join(ids, words.doc_id.eqNullSafe(ids.doc_id) & (words.text_key == ids.text_key)).select(words.doc_id.alias("d"), words.text_key.alias("t"), "n_hit", "ids")
    out = rows.join(both, rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("t")), "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
