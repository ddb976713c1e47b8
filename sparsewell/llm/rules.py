"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Four statistics of a text are compared with cutoffs.  The cutoffs move together
along a fixed path of levels, from rejecting next to nothing to rejecting a
lot.  Per stratum (language) the labelled holdout gives, for each level, the
number of good documents it would reject; a level is safe if the exact binomial
tail P(Bin(n, RISK) <= rejected) is at most ERROR divided by the number of
strata, where n and the rejected count distinct documents.  Levels are tested
in order and testing stops at the first that fails, so the only correction
needed is the one over strata.  The last safe level is used: with probability 1 - ERROR over the holdout, no stratum loses more than
RISK of its good documents to the method's rules.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, materialize
from .quality import held_out

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: Most good documents of a stratum that may be lost, and the chance that any stratum loses more.
RISK, ERROR = 0.03, 0.10
#: Cutoffs by level; a text is rejected at a level if any of its statistics exceeds that level's cutoff.
PATH = {
    "symbol_share": (0.60, 0.40, 0.30, 0.20, 0.15, 0.12, 0.09, 0.07, 0.05, 0.04, 0.03, 0.02),
    "capital_share": (0.95, 0.90, 0.85, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15),
    "repeat_share": (0.50, 0.48, 0.46, 0.44, 0.42, 0.40, 0.38, 0.36, 0.34, 0.32, 0.30, 0.28),
    "dup_line_share": (0.99, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50, 0.45),
}
LEVELS = len(PATH["symbol_share"])

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as stored values instead of computing them again.

    The one-row generator keeps the optimizer from merging this projection with the next.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts of its whole texts and n_lines, n_capitals.

    Lines count if they hold a word.  A null text has no words.
    """
    names = docs.columns
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = _once(
        df,
        _w=F.array_remove(F.split("_t", SPACE + "+"), ""),
        _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    third = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    none = F.array().cast("array<bigint>")
    df = _once(
        df.select(
            *names,
            "_w",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        ),
        _h=F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), third)).otherwise(none),
    ).drop("_w")
    # windows by hash, then place; equal neighbours are windows found twice or more
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = _once(df, _s=F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_h")
    twice = F.filter("_s", lambda x, k: (x.h == F.get("_s", k + 1).h) | (x.h == F.when(k > 0, F.get("_s", k - 1).h)))
    df = _once(df, _p=F.sort_array(F.transform(twice, lambda x: x.i))).drop("_s")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n"))
    return df.withColumn("n_repeat_words", F.aggregate("_p", start, step, lambda a: a.n)).drop("_p")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def with_severity(stats: DataFrame, lang: str = "lang") -> DataFrame:
    """Add base_failed, stratum and severity: how many levels of the path, from the strictest down, reject the text."""
    share = {
        "symbol_share": _share("n_symbols", "word_chars"),
        "capital_share": _share("n_capitals", "word_chars"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
    }
    over = [sum((F.when(share[name] > cut, 1).otherwise(0) for cut in cuts), F.lit(0)) for name, cuts in PATH.items()]
    return (
        stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("stratum", F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise(OTHER))
        .withColumn("severity", F.greatest(*over))
    )


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    below = F.lit(1.0)
    for k in range(8):
        below = below * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + series - F.log(below)


def _binomial_tail(k: Column, n: Column) -> Column:
    """P(Bin(n, RISK) <= k), summed in logarithms; 1 where k exceeds the mean anyway.

    Below the mean, terms fall faster than exp(-m * m / (2 * n * RISK)) over m steps
    down from k, so those more than ten times sqrt(n * RISK) below k are less
    than the rounding of the sum, which has as many terms.
    """
    n, k = n.cast("double"), k.cast("long")
    first = F.greatest(F.lit(0).cast("long"), k - F.ceil(10 * F.sqrt(n * RISK)) - 10)
    odds = F.log(F.lit(RISK / (1 - RISK)))
    start = _log_gamma(n + 1) - _log_gamma(first + 1.0) - _log_gamma(n - first + 1) + first * F.log(F.lit(RISK)) + (n - first) * F.log(F.lit(1 - RISK))

    def add(acc: Column, j: Column) -> Column:
        term = acc.term + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > first, F.sequence(first + 1, k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.aggregate(steps, F.struct(start.alias("term"), start.alias("total")), add, lambda a: a.total))
    return F.when(k > n * RISK, F.lit(1.0)).otherwise(tail)


def choose_levels(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum the least severity that is rejected: (stratum, reject_from), at most one row per stratum.

    The holdout are the good documents (quality 1) among labelled rows whose
    labels are not kept for evaluation, without those that the base rules
    reject.  A doc_id is one trial of its stratum, however many rows it has,
    and is rejected if any of them is.  The bound takes trials as independent:
    copies under other doc_ids count each, so the guarantee speaks of
    documents drawn like the labelled ones, copies included.  A stratum
    without a safe level has no row and loses nothing.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    seen = stats.where(~held_out() & ~F.col("base_failed")).select("doc_id", "stratum", "severity").join(good, "doc_id")
    trials = seen.groupBy("doc_id", "stratum").agg(F.max("severity").alias("severity")).groupBy("stratum", "severity").agg(F.count("*").alias("c"))
    levels = trials.select("stratum", "severity", "c", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    tested = levels.groupBy("stratum", "level").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("severity") > LEVELS - F.col("level"), F.col("c"))), F.lit(0)).alias("k"))
    tested = tested.withColumn("safe", _binomial_tail(F.col("k"), F.col("n")) <= ERROR / (len(STRATA) + 1))
    failed = F.coalesce(F.min(F.when(~F.col("safe"), F.col("level"))), F.lit(LEVELS + 1))
    chosen = tested.groupBy("stratum").agg((failed - 1).alias("level"))
    return chosen.where("level > 0").select("stratum", (LEVELS + 1 - F.col("level")).alias("reject_from"))


def _judged(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    # one row per stratum at most
    judged = rows.join(F.broadcast(chosen), "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("severity") >= F.col("reject_from"), F.lit(False)))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every whole text.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, stratum and severity.  Null,
    empty and blank texts have no words and fail the base rules; a null or
    unknown lang is stratum 'other'; a null doc_id stays null and takes no part
    in the choice of cutoffs; repeated rows give repeated results; without
    labels only the base rules reject; other columns are ignored; an empty
    table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    stats = materialize(with_severity(with_statistics(rows).drop("text")), "rules-statistics")
    return _judged(stats, choose_levels(stats, labels)).select("doc_id", *_COUNTS, "base_failed", "kept", "stratum", "severity")


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` that the rules keep; edge cases as in ``judge_documents``."""
    # written with the texts, so that no text is counted twice or shuffled to its labels
    stats = materialize(with_severity(with_statistics(docs.select(*DOCUMENT_COLUMNS))), "rules-statistics")
    return _judged(stats, choose_levels(stats, labels)).where("kept").select(*DOCUMENT_COLUMNS)
