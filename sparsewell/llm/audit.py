"""Filter interaction audit by inclusion-exclusion.

Five filters judge every document.  One pass counts, for each of the 32 subsets
of filters, the documents that fail all of them (sums of flag products), once
for all documents and once for each class whose losses matter.  Everything else
follows from these joint counts alone: Moebius inversion gives the survivors of
any set of filters, their differences what a filter removes after others and
what only it removes, and the signed joint counts are the Harsanyi dividends of
the removal game, so a filter's Shapley value is the sum of its dividends, each
shared among the filters of its subset.

The duplicate filter looks at the whole table: the texts' digests are grouped for
their smallest doc_id, and a document fails if it does not hold that place.
Documents meet the holders by digest and doc_id together, so a text that a third
of all documents share is no hot key.  Texts never leave their scan.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
#: Documents fail below so many words, below this percentage of distinct words, above this percentage of capitals, or with any of these symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_WORD_BREAK = r"[\x20\x09-\x0D]+"
_ALL = (1 << len(FILTERS)) - 1
_ORDERS = factorial(len(FILTERS))
_CLASSES = ("all", "good", "toxic")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as stored values instead of computing them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def text_flags(docs: DataFrame) -> DataFrame:
    """part, doc_id, text digest and the flags A to D (0 or 1) of every row."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _once(rows, words=F.array_remove(F.split("text", _WORD_BREAK), ""))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = {
        "A": F.size("words") < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.size("words"),
        "C": 100 * capitals > MOST_CAPITALS * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    return rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.cast("long").alias(k) for k, c in fails.items()))


def filter_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags A to E and the classes all, good and toxic (0 or 1) of every row."""
    rows = materialize(text_flags(docs), "audit-flags")
    holders = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(1))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    rows = rows.join(holders, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    again = (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("long")
    zero = F.lit(0).cast("long")
    return rows.select("part", "A", "B", "C", "D", again.alias("E"), F.lit(1).cast("long").alias("all"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))


def joint_failures(flags: DataFrame) -> DataFrame:
    """Per part one array for each class: at place S (bits of filters) how many documents fail every filter of S."""

    def product(kind: str, subset: int) -> Column:
        out = F.col(kind)
        for k, name in enumerate(FILTERS):
            if subset >> k & 1:
                out = out * F.col(name)
        return F.sum(out)

    counts = flags.groupBy("part").agg(*(product(kind, s).alias(f"{kind}{s}") for kind in _CLASSES for s in range(_ALL + 1)))
    return counts.select("part", *(F.array(*(F.col(f"{kind}{s}") for s in range(_ALL + 1))).alias(kind) for kind in _CLASSES))


def _survivors(joint: str) -> Column:
    """Moebius inversion: at place T the documents that fail no filter of T."""
    subsets = F.sequence(F.lit(0), F.lit(_ALL))
    signed = lambda s: F.when(F.bit_count(s) % 2 == 0, F.get(joint, s)).otherwise(-F.get(joint, s))
    return F.transform(subsets, lambda t: F.aggregate(subsets, F.lit(0).cast("long"), lambda n, s: n + F.when(s.bitwiseAND(t) == s, signed(s)).otherwise(F.lit(0).cast("long"))))


def _shapley(joint: str) -> Column:
    """At place k the Shapley value of filter k times the number of orders: its shares of all Harsanyi dividends."""
    shares = []
    for k in range(len(FILTERS)):
        mine = [s for s in range(_ALL + 1) if s >> k & 1]
        total = F.lit(0).cast("long")
        for s in mine:
            size = s.bit_count()
            total = total + F.get(joint, F.lit(s)) * F.lit((_ORDERS // size) * (1 if size % 2 else -1))
        shares.append(total)
    return F.array(*shares)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of every order of the filters.

    Returns one row per part (lang; null and '' are one part ''), filter_order and
    step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, all counts of rows of the part.  Null texts are empty texts: they
    fail A alone, and E behind a smaller doc_id with an empty text.  Repeated
    rows count each; those of the smallest doc_id of a text do not fail E,
    those of others do.  A null doc_id is no smaller id, never fails E
    and has no labels.  Repeated labels count once, a class holds if any row
    says so, null marks say nothing.  Texts are read whole, other columns are
    ignored, an empty table gives an empty table.
    """
    joint = joint_failures(filter_flags(docs, labels))
    tables = joint.select("part", F.col("all").alias("failing"), *(_survivors(kind).alias(kind) for kind in _CLASSES), _shapley("all").alias("shares"))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = tables.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda at: F.ascii(F.col("filter_order").substr(at, F.lit(1))) - ord(FILTERS[0])
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    earlier = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    before = F.aggregate(earlier, F.lit(0), lambda m, at: m + F.when(at < F.col("step"), power(place(at))).otherwise(0))
    steps = steps.withColumns({"before": before, "own": place(F.col("step")), "mine": power(place(F.col("step")))})
    lost = lambda kind: F.get(kind, F.col("before")) - F.get(kind, F.col("before") + F.col("mine"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("all", F.col("before") + F.col("mine")).alias("kept"),
        lost("all").alias("removed"),
        (F.get("failing", F.col("mine")) - lost("all")).alias("redundant"),
        (F.get("all", F.lit(_ALL) - F.col("mine")) - F.get("all", F.lit(_ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("own")).alias("shapley"),
    )
