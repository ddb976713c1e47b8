"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node passes the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    passed = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return passed.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    ``edges`` holds long columns u and v in any order; loops, repeated rows and
    rows with nulls are ignored.  Returns (id, component_id) for all nodes with
    an edge except the smallest of each component, whose component is itself.
    Rounds go on until the edge set no longer changes, so a component of any
    size or diameter is complete; every round is a written table.
    """
    current = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    before = None
    while True:
        rounded = materialize(_small_star(_large_star(current)), tag)
        now = rounded.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(current)
        current = rounded
        if tuple(now) == before:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = tuple(now)
