"""Connected components of a graph given as pairs, by alternating star contraction on DataFrames.

Each round links every vertex to the least of its neighbours, first those above it
(large star), then itself and those below it (small star). The number of pairs never grows, and
the rounds are logarithmic in the longest path. Pairs are written to the shared
folder after each round, so lost executors cost at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def mark(pairs: DataFrame) -> tuple[int, int]:
    """Number and check sum of pairs, which both stay the same once nothing moves."""
    row = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of pairs with u > v."""
    if large:  # neighbours of both sides, linked from those above
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # a vertex and those below it, all linked to the least
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (u, v) for each vertex ``u`` that is not the least of its component, which is ``v``.

    ``pairs`` has two columns of one orderable type, in any direction and with
    repeats; a pair of a vertex with itself is nothing.
    """
    a, b = pairs.columns
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = cut(edges)
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = cut(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    return edges
