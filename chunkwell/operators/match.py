"""Requests against keys: equal ones, else those of which one is part of the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at a time.
MOST_BROADCAST = 100_000
#: Letters of the parts by which keys and requests meet.
GRAM = 3


def broadcast_parts(frame: DataFrame, most: int = MOST_BROADCAST) -> list[DataFrame]:
    """A frame whole if it has ``most`` rows at most, else in parts by a hash of its rows, each of about as many rows; for joins that need one side broadcast."""
    n = frame.count()
    parts = -(-n // most)
    if parts < 2:
        return [frame] if n else []
    return [frame.filter(F.pmod(F.xxhash64(*frame.columns), F.lit(parts)) == k) for k in range(parts)]


def grams(text: Column, size: int) -> Column:
    """The parts of a text with ``size`` letters, each once; the empty part for 0."""
    if not size:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def all_grams(text: Column) -> Column:
    return F.concat(*[grams(text, n) for n in range(GRAM + 1)])


def longest_grams(text: Column) -> Column:
    """The parts with ``GRAM`` letters, or a shorter text itself."""
    return F.when(F.length(text) < GRAM, F.array(text)).otherwise(grams(text, GRAM))


@dataclass
class KeyIndex:
    """``keys`` (key), ``holders`` (gram, key): keys by all their parts of up to three letters, ``counts`` (gram, n) of these, and ``rarest`` (gram, key): each key by the rarest of its
    longest parts."""

    keys: DataFrame
    holders: DataFrame
    counts: DataFrame
    rarest: DataFrame


def rarest(texts: DataFrame, counts: DataFrame, *columns: str) -> DataFrame:
    """(gram, columns) of rows with columns and ``of``: the gram of ``of`` that the fewest keys hold. A gram that no key holds is the rarest of all."""
    each = texts.select(*columns, F.explode(longest_grams(F.col("of"))).alias("gram")).join(counts, "gram", "left")
    return each.groupBy(*columns).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))


def build_keys(keys: DataFrame) -> KeyIndex:
    """The index of distinct (key)."""
    holders = keys.select(F.explode(all_grams(F.col("key"))).alias("gram"), "key")
    counts = holders.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return KeyIndex(keys, holders, counts, rarest(keys.withColumn("of", F.col("key")), counts, "key"))


def partial(requests: DataFrame, index: KeyIndex) -> DataFrame:
    """(qid, key) of (qid, want): keys that hold what is wanted or are held by it; an empty one is held by all.

    What holds a text holds its rarest part, so that a request meets only the keys with that; and a request that holds a key holds the key's rarest part. Both are joins of equal
    parts, after which whole texts are compared.
    """
    asked = rarest(requests.withColumn("of", F.col("want")), index.counts, "qid", "want")
    holding = asked.join(index.holders, "gram").filter(F.contains("key", "want")).select("qid", "key")
    parts = requests.select("qid", "want", F.explode(all_grams(F.col("want"))).alias("gram"))
    held = parts.join(index.rarest, "gram").filter(F.contains("want", "key")).select("qid", "key")
    return holding.unionByName(held).distinct()


def exact_or_partial(requests: DataFrame, keys: DataFrame | KeyIndex) -> DataFrame:
    """(qid, key) for (qid, want) and distinct (key), or the index of these: an equal key for a request keeps its partial ones away."""
    index = keys if isinstance(keys, KeyIndex) else build_keys(keys)
    out = requests.join(index.keys, F.col("want") == F.col("key")).select("qid", "key")
    rest = requests.join(index.keys, F.col("want") == F.col("key"), "left_anti").select("qid", "want")
    return out.unionByName(partial(rest, index)) if rest.limit(1).count() else out
