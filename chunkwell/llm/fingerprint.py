"""Document fingerprints: SimHash in DataFrame functions, and a search by permuted block tables.

A term is two neighbouring words of a text in lower case, a text of one word its
only term. Terms weigh as often as they occur, and longer words weigh more, as they are the rarer: a term's
weight is the number of its characters up to ``HEAVIEST``. Each bit of a term's hash votes with that weight for 1 or -1,
and the fingerprint has the bits with more votes for 1. Votes are summed in long
columns of two 32-bit lanes each, so that 64 sums take 32 columns.

The search finds all fingerprints within a Hamming radius. A fingerprint's blocks are
permuted so that each choice of blocks comes first once, which makes a table for each
choice; two fingerprints within the radius agree on at least one choice of blocks.
Equal fingerprints are one entry.

Nulls: a null text is an empty one, whose fingerprint is zero. Null ids come after all
others. Repeated ids and rows are separate documents, in an order made by hashes of their texts, and dealt out by it.
A single document is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import cut, table

HEAVIEST = 15
#: Ranges of ids in which neighbours are found, at most, about as many rows in each at least, and sampled rows for each.
BUCKETS, BUCKET_ROWS, SAMPLED = 1 << 16, 200, 8
#: What a null id counts as when ranges are made.
LEAST = -(1 << 63)
#: Blocks of a fingerprint, those that agree if at most ``RADIUS`` bits differ.
BLOCKS, RADIUS = 6, 3
LANES = 32
ASKED = 50
LONG = "long"


def words_of(text: Column) -> Column:
    """The words of a text, in lower case."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def votes(hash_: Column, weight: Column) -> list[Column]:
    """For each pair of bits i and i + 32 the weight in their lanes, where they are set."""
    mask = F.lit((1 << 32) | 1).cast(LONG)
    return [F.shiftrightunsigned(hash_, i).bitwiseAND(mask) * weight for i in range(LANES)]


def combine(sums: list[Column], total: Column) -> Column:
    """The fingerprint: bits with over half of the total weight."""
    low = F.lit((1 << 32) - 1).cast(LONG)
    out = F.lit(0).cast(LONG)
    for i, s in enumerate(sums):
        for shift, lane in ((i, s.bitwiseAND(low)), (i + 32, F.shiftrightunsigned(s, 32))):
            bit = 1 << shift if shift < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(lane * 2 > total, F.lit(bit).cast(LONG)).otherwise(F.lit(0).cast(LONG)))
    return out


def simhash(rows: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """``keys`` and the fingerprint of ``text``; the keys identify a row and contain its partitioning."""
    words = rows.select(*keys, words_of(F.col(text)).alias("_w"))
    count = F.size("_w")
    #: each word with the one after it; of the last, which has none, only if it is alone
    after = F.slice(F.col("_w"), F.lit(2), F.greatest(count - 1, F.lit(1)))
    both = words.select(*keys, "_w", after.alias("_v"))
    each = both.select(*keys, F.explode_outer(F.arrays_zip("_w", "_v")).alias("_t"), (F.size("_w") > 1).alias("_many"))
    each = each.filter(~F.col("_many") | F.col("_t._v").isNotNull())
    weight = F.least(F.coalesce(F.length("_t._w"), F.lit(0)) + F.coalesce(F.length("_t._v"), F.lit(0)), F.lit(HEAVIEST))
    each = each.select(*keys, F.xxhash64("_t._w", "_t._v").alias("_h"), weight.cast(LONG).alias("_n"))
    summed = each.groupBy(*keys).agg(F.sum("_n").alias("_total"), *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(votes(F.col("_h"), F.col("_n")))])
    return summed.select(*keys, combine([F.col(f"_s{i}") for i in range(LANES)], F.col("_total")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near(entries: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows (query, fp): the distinct fingerprints ``fp`` of ``entries`` within ``radius`` bits of the distinct ``fp`` of ``queries``."""
    if blocks <= radius:
        raise ValueError("more blocks than bits of the radius are needed")
    bounds = [i * 64 // blocks for i in range(blocks + 1)]
    masks = [sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]

    def signed(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast(LONG)

    def tables(name: str) -> Column:
        """An entry of each table: its number, and the blocks that come first in its permutation."""
        return F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.col(name).bitwiseAND(signed(m)).alias("block")) for i, m in enumerate(masks)]))

    #: of the tables in which a pair agrees only the first makes a row
    different = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(different.bitwiseAND(signed(mask)) == 0, F.lit(i)) for i, mask in enumerate(masks)])
    left = queries.select(F.col("fp").alias("query")).distinct().withColumn("k", tables("query"))
    right = entries.select("fp").distinct().withColumn("e", tables("fp"))
    close = (F.col("k") == F.col("e")) & (F.bit_count(different) <= radius) & (F.col("k.number") == first)
    #: neither side is bounded, and what the planner guesses of their sizes leaves out the tables' number
    return left.join(right.hint("merge"), close).select("query", "fp")


def place() -> Column:
    """By which documents are ordered: the id, and for equal ids a hash of the text."""
    return F.struct(F.coalesce(F.col("doc_id").cast(LONG), F.lit(LEAST)).alias("i"), F.xxhash64("text").alias("h"))


def cuts(rows: DataFrame, most: int = BUCKETS, least: int = BUCKET_ROWS) -> list[tuple[int, int]]:
    """Bounds of ranges of places with about equal numbers of rows, from a sample of bounded size. Where they lie changes no result."""
    n = rows.count()
    wanted = max(1, min(most, n // least))
    if wanted == 1:
        return []
    sampled = rows.sample(min(1.0, SAMPLED * wanted / n), 1).select(place().alias("p")).select("p.*").toArrow()
    places = sorted(zip(*(c.to_pylist() for c in sampled.columns)))
    return sorted({places[len(places) * k // wanted] for k in range(1, wanted)}) if places else []


def rank_among(value: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are not above the value, by halving."""
    if not bounds:
        return F.lit(0)
    #: arrays of places, each folded into a constant: an array of structs would be made again for each row
    i, h = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") for x in zip(*bounds))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def halve(v: Column) -> Column:
        def step(at: Column, more: Column) -> Column:
            last = at + more - 1
            here = F.get(i, last)  # null beyond the last bound
            return F.when((here < v["i"]) | ((here == v["i"]) & (F.get(h, last) <= v["h"])), at + more).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    return bound(value, halve)  # a value holds a hash of a text


def with_next(documents: DataFrame) -> DataFrame:
    """``bucket``, ``doc_id``, ``text``, ``p``, ``ghost``: documents in ranges of places, each in order of descent.

    The last row of a range is a copy of the first of the next range (of the first
    range after the last), so that each document's next one is in its own range. Bounds and
    those first rows' places are at most ``BUCKETS`` pairs of numbers on the driver.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = cuts(rows)
    placed = rows.withColumn("p", place()).withColumn("bucket", (len(bounds) - rank_among(F.col("p"), bounds)).cast("int"))
    first = placed.groupBy("bucket").agg(F.max("p").alias("top")).collect()  # a row for each range
    order = sorted(r["bucket"] for r in first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    tops = spark.createDataFrame([(r["bucket"], tuple(r["top"]), before[r["bucket"]]) for r in first] or [(-1, (-1, -1), -1)], "bucket int, top struct<i:long,h:long>, into int")
    #: rows of one place have one text, and one copy of them is enough
    copies = placed.join(F.broadcast(tops), "bucket").filter(F.col("p") == F.col("top")).groupBy("into").agg(F.first(F.struct("doc_id", "text", "p")).alias("x"))
    copies = copies.select("x.*", F.col("into").alias("bucket"), F.lit(1).alias("ghost"))
    return placed.withColumn("ghost", F.lit(0)).unionByName(copies)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp.

    One shuffle of the texts brings neighbours together; everything else stays in
    its partition, as ranges of ids are what all steps are partitioned by.
    """
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("p").desc(), "text")
    placed = with_next(documents)
    placed = placed.withColumn("row", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(next, half)"))
    placed = placed.withColumn("n_chars", n).withColumn("half", half).withColumn("edited", edited)
    #: both texts' terms in one go: which of them is part of the key
    keys = ["bucket", "row", "ghost", "doc_id", "n_chars", "sha"]
    both = placed.select(*keys[:5], F.sha2(F.col("edited"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    both = both.filter("ghost = 0 or x.which = 0").select(*keys, "x.which", "x.t")
    prints = simhash(both, [*keys, "which"], "t", "fp")
    prints = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    following = Window.partitionBy("bucket").orderBy("row")
    prints = prints.withColumn("next_fp", F.lead("fp").over(following)).filter("ghost = 0")
    return prints.select("doc_id", F.col("n_chars").cast(LONG), F.col("sha").alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def near_counts(prints: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """``n_near``: for the asked rows how many other documents have a fingerprint within the radius; null for the rest."""
    counted = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    found = near(counted, prints.filter(asked), radius).join(counted, "fp").groupBy("query").agg(F.sum("n").alias("n"))
    out = prints.join(found, asked & (F.col("fp") == F.col("query")), "left")
    return out.withColumn("n_near", F.when(asked, F.col("n") - 1)).drop("query", "n")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search asks for every document whose id ``ASKED`` divides."""
    found = cut(fingerprint_documents(table(spark, sf_dir, "documents")))
    found = near_counts(found, F.coalesce(F.col("doc_id") % ASKED == 0, F.lit(False)))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )


QUERIES = {"op7_fingerprints": op7_fingerprints}
SQL: dict[str, str] = {}
