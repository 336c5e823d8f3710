"""Mixing sources to target weights, by blocks of words.

Each source's words are packed into blocks of a fixed length. Output shards have a
fixed number of slots; which source fills a slot is drawn at random, so that a
shard's counts are multinomial, up to what is left of a source's quota. What the draws leave a source under its quota is settled in
a last shard. The i-th slot of a source goes through a pseudorandom
permutation of the source's block numbers, and blocks are joined to slots by number, so that the draw decides in which shard a block is put out. Another seed of the
draw gives other shards, and the same words in all.

No source may take more than ``MOST`` times its words: its target stops there and
the excess goes to the others by weight. As a permutation gives every block once before
any block twice, no document is taken more than ``MOST`` times either.

Everything is made by DataFrame functions. A source's running word count is made
in parts, whose number grows with the rows, and its slots are summed up by groups of shards, so that a source with a third of all rows is no single task's work.

Nulls: a null text has no words; a null source is a source of its own, after all
others; null ids are kept. Repeated rows are separate documents. Texts without words get a row with
``taken`` 0. An empty table gives an empty result. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, named, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block, slots of an output shard, cells of the draw's lookup table.
BLOCK, SLOTS, CELLS = 128, 4096, 1024
#: Parts of a source's running count at least, rows for each further one, and shards whose slots one task sums up.
SALTS, SALT_ROWS, SHARDS = 64, 1 << 16, 1024
#: Up to so many sources their lookup table is broadcast.
MOST_BROADCAST = 100_000
SEED = 17
ROUNDS = 6
LONG = "long"


def div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source_size, rank, weight, target.

    With all sources in order of the ratio at which they fill up, a source is full
    if what is left for it and those after it, shared by weight, is no less than it can take.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int")))
    per = per.withColumn("most", F.col("source_size") * most).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    per = per.withColumn("full", F.col("level") >= F.col("ratio"))
    #: the first that is not full has it; after it the level falls, as it counts as full what is not
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * rest))
    return per.select("source", "source_size", "rank", "weight", "target")


def permuted(place: Column, size: Column, key: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of [0, size), at ``place``.

    Each round pairs x with (k - x) mod size and swaps the two or not, by a bit of
    a hash of the larger; it is its own inverse, so the whole is one to one for any size.
    The rounds are a fold, in which x is a variable: as nested columns the expression would double each round.
    """

    def turn(x: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(seed), r, key), size)
        other = F.pmod(k - x, size)
        return F.when(F.getbit(F.xxhash64(F.lit(seed), r, key, F.greatest(x, other)), F.lit(7)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place, turn)


def quotas(sources: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """With the number of a source's blocks and its slots, and its first ticket among all slots."""
    blocks = F.ceil(F.col("source_size") / block).cast(LONG)
    slots = F.least(blocks * most, F.round(F.col("target") * blocks / F.col("source_size")).cast(LONG))
    out = sources.filter("source_size > 0").withColumn("blocks", blocks).withColumn("slots", slots)
    order = Window.orderBy("rank")
    out = out.withColumn("first", F.sum("slots").over(order) - F.col("slots"))
    return out.withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))


def draw(quota: DataFrame, per_shard: int = SLOTS, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """Rows (rank, shard, blocks, offset, count): a source's slots in a shard are its offset-th and following.

    A slot draws one of as many tickets as there are slots, and the source that
    holds the ticket is found by equal cells of tickets, then by range.
    """
    q = quota.filter("slots > 0").select("rank", "slots", "blocks", "first", "all_slots")
    cell = lambda ticket: div(ticket * cells, F.col("all_slots"))
    held = q.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("slots") - 1))))
    n, sources = quota.agg(F.max("all_slots"), F.count(F.lit(1))).first()
    n = n or 0
    #: at most a row for each cell and source, of 40 bytes
    held = F.broadcast(held) if sources <= MOST_BROADCAST else held.hint("merge")
    shards = quota.sparkSession.range(-(-n // per_shard)).select(F.lit(n).cast(LONG).alias("n"), F.col("id").alias("shard"))
    slots = shards.select("n", "shard", F.explode(F.sequence(F.col("shard") * per_shard, F.least(F.col("n"), (F.col("shard") + 1) * per_shard) - 1)).alias("slot"))
    tickets = slots.select("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("slot")), F.col("n")).alias("ticket"), "n")
    tickets = tickets.withColumn("cell", div(F.col("ticket") * cells, F.col("n")))
    drawn = tickets.join(held, "cell").filter("ticket >= first and ticket < first + slots")
    drawn = drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("count"))
    #: the last shard settles: each source's row there takes what is missing; a surplus is cut off
    last = q.select("rank", F.lit(-(-n // per_shard)).cast(LONG).alias("shard"), F.col("slots").alias("count"))
    both = drawn.unionByName(last).join(q.select("rank", "slots", "blocks"), "rank")
    #: running sums by groups of shards, and within each
    both = both.withColumn("group", div(F.col("shard"), F.lit(SHARDS).cast(LONG)))
    before = both.groupBy("rank", "group").agg(F.sum("count").alias("n"))
    before = before.select("rank", "group", (F.sum("n").over(Window.partitionBy("rank").orderBy("group")) - F.col("n")).alias("before"))
    both = both.join(before, ["rank", "group"])
    both = both.withColumn("upto", F.col("before") + F.sum("count").over(Window.partitionBy("rank", "group").orderBy("shard")))
    both = both.withColumn("offset", F.least("slots", F.col("upto") - F.col("count")))
    return both.select("rank", "shard", "blocks", "offset", (F.least("slots", "upto") - F.col("offset")).alias("count")).filter("count > 0")


def slot_blocks(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (rank, block, copies, first_shard, last_shard): how often each block of each source is taken, and where."""
    #: dealt out by number, as a row makes up to a shard's slots
    dealt = drawn.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = dealt.select("rank", "blocks", "shard", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("count") - 1)).alias("i"))
    each = each.select("rank", "shard", permuted(F.pmod(F.col("i"), F.col("blocks")), F.col("blocks"), F.col("rank"), seed).alias("block"))
    return each.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("copies"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))


def packed(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, size, order columns k1, k2) with ``salt``, ``row`` and ``start``, the word at which each document starts in its source."""
    salts = max(SALTS, -(-sizes.count() // SALT_ROWS))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(salts)).cast("int"))
    order = Window.partitionBy("source", "salt").orderBy("k1", "k2", "size")
    inner = salted.withColumn("row", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = salted.groupBy("source", "salt").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("salt")) - F.col("n")).drop("n")
    totals = totals.withColumnsRenamed({"source": "_source", "salt": "_salt"})
    out = inner.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt")))
    return out.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("_source", "_salt", "before", "upto")


def pieces(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block it lies in: ``block``, ``at`` (the word of the document) and ``words``; one row without a block for those without words."""
    b = F.lit(block).cast(LONG)
    numbers = F.when(F.col("size") > 0, F.sequence(div(F.col("start"), b), div(F.col("start") + F.col("size") - 1, b)))
    out = documents.withColumn("block", F.explode_outer(numbers))
    begin = F.greatest(F.col("block") * b, F.col("start"))
    end = F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
    return out.withColumn("at", begin - F.col("start")).withColumn("words", F.coalesce(end - begin, F.lit(0).cast(LONG)))


def mix(sizes: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """``pieces`` of all documents with ``rank``, ``source_size``, ``target``, ``copies``, how often the piece is taken, and the first and last shard that it is put in.

    ``slots`` are those of a shard, ``seed`` is the draw's. ``sizes`` has source, size and the order columns k1 and k2; it is read more
    than once, so it should be a written table.
    """
    sources = cut(source_targets(sizes))
    copies = slot_blocks(draw(quotas(sources, block), slots, seed))
    named = sources.select(F.col("source").alias("_source"), "source_size", "rank", "target")
    documents = packed(sizes).join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return pieces(documents, block).join(copies, ["rank", "block"], "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast(LONG)))


def mixed_documents(documents: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first and last shard of every document, these null where nothing is taken."""
    sizes = cut(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2")))
    taken = [F.sum(F.col("words") * F.col("copies")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard")]
    out = mix(sizes, slots=slots, seed=seed).groupBy("rank", "salt", "row", "doc_id", "size", "source_size", "target").agg(*taken)
    return out.select("doc_id", F.col("size").cast(LONG), F.col("source_size").cast(LONG), "target", F.col("taken").cast(LONG), "first_shard", "last_shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as mixed: each row holds what is taken of a document once, and a further row what is taken twice. Rows lie together by the shard in which
    the first words of their document are put out, and in a shard by a hash.

    Texts are cut between words, and keep the white space that follows each word.
    Documents of which nothing is taken go; ``n_chars`` is made anew.
    """
    #: a row travels as one column, so that no name of its columns meets one of these
    whole = documents.select(F.struct(*named(documents)).alias("_row"))
    part = lambda name: F.col("_row").getField(name)
    text = F.coalesce(part("text"), F.lit(""))
    keyed = whole.withColumn("_k1", F.xxhash64(part("doc_id"), part("source"), text)).withColumn("_k2", F.xxhash64(text, F.lit(SEED), part("doc_id"), part("source")))
    #: rows that are alike in all of these are told apart by number
    sizes = cut(keyed.select(part("source").alias("source"), word_count(part("text")).alias("size"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2")))
    mixed = mix(sizes).filter("copies > 0")
    spans = mixed.groupBy("k1", "k2", "rank", "salt", "row").agg(F.array_sort(F.collect_list(F.struct("at", "words", "copies"))).alias("spans"), F.min("first_shard").alias("shard"))
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("row", "spans", "shard"))).alias("rows"))
    number = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    joined = keyed.withColumn("_n", number).join(spans, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    own = F.get(F.col("rows"), F.col("_n") - 1)
    joined = joined.select("_row", own["spans"].alias("_spans"), own["shard"].alias("_shard"), "_k1").filter("_spans is not null")
    joined = joined.withColumn("_words", F.regexp_extract_all(part("text"), F.lit(r"(?:^[\x20\x09-\x0D]+)?" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_spans", lambda s: s["copies"])).cast("int"))))
    chosen = F.filter("_spans", lambda s: s["copies"] >= F.col("_copy"))
    cut_text = F.array_join(F.transform(chosen, lambda s: F.array_join(F.slice(F.col("_words"), (s["at"] + 1).cast("int"), s["words"].cast("int")), "")), "")
    out = joined.select("_row", cut_text.alias("_text"), "_shard", "_k1", "_copy").repartition("_shard").sortWithinPartitions("_shard", "_k1", "_copy")
    made = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return out.select(*[made.get(c, part(c)).alias(c) for c in documents.columns])


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
