"""Phrase collocations, mined level by level as Apriori does.

Level 1 counts words. Each further pass reads the texts again with the frequent grams of one word less at hand, and gives out a gram only
if both of the grams that it overlaps are frequent, so that few grams of rare words are ever shuffled. Counts of a pass are sums over
tasks; only grams with ``LEAST`` occurrences or more go on. A gram that passes has its exact count, as nothing but the threshold decides what stays.

The frequent grams are broadcast as a bit array of hashes, 8 positions for each gram up to ``MOST_BITS`` in all (64 MB). A hash that is shared with another gram, or an array
that is too full for a very large corpus, lets more grams through to be counted, and the threshold then takes them out: results are the same at any size.

Candidates are the frequent grams of two words or more. Each cut of a candidate is scored from the level tables by joins, in decimals of 38 digits, so
that no product is rounded. A candidate goes if a longer one that holds it has half its occurrences or more; as counts fall with length, a look at those of one more word is enough.

A text is read in blocks, and a piece goes on from one to the next, however long it is; a single word is not split.

Nulls: a null text is an empty one and has no words; a null language is ``und``. Ids are not read: repeated rows count as often as
they are there. Ties are ordered by count and then by the phrase's bytes. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, cut, release, small_batches, table

#: Words of the longest candidate, occurrences that make a gram frequent, hundredths of them in a longer one that take a candidate out, rows a language.
LONGEST, LEAST, WITHIN, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes lower-cased, ends of pieces as line ends, blanks as spaces.
FOLDED = bytes.maketrans(UPPER.encode() + ENDS + BLANKS, UPPER.lower().encode() + b"\n" * len(ENDS) + b"  ")
#: A byte that no word has stands for the end of a piece.
END = b"."
#: Bytes that a task gathers before it counts their words, bytes of a text read at once.
GATHERED, BLOCK = 3 << 20, 1 << 18
#: Positions for each frequent gram, least and most of them (as powers of two), positions of a gram and of a chunk.
POSITIONS, LEAST_BITS, MOST_BITS, HASHES, CHUNK_BITS = 8, 19, 29, 2, 19
COUNTS = "lang string, phrase string, n long"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(text: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """A folded text in portions that end before white space."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(b" ", at + 1, at + most), text.rfind(b"\n", at + 1, at + most))
        if end < 0:
            found = [e for e in (text.find(b" ", at + most), text.find(b"\n", at + most)) if e >= 0]
            if not found:
                break
            end = min(found)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Gathered:
    """Folded portions of many texts, with the number of the language of each."""

    def __init__(self):
        self.blocks, self.of, self.langs, self.size = [], [], {}, 0

    def add(self, lang: str, block: bytes) -> None:
        self.blocks.append(block)
        self.of.append(self.langs.setdefault(lang, len(self.langs)))
        self.size += len(block)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Words of all portions in order, as numbers from 1 (0 is the end of a piece), the number of the language at each, and the words by their numbers."""
        lists = pc.split_pattern(pa.array(self.blocks, pa.binary()), " ")
        coded = lists.flatten().dictionary_encode()
        known, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lang = np.repeat(np.array(self.of, np.int64), np.diff(lists.offsets.to_numpy()))
        kept = number != pc.index(known, pa.scalar(b"", pa.binary())).as_py()  # between two blanks
        end = pc.index(known, pa.scalar(END, pa.binary())).as_py()
        w = np.where(number == end, 0, number + 1)[kept]
        return w, lang[kept], pa.concat_arrays([pa.array([END], pa.binary()), known])


def gather(batches: Iterator[pa.RecordBatch], size: int, most: int = GATHERED) -> Iterator[Gathered]:
    """Texts of columns lang and text; where a text goes on in the next, its last ``size - 1`` words are there again."""
    held = Gathered()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            lang, last = UNKNOWN if lang is None else lang, []
            for block in blocks((text.as_py() or b"").translate(FOLDED)):
                block = block.replace(b"\n", b" . ")
                held.add(lang, block)
                if size > 1:
                    last = (last + block.rsplit(None, size - 1)[1 - size :])[1 - size :]
                if held.size >= most:
                    yield held
                    held = Gathered()
                    if last:
                        held.add(lang, b" ".join(last))
            held.add(lang, END)
    if held.size:
        yield held


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * _P
    h ^= h >> np.uint64(29)
    return h * _Q


def hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of small numbers, and how often each is there."""
    sizes, key, steps, room = [int(c.max()) + 1 if len(c) else 1 for c in columns], columns[0], [], 1 << 62
    span = sizes[0]
    for c, size in zip(columns[1:], sizes[1:]):
        if span * size > room:  # number what is there so far anew
            known, key = np.unique(key, return_inverse=True)
            steps.append(("known", known))
            span = len(known)
        key = key * size + c
        steps.append(("size", size))
        span *= size
    key, n = np.unique(key, return_counts=True)
    out = []
    for kind, x in reversed(steps):
        if kind == "size":
            out.append(key % x)
            key = key // x
        else:
            key = x[key]
    return [key, *reversed(out)], n


def grams(held: Gathered, size: int, frequent: np.ndarray | None) -> pa.RecordBatch:
    """Grams of ``size`` words whose two grams of one word less are frequent, with their counts; for words, a language's total under the empty phrase too."""
    w, g, words = held.arrays()
    langs = list(held.langs)
    whole = w > 0
    if size == 1:
        at = np.flatnonzero(whole)
        cell = np.bincount(g[at] * len(words) + w[at])
        found = np.flatnonzero(cell)
        lang, parts, n = found // len(words), [found % len(words)], cell[found]
        total = np.bincount(g[at], minlength=len(langs))
    else:
        bits, m = (len(frequent) * 8 - 1).bit_length(), max(len(w) - size + 2, 0)
        of_word, h, fits = hashed(words.to_numpy(zero_copy_only=False)), hashed(langs)[g[:m]], np.ones(m, bool)
        for j in range(size - 1):
            h = mixed(h, of_word[w[j : j + m]])
            fits &= whole[j : j + m]
        for p in positions(h, bits):
            fits &= (frequent[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(fits[:-1] & fits[1:])
        (lang, *parts), n = distinct([g[at], *(w[at + j] for j in range(size))])
        total = np.zeros(0, np.int64)
    if parts and len(n):
        strings = words.cast(pa.string())
        taken = [strings.take(pa.array(p)) for p in parts]
        phrase = taken[0] if size == 1 else pc.binary_join_element_wise(*taken, " ")
    else:
        lang, phrase = lang[:0], pa.array([], pa.string())
    name = pa.array(langs, pa.string())
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([name.take(pa.array(lang)), name.take(pa.array(np.arange(len(total))))]), pa.concat_arrays([phrase, pa.array([""] * len(total), pa.string())]), pa.array(np.r_[n, total].astype(np.int64)),
    ], ["lang", "phrase", "n"])


def level(documents: DataFrame, size: int, least: int, frequent=None) -> DataFrame:
    """(lang, phrase, n) of the frequent grams of a size, written to the shared folder. With words comes each language's total under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gather(batches, size):
            made = grams(held, size, None if frequent is None else frequent.value)
            for at in range(0, len(made), 1 << 16):
                yield made.slice(at, 1 << 16)
            made = held = None
            pa.default_memory_pool().release_unused()
        release()

    found = documents.select(F.col("lang").cast("string"), "text").mapInArrow(run, COUNTS)
    return cut(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == "")))


def broadcast_grams(known: DataFrame):
    """The hashes of grams as a bit array of bounded size."""
    spark, size = known.sparkSession, 1 << CHUNK_BITS
    bits = min(max((POSITIONS * known.count() - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            split = [p.as_py().split(b" ") for p in batch.column(1).cast(pa.binary())]
            h = hashed(batch.column(0).to_pylist())
            for j in range(len(split[0])):  # all grams of a level are of one size
                h = mixed(h, hashed([s[j] for s in split]))
            at = np.unique(np.concatenate(positions(h, bits)))
            chunk = at >> CHUNK_BITS
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            data = [x.astype(np.uint32).tobytes() for x in np.split(at & (size - 1), first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int32()), pa.array(data, pa.binary())], ["number", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                kept.setdefault(i, np.zeros(size, bool))[np.frombuffer(data.as_py(), np.uint32)] = True
        for i, seen in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], ["number", "data"])

    chunks = known.select("lang", "phrase").mapInArrow(mark, "number int, data binary").repartition("number").mapInArrow(merge, "number int, data binary")
    out = np.zeros((1 << (bits - CHUNK_BITS), size // 8), np.uint8)
    for row in chunks.collect():  # one row for each chunk, of 64 KB at most
        out[row["number"]] = np.frombuffer(zlib.decompress(bytes(row["data"])), np.uint8)
    return spark.sparkContext.broadcast(out.reshape(-1))


def first_words(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def last_words(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", -n)


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN) -> tuple[DataFrame, DataFrame]:
    """Candidates that stay (lang, phrase, a, l, r, score), and the number of words of each language (lang, n)."""
    small_batches(documents.sparkSession)
    words = level(documents, 1, least)
    levels = [words.filter(F.col("phrase") != "")]
    for size in range(2, longest + 1):
        frequent = broadcast_grams(levels[-1])
        levels.append(level(documents, size, least, frequent))
        frequent.unpersist()

    kept = []
    for size in range(2, longest + 1):
        own = levels[size - 1]
        if size < longest:
            longer = levels[size]
            parts = longer.select("lang", "n", F.explode(F.array(first_words("phrase", size), last_words("phrase", size))).alias("phrase"))
            most = parts.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
            own = own.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(within) * F.col("n"))).drop("most")
        cuts = [F.struct(F.lit(k).alias("k"), first_words("phrase", k).alias("first"), last_words("phrase", size - k).alias("rest")) for k in range(1, size)]
        kept.append(own.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.*"))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    known = union(levels[: longest - 1])
    scored = union(kept).join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    exact = lambda c: f"cast({c} as decimal(16, 0))"
    scored = scored.withColumn("score", F.expr(f"(cast(1000000 as decimal(7, 0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low"))
    return least_cut.select("lang", "phrase", "low.a", "low.l", "low.r", "low.score"), words.filter(F.col("phrase") == "").select("lang", "n")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language, with ``rank``: of 64 parts of a language first, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, totals = collocations(table(spark, sf_dir, "documents"))
    return best(candidates).join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL_OP11 = f"""
with pieces as (
  select d, lang, p.piece, p.no from (select row_number() over () as d, coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]') as found from documents),
    lateral (select unnest(found) as piece, generate_subscripts(found, 1) as no) p
), worded as (
  select d, lang, no, w.word, w.i from (select d, lang, no, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as words from pieces),
    lateral (select unnest(words) as word, generate_subscripts(words, 1) as i) w
), grams as (
  select lang, word as w1, lead(word, 1) over piece as w2, lead(word, 2) over piece as w3 from worded window piece as (partition by d, no order by i)
), counted as (
  select lang, 1 as k, w1 as phrase, count(*) as f from grams group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from grams where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from grams where w3 is not null group by all
), totals as (
  select lang, sum(f) as n from counted where k = 1 group by lang
), candidates as (
  select * from counted where k > 1 and f >= {LEAST}
), within as (
  select distinct c.lang, c.phrase from candidates c join candidates longer on c.lang = longer.lang and c.k + 1 = longer.k and 100 * longer.f >= {WITHIN} * c.f
    and (longer.phrase[: length(c.phrase) + 1] = c.phrase || ' ' or longer.phrase[-length(c.phrase) - 1 :] = ' ' || c.phrase)
), cuts as (
  select c.lang, c.phrase, c.f as a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') as tail
  from candidates c, range(1, {LONGEST}) as cut(j) where j < c.k
), scored as (
  select u.*, x.f as l, y.f as r, cast(1000000::hugeint * u.a * u.a // (x.f::hugeint * y.f) as bigint) as score
  from cuts u join counted x on u.lang = x.lang and u.head = x.phrase join counted y on u.lang = y.lang and u.tail = y.phrase
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1
), ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank from lowest s anti join within w on s.lang = w.lang and s.phrase = w.phrase
)
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked join totals using (lang) where rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": SQL_OP11}
