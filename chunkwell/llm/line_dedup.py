"""Line deduplication across documents, by two Bloom filters.

A first pass marks each document's line keys in two filters: those seen, and those
seen again. Tasks emit the positions they have marked, once or again, by chunks of the filter, and no task holds the whole of it; chunks of equal
number are merged, so that the second filter holds every key of two
documents or more, wherever they lie. Only lines that it holds are shuffled, as digests of
128 bits with their documents, for exact counts and the choice of the document that
keeps the line.

The filters have four to eight positions for each line that is counted beforehand, up to ``MOST_BITS``, as the second one is broadcast. In a larger corpus
more lines are suspected and shuffled, at worst the digests and ids of all; the result does not change.

Nulls: a null or empty text is one empty line, which is kept. A null id is smaller than all
others, and all rows with null ids count as one document, as do all rows of any repeated id. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, fresh, named, release, small_batches, table

#: Code points of a key that counts, and documents in which its lines are repeats.
SHORTEST, DOCUMENTS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
#: Positions of the filters for each line, least and most of them (as powers of two: 64 MB are broadcast), positions of a key and of a chunk.
POSITIONS, LEAST_BITS, MOST_BITS, HASHES, CHUNK_BITS = 4, 20, 29, 3, 19
#: Marks that a task gathers before it emits them.
MARKS = 1 << 20
CHUNKS = "number int, data binary"


def blocks(text: str | None, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of whole lines, of about ``most`` bytes; joined by a line end they are the text."""
    raw, at = (text or "").encode(), 0
    while len(raw) - at > most:
        end = raw.rfind(b"\n", at, at + most)
        end = end if end >= 0 else raw.find(b"\n", at + most)
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:] if at else raw


def keys(block: bytes, shortest: int = SHORTEST) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a block, and each one's key, None if it is too short."""
    lines = block.split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        n = len(key)
        long = n >= shortest and (n >= 4 * shortest or key.isascii() or len(key.decode()) >= shortest)
        out.append(key if long else None)
    return lines, out


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of positions for each hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def hashes(found) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def filter_bits(documents: DataFrame) -> int:
    """Bits of a position's number, by the number of lines."""
    n = documents.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    return min(max((POSITIONS * n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def seen_again(documents: DataFrame, shortest: int = SHORTEST):
    """The second filter, a bit for each position, as a broadcast variable of bounded size."""
    spark, bits, size = documents.sparkSession, filter_bits(documents), 1 << CHUNK_BITS

    def marked(gathered: list[np.ndarray]) -> pa.RecordBatch:
        """For each chunk the positions in it, with a further bit for those marked again."""
        at, n = np.unique(positions(np.concatenate(gathered), bits), return_counts=True)
        chunk, marks = at >> CHUNK_BITS, (at & (size - 1) | (n > 1).astype(np.int64) << CHUNK_BITS).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        data = [x.tobytes() for x in np.split(marks, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int32()), pa.array(data, pa.binary())], ["number", "data"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for batch in batches:
            for text in batch.column(0):
                own = [hashes({k for k in keys(b, shortest)[1] if k is not None}) for b in blocks(text.as_py())]
                own = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                if len(own):
                    gathered.append(own)
            if sum(map(len, gathered)) >= MARKS:
                yield marked(gathered)
                gathered = []
        if gathered:
            yield marked(gathered)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                marks = np.frombuffer(data.as_py(), np.uint32)
                at, again = marks & np.uint32(size - 1), marks >> np.uint32(CHUNK_BITS)
                seen = kept.setdefault(i, np.zeros(size, np.uint8))
                seen[at] = np.minimum(seen[at] + 1 + again, 2)
        for i, seen in kept.items():
            twice = zlib.compress(np.packbits(seen >= 2).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([twice], pa.binary())], ["number", "data"])
        release()

    chunks = documents.select("text").mapInArrow(mark, CHUNKS).repartition("number").mapInArrow(merge, CHUNKS)
    twice = np.zeros((1 << (bits - CHUNK_BITS), size // 8), np.uint8)
    for row in chunks.collect():  # one row for each chunk
        twice[row["number"]] = np.frombuffer(zlib.decompress(bytes(row["data"])), np.uint8)
    return spark.sparkContext.broadcast(twice.reshape(-1))


def suspected(found: list[bytes], twice: np.ndarray) -> np.ndarray:
    at = positions(hashes(found), (len(twice) * 8 - 1).bit_length())
    return ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def drops(documents: DataFrame, shortest: int = SHORTEST, least: int = DOCUMENTS) -> DataFrame:
    """Rows (doc_id, h, gone): digests of the keys whose lines a row loses, by its id and the hash ``h`` of its text.

    A row gets keys of its own lines only, so that rows that share an id, or have none, don't hand each other all that any of them loses.
    """
    twice = seen_again(documents, shortest)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[bytes] = []
        for batch in batches:
            for row, text in enumerate(batch.column(2)):
                for block in blocks(text.as_py()):
                    own = [*{k for k in keys(block, shortest)[1] if k is not None}]
                    hit = np.flatnonzero(suspected(own, twice.value)) if own else ()
                    ids += [row] * len(hit)
                    found += [digest(own[i]) for i in hit]
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.binary())], ["doc_id", "h", "key"])
            ids, found = [], []
        release()

    shuffled = documents.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(suspects, f"doc_id {kind}, h long, key binary")
    held = shuffled.groupBy("key", "doc_id", "h").agg(F.lit(1).alias("one"))
    pairs = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    repeats = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least)
    gone = held.select("key", "doc_id", "h").join(repeats, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "h").agg(F.collect_list("key").alias("gone"))


def without_repeats(documents: DataFrame, shortest: int = SHORTEST, least: int = DOCUMENTS) -> DataFrame:
    """The documents and, as last column, the digests of lines they lose, null for none."""
    key, h, gone = fresh(documents, "_id", "_h", "_gone")
    lost = drops(documents.select("doc_id", "text"), shortest, least).select(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("gone").alias(gone))
    joined = documents.join(lost, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h)), "left")
    return joined.select(*named(documents), gone)


def cut_lines(text: str | None, gone: list[bytes] | None, shortest: int = SHORTEST) -> tuple[bytes, int, int]:
    """The text that stays, its lines before, and the lines lost."""
    if not gone:
        raw = (text or "").encode()
        return raw, raw.count(b"\n") + 1, 0
    lost, kept, n, left = set(gone), [], 0, 0
    for block in blocks(text):
        lines, found = keys(block, shortest)
        stay = [line for line, key in zip(lines, found) if key is None or digest(key) not in lost]
        n, left = n + len(lines), left + len(stay)
        if stay:
            kept.append(b"\n".join(stay))
    return b"\n".join(kept), n, n - left


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_lines(t.as_py(), g.as_py()) for t, g in zip(batch.column(1), batch.column(2))]
            shas = [hashlib.sha256(x[0]).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return without_repeats(documents).mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def line_dedup_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; ``n_chars`` is made anew, other columns stay. A null text stays null."""
    small_batches(spark)
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not t.is_valid else cut_lines(t.as_py(), g.as_py())[0].decode() for t, g in zip(batch.column(at), batch.column(len(names)))]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = without_repeats(documents).mapInArrow(run, documents.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return out


SQL_OP10 = f"""
with lines as (
  select d.doc_id, u.i, u.line from documents d,
    lateral (select unnest(string_split(coalesce(d.text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) as i) u
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') as key from lines
), repeats as (
  select key, max(doc_id) as keeper from keyed where length(key) >= {SHORTEST} group by key having count(distinct doc_id) >= {DOCUMENTS}
), marked as (
  select k.doc_id, k.i, k.line, r.key is not null and k.doc_id <> r.keeper as gone from keyed k left join repeats r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {"op10_line_dedup": SQL_OP10}
