"""SimHash near-duplicates, by anchor points of a covering code.

Fingerprints are 64 votes over the XXH64 of three-word shingles. Equal ones are
one vertex. The anchors are the words of a code on the first 46 bits: two binary Golay codes
side by side, each of which has exactly one word within 3 bits (its covering radius) of any 23
bits. A fingerprint's home is the anchor within the covering radius. It is
replicated to every anchor within covering radius plus threshold, where the threshold
is spent on the two halves together. If x and y differ in at most the threshold's
bits, y is no further than that from x's home, so home and replica meet there: no link is lost. Each anchor's
fingerprints are compared on their own, and of the links that are found a
spanning forest is kept, never all pairs of a group.

The pipeline's stage takes the groups that these fingerprints and anchors link as its candidates, and an exact check follows: texts are linked if the Jaccard similarity of their
sets of five-word shingles, as counted, is 0.8 or more. As of such texts nearly none are within 2 of 64 bits, and half are beyond 9, it has further
candidates beside them, which share one of 24 bands of four minima (MinHash).

Anchors number 2^24, so that a cell holds few fingerprints of different texts; a cell's
comparison runs in blocks of bounded size.

Nulls: a null or empty text has fingerprint zero, and is linked like any other; with fewer
words than a shingle the whole sequence is the one shingle. Null ids are no component's smallest id unless all are null.
Repeated rows have the same component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, named, portions, release, small_batches, table
from .components import components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: A binary Golay code: bits, check bits, generator polynomial, covering radius.
BITS, CHECKS, POLYNOMIAL, RADIUS = 23, 11, 0xC75, 3
#: Pairs of fingerprints that are compared at a time.
BLOCK = 1 << 21
#: The pipeline's stage links texts by what they share of five-word shingles.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 share none of the bands once in 300,000 times, more similar ones less often.
BANDS, ROWS = 24, 4
#: Members of a part of a cell, on average.
PART = 2048
_RANDOM = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MASKS, _FACTORS = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in order, by portions of the text; with fewer words the whole sequence is one, without words there is none."""
    carry: list[bytes] = []
    some = False
    for part in portions(text or "", 1 << 20):
        parts = carry + part.encode().lower().split()  # bytes: A-Z and ASCII white space only
        if len(parts) < words:
            carry = parts
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        begin = [0, *ends[: len(parts) - words].tolist()]
        found = map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(begin, (ends[words - 1 :] - 1).tolist())], repeat(SEED))
        yield np.fromiter(found, np.uint64, len(begin))
        carry, some = parts[len(parts) - words + 1 :], True
    if carry and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit by bit what over half of the shingles' hashes have set."""
    votes, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        for i in range(0, len(h), 1 << 14):
            votes += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the 64 bits as a signed long."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])
        release()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def remainder(x: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials, by the generator: the syndrome."""
    for i in range(BITS - 1, CHECKS - 1, -1):
        x = np.where(x >> i & 1, x ^ (POLYNOMIAL << (i - CHECKS)), x)
    return x


@lru_cache(maxsize=4)
def offsets(threshold: int) -> list[np.ndarray]:
    """For each excess over the radius, patterns by syndrome: what leads from a point to the code's words at that distance; -1 fills up.

    Excess 0 is the one word within the radius, excess e a word at radius + e.
    """
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        p = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BITS), w)], np.int64)
        s = remainder(p)
        order = np.argsort(s, kind="stable")
        s, p = s[order], p[order]
        counts = np.bincount(s, minlength=1 << CHECKS)
        rows = np.full((1 << CHECKS, counts.max()), -1, np.int64)
        rows[s, np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)] = p
        out.append(rows)
    return out


def replicas(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index of the fingerprint, and whether the anchor is its home."""
    u = fp.view(np.uint64)
    halves = [(u >> np.uint64(i * BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64) for i in (0, 1)]
    near = offsets(threshold)
    at = [remainder(h) for h in halves]
    anchors, index, home = [], [], []
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            a, b = near[i][at[0]], near[j][at[1]]
            both = ((halves[0][:, None] ^ a) >> CHECKS)[:, :, None] << (BITS - CHECKS) | ((halves[1][:, None] ^ b) >> CHECKS)[:, None, :]
            r, k, m = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
            anchors.append(both[r, k, m])
            index.append(r)
            home.append(np.full(len(r), i + j == 0))
    return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


class Forest:
    """Union-find over positions; keeps the links that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def cell_links(fp: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and all others of one anchor, as positions."""
    forest, u, homes = Forest(len(fp)), fp.view(np.uint64), np.flatnonzero(home)
    step = max(1, BLOCK // max(1, len(fp)))
    for i in range(0, len(homes), step):
        part = homes[i : i + step]
        for j in range(0, len(fp), BLOCK):
            x, y = np.nonzero(np.bitwise_count(u[part][:, None] ^ u[None, j : j + BLOCK]) <= threshold)
            a, b = part[x], y + j
            #: of each block only links between trees; most fall away before the loop
            new = forest.up[a] != forest.up[b]
            forest.join(a[new], b[new])
            forest.up = np.array([forest.top(k) for k in range(len(fp))]) if new.any() else forest.up
    return forest.links


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of fingerprints at most ``threshold`` bits apart, enough of them to connect all such."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2000):
                part = fp[i : i + 2000]
                anchor, index, home = replicas(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def done(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, len(anchor)])
            homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
            a, b = [], []
            #: small cells together: each home with each member
            small = (homes > 0) & (sizes > 1) & (homes * sizes <= 4096)
            where = np.flatnonzero(home & np.repeat(small, sizes))
            size, begin = np.repeat(sizes, sizes)[where], np.repeat(first, sizes)[where]
            for i in range(0, len(where), 1 << 14):
                s, f, w = size[i : i + (1 << 14)], begin[i : i + (1 << 14)], where[i : i + (1 << 14)]
                x = np.repeat(w, s)
                y = np.arange(len(x)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(f, s)
                near = (np.bitwise_count(fp[x].view(np.uint64) ^ fp[y].view(np.uint64)) <= threshold) & (x != y)
                a.append(fp[x[near]])
                b.append(fp[y[near]])
            for k in np.flatnonzero((homes > 0) & (sizes > 1) & ~small):
                part = slice(first[k], first[k] + sizes[k])
                for x, y in cell_links(fp[part], home[part], threshold):
                    a.append(fp[part][[x]])
                    b.append(fp[part][[y]])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            rows = [np.concatenate(x) for x in zip(left, now)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on in the next batch
            left = [x[whole:] for x in rows]
            if whole:
                yield done(*(x[:whole] for x in rows))
        if len(left[0]):
            yield done(*left)

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    dealt = spread_out.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_components(documents: DataFrame, words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that is reachable by links."""
    small_batches(documents.sparkSession, 4000)
    prints = cut(fingerprints(documents, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    heads = components(links(distinct, threshold)).select(F.col("u").alias("fp"), F.col("v").alias("head"))
    joined = distinct.join(heads, "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    least = joined.groupBy("head").agg(F.min("least").alias("component_id"))
    return prints.join(joined.select("fp", "head").join(least, "head").select("fp", "component_id"), "fp")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; a text without words has the hash of an empty one."""
    found = [np.unique(h) for h in shingle_hashes(text, words)] or [np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def bands(s: np.ndarray) -> np.ndarray:
    """One hash for each of the bands: of so many minima of a text's shingles under as many orders."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, ((s[i : i + 4096, None] ^ _MASKS) * _FACTORS).min(0), out=least)
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with at least that Jaccard similarity, as positions."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    for i in range(1, len(sets)):
        #: those before it of fitting sizes
        fit = np.flatnonzero((np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i]) - 1e-9))
        if not len(fit):
            continue
        own = number[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[number[: starts[i]]], starts[:i], dtype=np.int64)[fit]
        mark[own] = False
        near = fit[common >= similarity * (sizes[fit] + sizes[i] - common) - 1e-9]
        forest.join(np.full(len(near), i), near)
    return forest.links


def fingerprint_cells(rows: DataFrame) -> DataFrame:
    """(band, key) of rows of key and text: keys whose fingerprints are linked, as ``simhash_components`` links them, share a cell."""
    prints = cut(fingerprints(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "fp").distinct())
    heads = components(links(prints.select("fp").distinct())).select(F.col("u").alias("fp"), F.col("v").alias("head"))
    joined = prints.join(heads, "fp", "left").select(F.coalesce("head", "fp").alias("head"), "key")
    #: apart from the bands' hashes
    return joined.select(F.xxhash64("head", F.lit("fingerprint")).alias("band"), "key")


def jaccard_links(rows: DataFrame, words: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of keys whose texts' shingles are similar, enough of them to connect all such, for rows of key and text.

    Texts that share a band, or whose fingerprints are linked, meet in a cell, where their sets of shingles are compared as they are. Cells of equal members are one; a large cell is
    dealt as pairs of parts.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(shingles(t.as_py(), words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "signs"])
        release()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "hashes"])
        release()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1 and (found := set_links(sets, similarity)):
                k = np.array(keys, np.int64)
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(k[a]), pa.array(k[b])], ["a", "b"])

        for batch in batches:
            for band, i, j, key, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, i, j) != cell:
                    yield from done()
                    cell, keys, sets = (band, i, j), [], []
                keys.append(key)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield from done()
        release()

    signed = rows.mapInArrow(sign, "key long, signs binary").groupBy("key").agg(F.first("signs").alias("signs"))
    spread_out = cut(fingerprint_cells(rows).unionByName(signed.mapInArrow(spread, "band long, key long")))
    mixed = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    cells = spread_out.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *mixed).filter("n > 1")
    cells = cells.groupBy("n", "x0", "x1").agg(F.min("band").alias("band")).select("band", "n")
    members = cut(spread_out.join(cells, "band"))
    sets = rows.join(members.select("key").distinct(), "key", "left_semi").mapInArrow(hashed, "key long, hashes binary")
    sets = sets.groupBy("key").agg(F.first("hashes").alias("hashes"))
    parts = F.ceil(F.col("n") / PART).cast("long")
    own = F.pmod(F.xxhash64("key", F.lit(2)), parts)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key").join(sets, "key")
    dealt = dealt.select("band", "i", "j", "key", "hashes").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def content(text):
    """The key of a text as it is; a null one is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_components(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and of its component the smallest id that is reachable by links of the stage, and the key that goes with it."""
    small_batches(documents.sparkSession)
    rows = documents.select(content(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    prints = cut(documents.select("doc_id", content(F.col("text")).alias("key")))
    distinct = cut(prints.groupBy("key").agg(F.min("doc_id").alias("least")))
    heads = components(jaccard_links(rows)).select(F.col("u").alias("key"), F.col("v").alias("head"))
    joined = distinct.join(heads, "key", "left").withColumn("head", F.coalesce("head", "key"))
    least = joined.groupBy("head").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("x"))
    least = least.select("head", F.col("x.least").alias("component_id"), F.col("x.key").alias("component_key"))
    return prints.join(joined.select("key", "head").join(least, "head").select("key", "component_id", "component_key"), "key")


def simhash_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id, and of its texts under this id that with the smallest key. Ids may be null or repeated."""
    found = near_components(documents)
    #: those that go are the smaller side of the join
    name, key, own = fresh(documents, "_gone", "_key", "_own")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    gone = found.filter(~stays).select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct()
    keyed = documents.withColumn(own, content(F.col("text")))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own) == F.col(key)), "left_anti")
    if found.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*named(documents))


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
SQL: dict[str, str] = {}
