"""Quality by nearest neighbours among labelled texts in a space of latent semantics.

A text is a bag of hashed terms of two kinds: words, with A-Z lower-cased, and shapes of words (runs of small letters, capitals and digits as one sign
each, signs as they are), among which a word that repeats the one before it counts as a shape of its own. Counts are damped, weighed by how few of all documents have a term,
and each kind is brought to unit length, words with half the weight of shapes. The main directions of ``BASIS`` labelled texts span the latent space.

The labelled vectors, ``VOTERS`` at most, go to all workers. Each document's cosines to all of them are computed as exact products of blocks,
and the ``NEAREST`` vote for their labels, weighed by a power of the cosine; all that are as near as the last of them vote too. A score is the share of votes for label 1.

Bounds: voters and basis are those labelled rows of the training folds whose ids have the least hashes, 16,384 and 2,048 of them (parameters ``voters`` and ``basis``); in
a smaller table all are taken. Document frequencies are counted over all documents, and all documents are scored. 4 MB of voters,
2 MB of directions and 9,217 frequencies are what goes through the driver, and the basis's terms, 2,048 times 9,216 at most.

Folds: crc32 of the id as text, mod 5; fold 0 is held out. Labels, languages, sources and ids are no inputs of a score.

Nulls: a null text is an empty one. A text without words, or all of whose words are unknown to the space, gets the voters' mean label; without any labels that is 0.5. Null ids are never held out nor
learnt from, and null labels are no labels; a document labelled twice has the mean of its labels. Repeated rows are scored one by one. Long texts are read in blocks to their end; an empty table gives an empty result,
and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import blocks
from .common import UPPER, cut, release, small_batches, table

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that vote, rows that span the space, its directions, neighbours that vote, power of the cosine, score from which a text is good.
VOTERS, BASIS, DIRECTIONS, NEAREST, POWER, GOOD = 16_384, 2_048, 64, 8, 16, 0.3
#: Cells of hashed words and of hashed shapes, and the words' weight.
WORDS, SHAPES, WORD_WEIGHT = 1 << 13, 1 << 10, 0.5
TERMS = WORDS + SHAPES
#: Words known at once by a task, texts compared at once, parts of the voters of which the nearest are found first.
KNOWN, BLOCK, PARTS = 1 << 19, 256, 256
#: Cosines are compared in steps of this, so that the order of sums does not decide.
STEPS = np.float32(65536)
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
SPACED = bytes.maketrans(SPACE, b" " * len(SPACE))
SIGNS = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord(" ") if b in SPACE else b for b in range(256))
REPEAT = b"a a"
VECTORS = "label double, terms binary, counts binary"


class Cells(dict):
    """Numbers of words in order of their first use, and the cell of each."""

    def __init__(self, size: int, offset: int):
        super().__init__()
        self.size, self.offset, self.of = size, offset, np.zeros(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        if n == len(self.of):
            self.of = np.concatenate([self.of, np.zeros(n, np.int64)])
        self.of[n] = self.offset + xxhash.xxh3_64_intdigest(word) % self.size
        return n


class Reader:
    """Counts of a text's terms."""

    def __init__(self):
        self.words, self.shapes = Cells(WORDS, 0), Cells(SHAPES, WORDS)
        self.repeat = WORDS + xxhash.xxh3_64_intdigest(REPEAT) % SHAPES

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms in order, and how often each is there."""
        if len(self.words) + len(self.shapes) > KNOWN:
            self.__init__()
        parts, last = [], -1
        for block in blocks((text or b"").translate(SPACED)):
            found = block.translate(LOWER).split()
            if not found:
                continue
            own = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            signs = np.frombuffer(block.translate(SIGNS), np.uint8)
            shapes = signs[np.r_[True, signs[1:] != signs[:-1]]].tobytes().split()
            kinds = np.fromiter(map(self.shapes.__getitem__, shapes), np.int64, len(shapes))
            again = int((own[1:] == own[:-1]).sum()) + int(own[0] == last)
            last = own[-1]
            parts.append(np.unique(np.concatenate([self.words.of[own], self.shapes.of[kinds], np.full(again, self.repeat)]), return_counts=True))
        if len(parts) == 1:
            return parts[0]
        out = np.zeros(TERMS, np.int64)
        for terms, n in parts:
            out[terms] += n
        return np.flatnonzero(out), out[out > 0]


class Space:
    """Weights of terms and the main directions."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray):
        self.weights, self.axes = weights, axes

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A text's values, each kind of unit length times its weight."""
        x = (1 + np.log(counts)) * self.weights[terms]
        at = int(np.searchsorted(terms, WORDS))
        for part, weight in ((x[:at], WORD_WEIGHT), (x[at:], 1.0)):
            part *= weight / max(float(np.sqrt(part @ part)), 1e-12)
        return x

    def place(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of a text, or 0."""
        z = self.weighed(terms, counts).astype(np.float32) @ self.axes[terms]
        n = float(np.sqrt(z @ z))
        return z / np.float32(n) if n > 1e-6 else np.zeros_like(z)


class Voters:
    def __init__(self, space: Space, places: np.ndarray, labels: np.ndarray, nearest: int = NEAREST):
        self.space, self.places, self.labels, self.nearest = space, places, labels, nearest
        self.rest = float(labels.mean()) if len(labels) else 0.5

    def vote(self, places: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(places), self.rest)
        near, n, k = places @ self.places.T, len(self.labels), self.nearest
        #: as many voters as vote are at least as near as the k-th of the parts' nearest ones
        most = np.maximum.reduceat(near, np.arange(0, n, max(n // PARTS, 1)), axis=1)
        least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if most.shape[1] > k else near.min(1)
        out = np.empty(len(places))
        for i, row in enumerate(near):
            at = np.flatnonzero(row >= least[i] - 2 / STEPS)
            near_of = np.rint(row[at] * STEPS)
            keep = near_of >= max(np.partition(near_of, max(len(at) - k, 0))[max(len(at) - k, 0)], 1)
            w = (near_of[keep] / float(STEPS)) ** POWER
            total = w.sum()
            out[i] = (w @ self.labels[at[keep]]) / total if total > 0 else self.rest
        return np.clip(out, 0, 1)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def weights(documents: DataFrame) -> np.ndarray:
    """Of each term, by the documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total[reader.counts(text.as_py())[0]] += 1
                total[TERMS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "n"])
        release()

    total = np.zeros(TERMS + 1, np.int64)
    for term, n in documents.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term at most
        total[term] = n
    return np.log((1 + total[TERMS]) / (1 + total[:TERMS]))


def sample(documents: DataFrame, labels: DataFrame, voters: int) -> DataFrame:
    """Labels and terms of the labelled rows that vote, with their place in the order of hashes."""
    own = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label")).filter(fold(F.col("doc_id")) != HELD_OUT)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(voters)
    texts = documents.select("doc_id", "text").join(F.broadcast(own), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [reader.counts(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            terms, counts = [t.astype(np.uint16).tobytes() for t, _ in found], [c.astype(np.int64).tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["place", "label", "terms", "counts"])

    made = texts.select(F.xxhash64("doc_id").alias("place"), "label", "text").mapInArrow(run, "place long, " + VECTORS)
    return cut(made.orderBy("place", "label", "terms", "counts").limit(voters))  # an id may be there several times


def read_sparse(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["terms"], np.uint16).astype(np.int64), np.frombuffer(row["counts"], np.int64)


def main_axes(rows: list[tuple[np.ndarray, np.ndarray]], weigh: np.ndarray, directions: int) -> np.ndarray:
    """Right singular vectors of the rows' values, by the eigenvectors of their products."""
    flat = Space(weigh, np.zeros((0, 0), np.float32))
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (terms, counts) in enumerate(rows):
        x[i, terms] = flat.weighed(terms, counts)
    value, vector = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = [i for i in range(len(value) - 1, max(len(value) - directions, 0) - 1, -1) if value[i] > 1e-6]
    return x.T @ (vector[:, top] / np.sqrt(value[top])).astype(np.float32) if top else np.zeros((TERMS, 1), np.float32)


def fit(documents: DataFrame, labels: DataFrame, voters: int = VOTERS, basis: int = BASIS, directions: int = DIRECTIONS, nearest: int = NEAREST) -> Voters:
    spark = documents.sparkSession
    small_batches(spark)
    weigh, rows = weights(documents), sample(documents, labels, voters)
    first = [read_sparse(r) for r in rows.orderBy("place", "label", "terms", "counts").limit(basis).collect()]
    space = Space(weigh, main_axes(first, weigh, directions))
    shared = spark.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.frombuffer(t.as_py(), np.uint16).astype(np.int64), np.frombuffer(c.as_py(), np.int64)) for t, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.place(*p).tobytes() for p in pairs], pa.binary())], ["label", "at"])

    got = rows.select("label", "terms", "counts").mapInArrow(run, "label double, at binary").orderBy("at", "label").collect()  # ``voters`` rows at most
    places = np.array([np.frombuffer(r["at"], np.float32) for r in got], np.float32).reshape(len(got), space.axes.shape[1])
    return Voters(space, places, np.array([r["label"] for r in got]), nearest)


def score_documents(documents: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(), shared.value
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                places = np.array([model.space.place(*reader.counts(t.as_py())) for t in part.column(1).cast(pa.binary())], np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.vote(places), pa.float64())], ["doc_id", "score"])
        release()

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


QUERIES = {"op12_quality": op12_quality}
SQL: dict[str, str] = {}
