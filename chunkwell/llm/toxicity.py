"""Toxicity by class-conditional Kneser-Ney models of toxic and ordinary text.

Every labelled row of the training folds is counted. Counts are a table of pairs of words by class, keyed by
64-bit hashes, which grows with the corpus and stays distributed; words' counts and
contexts are sums over it. Only what a score needs goes to the workers: the words whose
difference counts, up to a number of them. Where there are more, workers get the most frequent words only, and the other words of the texts
meet theirs by a join, so that nothing that grows with the corpus is collected or broadcast; scores are the same either way.

A class's probability of a word is its count in the class less a discount, and what the discounts leave
over goes to backoff counts that both classes share: in how many contexts (after how many other words) a word is seen. So a
rare expression, of which the discounts take most, has about the same probability in both classes. A score compares the two
log-likelihoods of a text over its length. Small differences of a word, which
whole languages have and which many words would add up, do not count (``ZONE``; see README for what the plain sum finds).

The score is a logistic function of that difference, fitted on a fold of the training rows that the counts have not seen.

Folds: crc32 of the id as text, mod 5. Fold 0 is held out, fold 1 fits the
logistic function, the rest are counted. Labels, languages, sources and ids are no inputs of a score.

Nulls: a null text is scored as an empty one, which has no words: its score is
the logistic function at 0. A text is read in portions, however long it is; a run without white space is one portion. Rows with null labels are not learnt from; a document
labelled twice counts as toxic if one label says so. Null ids are never held out nor learnt from.
Without labelled rows of both classes every score is 0; if only
the fold of the logistic function lacks a class, its intercept is the log-odds of all training labels, below 0. Repeated rows are scored
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, named, portions, release, small_batches, table

FOLDS, HELD_OUT, FITTED = 5, 0, 1
#: Of Kneser and Ney's smoothing.
DISCOUNT = 0.75
#: Differences of a word's log-likelihoods up to this (a factor of 20) do not count: a language's or a subject's whole vocabulary differs by so much.
ZONE = 3.0
#: Added to a text's words before division, so that a single word in a short text does not decide.
LENGTH = 30
#: Cells of the histogram from which the logistic function is fitted, over differences in [-SPAN, SPAN].
CELLS, SPAN = 4001, 2.0
#: Labels up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 500_000
#: Words whose differences are sent to the workers at most (16 bytes each); those of others are joined by a shuffle.
BROADCAST_WORDS = 1 << 22

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and each one's text; letters, digits and all beyond ASCII make words.

    A word's hash is that of its bytes as a polynomial: differences of running sums.
    """
    parts = [f" {t.lower()} ".encode() for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    step = np.diff(_INNER[data].view(np.int8))
    first, last = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=sums[1:])
    h = (sums[last] - sums[first]) * powers(pow(_P, -1, 1 << 64), n)[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_Q)
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(ends, first, side="right")


def groups(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[list[str], np.ndarray]]:
    """Portions of texts in groups of about ``most`` characters, and the text that each is of."""
    parts, rows, n = [], [], 0
    for i, t in enumerate(texts):
        for part in portions(t, most):
            parts.append(part)
            rows.append(i)
            n += len(part)
            if n >= most:
                yield parts, np.array(rows)
                parts, rows, n = [], [], 0
    if parts:
        yield parts, np.array(rows)


COUNTS = "prev long, word long, n0 long, n1 long"


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words (0 before a text's first) and their counts in ordinary and toxic text, from columns text and toxic; repeated between groups."""
    for batch in batches:
        toxic, last = np.array(batch.column(1).to_pylist(), np.int64), (-1, 0)
        for parts, rows in groups([t or "" for t in batch.column(0).to_pylist()]):
            h, at = word_hashes(parts)
            of = rows[at]
            if not len(h):
                continue
            prev = np.zeros_like(h)
            prev[1:] = np.where(of[1:] == of[:-1], h[:-1], np.uint64(0))
            prev[0] = last[1] if last[0] == of[0] else 0  # a text goes on from the group before
            last = (of[-1], h[-1])
            pair = (prev * np.uint64(_P) ^ h) * np.uint64(_Q)
            _, first, which = np.unique(pair, return_index=True, return_inverse=True)
            n1 = np.bincount(which, toxic[of], minlength=len(first)).astype(np.int64)
            n = np.bincount(which, minlength=len(first))
            columns = [prev[first].view(np.int64), h[first].view(np.int64), n - n1, n1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["prev", "word", "n0", "n1"])
    release()


class Model:
    """What scoring needs: hashes of words, in order, with their differences beyond the zone, and that of all other words.

    ``tail``, if not None, has columns ``word`` and ``more``: by how much the difference of a word that the workers do not know is beyond that of all others.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, rest: float, tail: DataFrame | None = None):
        self.keys, self.values, self.rest, self.tail = keys, values, rest, tail

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tail": None}  # a frame stays on the driver

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences of words, and which of the words are known."""
        if not len(self.keys):
            return np.full(len(h), self.rest), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[place] == h
        return np.where(known, self.values[place], self.rest), known

    def difference(self, texts: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood, word by word beyond the zone, over the length."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for parts, rows in groups(texts):
            h, at = word_hashes(parts)
            total += np.bincount(rows[at], self.look(h)[0], minlength=len(texts))
            n += np.bincount(rows[at], minlength=len(texts))
        return total / (n + LENGTH)


def differences(documents: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """Documents with a column of their texts' differences, and its name, where words of the model are in a table of their own."""
    row, out, total, length = fresh(documents, "_row", "_difference", "_total", "_length")
    keyed = cut(documents.withColumn(row, F.monotonically_increasing_id()))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text the sum over the words known, and a row for each word that is not."""
        names = ["id", "word", "times", "total", "length"]
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t or "" for t in batch.column(1).to_pylist()]
            sums, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for parts, rows in groups(texts):
                h, at = word_hashes(parts)
                d, known = shared.value.look(h)
                of = rows[at]
                sums += np.bincount(of, d, minlength=len(texts))
                n += np.bincount(of, minlength=len(texts))
                a, b = of[~known], h[~known]
                if not len(a):
                    continue
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                columns = [pa.array(ids[a[first]]), pa.array(b[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(a)]))]
                nothing = [pa.array(np.zeros(len(first))), pa.array(np.zeros(len(first), np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *nothing], names)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), none, none, pa.array(sums), pa.array(n)], names)
        release()

    parts = cut(keyed.select(row, "text").mapInArrow(split, "id long, word long, times long, total double, length long"))
    known = parts.filter("word is null").select("id", "total", "length")
    more = parts.filter("word is not null").join(model.tail, "word")
    more = more.select("id", (F.col("times") * F.col("more")).alias("total"), "length")
    sums = known.unionByName(more).groupBy(F.col("id").alias(row)).agg(F.sum("total").alias(total), F.sum("length").alias(length))
    scored = keyed.join(sums, row)
    return scored.select(*named(documents), (F.col(total) / (F.col(length) + LENGTH)).alias(out)), out


def beyond(d):
    """A difference less the zone."""
    return F.signum(d) * F.greatest(F.abs(d) - ZONE, F.lit(0.0))


def learn(counted: DataFrame) -> Model | None:
    """The model of counts of pairs; none without words of both classes."""
    pairs = counted.groupBy("prev", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = cut(pairs.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("contexts")))
    n0, n1, t0, t1, contexts, v = words.agg(F.sum("n0"), F.sum("n1"), F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0), F.sum("contexts"), F.count(F.lit(1))).first()
    if not n0 or not n1:
        return None
    #: half a context more for each word, and for one that stands for all that are not seen
    shared = (F.col("contexts") + 0.5) / (contexts + 0.5 * (v + 1))
    #: what the discounts leave over
    p0, p1 = ((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * t * shared) / n for c, t, n in (("n0", t0, n0), ("n1", t1, n1)))
    rest = float(np.log(t1 / n1 / (t0 / n0)))
    rest = float(np.sign(rest) * max(abs(rest) - ZONE, 0))
    differing = words.select("word", (F.col("n0") + F.col("n1")).alias("n"), beyond(F.log(p1 / p0)).alias("d"))
    head = marked = differing.filter(F.col("d") != rest)
    tail = None
    if head.count() > BROADCAST_WORDS:
        #: words by the binary digits of their counts, at most 64 rows; the most frequent ones that are few enough
        digits, least = F.length(F.bin("n")), 1 << 62
        room = BROADCAST_WORDS
        for r in sorted(differing.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("held")).collect(), reverse=True):
            room -= r["held"]
            if room < 0:
                break
            least = 1 << (r["digits"] - 1)
        head = differing.filter(F.col("n") >= least)
        tail = cut(marked.filter(F.col("n") < least).select("word", (F.col("d") - rest).alias("more")))
    found = head.select("word", "d").toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], found.column(1).to_numpy()[order], rest, tail)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method over cells with weights, with a slight pull to 0."""
    scale = max(float(np.sqrt(np.average(x * x, weights=n))), 1e-9)
    X, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -35, 35)))
        g = X.T @ (n * (y - p)) - 1e-3 * beta
        H = (X * (n * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(H, g), -4, 4)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the training folds with their labels."""
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.filter(fold(F.col("doc_id")) != HELD_OUT)
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return documents.select("doc_id", "text").join(own, "doc_id").withColumn("fold", fold(F.col("doc_id")))


class Scorer:
    """Fitted by ``fit``; ``score`` gives a probability for each text."""

    def __init__(self, model: Model | None, slope: float, intercept: float):
        self.model, self.slope, self.intercept = model, slope, intercept

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.model.difference(texts) + self.intercept, -35, 35)))

    def column(self, documents: DataFrame) -> tuple[DataFrame, str] | None:
        """Documents with a column of scores, and its name, where the model's words are more than workers get."""
        if self.model is None or self.model.tail is None:
            return None
        seen, name = differences(documents, self.model)
        x = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), self.slope * F.col(name) + self.intercept))
        return seen.withColumn(name, 1 / (1 + F.exp(-x))), name


def fit(documents: DataFrame, labels: DataFrame) -> Scorer:
    spark = documents.sparkSession
    small_batches(spark)
    train = labelled(documents, labels)
    counted = train.filter(F.col("fold") != FITTED).select("text", "toxic").mapInArrow(count, COUNTS)
    model = learn(counted)
    if model is None:
        return Scorer(None, 0.0, 0.0)
    shared = spark.sparkContext.broadcast(model)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            d = shared.value.difference([t or "" for t in batch.column(0).to_pylist()])
            cell = np.clip(np.rint((d + SPAN) / (2 * SPAN) * (CELLS - 1)), 0, CELLS - 1).astype(np.int64)
            np.add.at(total, (np.array(batch.column(1).to_pylist(), np.int64), cell), 1)
        release()
        y, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[y, cell], pa.int64())], ["toxic", "cell", "n"])

    seen = train.filter(F.col("fold") == FITTED).select("text", "toxic")
    if model.tail is None:
        fitted = seen.mapInArrow(cells, "toxic int, cell int, n long")
    else:
        seen, name = differences(seen, model)
        cell = F.rint((F.col(name) + SPAN) / (2 * SPAN) * (CELLS - 1))
        fitted = seen.select("toxic", F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), cell.cast("int"))).alias("cell"), F.lit(1).alias("n"))
    got = fitted.groupBy("toxic", "cell").agg(F.sum("n").alias("n")).collect()  # at most 2 * CELLS rows
    if len({r["toxic"] for r in got}) < 2:
        #: the log-odds of all training labels; without evidence no text is toxic
        toxic, n = train.agg(F.sum("toxic"), F.count(F.lit(1))).first()
        slope, intercept = float(LENGTH), min(float(np.log((toxic + 0.5) / (n - toxic + 0.5))), -0.1)
    else:
        x = np.array([r["cell"] for r in got]) / (CELLS - 1) * 2 * SPAN - SPAN
        slope, intercept = fit_logistic(x, np.array([r["toxic"] for r in got], float), np.array([r["n"] for r in got], float))
    return Scorer(model, slope, intercept)


def score_documents(documents: DataFrame, scorer: Scorer) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
        release()

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text")
    joined = scorer.column(texts)
    if joined is None:
        scored = texts.mapInArrow(run, f"doc_id {kind}, score double")
    else:
        scored = joined[0].select("doc_id", F.col(joined[1]).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; all columns as they were."""
    scorer = fit(documents, table(spark, sf_dir, "labels"))
    joined = scorer.column(documents)
    if joined is not None:
        return joined[0].filter(F.col(joined[1]) < 0.5).select(*named(documents))
    at = documents.columns.index("text")
    shared = spark.sparkContext.broadcast(scorer)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < 0.5))
        release()

    return documents.mapInArrow(keep, documents.schema)


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
