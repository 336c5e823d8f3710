"""Which entities a text names: whole phrases, whatever the case of letters.

All names make a trie, kept as one sorted array of (node, letter), and a batch of texts is walked by all places at once at which a name may begin: after
the start of a text or a character that is no letter, digit or underscore. Each round takes every place one letter on, by a binary search, and leaves those
that no name goes on with. So a text is read once whatever the number of names, names of any form are alike, and nothing is joined.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reachable
from ..schema import MAX_ENTITIES

#: Letters of the names that are sent to the workers at a time (about 20 bytes each there); more names are as many passes over the texts. Letters of texts that are walked at once.
MOST_LETTERS, WALKED = 4_000_000, 1 << 18
#: A node and a letter in one number; what stands between two texts, which is no letter.
BITS, BETWEEN = 21, 0x110000
#: Texts that are taken out of a batch at a time.
TEXTS = 500


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the one that stands for its cases, and whether it is a letter, digit or underscore."""
    folded, word = np.arange(BETWEEN + 1, dtype=np.int64), np.zeros(BETWEEN + 1, bool)
    for i in range(BETWEEN):
        c = chr(i)
        word[i] = c.isalnum() or c == "_"
        upper = c.upper()
        lower = (upper if len(upper) == 1 else c).lower()
        if lower != c and len(lower) == 1:
            folded[i] = ord(lower)
    return folded, word


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Trie:
    """``steps`` is sorted; its entry i leads from a node to node i + 1. ``ends`` has a node's group of names or -1, and ``offsets`` where the group begins in ``names``."""

    def __init__(self, names: list[str]):
        parts = [letters()[0][codes(n)] for n in names]
        lengths = np.array([len(p) for p in parts], np.int64)
        starts, flat = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([*parts, np.empty(0, np.int64)])
        node, steps, total = np.zeros(len(names), np.int64), [np.empty(0, np.int64)], 0
        going, depth = np.flatnonzero(lengths > 0), 0
        while going.size:
            level, which = np.unique(node[going] << BITS | flat[starts[going] + depth], return_inverse=True)
            node[going] = total + 1 + which
            steps.append(level)
            total, depth = total + level.size, depth + 1
            going = going[lengths[going] > depth]
        self.steps, self.ends = np.concatenate(steps), np.full(total + 1, -1, np.int32)
        last, group = np.unique(node, return_inverse=True)
        self.ends[last] = np.arange(last.size)
        self.ends[0] = -1
        self.names = [names[i] for i in np.argsort(group, kind="stable")]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=last.size))])

    def walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, group) of all names in code points."""
        folded, word = (table[text] for table in letters())
        at = np.flatnonzero(~np.concatenate([[False], word[:-1]]))
        follows = np.concatenate([word[1:], [False]])
        place, node, places, groups = at, np.zeros(at.size, np.int64), [], []
        while place.size and self.steps.size:
            step = node << BITS | folded[at]
            i = np.minimum(np.searchsorted(self.steps, step), self.steps.size - 1)
            on = self.steps[i] == step
            place, at, node = place[on], at[on], i[on] + 1
            end = (self.ends[node] >= 0) & ~follows[at]
            places.append(place[end])
            groups.append(self.ends[node[end]])
            at = at + 1
            inner = at < text.size
            place, at, node = place[inner], at[inner], node[inner]
        return (np.concatenate(places), np.concatenate(groups).astype(np.int64)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))

    def found(self, texts: list[str | None]) -> list[list[str]]:
        """The names of each text, each once."""
        out: list[list[str]] = [[] for _ in texts]
        held, rows, size = [], [], 0
        for row, text in enumerate(texts):
            if text:
                held.append(codes(text))
                rows.append(row)
                size += held[-1].size
            if held and (size >= WALKED or row == len(texts) - 1):
                self.into(out, held, rows)
                held, rows, size = [], [], 0
        if held:
            self.into(out, held, rows)
        return out

    def into(self, out: list[list[str]], held: list[np.ndarray], rows: list[int]) -> None:
        between = np.array([BETWEEN], np.uint32)
        begins = np.concatenate([[0], np.cumsum([h.size + 1 for h in held])])
        place, group = self.walk(np.concatenate([x for h in held for x in (h, between)]))
        number = np.searchsorted(begins, place, "right") - 1
        for pair in np.unique(number * self.offsets.size + group):
            row, g = divmod(int(pair), self.offsets.size)
            out[rows[row]] += self.names[self.offsets[g] : self.offsets[g + 1]]


def finders(vocabulary: DataFrame) -> list:
    """Functions of a text that give the names of it; one unless the names have more letters than go to the workers at a time."""
    spark = vocabulary.sparkSession
    reachable(spark)
    names = vocabulary.select("name").filter("name <> ''").distinct()
    size = names.agg(F.sum(F.length("name")).alias("n")).first()["n"]
    parts = -(-(size or 0) // MOST_LETTERS)
    return [finder(spark, names if parts == 1 else names.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k)) for k in range(parts)]


def release() -> None:
    """Give memory that a worker no longer needs back to the system, as workers live on after a batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another system's C library
        pass


def finder(spark, names: DataFrame):
    trie = spark.sparkContext.broadcast(Trie([r["name"] for r in names.collect()]))

    @F.arrow_udf("array<string>")
    def names_in(texts: pa.Array) -> pa.Array:
        #: some texts at a time, as Python has them four times as large
        found = [pa.array(trie.value.found(texts.slice(i, TEXTS).to_pylist()), pa.list_(pa.string())) for i in range(0, len(texts), TEXTS)]
        release()
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    return names_in


def matches(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (id, name) for chunks (id, text)."""
    made = [chunks.select("id", F.explode(find("text")).alias("name")) for find in finders(vocabulary)]
    out = made[0] if made else chunks.select("id", F.lit("").alias("name")).limit(0)
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def longest(names: Column, limit: int) -> Column:
    """The longest names first, then by name, ``limit`` at most."""
    ordered = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("length"), n.alias("name"))))
    return F.transform(F.slice(ordered, 1, limit), lambda s: s["name"])


def merged(chunks: DataFrame, found: list, limit: int) -> DataFrame:
    """(id, entities) of texts that more names are looked for in than go to the workers at a time: the best of each part, then of all."""
    each = [chunks.select("id", longest(find("text"), limit).alias("l")).filter(F.size("l") > 0) for find in found]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.groupBy("id").agg(longest(F.array_distinct(F.flatten(F.collect_list("l"))), limit).alias("entities"))


def tag(chunks: DataFrame, vocabulary: DataFrame, limit: int = MAX_ENTITIES) -> DataFrame:
    """Rows (id, rank, name): a chunk's longest names first, then by name, ``limit`` at most."""
    found = finders(vocabulary)
    if len(found) > 1:
        lists = merged(chunks, found, limit)
    else:
        lists = chunks.select("id", (longest(found[0]("text"), limit) if found else F.array().cast("array<string>")).alias("entities"))
    return lists.select("id", F.posexplode("entities").alias("rank", "name")).select("id", (F.col("rank") + 1).alias("rank"), "name")


def with_entities(chunks: DataFrame, vocabulary: DataFrame, text: Column, limit: int = MAX_ENTITIES) -> DataFrame:
    """The chunks with their ``entities``."""
    found, none = finders(vocabulary), F.array().cast("array<string>")
    if len(found) < 2:
        return chunks.withColumn("entities", longest(found[0](text), limit) if found else none).select(*chunks.columns)
    lists = merged(chunks.select("id", text.alias("text")), found, limit)
    return chunks.drop("entities").join(lists, "id", "left").withColumn("entities", F.coalesce("entities", none)).select(*chunks.columns)
