"""The entity graph: who is named together with whom, how often, and where."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import reachable, shared_folder
from ..functions.text import normal_key
from ..schema import MAX_CITATIONS, RESULT_LIMIT
from .match import KeyIndex, exact_or_partial

#: Pairs of mentions, and mentions, that a task puts together before they are shuffled.
PUT_TOGETHER = 1 << 20


def mentions(chunks: DataFrame) -> DataFrame:
    """(ord, id, pos, key, name) of chunks (ord, id, entities)."""
    return chunks.select("ord", "id", F.posexplode("entities").alias("pos", "name")).withColumn("key", normal_key(F.col("name")))


def keyed(chunks: DataFrame) -> DataFrame:
    return chunks.select("ord", "id", F.transform(F.coalesce("entities", F.array()), normal_key).alias("k"), F.coalesce("entities", F.array()).alias("entities"))


def by_weight(work: Callable[[pa.RecordBatch], pa.RecordBatch], weigh: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A function of batches of (ord, id, k, ..) that gives ``work`` rows in order of ``ord`` and ``id``, as many at a time as the sizes of their lists allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for whole in batches:
            weights, at = np.cumsum(weigh(pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))), 0
            while at < whole.num_rows:
                before = weights[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(weights, before + PUT_TOGETHER - total, "right")))
                held.append(whole.slice(at, to - at))
                total, at = total + int(weights[to - 1] - before), to
                if total >= PUT_TOGETHER or at < whole.num_rows:
                    yield work(in_order(held))
                    held, total = [], 0
        if held:
            yield work(in_order(held))

    def in_order(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        rows = rows[0] if rows else held[0]
        return rows.take(pc.sort_indices(rows.select(["ord", "id"]), sort_keys=[("ord", "ascending"), ("id", "ascending")]))

    return run


def nodes(chunks: DataFrame) -> DataFrame:
    """(key, name): the name as it is written last."""
    return merge_nodes(node_parts(chunks)).select("key", "name")


def pairs(chunks: DataFrame) -> DataFrame:
    """(ord, id, src, dst) for each pair of a chunk's mentions with different keys, both ways; within the row, without a shuffle."""
    keyed = chunks.select("ord", "id", F.transform(F.coalesce("entities", F.array()), normal_key).alias("k"))
    both = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice(F.col("k"), i + 2, F.size("k")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = keyed.select("ord", "id", F.explode(F.filter(both, lambda p: p["a"] != p["b"])).alias("p"))
    return each.select("ord", "id", F.explode(F.array(F.struct(F.col("p.a").alias("src"), F.col("p.b").alias("dst")), F.struct(F.col("p.b").alias("src"), F.col("p.a").alias("dst")))).alias("e")).select("ord", "id", "e.*")


def weights(paired: DataFrame) -> DataFrame:
    return paired.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def citations(paired: DataFrame, most: int = MAX_CITATIONS) -> DataFrame:
    """(src, dst, rank, ord, id): the first mentions of each edge. A window with a limit, so that an edge's list is never longer."""
    order = Window.partitionBy("src", "dst").orderBy("ord")
    return paired.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("src", "dst", "rank", "ord", "id")


def edges(chunks: DataFrame, most: int = MAX_CITATIONS) -> DataFrame:
    """(src, dst, weight, citations). Edges of a part of the chunks are partial sums, which ``merge_edges`` puts together."""
    return merge_edges(edge_parts(chunks, most), most)


def edge_parts(chunks: DataFrame, most: int = MAX_CITATIONS) -> DataFrame:
    """``edges`` of some chunks at a time, put together within tasks, so that pairs are not shuffled."""
    reachable(chunks.sparkSession)

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(2)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        code, names = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
        begin = np.cumsum(sizes) - sizes
        some = [np.zeros((3, 0), np.int64)]
        for n in np.unique(sizes[sizes > 1]).tolist():
            row, (i, j) = np.flatnonzero(sizes == n), np.triu_indices(n, 1)
            cells = code[begin[row][:, None] + np.arange(n)]
            a, b, r = cells[:, i].ravel(), cells[:, j].ravel(), np.repeat(row, len(i))
            kept = (a != b) & (a >= 0) & (b >= 0)
            some.append(np.stack([a[kept], b[kept], r[kept]]))
        a, b, r = np.concatenate(some, axis=1)
        key, r = np.r_[a, b] * len(names) + np.r_[b, a], np.r_[r, r]
        order = np.lexsort((r, key))
        key, r = key[order], r[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        weight = np.diff(np.r_[first, len(key)])
        cited = pa.array(r[np.arange(len(key)) - np.repeat(first, weight) < most])
        places = pa.StructArray.from_arrays([rows.column(0).take(cited), rows.column(1).take(cited)], ["ord", "id"])
        citations = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.minimum(weight, most))].astype(np.int32)), places)
        src, dst = (names.take(pa.array(x)) for x in (key[first] // max(len(names), 1), key[first] % max(len(names), 1)))
        return pa.RecordBatch.from_arrays([src, dst, pa.array(weight), citations], ["src", "dst", "weight", "citations"])

    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("ord", "id")}
    schema = f"src string, dst string, weight long, citations array<struct<ord: {kind['ord']}, id: {kind['id']}>>"
    return keyed(chunks).select("ord", "id", "k").mapInArrow(by_weight(work, lambda n: n * (n - 1)), schema)


def first_cited(lists: str, most: int):
    """The first citations of several lists."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, most)


def merge_edges(parts: DataFrame, most: int = MAX_CITATIONS) -> DataFrame:
    """``edges`` of all chunks from those of parts of them: weights are added, of the citations the first stay. No part's chunks are read again, and the
    order of parts makes no difference. An edge's list is at most as long as its parts' lists together."""
    return parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), first_cited("citations", most).alias("citations"))


def node_parts(chunks: DataFrame) -> DataFrame:
    """(key, name, last, mentions): ``nodes`` of some chunks at a time, with where the name was written and how often a key is named."""
    reachable(chunks.sparkSession)

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.list_value_length(rows.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = rows.column(2).flatten().dictionary_encode(null_encoding="encode")
        code, row = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        keys, back, mentions = np.unique(code[::-1], return_index=True, return_counts=True)
        last = len(code) - 1 - back
        place = last - (np.cumsum(sizes) - sizes)[row[last]]
        lasts = pa.StructArray.from_arrays([rows.column(0).take(pa.array(row[last])), pa.array(place.astype(np.int32))], ["ord", "pos"])
        return pa.RecordBatch.from_arrays([encoded.dictionary.take(pa.array(keys)), rows.column(3).flatten().take(pa.array(last)), lasts, pa.array(mentions)], ["key", "name", "last", "mentions"])

    schema = f"key string, name string, last struct<ord: {chunks.schema['ord'].dataType.simpleString()}, pos: int>, mentions long"
    return keyed(chunks).mapInArrow(by_weight(work, lambda n: n), schema)


def merge_nodes(parts: DataFrame) -> DataFrame:
    """``node_parts`` of all chunks from those of parts of them."""
    return parts.groupBy("key").agg(F.max_by("name", "last").alias("name"), F.max("last").alias("last"), F.sum("mentions").alias("mentions"))


def follow(node_table: DataFrame, edge_table: DataFrame, requests: DataFrame, limit: int = RESULT_LIMIT, keys: KeyIndex | None = None) -> DataFrame:
    """(qid, rank, entity, weight, example_chunk_ids) for (qid, entity): neighbours one step away, the heaviest first, then by name.

    Neighbours of all matched entities are merged. A limit of 0 or less is all. ``keys`` is an index of the nodes' keys, if there is one.
    """
    wanted = requests.select("qid", normal_key(F.col("entity")).alias("want"))
    shared_folder(requests.sparkSession)
    node_table = node_table.checkpoint()  # read several times, and made of all chunks
    found = exact_or_partial(wanted, keys or node_table.select("key"))
    near = found.join(edge_table, F.col("key") == F.col("src"))
    sums = near.groupBy("qid", "dst").agg(F.sum("weight").alias("weight"), first_cited("citations", MAX_CITATIONS).alias("l"))
    named = sums.join(node_table.select(F.col("key").alias("dst"), "name"), "dst")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("weight").desc(), "name")))
    out = ranked.select("qid", "rank", F.col("name").alias("entity"), "weight", F.transform("l", lambda x: x["id"]).alias("example_chunk_ids"))
    return out.filter(F.col("rank") <= limit) if limit > 0 else out
