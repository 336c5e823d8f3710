"""Embedding near-duplicates: an exact metric range join on the unit sphere.

A cosine of at least c is a distance of at most r = sqrt(2 - 2c) between unit vectors.
Equal vectors are one entry with a count. Pivots are entries chosen by hash, as many as the root of the
entries' number; each entry has its home in the cell of the nearest pivot. By the triangle inequality an entry can lie within r of a
member of another pivot's cell only if its distance to the plane half way between the two pivots is at most r:
then it is replicated to that cell. Cells join on their own; neighbouring small ones are one task's, which gets an
entry once however many of its cells the entry is replicated to, and a cell with too many homes is dealt to several tasks.

Within a task the pivots prune again: what two vectors have in common is at most the product of their
projections onto some pivots' span and of the lengths that the projections leave over. Only pairs that this bound does not
exclude are computed in full, in double precision. Homes are kept, members stream past them in batches, so that memory is bounded whatever
the size of a cell. Links are counted, not kept: what leaves a task is a count for each home and, for the components, a tree over linked entries.

In many dimensions and without structure all distances are alike, so that most entries are replicated
to most cells; the join then does about the work of a blocked comparison of all pairs. Homes of a task grow with the root of the
entries' number, up to a number of bytes, so that replicas grow less than with the square.

Nulls: vectors that are null, empty, zero or hold nulls or non-finite numbers have no
links. Vectors of different lengths are never linked. Null ids are kept, and are a component's
smallest id only if all are null. Repeated rows are separate vectors that link with each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table
from .components import components

COSINE = 0.95
#: Pivots at most, which bounds what is sent to the workers; those that span the bound within a task.
PIVOTS, SPAN = 1024, 24
#: Homes of a task: least, times the root of the entries' number, and bytes of their vectors at most.
HOMES, HOMES_ROOT, HOMES_BYTES = 4096, 64, 64 << 20
#: Pairs whose bound is worked out at a time, and those computed in full at a time.
BLOCK, EXACT = 1 << 22, 1 << 15
#: Far more than the error of a product in single precision.
MARGIN = 1e-4


def entries(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can be linked: ``rid``, ``v``, ``copies``, ``least``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    found = fine.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return cut(found.withColumn("rid", F.monotonically_increasing_id()))


class Pivots:
    """Cells of pivots by vectors' length, and the tasks that join them."""

    def __init__(self, vectors: list[list[float]], radius: float, span: int = SPAN):
        self.radius = radius
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.span: dict[int, np.ndarray] = {}
        self.tasks: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({len(v) for v in vectors}):
            p = unit(np.array([v for v in vectors if len(v) == size], np.float64))
            self.by_size[size] = p, np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
            if span < size:
                self.span[size] = np.linalg.qr(p[:span].T)[0]

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of unit vectors of one length, and all cells of each as a matrix of truth values; without pivots of their length they have one cell."""
        if u.shape[1] not in self.by_size:
            return np.zeros(len(u), np.int64), np.ones((len(u), 1), bool)
        p, gap = self.by_size[u.shape[1]]
        square = 2 - 2 * (u @ p.T)
        home = square.argmin(1)
        own = square[np.arange(len(u)), home][:, None]
        return home, square - own <= 2 * gap[home] * self.radius + 1e-9

    def assign(self, counts: dict[int, dict[int, int]], total: int) -> None:
        """Tasks for the cells of each length, of which homes are counted: cells in the order of the pivots' main axis are packed."""
        number = 0
        for size, homes in sorted(counts.items()):
            most = max(HOMES, int(HOMES_ROOT * math.sqrt(total)))
            most = max(1, min(most, HOMES_BYTES // (8 * size)))
            cells = np.array(sorted(homes))
            if size in self.by_size:
                p = self.by_size[size][0]
                axis = p @ np.linalg.svd(p - p.mean(0), full_matrices=False)[2][0]
                cells = cells[np.argsort(axis[cells], kind="stable")]
            starts, held = [], 0
            for i, c in enumerate(cells.tolist()):
                if not starts or held + homes[c] > most:
                    starts.append(i)
                    held = 0
                held += homes[c]
            group = np.zeros(cells.max() + 1, np.int64)
            group[cells] = np.searchsorted(starts, np.arange(len(cells)), side="right") - 1
            n = np.bincount(group[cells], [homes[c] for c in cells.tolist()], minlength=len(starts))
            parts = np.ceil(n / most).astype(np.int64)
            first = number + np.cumsum(parts) - parts
            number += int(parts.sum())
            self.tasks[size] = cells, np.array(starts), group, first, parts

    def deal(self, u: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tasks, rows, and whether the row is at home there, of unit vectors of one length."""
        home, member = self.place(u)
        cells, starts, group, first, parts = self.tasks[u.shape[1]]
        at, g = np.nonzero(np.logical_or.reduceat(member[:, cells], starts, axis=1))
        times = parts[g]
        task = np.repeat(first[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        mine = rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        own = first[group[home]] + (mine % parts[group[home]].astype(np.uint64)).astype(np.int64)
        return task, at, task == own[at]

    def bound(self, u: np.ndarray) -> np.ndarray:
        """Vectors whose products are at least those of unit vectors: projections and what they leave over."""
        q = self.span.get(u.shape[1])
        if q is None:
            return u.astype(np.float32)
        a = u @ q
        return np.column_stack([a, np.sqrt(np.maximum(1 - (a * a).sum(1), 0))]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no squares under- or overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each length in a list column."""
    sizes = np.array([len(v) for v in column])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), size)


class Part:
    """The homes of a task, and what has been found for them."""

    def __init__(self, rid: np.ndarray, v: np.ndarray, cosine: float, pivots: Pivots):
        self.rid, self.u, self.cosine, self.pivots = rid, unit(v.astype(np.float64)), cosine, pivots
        self.low = pivots.bound(self.u)
        self.links = np.zeros(len(rid), np.int64)
        self.up = np.arange(len(rid))

    def meet(self, rid: np.ndarray, v: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare with members; pairs of a member's and a home's id for the tree."""
        u = unit(v.astype(np.float64))
        i, j = np.nonzero(self.low @ self.pivots.bound(u).T >= np.float32(self.cosine - MARGIN))
        other = self.rid[i] != rid[j]
        i, j = i[other], j[other]
        near = np.zeros(len(i), bool)
        for k in range(0, len(i), EXACT):
            near[k : k + EXACT] = np.einsum("ij,ij->i", self.u[i[k : k + EXACT]], u[j[k : k + EXACT]]) >= self.cosine
        i, j = i[near], j[near]
        self.links += np.bincount(i, copies[j], minlength=len(self.rid)).astype(np.int64)
        if not len(i):
            return i, i
        while True:  # a member's homes are one tree
            root = self.up[i]
            least = np.full(len(rid), len(self.rid))
            np.minimum.at(least, j, root)
            apart = root != least[j]
            if not apart.any():
                break
            np.minimum.at(self.up, root[apart], least[j][apart])
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]
        linked = np.flatnonzero(least < len(self.rid))
        return rid[linked], self.rid[least[linked]]

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        moved = self.up != np.arange(len(self.up))
        return self.rid[moved], self.rid[self.up[moved]]


def range_join(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (a, b, n): for b null the links of entry ``a`` with other entries' copies; else two entries of one component."""
    spark = found.sparkSession
    small_batches(spark, 8192)
    total = found.count()
    wanted = max(1, min(PIVOTS, math.ceil(math.sqrt(total))))
    chosen = found.orderBy(F.xxhash64("v"), "rid").limit(wanted).select("v").collect()
    made = Pivots([r["v"] for r in chosen], math.sqrt(2 - 2 * cosine))
    cells = spark.sparkContext.broadcast(made)
    element = found.schema["v"].dataType.elementType.simpleString()

    def home_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v in matrix(batch.column(0)):
                cell, n = np.unique(cells.value.place(unit(v.astype(np.float64)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), v.shape[1])), pa.array(cell), pa.array(n)], ["size", "cell", "n"])

    counts: dict[int, dict[int, int]] = {}
    #: a row for each pivot and for each length without one
    for r in found.select("v").mapInArrow(home_cells, "size long, cell long, n long").groupBy("size", "cell").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["size"], {})[r["cell"]] = r["n"]
    made.assign(counts, total)
    pivots = spark.sparkContext.broadcast(made)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, v in matrix(batch.column(2)):
                task, at, home = pivots.value.deal(unit(v.astype(np.float64)), rid[rows])
                for k in range(0, len(at), 8192):
                    take = rows[at[k : k + 8192]]
                    columns = [task[k : k + 8192], (~home[k : k + 8192]).astype(np.int64), rid[take], copies[take]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(2).take(pa.array(take))], ["task", "role", "rid", "copies", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, part = None, [], None

        def rows(a: np.ndarray, b, n: np.ndarray) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

        def meet(rid: np.ndarray, v: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = max(16, BLOCK // len(part.rid))
            for k in range(0, len(rid), step):
                x, y = part.meet(rid[k : k + step], v[k : k + step], copies[k : k + step])
                yield rows(x, y, np.zeros(len(x), np.int64))

        def homes() -> Iterator[pa.RecordBatch]:
            """All homes are there: they are compared with each other first."""
            nonlocal part, waiting
            rid, v, copies = (np.concatenate(x) for x in zip(*waiting))
            waiting, part = [], Part(rid, v, cosine, pivots.value)
            yield from meet(rid, v, copies)

        def end() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield from homes()
            if part is not None:
                yield rows(part.rid, None, part.links)
                a, b = part.tree()
                yield rows(a, b, np.zeros(len(a), np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            task, role, rid, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (role[1:] != role[:-1])]).tolist()
            for a, b in zip(starts, [*starts[1:], len(task)]):
                if task[a] != key:
                    yield from end()
                    key, waiting, part = task[a], [], None
                column = batch.column(4).slice(a, b - a)
                v = column.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if role[a] == 0:
                    waiting.append((rid[a:b], v, copies[a:b]))
                    continue
                if waiting:
                    yield from homes()
                if part is not None:  # a part may have got no homes
                    yield from meet(rid[a:b], v, copies[a:b])
        yield from end()
        release()

    dealt = found.select("rid", "copies", "v").mapInArrow(deal, f"task long, role long, rid long, copies long, v array<{element}>")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "role")
    return cut(dealt.mapInArrow(join, "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, for columns vec_id and embedding."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    found = entries(rows)
    joined = range_join(found, cosine)
    heads = components(joined.filter("b is not null").select("a", "b")).select(F.col("u").alias("rid"), F.col("v").alias("head"))
    counts = joined.filter("b is null").select(F.col("a").alias("rid"), F.col("n").alias("others"))
    named = found.join(counts, "rid", "left").join(heads, "rid", "left").withColumn("head", F.coalesce("head", "rid"))
    least = named.groupBy("head").agg(F.min("least").alias("component"))
    named = named.join(least, "head").select(F.col("v").alias("w"), "copies", "others", "component")
    out = rows.join(named, F.col("v") == F.col("w"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL_OP6 = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {COSINE}
), reach as (
  select a as vec_id, a as other from links union select r.vec_id, l.b from reach r join links l on r.other = l.a
), least as (
  select vec_id, min(other) as component_id from reach group by vec_id
), counts as (
  select a as vec_id, count(*) as n_links from links group by a
)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id,
  e.vec_id = coalesce(component_id, e.vec_id) as kept
from embeddings e left join counts using (vec_id) left join least using (vec_id)"""

QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
SQL = {"op6_embedding_dedup": SQL_OP6}
