"""The artifact: one JSON object of meta and chunks. Parquet is for work, this is for exchange.

It is written by all tasks, a chunk a line, as text files that in the order of their names are one object (``cat artifact.json/part-*``), so that no row and no
task holds all chunks. It is read by all tasks, also where it is one file without line ends: each takes a range of bytes. Whether a range begins within a string,
and how deep, follows from the ranges before it; so a first pass counts, for both cases, what each range does to that, and a second cuts out the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reachable
from ..schema import ARTIFACT, CHUNK, META
from .folders import file_system

DEFAULTS = {"id": "", "doc_id": "", "doc_title": "", "category": "", "format": "", "reliability_tier": "", "chunk_type": "", "extraction_method": "", "low_confidence": False, "char_count": 0}
#: Bytes of a range; bytes that are read on at a time; bytes from a key to its bracket at most.
RANGE, AHEAD, KEY = 32 << 20, 1 << 20, 4096
KEYS = re.compile(rb'"(meta|chunks)"[ \t\r\n]*:[ \t\r\n]*([\[{])')
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")], STEP[list(b"}]")], STEP[list(b'"')] = 1, -1, 2
SPACE = b" \t\r\n"


@dataclass(frozen=True)
class Range:
    path: str
    start: int
    end: int
    size: int


@dataclass(frozen=True)
class Begin:
    """How a range begins: within a string or not, how deep, what number its first chunk has, and where the list of chunks is opened if that is in it, else -1."""

    range: Range
    quoted: bool
    depth: int
    number: int
    opened: int


def marks(data: bytes, escaped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes and brackets, without escaped ones, and what each is; brackets in strings are among them. ``escaped``: the first byte is."""
    if escaped:
        data = b" " + data[1:]
    if b"\\" in data:
        data = data.replace(b"\\\\", b"  ").replace(b'\\"', b"  ")
    steps = STEP[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(steps)
    return at, steps[at]


def structure(data: bytes, escaped: bool, quoted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets outside of strings, +1 or -1 for each, and the depth after it, from 0."""
    at, steps = marks(data, escaped)
    outside = (steps != 2) & ((np.cumsum(steps == 2) + quoted) % 2 == 0)
    at, steps = at[outside], steps[outside]
    return at, steps, np.cumsum(steps, dtype=np.int64)


class Bytes:
    """The bytes of a file."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, end - start))

    def escaped(self, start: int) -> bool:
        """Whether a byte is escaped: an odd number of backslashes is right before it."""
        n, step = 0, 64
        while start - n > 0:
            back = self.read(max(0, start - n - step), start - n)
            run = len(back) - len(back.rstrip(b"\\"))
            n, step = n + run, step * 16
            if run < len(back):
                break
        return n % 2 == 1

    def before(self, place: int) -> tuple[int, bytes]:
        """The last byte before a place that is no space, and where; -1 and none at the beginning of the file."""
        step = 64
        while place > 0:
            back = self.read(max(0, place - step), place)
            kept = back.rstrip(SPACE)
            if kept:
                return place - len(back) + len(kept) - 1, kept[-1:]
            place, step = place - len(back), step * 16
        return -1, b""


def effects(file: Bytes, r: Range) -> dict:
    """What a range does, for a beginning outside of a string and for one within: how deep it leads, how deep it gets at least, objects by their depth, and keys."""
    data, escaped = file.read(r.start, r.end), file.escaped(r.start)
    at, steps = marks(data, escaped)
    ahead = data + file.read(r.end, min(r.size, r.end + KEY))
    found = [m for m in KEYS.finditer(ahead) if m.start() < len(data)]
    out = {"quotes": int((steps == 2).sum()) % 2, "first": (data.lstrip(SPACE)[:1] or b" ").decode("latin-1"), "cases": []}
    for quoted in (False, True):
        place, step, depth = structure(data, escaped, quoted)
        opens = np.frombuffer(data, np.uint8)[place] == ord("{")
        levels, numbers = np.unique(depth[opens] - 1, return_counts=True)
        keys = []
        for m in found:
            i = np.searchsorted(at, m.start())
            if i < at.size and at[i] == m.start() and (int((steps[:i] == 2).sum()) + quoted) % 2 == 0:
                j = int(np.searchsorted(place, m.start()))
                level = int(depth[j - 1]) if j else 0
                #: what follows the bracket, up to where the list is closed
                later = depth[j + 1 :] if m.start(2) < len(data) else depth[:0]
                closed = np.flatnonzero(later <= level)
                upto = int(closed[0]) if closed.size else later.size
                inner = opens[j + 1 :][:upto] & (later[:upto] == level + 2)
                keys.append((m[1].decode(), m[2].decode(), r.start + m.start(2), level, int(inner.sum()), bool(closed.size)))
        out["cases"].append({"depth": int(depth[-1]) if depth.size else 0, "low": int(depth.min()) if depth.size else 0, "objects": dict(zip(levels.tolist(), numbers.tolist())), "keys": keys})
    return out


def begins(ranges: list[Range], effect: list[dict]) -> tuple[list[Begin], tuple[Range, int] | None]:
    """How each range that holds chunks begins, and where meta does. An object that is not whole is an error."""
    out, meta, bracket, quoted, depth, number, state = [], None, None, False, 0, 0, "before"
    first = next((e["first"] for e in effect if e["first"] != " "), " ")
    wrong = first != "{"
    for r, e in zip(ranges, effect):
        case, more = e["cases"][quoted], None
        for name, kind, place, level, inner, closed in case["keys"]:
            if depth + level == 1 and name == "meta" and kind == "{" and meta is None:
                meta = (r, place)
            if depth + level == 1 and name == "chunks" and kind == "[" and state == "before":
                bracket, state, more = (r.path, place), "closed" if closed else "inside", inner
        here = bracket is not None and bracket[0] == r.path and r.start <= bracket[1] < r.end
        ahead = bracket is not None and bracket[0] == r.path and bracket[1] >= r.end
        if not ahead and (more is not None or state == "inside"):
            out.append(Begin(r, quoted, depth, number, bracket[1] if here else -1))
            number += case["objects"].get(2 - depth, 0) if more is None else more
            if more is None and depth + case["low"] <= 1:
                state = "closed"
        wrong = wrong or depth + case["low"] < 0
        depth, quoted = depth + case["depth"], bool((quoted + e["quotes"]) % 2)
    if depth or quoted or wrong:
        raise ValueError("the artifact is broken: not one whole JSON object")
    return out, meta


def whole(file: Bytes, r: Range, start: int) -> bytes:
    """The object or list that begins at a place, also where it goes beyond the range."""
    data, step = file.read(start, min(r.size, start + AHEAD)), AHEAD
    while True:
        at, _, depth = structure(data, False, False)
        ends = np.flatnonzero(depth == 0)
        if ends.size:
            return data[: int(at[ends[0]]) + 1]
        if start + len(data) >= r.size:
            raise ValueError(f"the artifact is broken: {r.path} ends within an object")
        step *= 2
        data += file.read(start + len(data), min(r.size, start + len(data) + step))


def cut(file: Bytes, b: Begin) -> Iterator[bytes]:
    """The chunks that begin in a range, as JSON. What else is in the list is an error."""
    r = b.range

    def check(right: bool, place: int) -> None:
        if not right:
            raise ValueError(f"the artifact is broken: no list of objects near byte {r.start + place} of {r.path}")

    data = file.read(r.start, r.end)
    at, steps, depth = structure(data, file.escaped(r.start), b.quoted)
    depth = depth + b.depth
    later = at > b.opened - r.start if b.opened >= 0 else at >= 0
    at, steps, depth = at[later], steps[later], depth[later]
    end = np.flatnonzero((steps < 0) & (depth == 1))
    if end.size:
        last = int(at[end[0]])
        _, byte = file.before(r.start + last)
        check(byte in (b"}", b"[", b""), last)
        at, steps, depth = at[: end[0]], steps[: end[0]], depth[: end[0]]
    opens, closes = at[(steps > 0) & (depth == 3)], at[(steps < 0) & (depth == 2)]
    if b.depth > 2 and b.opened < 0:  # what goes on here is another range's
        closes = closes[1:]
    for i, start in enumerate(opens.tolist()):
        check(data[start : start + 1] == b"{", start)
        if i:
            check(data[int(closes[i - 1]) + 1 : start].translate(None, SPACE) == b",", start)
        else:
            place, byte = file.before(r.start + start)
            check(byte in (b"[", b"") or byte == b"," and file.before(place)[1] in (b"}", b""), start)
        if i < closes.size:
            yield data[start : int(closes[i]) + 1]
        else:
            yield whole(file, r, r.start + start)


def ranges_of(path: str, size: int) -> list[Range]:
    """Ranges of a file, or of a folder's files in the order of their names."""
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [(path, info.size)]
    if info.type == fs.FileType.Directory:
        inside = system.get_file_info(fs.FileSelector(inner))
        found = sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in inside if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [Range(p, at, min(n, at + size), n) for p, n in found for at in range(0, n, size)]


def per_row(spark: SparkSession, n: int, schema: str, make) -> DataFrame:
    """``make(i)`` gives a record batch; a task each."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield make(i)

    reachable(spark)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, schema)


def read_artifact(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Meta (one row) and chunks (with ``ord``, the place in the file). A missing or broken file is an error; unknown keys are left out.

    Files are read a range of ``size`` bytes a task, twice. Where Arrow has no file system for the store, one task parses the whole of it.
    """
    filled = [F.coalesce(F.col(f.name), F.lit(DEFAULTS[f.name])).alias(f.name) if f.name in DEFAULTS else F.col(f.name) for f in CHUNK]
    try:
        file_system(path)
    except ValueError:
        one = spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        return one.select("meta.*"), one.select(F.posexplode("chunks").alias("ord", "c")).select(F.col("ord").cast("long"), "c.*").select("ord", *filled)
    ranges = ranges_of(path, size)

    def effect(i):
        import json

        return pa.RecordBatch.from_pydict({"i": [i], "effect": [json.dumps(effects(Bytes(ranges[i].path), ranges[i]))]})

    #: a few numbers for each range
    rows = sorted(per_row(spark, len(ranges), "i long, effect string", effect).collect())
    begun, about = begins(ranges, [read_effect(r["effect"]) for r in rows])

    def chunks_of(i):
        found = [c.decode() for c in cut(Bytes(begun[i].range.path), begun[i])]
        return pa.RecordBatch.from_pydict({"ord": pa.array(range(begun[i].number, begun[i].number + len(found)), pa.int64()), "value": pa.array(found, pa.string())})

    def meta_of(i):
        return pa.RecordBatch.from_pydict({"value": pa.array([whole(Bytes(about[0].path), *about).decode() if about else None], pa.string())})

    strict = {"mode": "FAILFAST"}
    meta = per_row(spark, 1, "value string", meta_of).select(F.from_json("value", META, strict).alias("m")).select("m.*")
    chunks = per_row(spark, len(begun), "ord long, value string", chunks_of).select("ord", F.from_json("value", CHUNK, strict).alias("c")).select("ord", "c.*")
    return meta, chunks.select("ord", *filled)


def read_effect(text: str) -> dict:
    import json

    out = json.loads(text)
    for case in out["cases"]:
        case["objects"] = {int(k): v for k, v in case["objects"].items()}
    return out


def write_artifact(meta: DataFrame, chunks: DataFrame, path: str) -> None:
    """A folder of text files: meta and the list's bracket, a chunk a line in the order of ``ord``, which is different for each, and the end."""
    whole_nulls = {"ignoreNullFields": "false"}
    first = chunks.agg(F.min("ord").alias("first"))
    value = F.to_json(F.struct(*[f.name for f in CHUNK]), whole_nulls)
    lines = chunks.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "ord", F.when(F.col("ord") == F.col("first"), value).otherwise(F.concat(F.lit(","), value)).alias("value"))
    none = F.lit(None).cast("long").alias("ord")
    head = meta.select(F.lit(0).alias("part"), none, F.concat(F.lit('{"meta":'), F.to_json(F.struct("*"), whole_nulls), F.lit(',"chunks":[')).alias("value"))
    tail = meta.select(F.lit(2).alias("part"), none, F.lit("]}").alias("value"))
    head.unionByName(lines).unionByName(tail).sort("part", "ord").select("value").write.mode("overwrite").text(path)
