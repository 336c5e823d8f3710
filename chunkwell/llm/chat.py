"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

States are the roles. A line is seen through its speaker marker (``User:``, ``### Response``, ``[system]``
and the like, or another name, or none), its length, whether it ends as a question, and whether it is a list or code
line. A fragment's first line has transitions of its own, as speakers change there, and seldom within. Transitions, emissions and starts are counted over the labelled conversations that are learnt
from. Viterbi finds the likeliest roles of all lines of a conversation together.

A line's features are one byte, so that only bytes move until the roles at segments' ends are known; then texts
are shuffled once, to be rendered. A conversation may be of any length: its fragments are dealt in segments of ``SEGMENT``. First each
segment's best log-probabilities from each role before it to each role at its end are found, nine numbers; then the best
path over the segments of a conversation fixes the roles at their ends; last each segment is decoded
between those. The result is the same as of one pass over the whole.

A turn begins with a marker or a change of role. It is rendered as ``<|role|>``, its lines without
marker, and ``<|end|>``; the fragments' renderings in order are the conversation's.

Nulls: a null or empty fragment is one empty line. A fragment with a null conversation id is a conversation of its own, whatever
its position; null positions come first; equal positions are ordered by a hash of the text, and null ones dealt in segments by it. Repeated rows are repeated fragments. An
empty table gives an empty result; without labels the model is that of its pseudo-counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

ROLES = ("system", "user", "assistant")
SEGMENT = 64
FOLDS, HELD_OUT = 5, 0
#: Speaker names by role.
NAMES = {
    "system": "system sys instructions context",
    "user": "user human q question instruction prompter customer me",
    "assistant": "assistant ai bot a answer response agent model gpt",
}
FAMILY = {name: i for i, role in enumerate(ROLES) for name in NAMES[role].split()}
OTHER, NONE = len(ROLES), len(ROLES) + 1
MARKER = re.compile(r"\s*(?:#+\s*(\w+)\s*(?::|$)|\[(\w+)\]\s*:?|<\|?(\w+)\|?>\s*:?|\**(\w+)\**\s*:)[ \t]*")
ITEM = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s|    |\t|```)")
#: Sizes of the features: marker, length, question, item.
SIZES = (len(ROLES) + 2, 5, 2, 2)
#: Codes of a line's features; as many more are those of first lines.
CODES = math.prod(SIZES)
PSEUDO = 0.5


def marker(line: str) -> tuple[int, str]:
    """Family of a line's marker, and the line without it; a name of no family is kept."""
    m = MARKER.match(line)
    if not m:
        return NONE, line
    family = FAMILY.get(next(g for g in m.groups() if g).lower(), OTHER)
    return family, line[m.end() :] if family != OTHER else line


def features(line: str) -> tuple[int, int, int, int]:
    n = len(line)
    return marker(line)[0], (n > 0) + (n > 40) + (n > 160) + (n > 640), line.rstrip().endswith("?"), bool(ITEM.match(line))


def code(line: str) -> int:
    """The features as one number below the product of their sizes."""
    out = 0
    for size, f in zip(SIZES, features(line)):
        out = out * size + int(f)
    return out


def codes(lines: list[str]) -> bytes:
    """A byte for each line of a fragment, of which the first is marked."""
    return bytes([code(lines[0]) + CODES, *map(code, lines[1:])])


class Hmm:
    def __init__(self, counts: dict[tuple[str, int, int], float]):
        def table_of(name: str, columns: int, rows: int = len(ROLES)) -> np.ndarray:
            t = np.full((rows, columns), PSEUDO)
            for (k, i, j), n in counts.items():
                if k == name:
                    t[i, j] += n
            return np.log(t / t.sum(1, keepdims=True))

        self.start = table_of("start", len(ROLES), 1)[0]
        #: within a fragment, and to its first line
        self.steps = [table_of("step", len(ROLES)), table_of("begin", len(ROLES))]
        self.emit = [table_of(f"f{k}", size) for k, size in enumerate(SIZES)]

        #: of each code of features
        cells = np.array(np.unravel_index(np.arange(2 * CODES) % CODES, SIZES))
        self.emission = sum(e[:, cells[k]].T for k, e in enumerate(self.emit))

    def emitted(self, found: bytes) -> np.ndarray:
        return self.emission[np.frombuffer(found, np.uint8)]

    def step(self, code: int) -> np.ndarray:
        """The transitions to a line."""
        return self.steps[code >= CODES]

    def span(self, found: bytes) -> np.ndarray:
        """Best log-probability from each role before to each role at the end; row 3 is that from the start of a conversation."""
        e = self.emitted(found)
        m = np.vstack([self.step(found[0]), self.start]) + e[0]
        for code, row in zip(found[1:], e[1:]):
            m = (m[:, :, None] + self.step(code)).max(1) + row
        return m

    def decode(self, found: bytes, before: int = -1, end: int | None = None) -> list[int]:
        """Roles of lines by their codes, with the role before (-1 at a start) and, if given, that of the last line fixed."""
        e = self.emitted(found)
        d = (self.start if before < 0 else self.step(found[0])[before]) + e[0]
        back = []
        for code, row in zip(found[1:], e[1:]):
            all_ = d[:, None] + self.step(code)
            back.append(all_.argmax(0))
            d = all_.max(0) + row
        out = [int(d.argmax()) if end is None else end]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are alike in the first columns; they lie together."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield batch_of(out, schema)
            out = []
    if out:
        yield batch_of(out, schema)


COUNTS = pa.schema([("name", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
SPANS = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("span", pa.list_(pa.float64()))])
ENDS = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("before", pa.int32()), ("end", pa.int32()), ("final", pa.bool_())])


def placed(transcripts: DataFrame) -> list[Column]:
    """Key ``c``, ``seg``, ``seq`` and ``tie`` of fragments with a conversation id, by which they are dealt out and put in order."""
    tie = F.xxhash64(F.coalesce("fragment", F.lit("")))
    #: those without a position come first, in segments by the top bits of the hash
    seg = F.when(F.col("seq").isNull(), F.shiftright(tie, 56) - F.lit(1 << 62)).otherwise(F.floor(F.col("seq") / SEGMENT).cast("long"))
    return [F.col("conv_id").cast("string").alias("c"), seg.alias("seg"), F.col("seq").cast("long").alias("seq"), tie.alias("tie")]


def coded(transcripts: DataFrame, role: Column) -> DataFrame:
    """c, seg, seq, tie, role and ``codes``, a byte for each line, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(lines_of(t.as_py())) for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.binary())], ["c", "seg", "seq", "tie", "role", "codes"])

    rows = transcripts.filter("conv_id is not null").select(*placed(transcripts), role.alias("role"), "fragment")
    made = rows.mapInArrow(run, "c string, seg long, seq long, tie long, role string, codes binary")
    return made.repartition("c", "seg").sortWithinPartitions("c", "seg", "seq", "tie")


def train(labelled: DataFrame) -> Hmm:
    """From columns conv_id, seq, fragment and role. Counts are sums of bounded tables; steps between segments are not counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for (_, seg), rows in grouped(batches, 2):
            before = None
            for *_, name, found in rows:
                role = ROLES.index(name) if name in ROLES else None
                for x in found if role is not None else b"":
                    if before is not None:
                        total["begin" if x >= CODES else "step", before, role] += 1
                    elif seg == 0:
                        total["start", 0, role] += 1
                    total["code", role, x % CODES] += 1
                    before = role
        out: Counter = Counter()
        for (name, i, j), n in total.items():
            for key in [(f"f{k}", i, int(v)) for k, v in enumerate(np.unravel_index(j, SIZES))] if name == "code" else [(name, i, j)]:
                out[key] += n
        yield batch_of([(*k, n) for k, n in out.items()], COUNTS)

    counts = coded(labelled, F.col("role")).mapInArrow(count, "name string, i int, j int, n long")
    got = counts.groupBy("name", "i", "j").agg(F.sum("n").alias("n")).collect()  # at most a few dozen cells
    return Hmm({(r["name"], r["i"], r["j"]): r["n"] for r in got})


def rendered(lines: list[str], roles: list[int], before: int, final: bool) -> tuple[int, str]:
    """How many turns begin in a fragment, and its text as turns."""
    parts, turns, last = [], 0, before
    for line, role in zip(lines, roles):
        family, rest = marker(line)
        if role != last or family not in (NONE, OTHER):
            parts += ["<|end|>\n"] * (last >= 0) + [f"<|{ROLES[role]}|>\n"]
            turns += 1
        parts.append(rest + "\n")
        last = role
    return turns, "".join(parts) + "<|end|>\n" * final


def parse(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, seq, role (of the first line), roles (of all lines), n_turns (that begin here) and rendered."""
    spark = transcripts.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, shared.value.span(b"".join(r[5] for r in rows)).ravel().tolist()) for key, rows in grouped(batches, 2))
        yield from batched(found, SPANS)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ROLES)

        def each() -> Iterator[tuple]:
            for (c,), rows in grouped(batches, 1):
                m = np.array([r[2] for r in rows]).reshape(-1, n + 1, n)
                d, back = m[0, n], []
                for x in m[1:, :n]:
                    all_ = d[:, None] + x
                    back.append(all_.argmax(0))
                    d = all_.max(0)
                path = [int(d.argmax())]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                path.reverse()
                for k, r in enumerate(rows):
                    yield c, r[1], path[k - 1] if k else -1, path[k], k == len(rows) - 1

        yield from batched(each(), ENDS)

    fixed = coded(transcripts, F.lit(None).cast("string")).mapInArrow(spans, "c string, seg long, span array<double>")
    fixed = fixed.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(ends, "c string, seg long, before int, end int, final boolean")
    kinds = {f.name: f.dataType.simpleString() for f in transcripts.schema}
    out_schema = f"conv_id {kinds['conv_id']}, seq {kinds['seq']}, role string, roles array<string>, n_turns int, rendered string"

    def made(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
        """``each`` gives rows of conv_id, seq, lines, roles, role before and whether the conversation ends."""
        first = next(batches, None)
        if first is None:
            return
        types = {f.name: f.type for f in first.schema}
        schema = pa.schema([("conv_id", types["conv_id"]), ("seq", types["place"]), ("role", pa.string()), ("roles", pa.list_(pa.string())), ("n_turns", pa.int32()), ("rendered", pa.string())])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def rows() -> Iterator[tuple]:
            for conv_id, seq, lines, roles, before, final in each(again()):
                yield conv_id, seq, ROLES[roles[0]], [ROLES[r] for r in roles], *rendered(lines, roles, before, final)

        yield from batched(rows(), schema, 500)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv_id, seq, fragment in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(fragment)
                yield conv_id, seq, lines, shared.value.decode(codes(lines)), -1, True

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, (head, *rows) in grouped(batches, 2):
            last, end, final = head[8:11]
            lines = [lines_of(r[7]) for r in rows]
            roles, at = shared.value.decode(b"".join(map(codes, lines)), last, end), 0
            for k, (row, own) in enumerate(zip(rows, lines)):
                mine = roles[at : at + len(own)]
                at += len(own)
                yield row[5], row[6], own, mine, last, final and k == len(rows) - 1
                last = mine[-1]

    single = transcripts.filter("conv_id is null").select("conv_id", F.col("seq").alias("place"), "fragment")
    #: a segment's ends and its texts meet in one shuffle
    texts = transcripts.filter("conv_id is not null").select(*placed(transcripts), F.lit(1).alias("kind"), "conv_id", F.col("seq").alias("place"), "fragment")
    both = texts.unionByName(fixed.withColumn("kind", F.lit(0)), allowMissingColumns=True).select("c", "seg", "kind", "seq", "tie", "conv_id", "place", "fragment", "before", "end", "final")
    both = both.repartition("c", "seg").sortWithinPartitions("c", "seg", "kind", "seq", "tie")
    return both.mapInArrow(lambda b: made(b, together), out_schema).unionByName(single.mapInArrow(lambda b: made(b, alone), out_schema))


def fold(conv_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(HELD_OUT))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table of turns: markers of several styles, which a sixth of the turns lacks. The role goes into the marker alone."""
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)).cast("int")
    names = {"system": ("", "System: ", "[system] ", "### System\n", "System: ", "<|system|>\n"), "user": ("", "User: ", "Human: ", "### Instruction:\n", "Q: ", "[user] "), "assistant": ("", "Assistant: ", "AI: ", "### Response:\n", "A: ", "[assistant] ")}
    mark = F.lit("")
    for role, styles in names.items():
        mark = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, styles)), style)).otherwise(mark)
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("fragment"), "role")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    transcripts = as_transcripts(table(spark, sf_dir, "conversations"))
    model = train(transcripts.filter(fold(F.col("conv_id")) != HELD_OUT))
    found = parse(transcripts.drop("role"), model)
    return found.select("conv_id", F.col("seq").alias("turn"), "role", F.array_join("roles", ",").alias("line_roles"), "n_turns", "rendered")


QUERIES = {"op2_chat": op2_chat}
SQL: dict[str, str] = {}
