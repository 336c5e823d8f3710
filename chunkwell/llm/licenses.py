"""Licence scans: TF-IDF cosine of lines to templates, then inheritance along directories.

Every line of a whole text is a candidate for a header, and so is every run of as many terms as a template has, across line breaks. Terms are runs of letters,
digits and characters beyond ASCII, in lower case. A term weighs by the number of documents of the whole
corpus that hold it, whether a template has it or not: these numbers are a table by hashes of terms, which grows with the corpus and stays distributed. A
file's licence is that of the template nearest to one of these, from ``LEAST`` cosine on. A
licence file (``LICENSE``, ``COPYING``, ``NOTICE``) gives its licence to its directory; a file without one of its own
has that of the nearest directory above it, by equal joins of directories with all their ancestors.

Lines and runs are compared only if they hold a key term. A template's other terms weigh less together
than ``LEAST``, so that no line without a key term can reach it. A first pass has the weights of the templates' terms, and keeps those
lines and runs that may be nearest with any weights of their other terms; the table then gives these terms' weights.

Nulls: a null text is an empty one; a null path is a file without directory. Repeated
paths are judged one by one; of several licence files in a directory the highest cosine counts, then the licence
first by name. An empty table gives an empty result.
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

from .common import cut, portions, release, small_batches, table
from .toxicity import groups, word_hashes

LEAST = 0.7
TERM = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
LICENCE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)(\.[A-Za-z]+)?$"
#: Licence, header or first sentence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


#: Marks a candidate that is a whole line.
LINE = "\n"


def idf(df: float, documents: int) -> float:
    return math.log((1 + documents) / (1 + df)) + 1


class Matcher:
    """Templates with the weights of their terms. ``LIGHT`` and ``heavy`` are the least and the most that any other term can weigh."""

    LIGHT = 1.0

    def __init__(self, templates, df: dict[str, int], documents: int, least: float = LEAST):
        self.least, self.heavy, self.documents = least, idf(0, documents), documents
        self.idf = {t: idf(df.get(t, 0), documents) for _, text in templates for t in terms(text)}
        self.templates, keys = [], set()
        for name, text in templates:
            v = {t: n * self.idf[t] for t, n in terms(text).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {t: x / norm for t, x in v.items()}
            self.templates.append((name, v))
            light = 0.0
            for t, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
                light += x * x
                if math.sqrt(light) >= least - 1e-9:
                    keys.add(t)
        self.keys = sorted(keys)
        self.key = re.compile("|".join(map(re.escape, self.keys)))
        self.lengths = [sum(terms(text).values()) for _, text in templates]
        self.holders: dict[str, list[int]] = {k: [i for i, (_, v) in enumerate(self.templates) if k in v] for k in self.keys}

    def best(self, run: str, other: dict[str, float] | float) -> tuple[float, str | None]:
        """The nearest template, the first of equal ones: for a line of all, for a run of those of its length. ``other`` has the weights of terms that no template has, or one for all."""
        counts, line, best, name = Counter(run.split()), run.startswith(LINE), 0.0, None
        w = {t: n * (self.idf[t] if t in self.idf else other if isinstance(other, float) else other[t]) for t, n in counts.items()}
        n, norm = sum(counts.values()), math.sqrt(sum(x * x for x in w.values()))
        for (licence, v), length in zip(self.templates, self.lengths):
            if (line or n == length) and (x := sum(x * w[t] for t, x in v.items() if t in w) / norm) > best + 1e-12:
                best, name = x, licence
        return best, name

    def lines(self, text: str) -> Iterator[str]:
        """Lines that hold a key term."""
        found = self.key.search(text)
        while found:
            end = text.find("\n", found.end())
            yield text[text.rfind("\n", 0, found.start()) + 1 : end if end >= 0 else len(text)]
            found = self.key.search(text, end) if end >= 0 else None

    def runs(self, text: str) -> dict[int, set[tuple[str, ...]]]:
        """For each template the runs of its length that hold one of its key terms and enough of it."""
        found: dict[int, set[tuple[str, ...]]] = {}
        longest, carry = max(self.lengths), []
        for part in portions(text, 1 << 20):
            words = carry + TERM.findall(part)
            done = -1  # the last start that was looked at, of each template
            seen: dict[int, int] = {}
            for p, w in enumerate(words):
                for i in self.holders.get(w, ()):
                    name, v = self.templates[i]
                    n = self.lengths[i]
                    for start in range(max(p - n + 1, 0, seen.get(i, done) + 1), min(p, max(len(words) - n, 0)) + 1):
                        run = words[start : start + n]
                        if sum(v[t] ** 2 for t in v.keys() & set(run)) >= self.least**2 - 1e-9:
                            found.setdefault(i, set()).add(tuple(run))
                        seen[i] = start
            carry = words[len(words) - longest + 1 :] if len(words) >= longest else words
        return found

    def candidates(self, text: str) -> list[str]:
        """Lines and runs, as terms joined by spaces (a line after ``LINE``), one of which is the nearest of the text whatever other terms weigh."""
        low = text.lower()
        if not any(k in low for k in self.keys):
            return []
        each = {LINE + " ".join(TERM.findall(line)) for line in self.lines(low)} - {LINE}
        each |= {" ".join(run) for found in self.runs(low).values() for run in found}
        bounds = []
        for run in each:
            most = self.best(run, self.LIGHT)[0]
            if most >= self.least - 1e-9:
                bounds.append((most, self.best(run, self.heavy)[0], run))
        least = max((b[1] for b in bounds), default=0.0)
        return sorted(run for most, _, run in bounds if most >= least - 1e-6)

    def choose(self, runs: list[str], df: dict[int, int]) -> tuple[float, str | None]:
        """The nearest of the candidates; of equal ones the longest, then the first. ``df`` is by hashes."""
        found = []
        for run in runs:
            words = run.split()
            new = sorted({w for w in words if w not in self.idf})
            score, name = self.best(run, {t: idf(df.get(h, 0), self.documents) for t, h in zip(new, term_hashes(new))})
            if score >= self.least:
                found.append((round(score, 9), len(words), run, score, name))
        if not found:
            return 0.0, None
        first = min(found, key=lambda x: (-x[0], -x[1], x[2]))
        return first[3], first[4]


def term_hashes(words: list[str]) -> list[int]:
    """The hash of each of some terms, as a signed long."""
    return word_hashes(words)[0].view(np.int64).tolist() if words else []


def document_counts(files: DataFrame) -> DataFrame:
    """(term, n): how many documents hold each term, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, held = -1, np.zeros(0, np.uint64)  # the last text's terms, as it may go on in the next group
            for parts, rows in groups([t or "" for t in batch.column(0).to_pylist()]):
                h, at = word_hashes(parts)
                of, h = np.r_[np.full(len(held), row), rows[at]], np.r_[held, h]
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])][: len(h)]
                of, h, row = of[new], h[new], rows[-1]
                yield counted(h[of != row])
                held = h[of == row]
            yield counted(held)
        release()

    def counted(h: np.ndarray) -> pa.RecordBatch:
        term, n = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    return cut(files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))


def matcher(files: DataFrame, counted: DataFrame, templates=TEMPLATES) -> Matcher:
    """With the counts of the templates' terms, which are few."""
    words = sorted({t for _, text in templates for t in terms(text)})
    hashes = dict(zip(term_hashes(words), words))
    got = counted.filter(F.col("term").isin(list(hashes))).collect()
    return Matcher(templates, {hashes[r["term"]]: r["n"] for r in got}, files.count())


def parent(path: Column) -> Column:
    """Directory of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame) -> DataFrame:
    """``path`` with own_licence, own_score, licence and inherited_from (the directory), for columns id, path and text."""
    spark = files.sparkSession
    small_batches(spark)
    counted = document_counts(files)
    shared = spark.sparkContext.broadcast(matcher(files, counted))
    kind = files.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.candidates(t.as_py() or "") for t in batch.column(2)]
            hashes = [sorted({*term_hashes([w for run in runs for w in run.split() if w not in shared.value.idf])}) for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["id", "path", "runs", "hashes"])
        release()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.choose(runs or [], {x["term"]: x["n"] for x in df or []}) for runs, df in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[1] for x in found], pa.string()), pa.array([x[0] for x in found], pa.float64())], ["id", "path", "own_licence", "own_score"])

    runs = cut(files.select("id", "path", "text").mapInArrow(find, f"id {kind}, path string, runs array<string>, hashes array<long>").withColumn("row", F.monotonically_increasing_id()))
    #: the counts of candidates' other terms; most rows have no candidates and take no part
    each = runs.select("row", F.explode("hashes").alias("term"))
    counts = counted.join(each.select("term").distinct(), "term", "left_semi")
    df = each.join(counts, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("df"))
    some = runs.filter(F.size("runs") > 0).join(df, "row", "left").select("id", "path", "runs", "df")
    schema = f"id {kind}, path string, own_licence string, own_score double"
    own = some.mapInArrow(match, schema).unionByName(runs.filter(F.size("runs") == 0).select("id", "path", F.lit(None).cast("string").alias("own_licence"), F.lit(0.0).alias("own_score")))
    own = cut(own.withColumn("dir", parent(F.coalesce("path", F.lit("")))))
    licensed = own.filter(F.col("own_licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    given = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_licence"))["own_licence"].alias("given"))
    #: each directory once, with itself and all above it
    dirs = own.filter("own_licence is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("up"))
    nearest = each.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "given")).alias("x"))
    nearest = nearest.select(F.col("dir").alias("_dir"), F.col("x.up").alias("_up"), F.col("x.given").alias("_given"))
    out = own.join(nearest, F.col("own_licence").isNull() & (F.col("dir") == F.col("_dir")), "left")
    return out.select("id", "path", "own_licence", "own_score", F.coalesce("own_licence", "_given").alias("licence"), F.col("_up").alias("inherited_from"))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as a tree of files, as the table has no paths: the source, then the id's leading digits; ids that end with 0 are licence files."""
    i = F.coalesce(F.col("doc_id"), F.lit(-1))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("k"), F.floor(i / 1000)), F.concat(F.lit("c"), F.floor(i / 100)))
    name = F.when(i % 10 == 0, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/d"), F.floor(i / 10), F.lit("/"), i, F.lit(".txt")))
    return documents.select(F.col("doc_id").alias("id"), F.concat(folder, name).alias("path"), "text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(as_files(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "path", "own_licence", F.round("own_score", 6).alias("own_score"), "licence", "inherited_from")


QUERIES = {"op5_licenses": op5_licenses}
SQL: dict[str, str] = {}
