"""Collocations against plain counting; quality against plain TF-IDF, singular vectors and neighbours, and on labels held out."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chunkwell.llm import collocations, common, quality

from ..test_entry import plain

PIECE, BLANK = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[\x20\x09]+")
UPPER = {ord(c): c.lower() for c in common.UPPER}
ALPHABET = ["a", "B", "ça", "É", "x'y", "0", "\x1c", "-", " ", "the", "The"]


def counted(rows, longest):
    out = {}
    for lang, text in rows:
        for piece in PIECE.split((text or "").translate(UPPER)):
            words = [w for w in BLANK.split(piece) if w]
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang or "und" if lang is None else lang, " ".join(words[i : i + k])
                    out[key] = out.get(key, 0) + 1
    return out


def mined(rows, longest, least, within):
    """(lang, phrase) to (a, l, r, score), in whole numbers."""
    f = counted(rows, longest)
    size = lambda p: p.count(" ") + 1
    candidates = {k: n for k, n in f.items() if size(k[1]) > 1 and n >= least}
    out = {}
    for (lang, phrase), a in candidates.items():
        inside = lambda other: f" {phrase} " in f" {other} " and size(other) > size(phrase)
        if any(g == lang and inside(other) and 100 * n >= within * a for (g, other), n in candidates.items()):
            continue
        words, cuts = phrase.split(" "), []
        for k in range(1, len(words)):
            l, r = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang, phrase] = (a, l, r, score)
    return out


def made(rng, n, ends=" \t  ..,\n\r!?;:\x0b"):
    return "".join(rng.choice(ALPHABET) + rng.choice(ends) for _ in range(n))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_by_plain_counting(spark, longest):
    rng = random.Random(longest)
    rows = [(rng.choice(["en", None, "", "q r"]), made(rng, rng.randint(0, 400))) for _ in range(60)] + [("en", None), (None, ""), ("en", "..  ,"), ("en", "a b c d " * 30)]
    candidates, totals = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), longest, 5, 60)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"]) for r in candidates.collect()}
    assert got == mined(rows, longest, 5, 60) and len(got) > 20
    n = Counter()
    for (lang, phrase), k in counted(rows, 1).items():
        n[lang] += k
    assert {r["lang"]: r["n"] for r in totals.collect()} == n


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_texts_go_on_from_block_to_block(size):
    """All grams of long pieces, whatever the sizes of blocks and of what a task gathers."""
    rng = random.Random(7)
    rows = [(lang, made(rng, n, ends)) for lang, n, ends in (("en", 3000, " \t"), ("de", 2000, " .\n"), ("en", 1, " "), (None, 500, " ,"))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    old = collocations.blocks.__defaults__
    collocations.blocks.__defaults__ = (40,)
    try:
        total = Counter()
        for held in collocations.gather(iter([batch]), size, 300):
            full = np.full(1 << (collocations.LEAST_BITS - 3), 255, np.uint8)
            for lang, phrase, n in zip(*(c.to_pylist() for c in collocations.grams(held, size, full).columns)):
                total[lang, phrase] += n
    finally:
        collocations.blocks.__defaults__ = old
    want = {k: n for k, n in counted(rows, size).items() if k[1].count(" ") == size - 1}
    assert {k: n for k, n in total.items() if k[1]} == want


def test_distinct_rows_of_large_numbers():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 20, 5000) for _ in range(4)]
    columns = [np.r_[c, c[:1000]] for c in columns]
    (a, b, c, d), n = collocations.distinct(columns)
    assert Counter(zip(*columns)) == dict(zip(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()), n.tolist()))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    documents = spark.createDataFrame([("en", made(rng, 300)) for _ in range(30)], "lang string, text string")
    rows = lambda: sorted(map(tuple, collocations.collocations(documents)[0].collect()))
    want = rows()
    full = spark.sparkContext.broadcast(np.full(1 << (collocations.LEAST_BITS - 3), 255, np.uint8))
    monkeypatch.setattr(full, "unpersist", lambda: None)
    monkeypatch.setattr(collocations, "broadcast_grams", lambda known: full)
    assert rows() == want and want


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    tables = iter([[("en", "", big * 9), ("en", "a", big), ("en", "b", big + 1)], [("en", "a b", big - 7)]])
    monkeypatch.setattr(collocations, "level", lambda *a: spark.createDataFrame(next(tables), collocations.COUNTS))
    row = collocations.collocations(spark.createDataFrame([], "lang string, text string"), 2)[0].first()
    assert row["score"] == 1000000 * (big - 7) ** 2 // (big * (big + 1))


def test_the_first_of_a_language(spark):
    rows = [("en", f"p {i}", 10 + i % 3, 1, 1, i % 5) for i in range(300)] + [("de", "é x", 1, 1, 1, 1), ("de", "z x", 1, 1, 1, 1)]
    got = collocations.best(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long"), 40).collect()
    order = lambda lang: [r[1] for r in sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1].encode()))][:40]
    for lang in ("en", "de"):
        assert [r["phrase"] for r in sorted(got, key=lambda r: r["rank"]) if r["lang"] == lang] == order(lang)


def test_op11_of_all_sizes(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.execute(collocations.SQL_OP11)
    names = [d[0] for d in want.description]
    rows = lambda cursor: sorted(tuple(map(plain, r)) for r in cursor)
    assert rows(collocations.op11_collocations(spark, sf).select(*names).collect()) == rows(want.fetchall())


def test_terms_of_a_text():
    reader, cell = quality.Reader(), quality.Cells
    words, shapes = cell(quality.WORDS, 0), cell(quality.SHAPES, quality.WORDS)
    of = lambda table, w: int(table.of[table[w]])
    terms, n = reader.counts("The THE the... x1 É\t|".encode())
    want = Counter({of(words, b"the"): 2, of(words, b"the..."): 1, of(words, b"x1"): 1, of(words, "É".encode()): 1, of(words, b"|"): 1})
    want += Counter({of(shapes, b"Aa"): 1, of(shapes, b"A"): 1, of(shapes, b"a."): 1, of(shapes, b"a0"): 1, of(shapes, b"a"): 1, of(shapes, b"|"): 1, reader.repeat: 1})
    assert dict(zip(terms.tolist(), n.tolist())) == want
    assert [len(x) for x in reader.counts(None)] == [0, 0] == [len(x) for x in reader.counts(b" \n")]
    text = "ab ab Cd! " * 200
    whole = reader.counts(text.encode())
    old = quality.blocks.__defaults__
    quality.blocks.__defaults__ = (50,)
    try:
        parts = quality.Reader().counts(text.encode())
    finally:
        quality.blocks.__defaults__ = old
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_quality_by_plain_neighbours(spark, sf):
    """Document frequencies, weights, singular vectors, cosines and votes in dense arithmetic."""
    documents, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, sf).collect()}
    rows, reader = documents.select("doc_id", "text").collect(), quality.Reader()
    x = np.zeros((len(rows), quality.TERMS))
    for i, r in enumerate(rows):
        terms, n = reader.counts((r["text"] or "").encode())
        x[i, terms] = n
    weigh = np.log((1 + len(rows)) / (1 + (x > 0).sum(0)))
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * weigh
    for part, w in ((x[:, : quality.WORDS], quality.WORD_WEIGHT), (x[:, quality.WORDS :], 1)):
        part *= w / np.maximum(np.sqrt((part**2).sum(1, keepdims=True)), 1e-12)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if not held(r["doc_id"])}
    at = [i for i, r in enumerate(rows) if r["doc_id"] in own]
    y = np.array([own[rows[i]["doc_id"]] for i in at])
    _, s, v = np.linalg.svd(x[at], full_matrices=False)
    z = x @ v[: quality.DIRECTIONS].T
    z /= np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-12)
    near = z @ z[at].T
    far = 0
    for i, r in enumerate(rows):
        kth = np.sort(near[i])[-quality.NEAREST]
        use = near[i] >= max(kth - 1e-9, 1e-6)
        w = near[i][use] ** quality.POWER
        far += abs(got[r["doc_id"]]["score"] - w @ y[use] / w.sum()) > 0.02
        assert got[r["doc_id"]]["held_out"] == held(r["doc_id"]) and got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)
    assert far <= 0.02 * len(rows)  # neighbours that are as near to within a step


def test_quality_of_labels_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, sf).collect()}
    rows = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in common.table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_voters_are_bounded(spark, sf):
    documents, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    doubled = documents.unionByName(documents)
    model = quality.fit(doubled, labels, voters=20, basis=10)
    assert len(model.labels) == 20 and model.places.shape[1] <= 10
    assert quality.fit(documents, labels.limit(0)).vote(np.zeros((2, 1), np.float32)).tolist() == [0.5, 0.5]


def test_nearest_voters():
    rng = np.random.default_rng(2)
    for n in (1, 3, 8, 9, 300, 3000):
        p = rng.normal(size=(n, 6)).astype(np.float32)
        p /= np.sqrt((p**2).sum(1, keepdims=True))
        p[: n // 3] = p[0]
        y = rng.random(n)
        q = np.vstack([p[:3], rng.normal(size=(20, 6)), np.zeros((1, 6))]).astype(np.float32)
        voters = quality.Voters(None, p, y)
        for score, near in zip(voters.vote(q), np.rint((q @ p.T) * quality.STEPS)):
            use = near >= max(np.sort(near)[-min(quality.NEAREST, n)], 1)
            w = (near[use] / 65536.0) ** quality.POWER
            assert math.isclose(score, w @ y[use] / w.sum() if w.sum() > 0 else y.mean(), rel_tol=1e-9)
