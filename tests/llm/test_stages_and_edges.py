"""Every dealt operator and every stage on awkward tables: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from chunkwell.llm import bpe, chat, collocations, common, embedding_dedup, fingerprint, licenses, line_dedup, mixing, quality, registry, simhash_dedup, toxicity, url_filters

LONG = "alpha beta gamma delta " * 20000
ROWS = [
    (1, "the first line is a longer one\nshort\nthe first line is a longer one", "en", "a", 10, "x"),
    (2, None, "en", "a", None, None),
    (3, "", None, None, 0, "x"),
    (4, " \n\t\n ", "de", "b", 5, "x"),
    (5, "The First Line Is A Longer One  \nother words stay here", "en", "b", 30, "x"),
    (6, "   the first line is a longer one\nÄÖ é 日本 😀", "en", None, 30, "x"),
    (6, "   the first line is a longer one\nÄÖ é 日本 😀", "en", None, 30, "x"),
    (None, "a row without an id\nthe first line is a longer one", "en", "a", 20, "x"),
    (7, LONG, "en", "c", len(LONG), "x"),
    (8, LONG, "en", "c", len(LONG), "x"),
    (9, "one", "en", "c", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string"


def save(spark, folder, **tables):
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def odd(spark, tmp_path):
    documents = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("score", "fold", "rows", "block", "rank", "key", "row", "size"):
        documents = documents.selectExpr("*", f"'{clash}' as {clash}")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (9, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7x?q#f", "h"), (2, None, None), (None, "no scheme", "h"), (3, "x://", "h"), (3, "x://", "h"), (4, "http://www.spam-farm.example.net?x", "h"), (5, "http://ÄA.org/es/", "h")], "page_id long, url string, html string")
    v = [1.0] + [0.0] * 3
    embeddings = spark.createDataFrame([(1, v, 0), (2, v, 0), (3, None, 0), (4, [0.0] * 4, 0), (5, [float("nan")] + [0.0] * 3, 0), (6, [None, 1.0, 0.0, 0.0], 0), (7, [1.0, 0.1, 0.0, 0.0], 1), (8, [1.0], 1), (9, [], 1), (None, v, None), (2, v, 0)], "vec_id long, embedding array<float>, label int")
    talks = spark.createDataFrame([(1, 0, "user", "hello?"), (1, 1, "assistant", None), (1, None, "user", ""), (None, 0, None, "x"), (2, 0, "user", "a\n\nb"), (2, 0, "user", "a\n\nb"), (2, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    return save(spark, tmp_path, documents=documents, labels=labels, pages=pages, embeddings=embeddings, conversations=talks)


@pytest.fixture
def empty(spark, tmp_path):
    schemas = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
    return save(spark, tmp_path, **{n: spark.createDataFrame([], s) for n, s in schemas.items()})


@pytest.mark.parametrize("name", list(registry.queries()))
def test_odd_rows(spark, odd, name):
    got = registry.queries()[name](spark, odd).collect()
    assert len(got) == {"op1_url_filters": 7, "op2_chat": 7, "op6_embedding_dedup": 11, "op11_collocations": 4}.get(name, len(ROWS))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


STAGES = (toxicity.toxicity_stage, line_dedup.line_dedup_stage, simhash_dedup.simhash_stage, mixing.mix_stage)


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns(spark, odd, empty, stage):
    for folder in (odd, empty):
        documents = common.table(spark, folder, "documents")
        out = stage(spark, documents, folder)
        assert out.columns == documents.columns
        assert out.dtypes == documents.dtypes
        assert len(out.collect()) == 0 or folder == odd


def test_url_rows(spark, odd):
    got = {r["page_id"]: r for r in url_filters.op1_url_filters(spark, odd).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("", "", None, "allow")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.spam-farm.example.net", "", None, "block")
    assert (got[5]["host"], got[5]["rule"], got[5]["verdict"]) == ("Äa.org", "org/es/", "block")


def test_embedding_rows(spark, odd):
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op6_embedding_dedup(spark, odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 4, 1, False), (8, 0, 8, True), (9, 0, 9, True), (None, 4, 1, False)], key=str)


def test_line_rows(spark, odd):
    got = {r["doc_id"]: r for r in line_dedup.op10_line_dedup(spark, odd).collect()}
    assert (got[1]["n_lines"], got[1]["n_dropped"]) == (3, 2) and got[1]["kept_sha256"] == hashlib.sha256(b"short").hexdigest()
    assert (got[2]["n_lines"], got[2]["n_dropped"]) == (1, 0) and got[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["n_dropped"] == 0 and got[5]["n_dropped"] == 1 and got[None]["n_dropped"] == 1


def test_simhash_stage_keeps_one(spark, odd):
    documents = common.table(spark, odd, "documents")
    kept = sorted(r["doc_id"] for r in simhash_dedup.simhash_stage(spark, documents, odd).filter("doc_id is not null").collect())
    assert kept == [1, 2, 5, 6, 7, 9]  # 2, 3 and 4 have no words, 7 and 8 are copies


def test_scores_without_a_class(spark, odd):
    rows = toxicity.op3_toxicity(spark, odd).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]


def test_collocation_rows(spark, odd):
    rows = sorted(collocations.op11_collocations(spark, odd).collect(), key=lambda r: r["rank"])
    #: the long text goes on over many blocks
    assert [(r["lang"], r["rank"]) for r in rows] == [("en", i) for i in (1, 2, 3, 4)]
    assert {r["phrase"]: r["a"] for r in rows} == {"alpha beta gamma": 40000, "beta gamma delta": 40000, "gamma delta alpha": 39998, "delta alpha beta": 39998}
    words = sum(len(t.split()) for _, t, lang, *_ in ROWS if t and lang == "en")
    assert all(r["n"] == words for r in rows)


def test_quality_rows(spark, odd):
    rows = quality.op12_quality(spark, odd).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    #: 5 is held out by its id or not; those without words have the voters' mean
    mean = quality.fit(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet")).rest
    assert got[2] == got[3] == got[4] == mean and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False] and len({r["score"] for r in rows if r["doc_id"] == 6}) == 1


def test_many_rows_without_an_id(spark, tmp_path):
    """Each of many rows loses one line of its own: so many digests in all, not a list of all of them for each."""
    n = 20_000
    rows = spark.range(n).selectExpr("cast(null as bigint) as doc_id", "concat('a line that is long enough ', id, '\\n', id) as text")
    others = spark.range(2 * n).selectExpr("id as doc_id", "concat('a line that is long enough ', id div 2) as text")
    documents = rows.unionByName(others).repartition(8)
    lost = line_dedup.drops(documents)
    assert sorted(map(tuple, lost.groupBy(lost.doc_id.isNull()).agg(F.count("*"), F.max(F.size("gone"))).collect())) == [(False, n, 1), (True, n, 1)]
    save(spark, tmp_path, documents=documents)
    got = line_dedup.op10_line_dedup(spark, str(tmp_path))
    assert got.filter("doc_id is null and n_lines = 2 and n_dropped = 1").count() == n
    assert got.filter("doc_id % 2 = 1 and n_dropped = 0").count() == n and got.filter("doc_id % 2 = 0 and n_dropped = 1").count() == n
    staged = line_dedup.line_dedup_stage(spark, documents, "")
    assert staged.filter("doc_id is null and not text like 'a line%'").count() == n


def test_mixing_rows(spark, odd):
    rows = mixing.op4_mixing(spark, odd).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    sizes = {1: 15, 2: 0, 3: 0, 4: 0, 5: 11, 6: 11, 7: 80000, 8: 80000, 9: 1}
    assert {i: r["size"] for i, r in got.items()} == sizes and sorted(r["doc_id"] == 6 for r in rows).count(True) == 2
    assert {i: r["source_size"] for i, r in got.items()} == {1: 27, 2: 27, 3: 22, 4: 11, 5: 11, 6: 22, 7: 160001, 8: 160001, 9: 160001}
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    #: the shares of a (3 of 9), b (1), c (2) and null (3) go to the one large source, up to twice its size
    assert [got[i]["target"] for i in (1, 5, 3)] == [54.0, 22.0, 44.0] and abs(got[7]["target"] - (1.5 * 160061 - 120)) < 1e-6


def test_fingerprint_rows(spark, odd):
    rows = fingerprint.op7_fingerprints(spark, odd).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[9]["edited_sha256"] == sha("onea"[:2] + LONG[:1]) and got[2]["edited_sha256"] == sha("") and got[2]["near_edited"] == 1.0
    assert got[8]["edited_sha256"] == sha(LONG[: len(LONG) // 2] + LONG[: len(LONG) // 2]) and got[8]["near_next"] == 1.0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 6}) == 1 and [r["n_chars"] for r in rows if r["doc_id"] is None] == [len(ROWS[7][1])]
    last = next(r for r in rows if r["doc_id"] is None)  # after it comes the first, 9
    assert last["edited_sha256"] == sha(ROWS[7][1][: len(ROWS[7][1]) - len(ROWS[7][1]) // 2] + "one")


def test_chat_rows(spark, odd):
    rows = chat.op2_chat(spark, odd).collect()
    alone = [r for r in rows if r["conv_id"] is None]
    assert len(alone) == 1 and alone[0]["rendered"].endswith("x\n<|end|>\n") and alone[0]["n_turns"] == 1
    assert sorted(len(r["line_roles"].split(",")) for r in rows if r["conv_id"] == 2 and r["turn"] == 0) == [3, 3]
    assert sum(r["rendered"].count("<|end|>") for r in rows if r["conv_id"] == 1) == sum(r["n_turns"] for r in rows if r["conv_id"] == 1)


def test_licence_rows(spark, odd):
    rows = licenses.op5_licenses(spark, odd).collect()
    assert all((r["own_licence"], r["own_score"], r["licence"], r["inherited_from"]) == (None, 0.0, None, None) for r in rows)


def test_licences_among_odd_rows(spark, odd, tmp_path):
    """Licence files of repeated ids, a licence at the end of a very long text and in a row without an id, and null texts below a licence file."""
    more = [(10, "Released under the MIT License.", "en", "a"), (20, "Licensed under the Apache License, Version 2.0.", "en", "b"), (20, "SPDX-License-Identifier: GPL-3.0-or-later", "en", "b"), (31, LONG + "\nSPDX-License-Identifier: MIT", "en", "c"), (None, "All rights reserved.", "en", "a"), (32, "ALL\tRIGHTS\u00a0\nReserved", None, None)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    folder = save(spark, tmp_path / "more", documents=spark.read.parquet(f"{odd}/documents.parquet").unionByName(extra, allowMissingColumns=True))
    rows = licenses.op5_licenses(spark, folder).collect()
    got = {(r["doc_id"], r["own_licence"], r["licence"], r["inherited_from"]) for r in rows}
    a, b = "a/k0/c0", "b/k0/c0"
    assert len(rows) == len(ROWS) + len(more)
    assert got == {
        (1, None, "MIT", a), (2, None, "MIT", a), (3, None, None, None), (4, None, "Apache-2.0", b), (5, None, "Apache-2.0", b), (6, None, None, None), (7, None, None, None), (8, None, None, None), (9, None, None, None), (None, None, None, None),
        (10, "MIT", "MIT", None), (20, "Apache-2.0", "Apache-2.0", None), (20, "GPL-3.0", "GPL-3.0", None), (31, "MIT", "MIT", None), (None, "proprietary", "proprietary", None), (32, "proprietary", "proprietary", None),
    }


def test_simhash_of_odd_rows(spark, odd):
    """Fingerprints of null, empty and very long texts, and classes of rows that repeat an id or have none, against plain Python."""

    def fingerprint_of(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = Counter(" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))) if words else Counter()
        ones = np.zeros(64, np.int64)
        for text, n in shingles.items():
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            ones += n * np.array([h >> k & 1 for k in range(64)])
        return sum(1 << k for k in range(64) if 2 * int(ones[k]) > sum(shingles.values()))

    prints = [(i, fingerprint_of(t)) for i, t, *_ in ROWS]
    rows = simhash_dedup.op9_simhash_dedup(spark, odd).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((i, f"{p:016x}") for i, p in prints)
    reach = {p: {p} for _, p in prints}
    for _ in prints:
        reach = {p: {q for x in near for q in reach if (x ^ q).bit_count() <= 2} for p, near in reach.items()}
    for r in rows:
        ids = [i for i, p in prints if p in reach[int(r["fingerprint"], 16)] and i is not None]
        assert r["component_id"] == min(ids, default=None)
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2} and {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}


def test_bpe_of_odd_rows(spark, odd):
    """Digests of null, empty, blank and very long texts, as the library gives them."""
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))] += 1
    got = bpe.op8_bpe(spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want and sum(n for (i, size, *_), n in want.items() if size == 0) >= 2


def test_licence_file_gives_to_its_directory(spark):
    files = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x"), (3, "a/b/d.py", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode"), (4, "z/e.py", "mit mit"), (5, None, None), (6, "a/b/COPYING.txt", "Licensed under CC BY 4.0."), (7, "a/x/y.py", "")], "id long, path string, text string")
    got = {r["id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licenses.scan(files).collect()}
    assert got[1][1] == "MIT" and got[2] == (None, "CC-BY-4.0", "a/b") and got[3][:2] == ("GPL-3.0", "GPL-3.0")
    assert got[4] == (None, None, None) and got[5] == (None, None, None) and got[7] == (None, "MIT", "a")


def test_no_line_without_key_term_is_near():
    m = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "license": 3, "under": 500}, 1000)
    for _, text in licenses.TEMPLATES:
        words = [w for w in licenses.terms(text) if w not in m.keys]
        assert not m.candidates(" ".join(words))
        assert m.choose(m.candidates(text), {})[0] > 0.999


def test_bpe_names_are_decoded(spark, odd):
    full = {r["doc_id"]: r for r in bpe.encode_documents(common.table(spark, odd, "documents"), full=True).filter("doc_id = 9").collect()}
    assert full[9]["n_tokens"] == 1 and full[9]["decoded"] == "one</w>"


def test_chat_renders_all_lines(spark, odd):
    rows = chat.op2_chat(spark, odd).filter("conv_id = 2").collect()
    text = "".join(r["rendered"] for r in rows)
    assert text.count("<|end|>") >= 1 and "alpha beta" in text


def test_fingerprint_of_no_words(spark, odd):
    rows = {r["doc_id"]: r for r in fingerprint.op7_fingerprints(spark, odd).collect()}
    assert rows[2]["fingerprint"] == "0" * 16 and rows[2]["n_chars"] == 0
    assert rows[7]["fingerprint"] == rows[8]["fingerprint"]


def test_simhash_stage_drops_near_copies(spark, tmp_path):
    """Pairs from 0.8 on go, those below stay, whatever their fingerprints' bits."""
    import random

    rng = random.Random(3)
    rows, near = [], 0
    for i in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(120)]
        copy = list(text)
        for at in rng.sample(range(10, 110), i % 8):
            copy[at] = "changed"
        a, b = (set(zip(*(t[k:] for k in range(5)))) for t in (text, copy))
        gone = len(a & b) >= 0.8 * len(a | b)
        near += gone and text != copy
        rows += [(2 * i, " ".join(text), not gone), (2 * i + 1, " ".join(copy), not gone)]
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash_dedup.simhash_stage(spark, documents, str(tmp_path)).collect())
    assert near >= 10 and kept == [i for i, _, alone in rows if i % 2 == 0 or alone]


def test_simhash_stage_takes_what_fingerprints_link(spark):
    """What repeats in a text outweighs the rest in its fingerprint: such texts share a cell, which they do not by bands of their sets of shingles."""
    base = " ".join(["alpha beta gamma delta epsilon"] * 400)
    texts = [base, base + " " + " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(200))]
    a, b = (simhash_dedup.fingerprint(t) for t in texts[:2])
    hashes = [simhash_dedup.bands(simhash_dedup.shingles(t, simhash_dedup.STAGE_SHINGLE)) for t in texts[:2]]
    assert (a ^ b).bit_count() <= simhash_dedup.THRESHOLD and not (hashes[0] == hashes[1]).any()
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    cells = {r["key"]: r["band"] for r in simhash_dedup.fingerprint_cells(rows).collect()}
    assert cells[0] == cells[1] != cells[2]
    plan = simhash_dedup.jaccard_links(rows)
    assert plan.collect() == []  # none is similar by its set


def test_set_links_connect_all_similar_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(100) < 0.95], rng.integers(0, 1 << 60, 4, dtype=np.uint64)]) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 60, 1, dtype=np.uint64)) for _ in range(3)]
    want, got = list(range(len(sets))), list(range(len(sets)))
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    for up, links in ((want, [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]), (got, simhash_dedup.set_links(sets, 0.8))):
        for a, b in links:
            up[:] = [up[b] if x == up[a] else x for x in up]
    assert len({*zip(want, got)}) == len({*want}) == len({*got}) < len(sets)


def test_simhash_stage_keeps_unlike_texts_of_one_id(spark, tmp_path):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"]), (1, text["c"]), (2, text["d"]), (2, text["e"]), (3, text["e"]), (3, text["f"]), (3, text["f"]), (1, text["d"]), (None, text["g"]), (None, text["g"])]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"][0]) for r in simhash_dedup.simhash_stage(spark, documents, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "e"), (3, "f"), (None, "g")], key=str)


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("Copyright (c) 2024 The Foo Authors. All rights reserved.", "proprietary"),
        ("Licensed under the MIT License. See LICENSE in the project root for license information.", "MIT"),
        ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3", "GPL-3.0"),
        ("/* Licensed under the Apache\n * License, Version 2.0. */ int main() { return 0; }", "Apache-2.0"),
        ("Copyright Foo. All rights reserved. Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "BSD-3-Clause"),
        ("all the words of an ordinary line with rights and a license, and no more", None),
    ],
)
def test_licence_sentences_within_lines_and_wrapped(text, licence):
    m = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "under": 500, "all": 400, "license": 30, "licensed": 25, "rights": 20, "reserved": 20, "mit": 15}, 1000)
    assert m.choose(m.candidates(text), {})[1] == licence
