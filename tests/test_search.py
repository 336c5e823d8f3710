"""The four searches on small fixtures of their own."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkwell.operators import fulltext as ft
from chunkwell.operators import graph as gr
from chunkwell.operators import match
from chunkwell.operators import tables as tb
from chunkwell.operators import tagging as tg
from chunkwell.operators import vectors as vs
from chunkwell.schema import CHUNK


def chunk(**given):
    return tuple({**{f.name: None for f in CHUNK}, "doc_title": "T", "category": "wiki", "reliability_tier": "reference", "chunk_type": "text", "entities": [], **given}[f.name] for f in CHUNK)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        chunk(id="1", text="The Salt Gate stands by the river.", section="Places", entities=["Salt Gate", "Marn"]),
        chunk(id="2", chunk_type="table", table=[["Height", "forty cubits"], ["Builder", "Orrin Vale"]]),
        chunk(id="3", text="Marn was seen at the Salt Gate twice."),
        chunk(id="4"),
    ]
    return ft.index_text(spark.createDataFrame(rows, CHUNK))


def found(spark, texts, query, limit=5):
    return [r["id"] for r in ft.search(texts, query, limit).orderBy("rank").collect()]


def test_keyword(spark, texts):
    assert texts.count() == 3
    assert found(spark, texts, "Orrin Vale") == ["2"] and found(spark, texts, "cubits") == ["2"]
    assert sorted(found(spark, texts, "salt gate")) == ["1", "3"] and len(found(spark, texts, "salt gate", 1)) == 1
    assert found(spark, texts, "zzz-qqq") == [] and found(spark, texts, "gate", 0) == []
    assert found(spark, texts, '"gate twice"') == ["3"] and found(spark, texts, "gate -twice") == ["1"] and found(spark, texts, "rivre~2") == ["1"]
    scores = ft.bm25(texts, spark.createDataFrame([(0, "river")], "qid int, query string")).collect()
    assert scores[0]["score"] > 0


T = [
    (1, "a1", "table", "Grey Tower", "Atlas", [["Attribute", "Value"], ["Height", "9"], ["Owner", "Ivo"], ["Age", "80"], ["Roof", "lead"]]),
    (2, "a2", "table", "Grey Tower", "Atlas", [["Stairs", "211"], ["Doors", "3"], ["one cell"]]),
    (3, "a3", "table", "Registry: someone", "R", [["Name", "Ada Quill"], ["Rank", "scribe"], ["Born", "12", "extra"]]),
    (4, "a4", "table", "Infobox", "Ada Quill", [["Rank", "warden"], ["", "blank label"]]),
    (5, "a5", "table", "Bone Horn", "Relics", [["Name", "Bone Horn"], ["Held by", "Ivo"]]),
    (6, "a6", "table", "Bone Horn", "Relics", [["Held by", "Ivo"], ["Last Holder", "Marn"]]),
    (7, "a7", "text", "Prose Only", "P", None),
    (8, "a8", "table", "Empty Hall", "E", [["lonely"]]),
]


@pytest.fixture(scope="module")
def tables(spark):
    frame = spark.createDataFrame(T, "ord int, id string, chunk_type string, section string, doc_title string, table array<array<string>>")
    return tb.table_chunks(frame).cache()


@pytest.mark.parametrize("entity, attribute, n", [
    ("grey tower", "HEIGHT", 1), ("Grey Tower", "", 7), ("Ada Quill", "rank", 2), ("Ada Quill", "", 5), ("Quill", "Born", 1), ("Bone Horn", "Held By", 2),
    ("bone horn", "by", 2), ("bone horn", "holder", 1), ("Prose Only", "", 0), ("nobody", "", 0), ("Empty Hall", "", 0),
])
def test_table_lookup(spark, tables, entity, attribute, n):
    asked = spark.createDataFrame([(1, entity, attribute)], "qid int, entity string, attribute string")
    assert tb.lookup(tables, asked).count() == n


def test_lookup_of_a_batch_is_that_of_each(spark, tables):
    asked = [(1, "Ada Quill", "rank"), (2, "tower", "height"), (3, "", ""), (4, "Ada Quill", "  ")]
    both = tb.lookup(tables, spark.createDataFrame(asked, "qid int, entity string, attribute string")).collect()
    for a in asked:
        alone = tb.lookup(tables, spark.createDataFrame([a], "qid int, entity string, attribute string")).collect()
        assert sorted(map(str, alone)) == sorted(str(r) for r in both if r["qid"] == a[0])
    assert {r["value"] for r in both if r["qid"] == 4} == {"blank label"}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(1, "c1", ["Ada", "Bren"]), (2, "c2", ["ada", "Bren"]), (3, "c3", ["Ada", "Bren", "Cato"]), (4, "c4", ["Cato", "Dun"]), (5, "c5", ["Bren"]), (6, "c6", None), (7, "c7", ["Esk", "Fair Isle"])]
    frame = spark.createDataFrame(rows, "ord int, id string, entities array<string>")
    return gr.nodes(frame).cache(), gr.edges(frame).cache()


def follow(spark, graph, name, limit=5):
    asked = spark.createDataFrame([(1, name)], "qid int, entity string")
    return [(r["entity"], r["weight"], r["example_chunk_ids"]) for r in gr.follow(*graph, asked, limit).orderBy("rank").collect()]


def test_graph(spark, graph):
    assert graph[0].count() == 6
    assert follow(spark, graph, " BREN ") == [("Ada", 3, ["c1", "c2", "c3"]), ("Cato", 1, ["c3"])]
    assert follow(spark, graph, "bren", 1) == [("Ada", 3, ["c1", "c2", "c3"])] and len(follow(spark, graph, "bren", 0)) == 2
    assert follow(spark, graph, "isle") == [("Esk", 1, ["c7"])] and follow(spark, graph, "nobody") == []
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph[1].collect()}
    assert all(edges[b, a] == n for (a, b), n in edges.items()) and all(a != b for a, b in edges)


def test_citations_stop_at_ten(spark):
    frame = spark.createDataFrame([(i, f"c{i:02d}", ["A", "B"]) for i in range(25)], "ord int, id string, entities array<string>")
    edge = gr.edges(frame).first()
    assert edge["weight"] == 25 and [c["id"] for c in edge["citations"]] == [f"c{i:02d}" for i in range(10)]


def test_vectors(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    found = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.2]), ("c", [0.0, 1.0]), ("gone", [1.0, 0.0])], "id string, embedding array<float>")
    store = vs.store(chunks, found)
    query = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query array<float>")
    assert [r["id"] for r in vs.search(store, query, 0).orderBy("rank").collect()] == ["a", "b", "c"]
    assert vs.search(store, query, 2).count() == 2
    texts = spark.createDataFrame([("a", "xx"), ("b", "")], "id string, text string")
    assert [(r["id"], r["embedding"]) for r in vs.embed(texts, lambda ts: [[float(len(t)), 0.5] for t in ts]).collect()] == [("a", [2.0, 0.5])]
    with pytest.raises(Exception, match="vectors for"):
        vs.embed(texts, lambda ts: []).collect()


def test_tagging(spark):
    names = spark.createDataFrame([("Salt Gate",), ("Gate",), ("é",), ("a.b",), ("+",), ("\\E x",)], "name string")
    texts = spark.createDataFrame([("1", "the SALT gate; été"), ("2", "Salt gates a.b + c"), ("3", "axb é."), ("4", None), ("5", "\\E x")], "id string, text string")
    got = {(r["id"], r["name"]) for r in tg.tag(texts, names).collect()}
    assert got == {("1", "Salt Gate"), ("1", "Gate"), ("2", "a.b"), ("2", "+"), ("3", "é"), ("5", "\\E x")}
    many = spark.createDataFrame([(f"n{i}" + "x" * (i % 3),) for i in range(40)], "name string")
    text = spark.createDataFrame([("1", " ".join(f"n{i}" + "x" * (i % 3) for i in range(40)))], "id string, text string")
    rows = tg.tag(text, many).orderBy("rank").collect()
    assert len(rows) == 25 and [len(r["name"]) for r in rows] == sorted((len(r["name"]) for r in rows), reverse=True)
    tagged = tg.with_entities(spark.createDataFrame([chunk(id="1", text="Salt Gate")], CHUNK), names, F.col("text")).first()
    assert tagged["entities"] == ["Salt Gate", "Gate"]


def phrase(name):
    """The rule of a whole phrase as a pattern."""
    return re.compile(r"(?<!\w)" + re.escape(name) + r"(?!\w)", re.IGNORECASE)


def test_tagging_equals_the_pattern(spark, monkeypatch):
    """Random texts and names of few letters, with marks, other cases, nested and repeated names; whole and in parts; short and long texts."""
    rng = random.Random(5)
    alphabet = "aAbBéÉßſsKk_1٣ .-+\\\n𝒳İıΣςσ"
    word = lambda low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    names = sorted({word(1, 4) for _ in range(150)} | {"ab", "AB", "a", "a b", "\\E", "b\\E."})
    texts = [(i, word(0, 60) if i % 10 else None) for i in range(400)] + [(400, "ab " * 5000 + "a b"), (401, "")]
    frame = spark.createDataFrame(texts, "id int, text string")
    vocabulary = spark.createDataFrame([(n,) for n in [*names, "", None, "ab"]], "name string")
    odd = "İ"  # a letter whose lower case is two
    plain = lambda n, t: odd not in n + (t or "")
    text_of = dict(texts)
    want = {(i, n) for n in names for i, t in texts if t and plain(n, t) and phrase(n).search(t)}
    found = tg.matches(frame, vocabulary)
    rows = [(r["id"], r["name"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and {r for r in rows if plain(r[1], text_of[r[0]])} == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLike" not in plan and "Join" not in plan
    whole = {(r["id"], r["rank"], r["name"]) for r in tg.tag(frame, vocabulary, 3).collect()}
    monkeypatch.setattr(tg, "MOST_LETTERS", 100)
    monkeypatch.setattr(tg, "WALKED", 50)
    assert len(tg.finders(vocabulary)) > 2
    assert {(r["id"], r["name"]) for r in tg.matches(frame, vocabulary).collect()} == set(rows)
    assert {(r["id"], r["rank"], r["name"]) for r in tg.tag(frame, vocabulary, 3).collect()} == whole
    nothing = vocabulary.limit(0)
    assert tg.matches(frame, nothing).count() == tg.tag(frame, nothing).count() == 0
    assert tg.with_entities(spark.createDataFrame([chunk(id="1", text="x")], CHUNK), nothing, F.col("text")).first()["entities"] == []


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [
        chunk(id="1", text="The Salt Gate stands by the river.", section="Places", entities=["Salt Gate", "Marn"]),
        chunk(id="2", chunk_type="table", table=[["Height", "forty cubits"], ["Builder", "Orrin Vale"]]),
        chunk(id="3", text="Marn was seen at the Salt Gate twice."),
        chunk(id="4"),
    ]
    return ft.build_index(ft.field_texts(spark.createDataFrame(rows, CHUNK))).save(str(tmp_path_factory.mktemp("index")))


def test_saved_index(spark, index):
    assert index.size() == 3
    assert found(spark, index, "Orrin Vale") == ["2"] and found(spark, index, "zzz-qqq") == [] and found(spark, index, "gate", 0) == []
    assert found(spark, index, '"gate twice"') == ["3"] and found(spark, index, "gate -twice") == ["1"] and found(spark, index, "rivre~2") == ["1"]
    assert found(spark, index, 'section:places') == ["1"] and found(spark, index, "Entities:marn") == ["1"] and found(spark, index, "+marn +twice") == ["3"]
    assert found(spark, index, "nofield:cubits") == ["2"] and found(spark, index, '-"salt gate" cubits') == ["2"] and found(spark, index, "-marn") == []
    assert found(spark, index, "river twice^9")[0] == "3" and found(spark, index, "river^9 twice")[0] == "1" and found(spark, index, "-rivre~2 gate") == ["3"]


def test_a_search_reads_the_folders_of_its_terms(spark, index):
    asked = spark.createDataFrame([(0, "cubits")], "qid int, query string")
    plan = ft.bm25(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan or "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ft.bm25(index, asked).first()["id"] == "2"


def test_texts_and_index_give_the_same(spark, sf):
    from chunkwell.queries import chunk_texts, t

    texts, asked = chunk_texts(spark, sf), t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(ft.bm25(texts, asked).select("qid", "id", "rank", "score")) == rows(ft.bm25(ft.build_index(texts), asked).select("qid", "id", "rank", "score"))


def test_all_near_terms_count(spark):
    """Over a hundred terms within one edit."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    near = {"stone"[:i] + c + "stone"[i + 1 :] for i in range(5) for c in letters} | {"stone"[:i] + c + "stone"[i:] for i in range(6) for c in letters} | {"tone", "sone", "stne", "stoe", "ston"}
    rows = [(w, w) for w in sorted(near)] + [("far", "stbbbe"), ("two", "stonexx"), ("far2", "xtine")]
    texts = spark.createDataFrame(rows, "id string, text string")
    assert len(near) > 150 and {r["id"] for r in ft.search(texts, "stone~1", None).collect()} == near
    one = spark.createDataFrame([(0, "stone"), (1, "x")], "qid int, query string")
    assert near == {r["id"] for r in ft.fuzzy(texts, one).filter("qid = 0").collect()}
    for query in ("stone~3", "a b~17"):
        with pytest.raises(Exception, match="too many edits"):
            ft.search(texts, query).collect()
    with pytest.raises(ValueError, match="3 edits"):
        ft.fuzzy(texts, one, 3)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_near_terms_by_brute_force(spark, edits):
    rng = random.Random(edits)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 8))) for _ in range(500)} | {"a", "", "ab"}
    asked = [(i, q) for i, q in enumerate(sorted(words)[::25] + ["zzzz", "", "abcdefghijkl"])]
    terms, queries = spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame(asked, "qid int, q string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((i, w) for i, q in asked for w in words if distance(q, w) <= edits)
    assert sorted(map(tuple, ft.near_terms(terms, queries, edits).collect())) == want


def test_few_terms_are_compared(spark, sf):
    """Of the words of all documents; the plan has no loop over pairs."""
    from chunkwell.queries import doc_texts

    terms = ft.doc_freq(ft.postings(doc_texts(spark, sf))).select("term").cache()
    asked = spark.createDataFrame([(0, "worthles"), (1, "licens"), (2, "reserved")], "qid int, q string")
    for edits, most in ((1, 0.01), (2, 0.05)):
        compared = ft.compared_terms(terms, asked, edits)
        assert 0 < compared.count() < most * 3 * terms.count()
        assert "NestedLoop" not in compared._jdf.queryExecution().toString() and "Cartesian" not in compared._jdf.queryExecution().toString()


def test_partial_keys_by_brute_force(spark):
    """Requests that hold keys and are held by them, short and empty ones too; no loop over pairs."""
    rng = random.Random(5)
    keys = {"".join(rng.choice("ab cé") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"", "a", "key 3"}
    asked = [(i, "".join(rng.choice("ab cé") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(90, ""), (91, "key 3"), (92, "zzz"), (93, "zz key 3"), (94, "ey"), (95, None)]
    keyed, requests = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(asked, "qid int, want string")
    want = sorted((i, k) for i, w in asked if w is not None for k in ([w] if w in keys else [k for k in keys if k in w or w in k]))
    found = match.exact_or_partial(requests, match.build_keys(keyed))
    assert sorted(map(tuple, found.collect())) == want == sorted(map(tuple, match.exact_or_partial(requests, keyed).collect()))
    plan = match.partial(requests, match.build_keys(keyed))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_strings_at_once(spark, index):
    """Each string of a batch as if it were alone."""
    strings = ["Orrin Vale", '"gate twice"', "gate -twice", "rivre~2", "section:places", "+marn +twice", "nofield:cubits", '-"salt gate" cubits', "-marn", "river twice^9", "-rivre~2 gate", "", "+?", None, '"the the"', "gate gate^0.5", 'x:"salt gate"', '+entities:marn "salt gate"']
    both = ft.search_all(index, spark.createDataFrame(list(enumerate(strings)), "qid int, query string"), None).collect()
    for i, s in enumerate(strings):
        alone = [] if s is None else [(r["rank"], r["id"], r["score"]) for r in ft.search(index, s, None).collect()]
        assert sorted(alone) == sorted((r["rank"], r["id"], r["score"]) for r in both if r["qid"] == i)
    first = {i: [r["id"] for r in sorted(both, key=lambda r: r["rank"]) if r["qid"] == i] for i in range(len(strings))}
    assert first[0] == ["2"] and first[1] == ["3"] and first[2] == ["1"] and first[8] == [] == first[12] == first[14] and first[17] == ["1"]


def test_terms_reach_the_scan(spark, index):
    asked = spark.createDataFrame([(0, "cubits river")], "qid int, query string")
    plan = ft.bm25(index, asked)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "positions" in line and "PushedFilters" in line or "folder#" in line and "PushedFilters" in line)
    assert "In(term, [cubits,river])" in scan or "In(term, [river,cubits])" in scan


def test_best_blocks_are_enough(spark, sf, tmp_path):
    """The same hits and scores as of all postings, from under a fifth of the blocks that hold a word of the query; heads are read without texts."""
    from chunkwell.queries import chunk_texts

    made = ft.build_index(chunk_texts(spark, sf.replace("sf0.001", "sf0.01"))).save(str(tmp_path / "index"))
    strings = ["stupid clown worthless license", "licensed under the apache license", "worthless scum", "all rights reserved", "no such-words", "", "the the of"]
    asked = spark.createDataFrame(list(enumerate(strings)), "qid int, query string")
    rows = lambda frame: sorted(map(str, frame.select("qid", "rank", "id", "score").collect()))
    hits, told = ft.best_blocks(made, asked)
    assert rows(hits) == rows(ft.bm25(made, asked)) and len(rows(hits)) > 20
    blocks = told.cache()
    assert blocks.filter("read").count() < 0.2 * blocks.count()
    most = ft.best_blocks(made, asked, 100_000)[0]
    assert rows(most) == rows(ft.bm25(made, asked, 100_000))


def test_an_index_is_saved_of_one_pass_over_texts(spark, tmp_path, monkeypatch):
    """Texts are made once; each is in one block of a field, of a few texts, and a block's figures are those of its texts. All as of the postings themselves, in many files."""
    monkeypatch.setattr(ft, "FILE_WORDS", 1, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return None if i == 50 else "" if i % 9 == 8 else " ".join(f"Wo{(i * k) % 13} the" for k in range(i % 5 + 1))

    texts = spark.range(60, numPartitions=3).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "title").otherwise("all").alias("field"), F.udf(text, "string")("id").alias("text"))
    try:
        index = ft.build_index(texts).save(str(tmp_path / "index"))
        assert made.value == 60
        rows = lambda frame, *names: sorted(map(str, frame.select(*names).collect()))
        fresh = ft.build_index(texts)
        names = ["folder", "field", "term", "id", "dl", "tf", "positions"]
        assert rows(index.postings, *names) == rows(fresh.postings, *names) and index.postings.count() > 200
        assert rows(index.stats, "field", "n", "avgdl") == rows(fresh.stats, "field", "n", "avgdl") and rows(index.terms, "field", "term", "df") == rows(fresh.terms, "field", "term", "df")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks, mean = index.blocks.collect(), {r["field"]: r["avgdl"] for r in index.stats.collect()}
    assert all(1 <= b["n"] == len(b["texts"]) <= ft.BLOCK_TEXTS and abs(b["most"] - max(ft.share(x["tf"], x["dl"], mean[b["field"]]) for x in b["texts"])) < 1e-12 for b in blocks)
    assert len({(b["field"], x["id"], b["block"]) for b in blocks for x in b["texts"]}) == len({(b["field"], x["id"]) for b in blocks for x in b["texts"]})
    assert len({(b["field"], b["block"], b["term"]) for b in blocks}) == len(blocks) and max(b["n"] for b in blocks) > 1
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["blocks", "stats", "terms"]


def test_many_vectors_go_in_parts(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(40)], "id int, embedding array<float>")
    queries = vectors.selectExpr("id as qid", "embedding as query")
    rows = lambda most, limit: sorted(map(str, vs.search(vectors, queries, limit, most=most).select("qid", "id", "rank", "score").collect()))
    assert rows(10_000, 3) == rows(7, 3) and len(rows(7, 3)) == 120 and len(rows(7, 0)) == 1600
    assert vs.search(vectors, queries.filter("qid < 0")).count() == 0


def test_ties_of_a_batch_are_cut_by_id():
    rng = np.random.default_rng(4)
    for ids in (pa.array(rng.permutation(50)), pa.array([f"id{i}" for i in rng.permutation(50)])):
        scores = np.round(rng.random((50, 30)), 1)
        scores[:, 0] = 0.0
        kept = vs.first_rows(scores, ids, 4)
        for j in range(30):
            best = sorted(range(50), key=lambda i: (-scores[i, j], ids[i].as_py()))[:4]
            assert sorted(np.flatnonzero(kept[:, j]).tolist()) == sorted(best)


def test_vectors_are_kept(spark, tmp_path):
    """Each text is sent once, whatever run and whatever chunks it is of; a run that breaks leaves what it has."""
    sent = spark.sparkContext.accumulator(0)

    class Client:
        def __init__(self, fails=""):
            self.fails = fails

        def batch_embed(self, texts, side):
            if self.fails and any(self.fails in t for t in texts):
                raise OSError("gone")
            sent.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

    rows = [chunk(id=str(i), text=f"text {i % 20}" + "x" * (i % 20)) for i in range(40)] + [chunk(id="t", chunk_type="table", table=[["a", "b"]]), chunk(id="none", text="")]
    chunks = spark.createDataFrame(rows, CHUNK)
    run = lambda client=Client(), model="m/1": {r["id"]: r["embedding"] for r in vs.build_kept(chunks, client, str(tmp_path / "kept"), model, 3, 4).collect()}  # noqa: E731, B008
    with pytest.raises(Exception, match="gone"):
        run(Client("text 7x"))
    before = sent.value
    got = run()
    assert len(got) == 41 and got["3"] == got["23"] == [9.0, 1.0] and 0 < before < 21 and sent.value < before + 21
    n = sent.value
    assert run() == got and sent.value == n and run(model="m/2") == got and sent.value == n + 21


def test_chunks_of_hits(spark, texts):
    hits = ft.bm25(texts, spark.createDataFrame([(0, "river")], "qid int, query string"))
    chunks = spark.createDataFrame([chunk(id="1", text="whole"), chunk(id="9", text="other")], CHUNK)
    assert [(r["id"], r["text"], r["rank"]) for r in ft.with_chunks(hits, chunks).collect()] == [("1", "whole", 1)]


def test_postings_and_edges_shuffle_no_words(spark):
    """A text's words are counted within its row; a text is scored for all queries at once, and what a batch of texts gives is bounded by its first hits."""
    texts = spark.range(3000).selectExpr("cast(id as string) id", "concat('b a b x', id % 7, ' c') text")
    made = ft.build_index(texts)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(made.postings)
    rows = {(r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in made.postings.filter("id = '8'").collect()}
    assert rows == {("a", 1, 5, (1,)), ("b", 2, 5, (0, 2)), ("x1", 1, 5, (3,)), ("c", 1, 5, (4,))}
    asked = spark.createDataFrame([(1, "a x3"), (2, "b"), (3, "nothing")], "qid long, query string")
    terms = ft.query_terms(asked).selectExpr("qid", "0 c", "'' sign", "false held", "1 n", "0 k", "'all' field", "term", "weight boost")
    best = ft.best_texts(ft.scored_texts(texts, terms), terms, None, 5)
    assert best.count() <= 2 * 5 * texts.rdd.getNumPartitions()
    got = [(r["qid"], r["id"]) for r in ft.bm25(texts, asked, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, "10"), (1, "1004"), (2, "0"), (2, "1")]


def test_edges_are_put_together_within_tasks(spark):
    from chunkwell.operators import graph as gr

    chunks = spark.range(0, 5000, 1, 2).selectExpr("cast(id as decimal(38,0)) ord", "concat('c', id) id", "array('A', 'b', 'a', concat('n', id % 2), null) entities")
    parts = gr.edge_parts(chunks, 3)
    assert parts.count() <= 12 * 2 and gr.node_parts(chunks).count() <= 5 * 2
    edges = {(r["src"], r["dst"]): (r["weight"], [c["id"] for c in r["citations"]]) for r in gr.edges(chunks, 3).collect()}
    assert edges["a", "b"] == edges["b", "a"] == (10000, ["c0", "c0", "c1"]) and edges["n1", "b"] == (2500, ["c1", "c3", "c5"]) and len(edges) == 10
    names = {r["key"]: (r["name"], r["mentions"]) for r in gr.merge_nodes(gr.node_parts(chunks)).collect()}
    assert names["a"] == ("a", 10000) and names["n1"] == ("n1", 2500) and names[None] == (None, 5000)


def test_lines_of_evidence_are_dealt_out_and_short(spark):
    from chunkwell.plans.agent import evidence_lines

    chunks = spark.range(50).selectExpr("string(id) id", "'d' doc_id", "1 page", "'s' section", "'official' reliability_tier", "repeat('x', 5000) text", "cast(null as array<array<string>>) table")
    made = evidence_lines(chunks, chunks)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and all(len(r["line"]) < 600 for r in made.collect())


def test_rounds_of_texts_are_written_once(spark, tmp_path):
    """Texts that have no vector yet are worked out once, however many rounds there are."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    class Client:
        def batch_embed(self, texts, side):
            return [[float(len(t))] for t in texts]

    chunks = spark.range(40).selectExpr("string(id) id", "concat('t', id) text", "cast(null as array<array<string>>) table").mapInPandas(count, "id string, text string, table array<array<string>>")
    kept = vs.build_kept(chunks, Client(), str(tmp_path / "kept"), "m", texts_a_round=5)
    assert seen.value == 40 and kept.count() == 40


def test_pictures_tasks_are_bounded(spark):
    from chunkwell import fakes
    from chunkwell.sources import adapters

    cores = spark.sparkContext.defaultParallelism
    pictures = spark.createDataFrame([], adapters.SPLIT)
    made = adapters.read_pictures(pictures, 10**9, {"scan_pdf": adapters.scan_parser(fakes.Pages())})
    assert f", {adapters.TASKS_A_CORE * cores}" in made._jdf.queryExecution().analyzed().toString().replace("RepartitionByExpression [doc_id", "")


def test_strings_over_texts_take_one_pass(spark):
    """All kinds of strings over texts, with and without fields, as over an index of them; texts are read once, and once more for each number of edits of fuzzy words."""
    rng = random.Random(3)
    words = ["gate", "river", "marn", "salt", "the", "é"]
    rows = [(f"{i:03d}", field, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) or None) for i in range(200) for field in ("all", "section")]
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    strings = ["salt gate", '"gate river"^2', "+marn +river -the", "section:gate the", '-"salt gate" É', "", "nothing", 'section:"the gate" +section:salt', "the", None]
    asked = lambda s: spark.createDataFrame(list(enumerate(s)), "qid int, query string")
    hits = lambda source, s: sorted(map(str, ft.search_all(source, asked(s), 7).select("qid", "rank", "id", "score").collect()))
    both = spark.createDataFrame(rows, "id string, field string, text string")
    for texts in (both, both.filter("field = 'all'").drop("field")):
        watched = texts.mapInPandas(seen, texts.schema)
        index, n, before = ft.build_index(texts), texts.count(), read.value
        assert hits(watched, strings) == hits(index, strings) != [] and read.value - before == n
        near = ["rivre~2", "-gat~ marn", "+solt~1 gate"]
        assert hits(watched, near) == hits(index, near) != [] and read.value - before == 4 * n
        assert hits(watched, ["", "+?"]) == []
