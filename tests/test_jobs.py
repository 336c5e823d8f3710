"""The jobs over small and growing inputs; their queries against SQL."""

import json
import logging

import duckdb
import pytest
from pyspark.sql import functions as F

from chunkwell.operators import graph as gr
from jobs import common, evidence, mentions, registry

from .test_entry import TABLES, plain

DOCUMENTS = "doc_id long, text string, lang string, source string"
PAGES = [("<ul><li><a href='x'>no</a></li><li><a href=\"/1\">Red Fox</a></li><li><a href=\"/2\">hen</a></li></ul>",), ('<li><a href="/3"> Owl </a><li><a href="/4">hen</a>',), (None,)]
TEXTS = [(1, "The red fox met a hen.\n\nAn owl saw the hen.", "en", "a"), (2, "Owl and red  fox; RED FOX and owl!", "de", "a"), (3, None, None, "b"), (4, "nobody", None, None), (5, "hen, owl", "en", "b"), (6, "owl? hen.", "7", "b")]


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_job_is_its_sql(spark, sf, name):
    spark.range(1).collect()
    before = spark.conf.getAll
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf), db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda cursor: sorted(tuple(map(plain, r)) for r in cursor)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
    after = spark.conf.getAll
    assert {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)} <= {"spark.checkpoint.dir", "spark.app.name"}


def add(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(path))


def found(edges):
    return sorted((r["src"], r["dst"], r["weight"], tuple(c["id"] for c in r["citations"])) for r in edges.collect())


@pytest.fixture
def places(spark, tmp_path):
    add(spark, PAGES, "html string", tmp_path / "pages")
    return {k: str(tmp_path / k) for k in ("documents", "pages", "out", "checkpoint")}


def test_growing_input_is_taken_once(spark, places, caplog):
    caplog.set_level(logging.INFO, "jobs")
    add(spark, TEXTS[:2], DOCUMENTS, places["documents"])
    first = found(mentions.run(spark, **places))
    assert first == [("hen", "owl", 1, ("1::000",)), ("hen", "red fox", 1, ("1::000",)), ("owl", "hen", 1, ("1::000",)), ("owl", "red fox", 2, ("1::000", "2::000")), ("red fox", "hen", 1, ("1::000",)), ("red fox", "owl", 2, ("1::000", "2::000"))]
    add(spark, TEXTS[2:], DOCUMENTS, places["documents"])
    caplog.clear()
    second = found(mentions.run(spark, **places))
    assert "read 4 new documents in 1 batches" in caplog.text
    assert ("hen", "owl", 3, ("1::000", "5::000", "6::000")) in second
    caplog.clear()
    assert found(mentions.run(spark, **places)) == second and "read 0 new documents" in caplog.text
    #: all at once gives the same
    whole = {**places, "out": places["out"] + "-2", "checkpoint": places["checkpoint"] + "-2"}
    assert found(mentions.run(spark, **whole)) == second
    nodes = {r["key"]: (r["name"], r["mentions"]) for r in spark.read.parquet(f"{places['out']}/nodes").collect()}
    assert nodes == {"red fox": ("Red Fox", 2), "hen": ("hen", 3), "owl": ("Owl", 4)}
    assert spark.read.parquet(f"{places['out']}/chunks").filter("doc_id = 3").count() == 0


def test_a_batch_done_again_counts_once(spark, places, tmp_path):
    add(spark, TEXTS[:2], DOCUMENTS, places["documents"])
    mentions.run(spark, **places)
    add(spark, TEXTS[2:], DOCUMENTS, places["documents"])
    want = found(mentions.run(spark, **places))
    #: as if the driver was lost after the batch's tables were written and before the stream knew
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert found(mentions.run(spark, **places)) == want


def test_no_names_and_no_documents(spark, places):
    add(spark, [("none",)], "html string", places["pages"], "overwrite")
    add(spark, [], DOCUMENTS, places["documents"])
    assert found(mentions.run(spark, **places)) == []
    add(spark, TEXTS, DOCUMENTS, places["documents"])
    assert found(mentions.run(spark, **places)) == []


def test_parts_merge_in_any_order(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", [["a", "b", "c", "A"][j] for j in range(4) if (i + j) % 3]) for i in range(40)], "ord long, id string, entities array<string>")
    at_once = found(gr.edges(chunks))
    parts = [gr.edges(chunks.filter(F.pmod("ord", F.lit(3)) == k)) for k in (2, 0, 1)]
    twice = gr.merge_edges(gr.merge_edges(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert found(twice) == at_once and all(len(c) <= 10 for *_, c in at_once)


def test_evidence_is_the_same_again(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    add(spark, TEXTS, DOCUMENTS, tmp_path / "documents")
    add(spark, [(1, "owl HEN"), (2, "?"), (3, None), (4, "nobody")], "item_id long, text string", tmp_path / "questions")
    run = lambda **more: sorted(map(tuple, evidence.run(spark, f"{tmp_path}/documents", f"{tmp_path}/questions", f"{tmp_path}/out/", common.config("evidence") | more).collect()))
    got = run()
    assert [(r[0], r[1], r[3], r[8]) for r in got] == [(1, 1, "5::000", "en"), (1, 2, "6::000", "7"), (1, 3, "1::000", "en"), (1, 4, "2::000", "de"), (4, 1, "4::000", "und")]
    assert run() == got and "en: read 2 documents, wrote 2 chunks and 2 results of 1 questions" in caplog.text
    assert [r[7] for r in run(results=1, evidence_chars=3)] == ["hen", "nob"]


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"results": 2}))
    assert common.config("evidence", str(tmp_path / "c.json"), spark)["results"] == 2
    (tmp_path / "d.json").write_text(json.dumps({"result": 2}))
    with pytest.raises(ValueError, match="result"):
        common.config("evidence", str(tmp_path / "d.json"), spark)
    assert common.as_pattern("/a/b.parquet") == "/a/b.parque[t]" and common.as_pattern("/a/*.parquet") == "/a/*.parquet"
