"""Files to chunks, the artifact, and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.operators import chunks as ch
from chunkwell.plans import ingest as ing
from chunkwell.schema import CHUNK, META
from chunkwell.sources import adapters, artifact, files, markup
from chunkwell.streaming import files as stream

MD = """# The Tower
Intro with [[Ada Quill|her]]
more intro.

# second title is text
## Walls
| Name | [[Grey|x]] |
|------|:---:|
| Height | 9 |
text right after
### Doors

Last."""


@pytest.fixture
def archive(tmp_path):
    for name in files.TIERS:
        (tmp_path / name / "deep").mkdir(parents=True)
    (tmp_path / "wiki/tower.md").write_text(MD)
    (tmp_path / "wiki/.hidden.md").write_text("# no")
    (tmp_path / "wiki/deep/x.md").write_text("# no")
    (tmp_path / "wiki/blank.md").write_text("\n")
    (tmp_path / "codex/old_law-book.TXT").write_text("Para one.\n \nPara two names Ada Quill? No: the tower.")
    (tmp_path / "codex/titled.txt").write_text("# My Title\nBody.")
    (tmp_path / "codex/x.unknown").write_text("?")
    (tmp_path / "ephemera/note.scan.pdf").write_bytes(b"pages")
    (tmp_path / "chronicles/tale.pdf").write_bytes(b"page one|page two")
    return tmp_path


def fake_pdf(content, doc_id):
    for i, text in enumerate(content.decode().split("|"), 1):
        yield {"type": "text", "page": i, "text": text}


def test_markdown(spark):
    rows = markup.markdown_blocks(spark.createDataFrame([("d", MD)], "doc_id string, text string")).orderBy("pos").collect()
    assert [(r["type"], r["text"], r["rows"]) for r in rows] == [
        ("title", "The Tower", None), ("text", "Intro with Ada Quill more intro.", None), ("text", "# second title is text", None), ("heading", "Walls", None),
        ("table", None, [["Name", "[[Grey", "x]]"], ["Height", "9"]]), ("text", "text right after", None), ("heading", "Doors", None), ("text", "Last.", None),
    ]


def test_ingest(spark, archive):
    listed = files.walk(spark, str(archive))
    names = markup.vocabulary(listed.filter("format = 'md'").selectExpr("decode(content, 'UTF-8') as text"))
    documents, chunks = (f.cache() for f in ing.ingest(listed, names, {"pdf": fake_pdf}))
    docs = {r["doc_id"]: r for r in documents.collect()}
    assert set(docs) == {"wiki/tower.md", "wiki/blank.md", "codex/old_law-book.TXT", "codex/titled.txt", "ephemera/note.scan.pdf", "chronicles/tale.pdf"}
    assert docs["codex/old_law-book.TXT"]["doc_title"] == "Old Law Book" and docs["codex/titled.txt"]["doc_title"] == "My Title"
    assert docs["wiki/blank.md"]["doc_title"] == "Untitled" and docs["chronicles/tale.pdf"]["doc_title"] == "page one"
    rows = chunks.orderBy("ord").collect()
    assert [r["id"] for r in rows][:2] == ["chronicles/tale.pdf::000", "chronicles/tale.pdf::001"] and [r["page"] for r in rows[:2]] == [1, 2]
    tower = [r for r in rows if r["doc_id"] == "wiki/tower.md"]
    assert [(r["id"][-3:], r["section"], r["chunk_type"]) for r in tower] == [("000", None, "text"), ("001", "Walls", "table"), ("002", "Walls", "text"), ("003", "Doors", "text")]
    assert tower[0]["text"] == "Intro with Ada Quill more intro.\n# second title is text" and tower[1]["char_count"] == len("Name | [[Grey | x]]\nHeight | 9")
    law = next(r for r in rows if r["doc_id"] == "codex/old_law-book.TXT")
    assert law["entities"] == ["The Tower"] and law["reliability_tier"] == "official" and not law["low_confidence"]
    summary = ch.meta(documents, chunks, names, "root").first()
    assert summary["document_count"] == 6 and summary["chunk_count"] == len(rows) and summary["by_category"]["ephemera"] == 0
    assert summary["by_extraction_method"] == {"markdown": 4, "plain-text": 2, "pdfplumber": 2} and summary["entity_count"] == 1


def test_job_and_artifact(spark, archive, tmp_path):
    out = tmp_path / "out"
    assert ing.main(["--archive", str(tmp_path / "none"), "--out", str(out)]) == 1
    assert ing.main(["--archive", str(archive), "--out", str(out), "--sample", "1", "--artifact"]) == 0
    meta, chunks = artifact.read_artifact(spark, f"{out}/artifact.json")
    assert meta.first()["sample_mode"] == 1 and chunks.count() == spark.read.parquet(f"{out}/chunks").count() > 0
    assert chunks.filter("page is not null").count() == 0


def test_artifact_fills_and_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"chunk_count": 2, "more": 1}, "chunks": [{"id": "x", "text": "t", "odd": 1}, {"id": "y", "table": [["a", "b"]], "page": 3}]}))
    meta, chunks = artifact.read_artifact(spark, str(tmp_path / "a.json"))
    rows = chunks.orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [0, 1]
    assert meta.first()["chunk_count"] == 2 and rows[0]["low_confidence"] is False and rows[0]["page"] is None and rows[1]["page"] == 3 and rows[1]["doc_id"] == ""
    with pytest.raises(Exception):
        artifact.read_artifact(spark, str(tmp_path / "none.json"))[1].collect()
    (tmp_path / "b.json").write_text('{"meta": {"chunk_count": 2}, "chunks": [{"id"')
    with pytest.raises(Exception):
        artifact.read_artifact(spark, str(tmp_path / "b.json"))[1].collect()


def test_best_ocr(spark):
    rows = [(1, 6, "six", [90.0, -1.0]), (1, 12, "twelve", [90.0]), (2, 6, "low", [34.9]), (3, 6, "edge", [35.0]), (4, 6, "none", [-1.0]), (5, 6, " ", [99.0])]
    got = {r["page"]: (r["text"], r["confidence"]) for r in adapters.best_ocr(spark.createDataFrame(rows, "page int, mode int, text string, conf array<double>"), ["page"]).collect()}
    assert got == {1: ("six", 90.0), 3: ("edge", 35.0)}


def test_chunk_ids_and_tiers(spark):
    pieces = spark.createDataFrame([("d", i, 0, None, None, None, "x" if i % 7 else " ", None, False) for i in range(1200)], "doc_id string, pos long, piece int, page int, confidence double, section string, text string, table array<array<string>>, recognised boolean")
    docs = spark.createDataFrame([("d", "T", "codex", "md", 1, "markdown")], "doc_id string, doc_title string, category string, format string, rank int, method string")
    ids = [r["id"] for r in ch.in_corpus_order(ch.build_chunks(pieces, docs)).orderBy("ord").collect()]
    assert ids == [f"d::{i:03d}" for i in range(len(ids))] and ids[-1] == "d::1027"
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("odd",)], "c string").select(files.tier_of(__import__("pyspark").sql.functions.col("c"))).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x" * 1000 + "\n" + "y" * 1000)
    for _ in range(2):  # the second run finds only what is new
        stream.run(stream.text_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    assert [(r["doc_id"], r["n"], len(r["text"])) for r in rows] == [("a.txt", 0, 1000), ("a.txt", 1, 1000)]


class Pages(adapters.Recogniser):
    def page(self, content, number):
        return content.decode().split("|")[number - 1]

    def count(self, content):
        return content.decode().count("|") + 1

    def plate(self, content):
        return content.decode()

    def words(self, picture, mode):
        return f"{picture} {mode}", [20.0 if "dim" in picture else 90.0 - (mode == 12), -1.0]


def mixed_pdf(content, doc_id):
    yield {"type": "text", "page": 1, "text": "Front\n\nbody"}
    yield {"type": "needs_ocr", "page": 2}
    yield {"type": "table", "page": 3, "rows": [["a", "b"]]}


def test_recognition(spark, archive):
    for folder in ("codex/images", "images", "wiki/images"):
        (archive / folder).mkdir()
        (archive / folder / "plate_one.png").write_bytes(b"A plate")
    (archive / "wiki/images/dim.jpg").write_bytes(b"dim art")
    (archive / "wiki/images/.x").write_bytes(b"hidden")
    (archive / "codex/none.txt").write_bytes(b"")
    (archive / "chronicles/mixed.pdf").write_bytes(b"one|two|three")
    listed = files.walk(spark, str(archive))
    made = Pages()
    parsers = {"pdf": adapters.with_recognised(mixed_pdf, made), "scan_pdf": adapters.scan_parser(made), "image": adapters.image_parser(made)}
    documents, chunks = (f.cache() for f in ing.ingest(listed, None, parsers))
    docs = {r["doc_id"]: (r["doc_title"], r["format"], r["category"]) for r in documents.collect()}
    assert docs["codex/images/plate_one.png"] == ("Plate One", "image", "codex") and docs["wiki/images/dim.jpg"][1:] == ("image", "wiki")
    assert not any(k.startswith("images/") or "/.x" in k for k in docs)
    assert docs["ephemera/note.scan.pdf"] == ("Note", "scan_pdf", "ephemera") and docs["codex/none.txt"] == ("None", "txt", "codex") and docs["chronicles/mixed.pdf"][0] == "Front"
    rows = [(r["id"], r["page"], r["text"], r["extraction_method"], r["extraction_confidence"]) for r in chunks.orderBy("ord").collect() if r["extraction_method"] in ("pdfplumber", "tesseract-ocr")]
    assert ("chronicles/mixed.pdf::001", 2, "two 6", "tesseract-ocr", 90.0) in rows and ("chronicles/mixed.pdf::002", 3, None, "pdfplumber", None) in rows
    assert [r for r in rows if r[0].startswith("ephemera/note")] == [("ephemera/note.scan.pdf::000", 1, "pages 6", "tesseract-ocr", 90.0)]
    assert rows[-2:] == [("codex/images/plate_one.png::000", None, "A plate 6", "tesseract-ocr", 90.0), ("wiki/images/plate_one.png::000", None, "A plate 6", "tesseract-ocr", 90.0)]
    assert ch.meta(documents, chunks, spark.createDataFrame([("n",)], "name string"), "a/b").first()["document_count"] == documents.count() == len(docs)


def test_job_switches(spark, archive, tmp_path, capsys):
    import shutil

    (archive / "codex/images").mkdir()
    (archive / "codex/images/p.png").write_bytes(b"P")
    (archive / "wiki/zzz.md").write_text("# Zed\nAda and Zed.")
    shutil.rmtree(archive / "chronicles")  # a folder that is not there is passed over
    asked = []

    def make():
        asked.append(1)
        return Pages()

    def run(name, *flags, make=make):
        assert ing.main(["--archive", str(archive), "--out", str(tmp_path / name), *flags], make) == 0
        meta = spark.read.parquet(f"{tmp_path}/{name}/meta").first()
        return meta, spark.read.parquet(f"{tmp_path}/{name}/chunks")

    meta, chunks = run("all")
    assert chunks.filter("extraction_method = 'tesseract-ocr'").count() == 2 and meta["ocr_available"] and meta["archive_root"] == archive.name and not (tmp_path / "all/artifact.json").exists()
    #: names come from the whole wiki, also where one file of a format is taken
    meta, chunks = run("skipped", "--skip-ocr", "--sample", "1")
    assert chunks.filter("extraction_method = 'tesseract-ocr'").count() == 0 and meta["ocr_available"] and len(asked) == 1
    assert meta["entity_count"] == 2 and meta["sample_mode"] == 1 and meta["document_count"] == 4

    def none():
        raise OSError("no program")

    meta, chunks = run("without", make=none)
    assert not meta["ocr_available"] and chunks.filter("format = 'image'").count() == 0 and "no program" in capsys.readouterr().err


def test_plain_titles_and_headings(spark):
    texts = [("a", "  # Padded \nBody"), ("b", "x\n# not first"), ("c", "")]
    rows = markup.plain_blocks(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["type"], r["text"]) for r in rows} == {("a", "title", "Padded"), ("a", "text", "Body"), ("b", "text", "x\n# not first")}
    lines = [("## Two", "Two"), ("###### Six  ", "Six"), ("####### seven", None), ("##none", None), ("# one", None), ("##", None), ("## # x", "# x"), ("##\tTab", "Tab")]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(x,) for x, _ in lines], "line string").select(markup.heading(F.col("line")).alias("h")).collect()
    assert [r["h"] for r in got] == [h for _, h in lines]
    rules = [("|---|:-:|", True), ("---", True), ("| a |", False), ("| - x", False), ("|", True)]
    got = spark.createDataFrame([(x,) for x, _ in rules], "line string").select(markup.rule(F.col("line")).alias("r")).collect()
    assert [r["r"] for r in got] == [x for _, x in rules]


class Styled:
    def __init__(self, text, style):
        self.text, self.style = text, type("S", (), {"name": style})


class Grid:
    def __init__(self, rows):
        cell = lambda x: type("C", (), {"text": x})
        self.rows = [type("R", (), {"cells": [cell(c) for c in r]}) for r in rows]


def test_docx_and_pdf_libraries(monkeypatch):
    """The parsers by stand-ins of their libraries."""
    import sys
    import types

    items = [Styled(" Top ", "Title"), Styled("Sub", "Subtitle"), Styled("Four", "Heading 4"), Styled("Five", "Heading 5"), Styled(" ", "Heading 1"), Grid([["a ", ""], ["", "b"]]), Grid([["", " "]])]
    monkeypatch.setitem(sys.modules, "docx", types.SimpleNamespace(Document=lambda f: types.SimpleNamespace(iter_inner_content=lambda: iter(items))))
    got = [(b["type"], b.get("text") or b.get("rows")) for b in adapters.docx_parser()(b"", "d")]
    assert got == [("heading", "Top"), ("text", "Sub"), ("heading", "Four"), ("text", "Five"), ("table", [["a", ""], ["", "b"]])]

    class Page:
        def __init__(self, text, tables, images):
            self.extract_text, self.extract_tables, self.images = (lambda: text), (lambda: tables), images

    class Pdf:
        pages = [Page(" one ", [[["x", None]]], []), Page(None, [], ["picture"]), Page("", [], []), Page("", [[["", None]]], ["p"])]

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: Pdf()))
    got = [(b["type"], b["page"], b.get("text") or b.get("rows")) for b in adapters.pdf_parser()(b"", "d")]
    assert got == [("text", 1, "one"), ("table", 1, [["x", ""]]), ("needs_ocr", 2, None)]


def test_all_names_are_walked(spark, tmp_path):
    """Names that begin with an underscore, files of no bytes and many names; in one scan, and nothing of it on the driver."""
    (tmp_path / "wiki").mkdir()
    for name, text in (("_index.md", "# Index\nx"), ("_none.txt", ""), (".hidden.md", "# h"), ("a b%20.md", "# A")):
        (tmp_path / "wiki" / name).write_text(text)
    (tmp_path / "ephemera").mkdir()
    for i in range(10_000):
        (tmp_path / f"ephemera/{i}.txt").write_bytes(str(i).encode() if i % 2 else b"")
    found = files.walk(spark, str(tmp_path))
    rows = {r["doc_id"]: bytes(r["content"]) for r in found.collect()}
    assert len(rows) == 10_003 and rows["wiki/_index.md"] == b"# Index\nx" and rows["wiki/_none.txt"] == b"" and rows["wiki/a b%20.md"] == b"# A" and rows["ephemera/77.txt"] == b"77"
    assert files.walk(spark, f"file://{tmp_path}", only=("wiki",)).count() == 3 and files.walk(spark, f"{tmp_path}/none").count() == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    _, chunks = ing.ingest(files.walk(spark, str(tmp_path), only=("wiki",)))
    assert {r["doc_title"] for r in chunks.collect()} == {"Index"}


def test_line_ends(spark, tmp_path):
    (tmp_path / "ephemera").mkdir()
    (tmp_path / "ephemera/m.txt").write_bytes(b"a\r\nb\r\n\r\nc\r\rd")
    (tmp_path / "ephemera/n.md").write_bytes(b"# T\r## S\r\nx\ry")
    _, chunks = ing.ingest(files.walk(spark, str(tmp_path)))
    assert [(r["doc_title"], r["section"], r["text"]) for r in chunks.orderBy("ord").collect()] == [("M", None, "a\nb\nc\nd"), ("T", "S", "x y")]


def test_sample_is_by_ending(spark):
    names = ["codex/a.txt", "codex/b.TXT", "codex/c.scan.pdf", "codex/d.pdf", "codex/e.SCAN.PDF", "wiki/f.txt", "codex/images/a.png", "codex/images/b.jpg", "codex/images/c.png"]
    listed = files.classify(spark.createDataFrame([(n, b"") for n in names], "path string, content binary"))
    kept = {r["doc_id"] for r in files.sample(listed, 1).collect()}
    assert kept == {"codex/a.txt", "codex/c.scan.pdf", "codex/d.pdf", "wiki/f.txt", "codex/images/a.png", "codex/images/b.jpg"}
    assert files.sample(listed, 0).count() == len(names)


def test_a_file_is_read_once(spark, archive, monkeypatch):
    """All formats come from one scan of the archive: each file's parser is called once, and the listing reads what the pass has written."""
    calls = spark.sparkContext.accumulator(0)

    def counted(content, doc_id):
        calls.add(1)
        yield from fake_pdf(content, doc_id)

    documents, chunks = ing.ingest(files.walk(spark, str(archive)), None, {"pdf": counted, "scan_pdf": counted})
    assert documents.count() == 6 and chunks.filter("page is not null").count() == 3 and calls.value == 2
    for frame in (documents, chunks):
        assert "BatchScan" not in frame._jdf.queryExecution().executedPlan().toString()


def test_a_store_that_only_spark_reads(spark, archive, monkeypatch):
    want = {r["doc_id"] for r in files.walk(spark, str(archive)).collect()}

    def none(root):
        raise ValueError(root)

    monkeypatch.setattr(files, "file_system", none)
    assert {r["doc_id"] for r in files.walk(spark, str(archive)).collect()} == want


class Memory(artifact.Bytes):
    def __init__(self, data):
        self.data = data

    def read(self, start, end):
        return self.data[start : max(start, end)]


def some_json(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 3)
    if kind < 4:
        return rng.choice(["a{", '}]"', "\\", '\\\\"', '"chunks": [{', "x" * rng.randint(0, 30), "é\n", None, 3, '[{"meta":{'])
    if kind < 6:
        return {rng.choice(["a", "chunks", "meta", 'b"', "\\"]): some_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [some_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def pieces(data, size):
    """Meta and chunks by ranges of a size, as the tasks do it."""
    ranges, file = [artifact.Range("p", i, min(len(data), i + size), len(data)) for i in range(0, len(data), size)], Memory(data)
    begun, about = artifact.begins(ranges, [artifact.read_effect(json.dumps(artifact.effects(file, r))) for r in ranges])
    out = []
    for b in begun:
        found = [json.loads(c) for c in artifact.cut(file, b)]
        assert not found or b.number == len(out)
        out += found
    return json.loads(artifact.whole(file, *about)) if about else None, out


def test_artifact_is_split_anywhere():
    """Objects with brackets, quotes, backslashes and the same keys within, cut at every place, against the whole parsed at once."""
    rng = random.Random(3)
    for _ in range(25):
        given = {}
        for key in rng.sample(["x", "meta", "chunks", "y"], 4):
            if key == "meta":
                given[key] = {"a": some_json(rng), "chunks": [{}]}
            elif key == "chunks":
                given[key] = [{"id": i, "v": some_json(rng), "w": some_json(rng)} for i in range(rng.randint(0, 6))]
            else:
                given[key] = some_json(rng)
        data = json.dumps(given, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        for size in (1, 3, 8, 17, 64, len(data)):
            assert pieces(data, size) == (given["meta"], given["chunks"]), (size, data)
    assert pieces(b'{"x": 1}', 3) == (None, []) and pieces(b'{"chunks": []}', 3) == (None, [])
    for broken in (b'{"chunks": [{}', b'{"chunks": [{"a": "}]}', b'{"chunks": []}}', b'[{"chunks": []}]', b'{"chunks": [{} {}]}', b'{"chunks": [{}, 3]}', b'{"chunks": [{},]}', b'{"chunks": [{},,{}]}', b'{"chunks": [,{}]}', b'{"chunks": ["a", {}]}', b'{"chunks": [1, 2]}', b'{"chunks": [[{}]]}', b""):
        for size in (1, 4, 100):
            with pytest.raises(ValueError, match="broken"):
                pieces(broken, size)


def test_artifact_of_many_parts(spark, tmp_path):
    """No row and no task has all chunks: several files, which make one object together, and are read in many ranges."""
    rows = [tuple({**dict.fromkeys(CHUNK.names), "id": f"c{i}", "text": 'a "b" \\ {[' + "\n" * (i % 3), "low_confidence": i % 2 == 0, "char_count": i, "table": [["x", None]] if i % 5 else None}.values()) for i in range(500)]
    chunks = spark.createDataFrame([(i * 3, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("ord", T.LongType()), *CHUNK])).repartition(7)
    meta = spark.createDataFrame([tuple({**dict.fromkeys(META.names), "chunk_count": 500, "archive_root": "ü", "by_format": {"md": 2}}.values())], META)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part
    try:
        artifact.write_artifact(meta, chunks, f"{tmp_path}/a.json")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files_ = sorted((tmp_path / "a.json").glob("part-*"))
    one = json.loads(b"".join(f.read_bytes() for f in files_))
    assert len(files_) > 1 and [c["id"] for c in one["chunks"]] == [f"c{i}" for i in range(500)] and one["meta"]["by_format"] == {"md": 2}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1, ensure_ascii=False))
    for path in ("a.json", "one.json"):
        about, read = artifact.read_artifact(spark, f"{tmp_path}/{path}", 9000)
        assert read.rdd.getNumPartitions() > 10 and about.first()["archive_root"] == "ü"
        assert [tuple(r)[1:] for r in read.orderBy("ord").collect()] == [tuple("" if r[k] is None and f in artifact.DEFAULTS else r[k] for k, f in enumerate(CHUNK.names)) for r in rows]
        assert [r["ord"] for r in read.select("ord").orderBy("ord").collect()] == list(range(500))
    artifact.write_artifact(meta, chunks.limit(0), f"{tmp_path}/none.json")
    about, read = artifact.read_artifact(spark, f"{tmp_path}/none.json")
    assert read.count() == 0 and about.first()["chunk_count"] == 500


def test_pages_of_one_file_go_to_all_tasks(spark):
    """A file of 400 pages is recognised by as many tasks as there are, with order and ids as when one task reads it."""
    content = "|".join(f"page {i}" if i % 7 else "dim" for i in range(1, 401)).encode()
    listed = files.classify(spark.createDataFrame([("codex/long.scan.pdf", content), ("codex/short.scan.pdf", b"only"), ("codex/images/p.png", b"plate"), ("codex/none.pdf", b"")], "path string, content binary"))
    made = Pages()
    parsers = {"scan_pdf": adapters.scan_parser(made), "image": adapters.image_parser(made)}
    own = listed.select("doc_id", "category", "format", "rank", F.lit(None).cast("string").alias("text"), "content")
    blocks = adapters.parsed_blocks(own, parsers).filter("type = 'text'")
    tasks = {r["t"]: r["n"] for r in blocks.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks.values()) < 120
    whole = list(parsers["scan_pdf"](content, "d"))
    rows = blocks.filter("doc_id = 'codex/long.scan.pdf'").orderBy("pos").collect()
    assert [(r["page"], r["text"], r["confidence"]) for r in rows] == [(b["page"], b["text"], b["confidence"]) for b in whole] and len(rows) == 343
    _, chunks = ing.ingest(listed, None, parsers)
    ids = [(r["id"], r["page"]) for r in chunks.orderBy("ord").collect() if r["doc_id"] == "codex/long.scan.pdf"]
    assert ids == [(f"codex/long.scan.pdf::{i:03d}", b["page"]) for i, b in enumerate(whole)]
    nothing = adapters.parsed_blocks(own.filter("format = 'pdf'"), parsers).collect()
    assert [r["type"] for r in nothing] == ["file"]
