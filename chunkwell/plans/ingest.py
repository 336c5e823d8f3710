"""The job that makes the chunks table of an archive.

python -m chunkwell.plans.ingest --archive DIR --out DIR [--sample N] [--skip-ocr] [--artifact]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared_folder
from ..functions.text import file_title, page_title, table_text
from ..operators import chunks as ch
from ..operators.tagging import with_entities
from ..schema import BLOCK
from ..sources import artifact, files as fs, markup
from ..sources.adapters import Recogniser, docx_parser, image_parser, parsed_blocks, pdf_parser, recogniser, scan_parser, with_recognised

#: How the text of each format is got, as chunks name it.
METHODS = {"md": "markdown", "txt": "plain-text", "docx": "python-docx", "pdf": "pdfplumber", "scan_pdf": ch.RECOGNISED, "image": ch.RECOGNISED}
SECTIONED = ("md", "txt", "docx")


def titles(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, doc_title): of Markdown its title line, of a PDF what its first block begins with, of DOCX its first heading, else and for all others the file's name."""
    first = blocks.groupBy("doc_id").agg(
        F.max(F.when(F.col("type") == "title", F.col("text"))).alias("title"),
        F.min_by(F.struct("type", "text"), "pos").alias("first"),
        F.min_by("text", F.when(F.col("type") == "heading", F.col("pos"))).alias("heading"),
    )
    stem = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"(?<=.)(?i:\.scan\.pdf|\.[^.]*)$", "")
    of_page = F.when(F.col("first.type") == "text", page_title(F.col("first.text")))
    named = listed.select("doc_id", "format").join(first, "doc_id", "left")
    own = F.when(F.col("format").isin("md", "txt"), F.col("title")).when(F.col("format") == "docx", F.col("heading")).when(F.col("format") == "pdf", of_page)
    rest = F.when(F.col("format") == "md", "Untitled").otherwise(file_title(stem))
    return named.select("doc_id", F.when(own != "", own).otherwise(rest).alias("doc_title"))


def pieces_of(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """Pieces of blocks by their documents' formats: with headings, with pages, or whole as plates."""
    typed = blocks.join(listed.select("doc_id", "format"), "doc_id")
    sectioned = ch.sectioned_pieces(typed.filter(F.col("format").isin(*SECTIONED)).drop("format"))
    paged = ch.paged_pieces(typed.filter(~F.col("format").isin(*SECTIONED, "image")))
    return sectioned.unionByName(paged).unionByName(ch.paged_pieces(typed.filter("format = 'image'"), split=False))


def chunked(blocks: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks in the order of the walk, of blocks and (doc_id, category, format, rank)."""
    method = F.try_element_at(F.create_map(*[F.lit(x) for p in METHODS.items() for x in p]), F.col("format"))
    documents = listed.select("doc_id", "category", "format", "rank").join(titles(blocks, listed), "doc_id")
    documents = documents.select("doc_id", "doc_title", "category", "format", "rank", method.alias("method"))
    return documents, ch.in_corpus_order(ch.build_chunks(pieces_of(blocks, listed), documents))


def ingest(listed: DataFrame, vocabulary: DataFrame | None = None, parsers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of files (doc_id, category, format, rank, content).

    ``parsers`` has a function for each format that needs a library; formats without one have documents but no chunks.
    """
    is_text = F.col("format").isin("md", "txt")
    #: a file's bytes are read in this one pass; all that follows reads what was made of them
    files = listed.select("doc_id", "category", "format", "rank", F.when(is_text, markup.universal(F.decode("content", "UTF-8"))).alias("text"), F.when(~is_text, F.col("content")).alias("content"))
    shared_folder(listed.sparkSession)
    parsed = parsed_blocks(files, parsers or {}).checkpoint()
    texts = lambda f: parsed.filter((F.col("type") == "raw") & (F.col("format") == f)).select("doc_id", "text")
    no_conf = [F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("confidence")]
    blocks = markup.markdown_blocks(texts("md")).unionByName(markup.plain_blocks(texts("txt"))).select("*", *no_conf)
    blocks = blocks.unionByName(parsed.filter(~F.col("type").isin("file", "raw")).select(*[f.name for f in BLOCK]))
    #: titles and pieces both read blocks
    documents, made = chunked(blocks.checkpoint(), parsed.filter("type = 'file'").select("doc_id", "category", "format", "rank"))
    if vocabulary is not None:
        made = with_entities(made, vocabulary, F.coalesce("text", table_text(F.col("table"))))
    return documents, made


def usual_parsers(skip_ocr: bool = False, make_recogniser: Callable[[], Recogniser] = recogniser) -> tuple[dict[str, Callable], bool]:
    """Parsers of the libraries that are there, and whether recognition was wanted and cannot be had.

    Whether it can be had is found out once, before the run: a job on many executors has no first file.
    """
    parsers, made, missing = {}, None, False
    if not skip_ocr:
        try:
            made = make_recogniser()
            parsers |= {"scan_pdf": scan_parser(made), "image": image_parser(made)}
        except (ImportError, OSError) as error:
            missing = True
            print(f"no recognition of scans and images: {error}", file=sys.stderr)
    for name, make in (("pdf", pdf_parser), ("docx", docx_parser)):
        try:
            parsers[name] = make()
        except ImportError:
            print(f"no library for {name}; its files have no chunks", file=sys.stderr)
    if "pdf" in parsers:
        parsers["pdf"] = with_recognised(parsers["pdf"], made)
    return parsers, missing


def main(args: list[str] | None = None, make_recogniser: Callable[[], Recogniser] = recogniser) -> int:
    p = argparse.ArgumentParser(description="Make the chunks table of an archive.")
    p.add_argument("--archive", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--sample", type=int, default=0)
    p.add_argument("--skip-ocr", action="store_true")
    p.add_argument("--artifact", action="store_true", help="also write all chunks as one JSON object, for small archives")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    path = spark._jvm.org.apache.hadoop.fs.Path(a.archive)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        print(f"no such archive: {a.archive}", file=sys.stderr)
        return 1
    found = fs.walk(spark, a.archive)
    #: names come from all of the wiki, whatever the sample
    wiki = fs.walk(spark, a.archive, only=("wiki",)).filter("format = 'md'")
    names = markup.vocabulary(wiki.select(markup.universal(F.decode("content", "UTF-8")).alias("text")))
    parsers, missing = usual_parsers(a.skip_ocr, make_recogniser)
    documents, chunks = ingest(fs.sample(found, a.sample), names, parsers)
    chunks.write.mode("overwrite").parquet(f"{a.out}/chunks")
    written = spark.read.parquet(f"{a.out}/chunks")
    summary = ch.meta(documents, written, names, a.archive, ocr_available=not missing, sample_mode=a.sample or None)
    summary.write.mode("overwrite").parquet(f"{a.out}/meta")
    if a.artifact:
        artifact.write_artifact(summary, written, f"{a.out}/artifact.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
