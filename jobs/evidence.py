"""Evidence for a list of questions: the best chunks of a corpus for each, with their texts and where they are from.

    python -m jobs.evidence --documents PATH --questions PATH --out PATH [--config FILE]

Documents are split into chunks, which are written by language; all questions are then ranked over the chunks in one pass (BM25), and what is found
is written by language too, with a summary beside it. Who checks answers, or has them written by a model, reads these tables.

Tables of ``--out``: ``chunks`` (id, doc_id, source, n, char_count, text; by lang), ``evidence`` (qid, rank, score, id, doc_id, source, char_count, text; by lang) and ``summary``
(lang, documents, chunks, questions, results). A run replaces all of them by what it makes of its inputs, so that a further run over the same inputs gives the same rows;
one that was broken off is run again. A null text has no chunks; a null language is written as ``und``; a question without a word has no results.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.functions.text import split_long
from chunkwell.operators import fulltext as ft

from .common import config, logger, read_back, session

log = logger("evidence")
UNKNOWN = "und"


def chunks_of(documents: DataFrame) -> DataFrame:
    each = documents.select("doc_id", "source", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.posexplode(split_long(F.coalesce("text", F.lit("")))).alias("n", "text"))
    name = F.format_string("%s::%03d", F.col("doc_id").cast("string"), "n")
    return each.select(name.alias("id"), "doc_id", "source", F.col("n").cast("long"), F.length("text").cast("long").alias("char_count"), "text", "lang")


def run(spark: SparkSession, documents: str, questions: str, out: str, settings: dict | None = None) -> DataFrame:
    """Writes the tables to ``out`` and returns the evidence, read back."""
    s = settings or config("evidence")
    out = out.rstrip("/")
    read = lambda path: spark.read.format(s["format"]).load(path)
    given, asked = read(documents), read(questions).select(F.col(s["question_id"]).alias("qid"), F.col(s["question_text"]).alias("query"))

    made = chunks_of(given)
    made.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/chunks")
    chunks = read_back(spark, f"{out}/chunks", made)

    hits = ft.bm25(chunks.select("id", "text"), asked, s["results"])
    found = ft.with_chunks(hits, chunks)
    evidence = found.select("qid", F.col("rank").cast("long"), "score", "id", "doc_id", "source", "char_count", F.substring("text", 1, s["evidence_chars"]).alias("text"), "lang")
    evidence.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/evidence")
    written = read_back(spark, f"{out}/evidence", evidence)

    of_documents = given.groupBy(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")).agg(F.count(F.lit(1)).alias("documents"))
    of_chunks = chunks.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"))
    of_results = written.groupBy("lang").agg(F.count_distinct("qid").alias("questions"), F.count(F.lit(1)).alias("results"))
    summary = of_documents.join(of_chunks, "lang", "left").join(of_results, "lang", "left").na.fill(0)
    summary.write.mode("overwrite").json(f"{out}/summary")
    for row in spark.read.schema(summary.schema).json(f"{out}/summary").orderBy("lang").toLocalIterator():
        log.info("%s: read %d documents, wrote %d chunks and %d results of %d questions", row["lang"], row["documents"], row["chunks"], row["results"], row["questions"])
    return written


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Find evidence for questions in a corpus.")
    for name in ("documents", "questions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(args)
    spark = session("evidence")
    try:
        run(spark, a.documents, a.questions, a.out, config("evidence", a.config, spark))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
