"""Who is named together with whom in a growing corpus: the entity graph, kept up to date from new files only.

    python -m jobs.mentions --documents FOLDER --pages PATH --out PATH --checkpoint PATH [--config FILE]

A stream takes the files of ``--documents`` that its checkpoint does not know yet, in batches, and ends. Each batch is split into chunks, names are found in
them, and the batch's own edges and nodes are written as partial sums. The graph is then merged from the partial sums of all batches: texts are
read once, however often the job runs. Names are the texts of links of ``--pages`` as they are when a batch is taken.

Tables of ``--out``: ``chunks`` (ord, id, doc_id, lang, text), ``entities`` (ord, id, entities), ``edge_parts`` and ``node_parts``, all by batch; ``edges`` (src, dst, weight, citations; by a hash
of src) and ``nodes`` (key, name, mentions). A batch that is done again after a failure replaces its own partitions, so nothing counts twice; merging replaces the whole graph
and gives the same whenever it is done. Files are to be added, not changed; a null text has no chunks.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.functions.text import split_long, strip
from chunkwell.operators import graph as gr
from chunkwell.operators.tagging import with_entities

from .common import as_pattern, config, logger, read_back, session

log = logger("mentions")
PLACE = "decimal(38,0)"


def names_of(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    found = pages.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pattern), F.lit(1))).alias("name"))
    return found.select(strip(F.col("name")).alias("name")).filter("name <> ''").distinct()


def chunks_of(documents: DataFrame) -> DataFrame:
    """Chunks with ``ord``, which rises with the document and the number in it, whatever batch they are of."""
    each = documents.select("doc_id", "lang", F.posexplode(split_long(F.coalesce("text", F.lit("")))).alias("n", "text"))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("n")
    return each.select(place.cast(PLACE).alias("ord"), F.format_string("%s::%03d", F.col("doc_id").cast("string"), "n").alias("id"), "doc_id", "lang", "text")


def take(spark: SparkSession, documents: DataFrame, batch: int, pages: str, out: str, s: dict) -> None:
    """One batch of new documents to its partitions."""

    def put(frame: DataFrame, name: str) -> DataFrame:
        kept = frame.withColumn("batch", F.lit(batch))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        return spark.read.schema(kept.schema).parquet(f"{out}/{name}").filter(F.col("batch") == batch).drop("batch")

    names = names_of(spark.read.parquet(pages), s["names_column"], s["name_pattern"])
    chunks = put(chunks_of(documents), "chunks")
    tagged = with_entities(chunks.withColumn("entities", F.array().cast("array<string>")), names, F.col("text"), s["names_per_chunk"])
    named = put(tagged.select("ord", "id", "entities"), "entities")
    put(gr.edges(named, s["citations"]), "edge_parts")
    put(gr.node_parts(named), "node_parts")
    log.info("batch %d: wrote %d chunks", batch, chunks.count())


def run(spark: SparkSession, documents: str, pages: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Takes what is new, merges the graph and returns its edges, read back."""
    s, out = settings or config("mentions"), out.rstrip("/")
    given = spark.readStream.schema(spark.read.parquet(documents).select("doc_id", "lang", "text").schema).option("maxFilesPerTrigger", s["files_per_batch"])
    stream = given.parquet(as_pattern(documents)).writeStream.foreachBatch(lambda frame, batch: take(frame.sparkSession, frame, batch, pages, out, s))
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new documents in %d batches", sum(p["numInputRows"] for p in query.recentProgress), sum(p["numInputRows"] > 0 for p in query.recentProgress))

    place = f"struct<ord: {PLACE}, {{}}>"
    parts = lambda name, schema: spark.createDataFrame([], schema) if not exists(spark, f"{out}/{name}") else spark.read.schema(schema).parquet(f"{out}/{name}")
    edges = gr.merge_edges(parts("edge_parts", f"src string, dst string, weight long, citations array<{place.format('id: string')}>"), s["citations"])
    edges = edges.withColumn("folder", F.pmod(F.xxhash64("src"), F.lit(s["folders"])).cast("int"))
    nodes = gr.merge_nodes(parts("node_parts", f"key string, name string, last {place.format('pos: int')}, mentions long")).drop("last")
    edges.write.mode("overwrite").partitionBy("folder").parquet(f"{out}/edges")
    nodes.write.mode("overwrite").parquet(f"{out}/nodes")
    written = read_back(spark, f"{out}/edges", edges)
    log.info("wrote %d edges of %d nodes", written.count(), spark.read.schema(nodes.schema).parquet(f"{out}/nodes").count())
    return written.drop("folder")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Keep the graph of names up to date.")
    for name in ("documents", "pages", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(args)
    spark = session("mentions")
    try:
        run(spark, a.documents, a.pages, a.out, a.checkpoint, config("mentions", a.config, spark))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
