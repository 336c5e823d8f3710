"""Blocks to chunks: sections, packing, ids, and the counts that describe a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_cell, clean_rows, pack, split_long, strip, table_text
from ..schema import CHUNK, LOW_CONFIDENCE
from ..sources.files import tier_of

NO_TABLE = "array<array<string>>"
#: Fixed value: how recognised text is marked.
RECOGNISED = "tesseract-ocr"


def low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False))


def with_sections(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``section``: the text of the last heading so far."""
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.last(F.when(F.col("type") == "heading", F.col("text")), True).over(so_far))


def sectioned_pieces(blocks: DataFrame) -> DataFrame:
    """Pieces of documents with headings: the texts between headings and tables are packed together, a table is a piece."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = with_sections(blocks.filter("type in ('heading', 'text', 'table')"))
    kept = kept.withColumn("run", F.sum((F.col("type") != "text").cast("int")).over(order))
    texts = kept.filter("type = 'text'").groupBy("doc_id", "run", "section").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    texts = texts.select("doc_id", "pos", "section", F.posexplode(pack(F.transform("l", lambda x: x["text"]))).alias("piece", "text"))
    texts = texts.select("doc_id", "pos", "piece", "section", "text", F.lit(None).cast(NO_TABLE).alias("table"))
    tables = kept.filter("type = 'table'").select("doc_id", "pos", F.lit(0).alias("piece"), "section", F.lit(None).cast("string").alias("text"), F.col("rows").alias("table"))
    none = [F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("recognised")]
    return texts.unionByName(tables).select("*", *none)


def paged_pieces(blocks: DataFrame, split: bool = True) -> DataFrame:
    """Pieces of documents with pages: each text is split on its own; ``split`` false keeps them whole, as are single recognised pages among others (type ``recognised``)."""
    units = F.when(F.col("type") == "text", split_long(F.col("text"))).otherwise(F.array("text")) if split else F.array("text")
    texts = blocks.filter("type in ('text', 'recognised')").select("doc_id", "pos", "page", "confidence", (F.col("type") == "recognised").alias("recognised"), F.posexplode(units).alias("piece", "text"))
    texts = texts.withColumn("table", F.lit(None).cast(NO_TABLE))
    tables = blocks.filter("type = 'table'").select("doc_id", "pos", "page", "confidence", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("text"), F.col("rows").alias("table"))
    return texts.unionByName(tables.withColumn("recognised", F.lit(False))).withColumn("section", F.lit(None).cast("string"))


def build_chunks(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks table with its place (rank, n), without entities, from pieces and (doc_id, doc_title, category, format, method, rank).

    Blank texts and tables without a filled cell go before chunks are numbered.
    """
    text, rows = strip(F.col("text")), clean_rows(F.col("table"))
    kept = pieces.withColumn("text", text).withColumn("table", rows).filter(F.when(F.col("table").isNull(), F.coalesce("text", F.lit("")) != "").otherwise(any_cell(F.col("table"))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "piece")) - 1
    joined = kept.withColumn("n", number).join(documents, "doc_id")
    shown = F.coalesce("text", table_text(F.col("table")))
    out = joined.select(
        F.format_string("%s::%03d", "doc_id", "n").alias("id"), "doc_id", "doc_title", "category", "format", tier_of(F.col("category")).alias("reliability_tier"),
        F.col("page").cast("int"), "section", F.when(F.col("table").isNull(), "text").otherwise("table").alias("chunk_type"), "text", "table",
        F.array().cast("array<string>").alias("entities"), F.when(F.col("recognised"), RECOGNISED).otherwise(F.col("method")).alias("extraction_method"), F.col("confidence").alias("extraction_confidence"),
        low_confidence(F.col("confidence")).alias("low_confidence"), F.length(shown).alias("char_count"), "rank", "n",
    )
    return out


def in_corpus_order(chunks: DataFrame) -> DataFrame:
    """The chunks with ``ord``, which rises with the walk's rank, the document and the number in it.

    Documents are put in order by ranges, so that no single task sorts them all.
    """
    docs = chunks.select("rank", "doc_id").distinct()
    placed = docs.repartitionByRange("rank", "doc_id").sortWithinPartitions("rank", "doc_id").withColumn("_place", F.monotonically_increasing_id())
    place = F.col("_place").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("n")
    return chunks.join(placed, ["rank", "doc_id"]).withColumn("ord", place.cast("decimal(38,0)")).select("ord", *[f.name for f in CHUNK])


def counts_by(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunks of each value of ``key`` among documents; values whose documents have no chunk count 0."""
    per = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.join(per, "doc_id", "left").groupBy(key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))


def meta(documents: DataFrame, chunks: DataFrame, vocabulary: DataFrame, archive_root: str, ocr_available: bool = True, sample_mode: int | None = None) -> DataFrame:
    """One row that describes the corpus; the archive is named by its last folder."""
    as_map = lambda f, k: f.agg(F.map_from_entries(F.collect_list(F.struct(F.col(k), F.col("chunk_count").cast("int")))).alias(f"by_{k}"))
    methods = chunks.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("chunk_count"))
    one = documents.agg(F.count(F.lit(1)).cast("int").alias("document_count"))
    for f in (
        chunks.agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.count_if("low_confidence").cast("int").alias("low_confidence_chunk_count")),
        vocabulary.agg(F.count_distinct("name").cast("int").alias("entity_count")),
        as_map(counts_by(documents, chunks, "category"), "category"), as_map(counts_by(documents, chunks, "format"), "format"), as_map(methods, "extraction_method"),
    ):
        one = one.crossJoin(f)  # single rows
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return one.select(
        now.alias("generated_at"), F.lit(archive_root.rstrip("/").rpartition("/")[2]).alias("archive_root"), "document_count", "chunk_count", "by_category", "by_format", "by_extraction_method",
        "low_confidence_chunk_count", "entity_count", F.lit(ocr_available).alias("ocr_available"), F.lit(sample_mode).cast("int").alias("sample_mode"),
    )
