"""The tables of the engine, and the fixed values of its rules."""

from __future__ import annotations

from pyspark.sql import types as T

#: Characters of a chunk, entities of a chunk, confidence below which text is doubtful, confidence
#: that recognised text needs, citations of an edge, results of a search, steps of a question, characters of a title and of evidence.
MAX_CHUNK_CHARS = 1600
MAX_ENTITIES = 25
LOW_CONFIDENCE = 60.0
OCR_FLOOR = 35.0
MAX_CITATIONS = 10
RESULT_LIMIT = 5
MAX_STEPS = 6
MAX_TITLE_CHARS = 120
EVIDENCE_CHARS = 500

#: Categories in the order of the walk, and the reliability of each.
TIERS = {
    "chronicles": "narrative",
    "codex": "official",
    "ephemera": "in_world_unreliable",
    "wiki": "reference",
}

#: Folders of images and the category of each; a further folder of the same images is left out.
IMAGES = {"codex/images": "codex", "wiki/images": "wiki"}

STRING, TABLE = T.StringType(), T.ArrayType(T.ArrayType(T.StringType()))

#: Fixed names: the fields of chunks and of the description of a corpus are what archives are exchanged by.
CHUNK = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("doc_id", STRING),
        T.StructField("doc_title", STRING),
        T.StructField("category", STRING),
        T.StructField("format", STRING),
        T.StructField("reliability_tier", STRING),
        T.StructField("page", T.IntegerType()),
        T.StructField("section", STRING),
        T.StructField("chunk_type", STRING),
        T.StructField("text", STRING),
        T.StructField("table", TABLE),
        T.StructField("entities", T.ArrayType(STRING)),
        T.StructField("extraction_method", STRING),
        T.StructField("extraction_confidence", T.DoubleType()),
        T.StructField("low_confidence", T.BooleanType()),
        T.StructField("char_count", T.IntegerType()),
    ]
)
COUNTS = T.MapType(STRING, T.IntegerType())
META = T.StructType(
    [
        T.StructField("generated_at", STRING),
        T.StructField("archive_root", STRING),
        T.StructField("document_count", T.IntegerType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("by_category", COUNTS),
        T.StructField("by_format", COUNTS),
        T.StructField("by_extraction_method", COUNTS),
        T.StructField("low_confidence_chunk_count", T.IntegerType()),
        T.StructField("entity_count", T.IntegerType()),
        T.StructField("ocr_available", T.BooleanType()),
        T.StructField("sample_mode", T.IntegerType()),
    ]
)
ARTIFACT = T.StructType([T.StructField("meta", META), T.StructField("chunks", T.ArrayType(CHUNK))])

#: What parsers make of a document: blocks in order. ``type`` is text, table, heading or needs_ocr.
BLOCK = T.StructType(
    [
        T.StructField("doc_id", STRING),
        T.StructField("pos", T.LongType()),
        T.StructField("type", STRING),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", STRING),
        T.StructField("rows", TABLE),
        T.StructField("confidence", T.DoubleType()),
    ]
)

#: Blocks with what is known of their file, and rows of type ``file`` and ``raw``.
PARSED = T.StructType([BLOCK["doc_id"], T.StructField("category", STRING), T.StructField("format", STRING), T.StructField("rank", T.IntegerType()), *BLOCK.fields[1:]])
#: The same with pictures of pages that are not read yet.
SPLIT = T.StructType([*PARSED.fields, T.StructField("picture", T.BinaryType())])
