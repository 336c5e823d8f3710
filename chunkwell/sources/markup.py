"""Markdown and plain text to blocks, by windows over the lines of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_links, not_blank, strip

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Hashes of a heading, signs of the line under a table's head.
LEAST_HASHES, MOST_HASHES = 2, 6
RULE_SIGNS = ":|-"


def universal(text: Column) -> Column:
    """With line feeds as the only line ends, as a text file is read."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def heading(line: Column) -> Column:
    """What follows two to six hashes and white space at the beginning of a line; null for other lines. A seventh hash is part of what follows only after white space."""
    rest = F.regexp_replace(line, "^#+", "")
    hashes = F.length(line) - F.length(rest)
    text = strip(rest)
    return F.when((hashes >= LEAST_HASHES) & (hashes <= MOST_HASHES) & (text != "") & (F.length(text) < F.length(rest)), text)


def rule(line: Column) -> Column:
    """Lines of nothing but the signs of a rule and white space."""
    return strip(F.translate(line, RULE_SIGNS, "")) == ""


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """``doc_id, pos, type, text, rows`` and, in rows of type ``title``, the first ``# `` line, for columns doc_id and text.

    The title line is as if it were not there; a second one is text. Headings, blank lines
    and changes between text and table end a block.
    """
    lines = texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_ENDS)).alias("pos", "raw"))
    lines = lines.select("doc_id", "pos", strip(F.col("raw")).alias("line"))
    doc = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("line").startswith("# "), F.col("pos"))).over(doc)
    kind = F.when(F.col("pos") == F.col("first"), "title").when(heading(F.col("line")).isNotNull(), "heading").when(F.col("line").startswith("|"), "table").when(F.col("line") == "", "blank").otherwise("text")
    lines = lines.withColumn("first", first).withColumn("type", kind)
    body = lines.filter("type <> 'title'")
    order = doc.orderBy("pos")
    new = (F.col("type") == "heading") | ~F.col("type").eqNullSafe(F.lag("type").over(order))
    runs = body.withColumn("run", F.sum(new.cast("int")).over(order)).filter("type <> 'blank'")
    blocks = runs.groupBy("doc_id", "run", "type").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    lines_of = F.transform("lines", lambda x: x["line"])
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: clean_links(strip(c)))
    rows = F.filter(F.transform(F.filter(lines_of, lambda x: ~rule(x)), cells), lambda r: F.exists(r, lambda c: c != ""))
    text = F.when(F.col("type") == "heading", heading(F.get(lines_of, F.lit(0)))).when(F.col("type") == "text", clean_links(strip(F.array_join(lines_of, " "))))
    out = blocks.select("doc_id", F.col("pos").cast("long"), "type", text.alias("text"), F.when(F.col("type") == "table", rows).alias("rows"))
    out = out.filter((F.col("type") != "table") | (F.size("rows") > 0))
    titles = lines.filter("type = 'title'").select("doc_id", F.lit(-1).cast("long").alias("pos"), "type", strip(F.expr("substring(line, 3)")).alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return out.unionByName(titles)


def plain_blocks(texts: DataFrame) -> DataFrame:
    """As ``markdown_blocks``: a title only if the first line is one, paragraphs between blank lines."""
    text = F.coalesce("text", F.lit(""))
    line = F.get(F.split(text, LINE_ENDS), F.lit(0))
    titled = texts.select("doc_id", text.alias("text"), line.alias("line"))
    title = F.when(strip(F.col("line")).startswith("# "), strip(F.substring(strip(F.col("line")), F.lit(3), F.length("line"))))
    body = F.when(title.isNotNull(), F.expr("substring(text, length(line) + 2)")).otherwise(F.col("text"))
    titled = titled.select("doc_id", title.alias("title"), body.alias("body"))
    none = F.lit(None).cast("array<array<string>>").alias("rows")
    paragraphs = titled.select("doc_id", F.posexplode(not_blank(F.split("body", r"(?U)\n\s*\n"))).alias("pos", "text"))
    out = paragraphs.select("doc_id", F.col("pos").cast("long"), F.lit("text").alias("type"), "text", none)
    return out.unionByName(titled.filter("title is not null").select("doc_id", F.lit(-1).cast("long").alias("pos"), F.lit("title").alias("type"), F.col("title").alias("text"), none))


def vocabulary(texts: DataFrame) -> DataFrame:
    """Names of entities: the first ``# `` heading of each text."""
    name = strip(F.regexp_extract("text", r"(?mU)^#\s+(.+)$", 1))
    return texts.select(name.alias("name")).filter("name <> ''").distinct()

