"""Table lookup: what tables say of an entity's attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared_folder
from ..functions.text import contains_either, normal_key, strip
from .match import KeyIndex, exact_or_partial


def subject(rows: Column, section: Column, title: Column) -> Column:
    """Whom a table is about: its ``name`` row, else its section (without ``Registry:``, and no infobox), else the title."""
    named = F.filter(rows, lambda r: (F.size(r) >= 2) & (normal_key(F.get(r, F.lit(0))) == "name"))
    prefix = "Registry:"
    of_section = F.when(section.startswith(prefix), strip(F.regexp_replace(section, f"^{prefix}", ""))).otherwise(section)
    usable = section.isNotNull() & (F.lower(section) != "infobox")
    return F.when(F.size(named) > 0, F.get(F.get(named, F.lit(0)), F.lit(1))).when(usable, of_section).otherwise(title)


def table_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of tables with their subject and its key."""
    tables = chunks.filter((F.col("chunk_type") == "table") & (F.size("table") > 0))
    with_subject = tables.withColumn("subject", subject(F.col("table"), F.col("section"), F.col("doc_title")))
    return with_subject.withColumn("subject_key", normal_key(F.col("subject")))


def table_rows(tables: DataFrame, *more: str) -> DataFrame:
    """(subject_key, subject, ord, id, row_no, label, label_key, value), and further columns; rows of fewer than two cells are none."""
    each = tables.select(*more, "subject_key", "subject", "ord", "id", F.posexplode("table").alias("row_no", "r")).filter(F.size("r") >= 2)
    label = F.get("r", F.lit(0))
    return each.select(*more, "subject_key", "subject", "ord", "id", "row_no", label.alias("label"), normal_key(label).alias("label_key"), F.get("r", F.lit(1)).alias("value"))


def lookup(tables: DataFrame, requests: DataFrame, keys: KeyIndex | None = None) -> DataFrame:
    """(qid, subject, label, value, id, ord, row_no) for (qid, entity, attribute).

    ``keys`` is an index of the tables' subject keys, if there is one. An attribute of "" is all of them. A label equal to the attribute in any row of a request keeps
    away rows whose label only is part of it or the other way round. Subjects of tables without rows count when entities are matched.
    """
    wanted = requests.select("qid", normal_key(F.col("entity")).alias("want"), F.col("attribute") == "", normal_key(F.col("attribute")).alias("attr"))
    wanted = wanted.toDF("qid", "want", "all", "attr")
    if keys is None:
        shared_folder(requests.sparkSession)
        distinct = tables.select(F.col("subject_key").alias("key")).distinct().checkpoint()  # read several times, and made of all tables
    found = exact_or_partial(wanted.select("qid", "want"), keys or distinct)
    #: only the rows of tables that are found
    rows = table_rows(found.join(tables, F.col("key") == F.col("subject_key")), "qid").join(wanted.select("qid", "all", "attr"), "qid")
    rows = rows.withColumn("exact", F.col("label_key") == F.col("attr")).filter(F.col("all") | F.col("exact") | contains_either(F.col("label_key"), F.col("attr")))
    rows = rows.withColumn("any_exact", F.max("exact").over(Window.partitionBy("qid"))).filter(F.col("all") | ~F.col("any_exact") | F.col("exact"))
    return rows.select("qid", "subject", "label", "value", "id", "ord", "row_no")
