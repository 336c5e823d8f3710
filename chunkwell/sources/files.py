"""The walk over an archive: a row for each file, with its category, format and place in the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import IMAGES, TIERS
from .folders import Folders, file_system

#: Formats by the end of a path, the longer ones first.
FORMATS = ((".scan.pdf", "scan_pdf"), (".pdf", "pdf"), (".docx", "docx"), (".md", "md"), (".txt", "txt"))


def format_of(path: Column) -> Column:
    """Null where the format is not known; the case of letters makes no difference."""
    out = F.lit(None).cast("string")
    for suffix, name in reversed(FORMATS):
        out = F.when(F.lower(path).endswith(suffix), name).otherwise(out)
    return out


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), category)


def tier_of(category: Column) -> Column:
    """The reliability of a category; an unknown one is an error."""
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(category, F.lit("null")))).cast("string"))


def classify(files: DataFrame, images: dict[str, str] = IMAGES) -> DataFrame:
    """(doc_id, category, format, rank, content) of files (path, content), with paths from the archive's root.

    Files directly in each category's folder, without hidden ones and those of unknown formats, and those of image folders (folder to category), whatever their
    names. ``rank`` is the place of the folder in the walk.
    """
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    places = [(c, c, None) for c in TIERS] + [(f, c, "image") for f, c in images.items()]
    rows = files.select(F.col("path").alias("doc_id"), folder.alias("folder"), name.alias("name"), "content").filter(~F.col("name").startswith("."))
    known = F.map_from_entries(F.array(*[F.struct(F.lit(f), F.struct(F.lit(c).alias("category"), F.lit(kind).cast("string").alias("format"), F.lit(i).alias("rank"))) for i, (f, c, kind) in enumerate(places)]))
    placed = rows.withColumn("at", F.try_element_at(known, F.col("folder"))).filter("at is not null")
    out = placed.select("doc_id", "at.category", F.coalesce("at.format", format_of(F.col("name"))).alias("format"), "at.rank", "content")
    return out.filter("format is not null")


def walk(spark: SparkSession, root: str, images: dict[str, str] = IMAGES, only: tuple[str, ...] | None = None) -> DataFrame:
    """``classify`` of an archive's files, of the folders ``only`` or of all; one scan, which lists and reads on the executors. Folders that are not there are passed over.

    Where Arrow has no file system for the archive's store, Spark's file source reads it, which knows no empty files and no names that begin with ``_``.
    """
    root, folders = root.rstrip("/"), [f for f in (*TIERS, *images) if only is None or f in only]
    try:
        file_system(root)
    except ValueError:
        at = "{" + ",".join(folders) + "}"
        found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(f"{root}/{at}/*")
        folder = F.regexp_extract("path", "/(" + "|".join(sorted(folders, key=len, reverse=True)) + ")/[^/]*$", 1)
        return classify(found.select(F.concat_ws("/", folder, F.element_at(F.split("path", "/"), -1)).alias("path"), "content"), images)
    spark.dataSource.register(Folders)
    found = spark.read.format(Folders.name()).option("root", root).option("folders", "\n".join(folders)).option("shares", spark.sparkContext.defaultParallelism)
    return classify(found.load().select("path", "content"), images)


def suffix(path: Column) -> Column:
    """By what samples are grouped: a format of several endings, else a name's last ending, in lower case."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.endswith(".scan.pdf"), ".scan.pdf").otherwise(F.regexp_extract(name, r".(\.[^.]*)$", 1))


def sample(files: DataFrame, n: int | None, by: tuple[str | Column, ...] | None = None, order: str = "doc_id") -> DataFrame:
    """The first ``n`` of each group, which without ``by`` is a folder's files of one ending; all for no ``n`` or 0."""
    if not n:
        return files
    window = Window.partitionBy(*(by or ("rank", suffix(F.col("doc_id"))))).orderBy(order)
    return files.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")
