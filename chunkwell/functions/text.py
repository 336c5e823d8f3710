"""Column expressions for text and tables; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_CHUNK_CHARS, MAX_TITLE_CHARS

NO_STRINGS = "array<string>"
#: Unicode's white space, which is what ``\s`` is with ``(?U)``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode has it (``trim`` knows spaces only); what lies between is not looked at."""
    return F.btrim(text, F.lit(WHITE))


def normal_key(text: Column) -> Column:
    return F.lower(strip(text))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clean_links(text: Column) -> Column:
    """``[[Name|shown]]`` and ``[[Name#part]]`` to ``Name``, without outer spaces."""
    return F.regexp_replace(text, r"(?U)\[\[\s*([^\]|#]*?[^\]|#\s])\s*(?:[|#][^\]]*)?\]\]", "$1")


def not_blank(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def pack(units: Column, most: int = MAX_CHUNK_CHARS, clean: bool = True) -> Column:
    """Units joined by lines into pieces of about ``most`` characters; each unit counts one more than its length, and none is cut.
    Units are stripped and blank ones left out, unless they are ``clean`` already (False).

    A fold, not a window: where a piece ends depends on where the one before it did.
    """
    start = F.struct(F.array().cast(NO_STRINGS).alias("done"), F.lit(None).cast("string").alias("piece"), F.lit(0).alias("n"))

    def add(state: Column, unit: Column) -> Column:
        full = state["piece"].isNotNull() & (state["n"] + F.length(unit) + 1 > most)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["piece"])).otherwise(state["done"]).alias("done"),
            F.when(full | state["piece"].isNull(), unit).otherwise(F.concat(state["piece"], F.lit("\n"), unit)).alias("piece"),
            (F.when(full, F.lit(0)).otherwise(state["n"]) + F.length(unit) + 1).alias("n"),
        )

    def end(state: Column) -> Column:
        return F.when(state["piece"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["piece"]))

    return F.aggregate(not_blank(units) if clean else units, start, add, end)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, as a lambda's variable, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_long(text: Column, most: int = MAX_CHUNK_CHARS) -> Column:
    """Pieces of a long text: cut at blank lines, else at lines, else after sentences."""

    def sentences(whole: Column) -> Column:
        return pack(F.split(whole, r"(?U)(?<=[.!?])\s+"), most)

    def parts(whole: Column) -> Column:
        lines = lambda: bound(not_blank(F.split(whole, "\n")), lambda u: F.when(F.size(u) >= 2, pack(u, most, False)).otherwise(sentences(whole)))
        return bound(not_blank(F.split(whole, "\n\n")), lambda u: F.when(F.size(u) >= 2, pack(u, most, False)).otherwise(lines()))

    return bound(strip(text), lambda w: F.when(w == "", F.array().cast(NO_STRINGS)).when(F.length(w) <= most, F.array(w)).otherwise(parts(w)))


def clean_rows(rows: Column) -> Column:
    """Cells without outer white space, empty where null."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))


def any_cell(rows: Column) -> Column:
    return F.exists(rows, lambda r: F.exists(r, lambda c: c != ""))


def table_text(rows: Column, cells: str = " | ", ends: str = "") -> Column:
    """A table as lines: for tagging with bars, for searching with spaces and a line end after each row."""
    line = lambda r: F.concat(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), cells), F.lit(ends))
    return F.array_join(F.transform(rows, line), "" if ends else "\n")


def search_text(text: Column, rows: Column) -> Column:
    """The text if there is one, even an empty one, else the table's cells."""
    return F.coalesce(text, table_text(rows, " ", "\n"), F.lit(""))


def file_title(stem: Column) -> Column:
    """A file's name as a title: every run of letters begins with a capital."""
    words = F.regexp_extract_all(strip(F.translate(stem, "_-", "  ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def page_title(text: Column, most: int = MAX_TITLE_CHARS) -> Column:
    """A title from the first page's text: its first paragraph on one line if short, else its first line if short."""
    paragraph = strip(F.regexp_replace(F.get(F.split(text, "\n\n"), F.lit(0)), r"(?U)\s+", " "))
    line = strip(F.get(F.split(text, r"\r\n|[\n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), F.lit(0)))
    return F.when(F.length(paragraph) <= most, paragraph).when((line != "") & (F.length(line) <= most), line)


def contains_either(a: Column, b: Column) -> Column:
    """One is part of the other; an empty one is part of all."""
    return F.contains(a, b) | F.contains(b, a)
