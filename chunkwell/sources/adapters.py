"""Sources that need a library: PDF, DOCX and OCR. The library comes as a function that is handed in.

A parser takes (bytes, doc_id) and gives blocks as dicts with type, page, text, rows
and confidence; it runs on the executors, a file at a time. ``pdf_parser``, ``docx_parser`` and ``recogniser`` make one of the
usual libraries if they can be imported. A recogniser reads pages that are pictures: ``scan_parser``, ``image_parser`` and ``with_recognised`` make
parsers of it, in two steps: a file is split into its pages' pictures, and these are dealt out to all tasks and read, as that is what takes long.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reachable, shared_folder
from ..schema import OCR_FLOOR, PARSED, SPLIT

Parser = Callable[[bytes, str], Iterable[dict]]
#: Styles of paragraphs that are headings.
HEADINGS = ("Title", "Heading 1", "Heading 2", "Heading 3", "Heading 4")
#: Modes of recognition in the order of preference, dots an inch of a page's picture, times a plate is enlarged.
MODES, DPI, ENLARGED = (6, 12), 300, 2


#: Blocks that are pictures yet, and the type each has when it is read.
PICTURES = {"picture": "text", "picture among pages": "recognised"}
#: Pictures that a task reads, and bytes of them that it hands on at a time.
PICTURES_A_TASK, HANDED_ON, TASKS_A_CORE = 128, 16 << 20, 64


def parsed_blocks(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """``PARSED`` of files (doc_id, category, format, rank, text, content) in one pass: a row of type ``file`` for each, one of type ``raw`` with the
    text of those that have one, and the blocks of those whose format has a parser.

    Pictures of pages are written to the shared folder by the pass, and then read, each by itself, by as many tasks as their number asks for.
    """
    reachable(files.sparkSession)
    of_file, names = ["doc_id", "category", "format", "rank"], [f.name for f in SPLIT]

    def frame_of(rows: list[dict], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page": "Int32", "confidence": "Float64"})

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for file in frame.to_dict("records"):
                own = {**dict.fromkeys(names), **{k: file[k] for k in of_file}}
                rows.append({**own, "pos": -1, "type": "file"})
                if file["text"] is not None:
                    rows.append({**own, "pos": -1, "type": "raw", "text": file["text"]})
                elif parser := parsers.get(file["format"]):
                    for i, block in enumerate((parser.split if isinstance(parser, Paged) else parser)(file["content"], file["doc_id"])):
                        rows.append({**own, **block, "pos": i})
                        held += len(block.get("picture") or block.get("text") or "")
                        if held > HANDED_ON:
                            yield frame_of(rows, names)
                            rows, held = [], 0
            yield frame_of(rows, names)

    found = files.select(*of_file, "text", "content").mapInPandas(split, SPLIT)
    if not any(isinstance(p, Paged) for p in parsers.values()):
        return found.drop("picture")
    shared_folder(files.sparkSession)
    found = found.checkpoint()
    is_picture = F.col("type").isin(*PICTURES)
    n, plain = found.filter(is_picture).count(), found.filter(~is_picture).drop("picture")
    return plain.unionByName(read_pictures(found.filter(is_picture), n, parsers)) if n else plain


def read_pictures(pictures: DataFrame, n: int, parsers: dict[str, Parser]) -> DataFrame:
    """``PARSED`` of ``SPLIT`` rows that are pictures; those without text go."""
    names = [f.name for f in PARSED]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                made = parsers[row["format"]].made
                if found := read_picture(made, made.unpacked(row["picture"])):
                    page = None if pd.isna(row["page"]) else row["page"]
                    rows.append({**{k: row[k] for k in names}, **found, "type": PICTURES[row["type"]], "page": page, "rows": None})
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "confidence": "Float64"})

    cores = pictures.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, min(-(-n // PICTURES_A_TASK), TASKS_A_CORE * cores))
    return pictures.repartition(tasks, "doc_id", "pos").mapInPandas(read, PARSED)


def pdf_parser() -> Parser:
    """Each page's text, then its tables; a page with neither but with images needs OCR."""
    import io

    import pdfplumber

    def parse(content: bytes, doc_id: str) -> Iterator[dict]:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                text, tables = (page.extract_text() or "").strip(), page.extract_tables()
                if text:
                    yield {"type": "text", "page": number, "text": text}
                elif not tables and page.images:
                    yield {"type": "needs_ocr", "page": number}
                for rows in tables:
                    cells = [[(c or "").strip() for c in r] for r in rows]
                    if any(any(r) for r in cells):
                        yield {"type": "table", "page": number, "rows": cells}

    return parse


def docx_parser() -> Parser:
    """Paragraphs and tables in the order of the body."""
    import io

    import docx

    def parse(content: bytes, doc_id: str) -> Iterator[dict]:
        for item in docx.Document(io.BytesIO(content)).iter_inner_content():
            if hasattr(item, "rows"):
                cells = [[c.text.strip() for c in r.cells] for r in item.rows]
                if any(any(r) for r in cells):
                    yield {"type": "table", "rows": cells}
            elif text := item.text.strip():
                yield {"type": "heading" if item.style.name in HEADINGS else "text", "text": text}

    return parse


class Recogniser:
    """What recognition needs of its libraries; ``pages`` are pictures."""

    def page(self, content: bytes, number: int):
        """The picture of a page of a PDF, from 1 on."""
        raise NotImplementedError

    def count(self, content: bytes) -> int:
        """Pages of a PDF."""
        raise NotImplementedError

    def plate(self, content: bytes):
        """The picture of an image file, enlarged."""
        raise NotImplementedError

    def packed(self, picture) -> bytes:
        """A picture as it goes from one task to another."""
        return pickle.dumps(picture)

    def unpacked(self, content: bytes):
        return pickle.loads(content)

    def words(self, picture, mode: int) -> tuple[str, list[float]]:
        """The text read in a mode, and the confidence of each word, -1 for what is none."""
        raise NotImplementedError


def recogniser() -> Recogniser:
    """By the usual libraries; an ImportError or OSError if one of them, or the program behind it, is not there."""
    import io
    import shutil

    import fitz
    import pytesseract
    from PIL import Image

    if not shutil.which("tesseract"):
        raise OSError("no tesseract program")

    class Usual(Recogniser):
        def page(self, content, number):
            with fitz.open(stream=content, filetype="pdf") as pdf:
                return Image.open(io.BytesIO(pdf[number - 1].get_pixmap(dpi=DPI).tobytes("png"))).convert("L")

        def count(self, content):
            with fitz.open(stream=content, filetype="pdf") as pdf:
                return len(pdf)

        def plate(self, content):
            grey = Image.open(io.BytesIO(content)).convert("L")
            return grey.resize((grey.width * ENLARGED, grey.height * ENLARGED))

        def packed(self, picture):
            out = io.BytesIO()
            picture.save(out, "PNG")
            return out.getvalue()

        def unpacked(self, content):
            return Image.open(io.BytesIO(content))

        def words(self, picture, mode):
            flags = f"--psm {mode}"
            data = pytesseract.image_to_data(picture, config=flags, output_type=pytesseract.Output.DICT)
            return pytesseract.image_to_string(picture, config=flags), [float(c) for c in data["conf"]]

    return Usual()


def read_picture(made: Recogniser, picture) -> dict | None:
    """Text and confidence of the mode with the highest mean over words, the first of equal ones; none without text or below the floor."""
    best = None
    for mode in MODES:
        text, found = made.words(picture, mode)
        of_words = [c for c in found if c != -1]
        mean = sum(of_words) / len(of_words) if of_words else -1.0
        if best is None or mean > best["confidence"]:
            best = {"type": "text", "text": text.strip(), "confidence": mean}
    return best if best["text"] and best["confidence"] >= OCR_FLOOR else None


@dataclass(frozen=True)
class Paged:
    """A parser in two steps: ``split`` gives blocks of which some are pictures, packed in ``picture``; ``made`` reads one of them. Called, it does both."""

    made: Recogniser
    split: Parser

    def __call__(self, content: bytes, doc_id: str) -> Iterator[dict]:
        for block in self.split(content, doc_id):
            if block["type"] not in PICTURES:
                yield block
            elif found := read_picture(self.made, self.made.unpacked(block["picture"])):
                yield {**found, "type": PICTURES[block["type"]], **({"page": block["page"]} if "page" in block else {})}


def scan_parser(made: Recogniser) -> Paged:
    """Every page of a scanned PDF."""

    def split(content: bytes, doc_id: str) -> Iterator[dict]:
        for number in range(1, made.count(content) + 1):
            yield {"type": "picture", "page": number, "picture": made.packed(made.page(content, number))}

    return Paged(made, split)


def image_parser(made: Recogniser) -> Paged:
    """A plate; without text it has no block."""

    def split(content: bytes, doc_id: str) -> Iterator[dict]:
        yield {"type": "picture", "picture": made.packed(made.plate(content))}

    return Paged(made, split)


def with_recognised(parser: Parser, made: Recogniser | None) -> Parser:
    """A PDF's parser whose pages that need it are recognised, in one piece each; without a recogniser they go."""

    def split(content: bytes, doc_id: str) -> Iterator[dict]:
        for block in parser(content, doc_id):
            if block["type"] != "needs_ocr":
                yield block
            elif made:
                yield {"type": "picture among pages", "page": block["page"], "picture": made.packed(made.page(content, block["page"]))}

    return Paged(made, split) if made else split


def best_ocr(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of several recognitions of a page (mode, text, conf: confidences of words, -1 for none) the one with the highest mean.

    Of equal ones the first mode's. Those without text or below the floor go.
    """
    words = F.filter("conf", lambda c: c != -1)
    mean = F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda s, c: s + c) / F.size(words)).otherwise(-1.0)
    scored = candidates.withColumn("confidence", mean)
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("mode", "text", "confidence"), F.struct("confidence", -F.col("mode"))).alias("b"))
    return best.select(*keys, "b.*").filter((F.trim("text") != "") & (F.col("confidence") >= OCR_FLOOR))
