"""Files as a source: bytes to text by format, with errors as values.

A file that cannot be read never stops the others: extraction returns (text, error). Plain text and all routing are
expressions; the zipped and PDF formats are read in one Arrow pass, a file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.markdown import WEB_SPACE
from . import pdf

# Formats, and what users are told.
SUPPORTED = ("pdf", "docx", "pptx", "txt")
LEGACY = {"doc": "docx", "ppt": "pptx"}
UNSUPPORTED = 'Unsupported file type ".%s". Supported formats: pdf, docx, pptx, txt.'
TOO_LARGE = "File is too large (%s MB). Maximum allowed size is 20 MB. Please compress or split the file."
ERRORS = {
    "docx": "No text found in this Word document. It may be empty or image-only.",
    "doc": "Legacy .doc format has limited support. Please open the file in Word and save it as .docx, then re-upload.",
    "ppt": "Legacy .ppt binary format cannot be extracted in the browser. Open the file in PowerPoint and save as .pptx, then re-upload.",
    "pptx unreadable": "Could not open this PowerPoint file. It may be corrupted or in the older .ppt binary format. Please save it as .pptx and try again.",
    "pptx no slides": "No slides found in this PowerPoint file. It may be an unsupported format or an empty presentation.",
    "pptx no text": "No readable text found in this presentation. Slides may contain only images or shapes without text.",
    "pdf": "No text could be extracted from this PDF. It may be a scanned image-only PDF. Try running OCR on it first.",
    "pdf unreadable": "This PDF uses features that the built-in reader does not know.",
}
SLIDE = re.compile(r"ppt/slides/slide[0-9]+\.xml", re.IGNORECASE)


class ExtractionError(ValueError):
    """A message for the user about one file."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, ext, content: a row per file; columns that are not used are not read, content included.

    Spark's reader passes over files without bytes, so those are listed by themselves.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    empty = spark.createDataFrame([(p, 0, bytearray()) for p in _without_bytes(spark, path)], "path string, length long, content binary")
    return entries(raw.unionByName(empty))


def _without_bytes(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folder's files that have no bytes, but for names that Spark hides."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, out = system.listFiles(root, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and f.getPath().getName()[:1] not in "._":
            out.append(f.getPath().toString())
    return out


def entries(raw: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.sha2("path", 256).alias("id"), "path", name.alias("name"), F.col("length").alias("size"), tx.extension(name).alias("ext"), "content")


def too_large(size: Column) -> Column:
    return size > tx.MOST_FILE_BYTES


def route(ext: Column, size: Column) -> Column:
    """too_large, pdf, docx, doc, pptx, ppt, txt or unsupported; size is looked at first."""
    known = ext.isin(*SUPPORTED, *LEGACY)
    return F.when(too_large(size), "too_large").when(known, ext).otherwise("unsupported")


def route_error(ext: Column, size: Column) -> Column:
    """The message for files that are not opened; null for others."""
    megabytes = tx.one_decimal(size / F.lit(float(tx.MIB)))
    by = route(ext, size)
    return F.when(by == "too_large", F.format_string(TOO_LARGE, megabytes)).when(by == "unsupported", F.format_string(UNSUPPORTED, ext))


def decoded(content: Column) -> Column:
    """UTF-8 text; malformed bytes become U+FFFD and a leading byte-order mark goes. Neither trimmed nor refused when empty."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\A\ufeff", "")


def slide_text(xml: str) -> str:
    for a, b in tx.SLIDE_TEXT:
        xml = xml.replace(a, b)
    xml = re.sub("<[^>]+>", "", xml)
    for a, b in tx.SLIDE_ENTITIES:
        xml = xml.replace(a, b)
    return re.sub(f"[{WEB_SPACE}]{{2,}}", " ", xml).strip(WEB_SPACE)


def _first_number(name: str) -> int:
    m = re.search("[0-9]+", name)
    return int(m[0]) if m else 0


def pptx_text(data: bytes) -> str:
    """Slides in order of their numbers. One without text takes up its place in the numbering but is not shown."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = sorted(filter(SLIDE.fullmatch, archive.namelist()), key=_first_number)
        texts = [slide_text(archive.read(n).decode("utf-8", "replace")) for n in names]
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
        raise ExtractionError(ERRORS["pptx unreadable"]) from e
    if not names:
        raise ExtractionError(ERRORS["pptx no slides"])
    shown = "\n\n".join(f"[Slide {i}]\n{t}" for i, t in enumerate(texts, 1) if t)
    if not shown:
        raise ExtractionError(ERRORS["pptx no text"])
    return shown.strip(WEB_SPACE)


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CHOICE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_MARKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}


def _paragraph(node: ElementTree.Element, inner: list[str]) -> str:
    """The node's own text; paragraphs within it, as in text boxes, go to inner. Of alternatives one is read, the fallback if there is one."""
    text = []
    for e in node:
        if e.tag == f"{_WORD}p":
            own: list[str] = []
            inner.append(_paragraph(e, own))
            inner += own
        elif e.tag == f"{_WORD}t":
            text.append(e.text or "")
        elif e.tag in _MARKS:
            text.append(_MARKS[e.tag])
        elif e.tag == f"{_CHOICE}AlternateContent":
            chosen = e.find(f"{_CHOICE}Fallback")
            chosen = e.find(f"{_CHOICE}Choice") if chosen is None else chosen
            if chosen is not None:
                text.append(_paragraph(chosen, inner))
        else:
            text.append(_paragraph(e, inner))
    return "".join(text)


def docx_text(data: bytes) -> str:
    """The paragraphs' text, a blank line after each, those of a text box after the one that holds it; tabs and breaks as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs: list[str] = []
    _paragraph(root, paragraphs)
    text = "\n\n".join(paragraphs).strip(WEB_SPACE)
    if not text:
        raise ExtractionError(ERRORS["docx"])
    return text


def pdf_text(data: bytes) -> str:
    """Each page's shown strings joined by a space under its number; a page without text still has its number."""
    try:
        found = pdf.pages(data)
    except pdf.PdfError as e:
        raise ExtractionError(ERRORS["pdf unreadable"]) from e
    text = "".join(f"[Page {i}]\n{t}\n\n" for i, t in enumerate(found, 1)).strip(WEB_SPACE)
    if not text:
        raise ExtractionError(ERRORS["pdf"])
    return text


Extractor = Callable[[bytes], str]
EXTRACTORS: dict[str, Extractor] = {"pdf": pdf_text, "docx": docx_text, "pptx": pptx_text}


def extract(kind: str, data: bytes, extractors: dict[str, Extractor] = EXTRACTORS) -> tuple[str | None, str | None]:
    """(text, error) of a file by its ending. Whatever goes wrong with a legacy format has one message."""
    try:
        return extractors[LEGACY.get(kind, kind)](data), None
    except Exception as e:  # noqa: BLE001  one file's failure is that file's result
        if kind in LEGACY:
            return None, ERRORS[kind]
        return None, str(e) or type(e).__name__


def extracted(entries: DataFrame, extractors: dict[str, Extractor] = EXTRACTORS) -> DataFrame:
    """entries without content, with text and error; one of them is null. Other extractors can be plugged in by format.

    Only the files that need Python cross to it; texts and refusals stay on the JVM's side.
    """
    ext, size = F.col("ext"), F.col("size")
    routed = entries.withColumns({"_route": route(ext, size), "_refusal": route_error(ext, size)})
    binary = F.col("_route").isin("pdf", "docx", "doc", "pptx", "ppt")
    keep = [c for c in entries.columns if c != "content"]
    plain = routed.where(~binary).select(*keep, F.when(F.col("_route") == "txt", decoded(F.col("content"))).alias("text"), F.col("_refusal").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A row at a time to the readers, whose texts are small beside the files; the other columns pass as they are.
            found = [extract(k, c.as_py() or b"", extractors) for k, c in zip(b.column("_route").to_pylist(), b.column("content"))]
            text, error = (pa.array([f[i] for f in found], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text, error], [*keep, "text", "error"])

    zipped = routed.where(binary).select(*keep, "content", "_route").mapInArrow(run, plain.schema)
    return plain.unionByName(zipped)
