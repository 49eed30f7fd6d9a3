"""Files as a source: an inventory without contents, and texts read from several formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MEDIA_EXTENSIONS, OFFICE_EXTENSIONS, TEXT_EXTENSIONS
from ..functions.text import extension
from ..operators.incremental import indexable

#: Limits of what is read of one file.
MOST_BYTES, MOST_SHEET_BYTES = 100 << 20, 10 << 20
MOST_PARAGRAPHS, MOST_TABLES, MOST_TABLE_ROWS, MOST_SHEET_ROWS, MOST_SLIDES = 500, 20, 500, 2000, 50


def inventory(spark: SparkSession, roots: list[str], keywords: list[str] | None = None, notes: bool = False) -> DataFrame:
    """(filepath, filename, mtime, length, source_type) of all files that an index takes. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "modificationTime", "length")
    path = F.regexp_replace("path", r"^file:/*", "/")
    named = rows.select(path.alias("filepath"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.unix_micros("modificationTime").cast("double").alias("t"), "length")
    named = named.select("filepath", "filename", (F.col("t") / 1e6).alias("mtime"), "length", F.lit("mweb" if notes else "file").alias("source_type"))
    return indexable(named, [".md"] if notes else [*TEXT_EXTENSIONS, *OFFICE_EXTENSIONS, *MEDIA_EXTENSIONS], keywords, MOST_BYTES)


def _texts(root: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in root.iter() if x.tag.endswith("}" + tag))


def _parts(archive: zipfile.ZipFile, pattern: str) -> list[ElementTree.Element]:
    found = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n)))
    return [ElementTree.fromstring(archive.read(n)) for _, n in found]


def read_docx(raw: bytes) -> tuple[str, list[str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    lines, heads, tables = [], [], 0
    for block in body.iter():
        if block.tag.endswith("}body"):
            for x in block:
                if x.tag.endswith("}p") and len(lines) < MOST_PARAGRAPHS and (text := _texts(x, "t").strip()):
                    lines.append(text)
                    if any(s.tag.endswith("}pStyle") and str(next(iter(s.attrib.values()), "")).lower().startswith(("heading", "title")) for s in x.iter()):
                        heads.append(text)
                elif x.tag.endswith("}tbl") and tables < MOST_TABLES:
                    tables += 1
                    for row in [r for r in x if r.tag.endswith("}tr")][:MOST_TABLE_ROWS]:
                        cells = dict.fromkeys(t for c in row if c.tag.endswith("}tc") and (t := _texts(c, "t").strip()))
                        if cells:
                            lines.append(" | ".join(cells))
    return "\n".join(lines), heads


def read_xlsx(raw: bytes) -> tuple[str, list[str]]:
    if len(raw) > MOST_SHEET_BYTES:
        return "", []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        shared = [_texts(x, "t") for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in archive.namelist() else []
        titles = [x.attrib["name"] for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
        sheets = _parts(archive, r"xl/worksheets/sheet(\d+)\.xml")
    lines, rows = [], 0
    for title, sheet in zip(titles, sheets, strict=False):
        lines.append(f"Sheet: {title}")
        for row in (r for r in sheet.iter() if r.tag.endswith("}row")):
            if rows >= MOST_SHEET_ROWS:
                break
            rows += 1
            cells = []
            for c in row:
                value = _texts(c, "v") or _texts(c, "t")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            if any(cells):
                lines.append(" ".join(x for x in cells if x))
    return "\n".join(lines), titles


def read_pptx(raw: bytes) -> tuple[str, list[str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        slides = _parts(archive, r"ppt/slides/slide(\d+)\.xml")[:MOST_SLIDES]
    lines, heads = [], []
    for slide in slides:
        for shape in (x for x in slide.iter() if x.tag.endswith("}sp")):
            text = _texts(shape, "t").strip()
            if text:
                lines.append(text)
                if any(p.tag.endswith("}ph") and p.attrib.get("type") in ("title", "ctrTitle") for p in shape.iter()):
                    heads.append(text)
    return "\n".join(lines), heads


READERS = {".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx}


def read_text(ext: str, raw: bytes) -> tuple[str, list[str]]:
    """Text and headings of a file. Office files must be archives; media, broken files and formats without a reader have no text."""
    if ext in TEXT_EXTENSIONS:
        return raw.decode("utf-8", errors="ignore"), []
    if ext in READERS and raw[:4] == b"PK\x03\x04":
        try:
            return READERS[ext](raw)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
            return "", []
    return "", []


def contents(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """Adds content and headings to an inventory (or a part of it, such as what a parse cache lacks)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select(F.regexp_replace("path", r"^file:/*", "/").alias("filepath"), "content")
    rows = files.join(raw, "filepath").withColumn("ext", extension(F.col("filename"))).select("filepath", "ext", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_text(e, bytes(c)) for e, c in zip(frame["ext"], frame["content"], strict=True)]
            yield pd.DataFrame({"filepath": frame["filepath"], "content": [t for t, _ in read], "headings": [h for _, h in read]})

    return files.join(rows.mapInPandas(run, "filepath string, content string, headings array<string>"), "filepath")


def preview(files: DataFrame, most: int = 512 << 10, sniffed: int = 8192) -> DataFrame:
    """The first bytes of files (content, binary) as text, or null with is_binary where a zero byte is among the first ones."""
    head = F.substring("content", 1, sniffed)
    binary = F.instr(F.hex(head), "00") > 0
    zero = F.exists(F.sequence(F.lit(1), F.greatest(F.length(head), F.lit(1))), lambda i: F.hex(F.substring(head, i, F.lit(1))) == "00")
    return files.withColumn("is_binary", binary & zero).withColumn("preview", F.when(~F.col("is_binary"), F.expr(f"try_validate_utf8(cast(substring(content, 1, {most}) AS string))")))


QREL = "query string, query_type string, relevant_files array<struct<filepath:string,grade:int>>, must_include array<string>, notes string"


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries from JSON lines: blank lines and comments are skipped; broken rows, repeated files, grades outside 0 to 3 and
    queries without a relevant file are errors."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    rows = lines.select("value", F.from_json("value", QREL).alias("x")).select("value", "x.*")
    wrong = (
        F.when(F.col("query").isNull() | F.col("relevant_files").isNull(), "not a judged query: ")
        .when(F.size("relevant_files") != F.size(F.array_distinct(F.transform("relevant_files", lambda r: r["filepath"]))), "a file is judged twice: ")
        .when(F.exists("relevant_files", lambda r: ~F.coalesce(r["grade"].between(0, 3), F.lit(False))), "a grade is not within 0 to 3: ")
        .when(~F.exists("relevant_files", lambda r: r["grade"] > 0), "no file is relevant: ")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("value")))).otherwise(F.col("query"))
    return rows.select(checked.alias("query"), "query_type", "relevant_files", "must_include", "notes")
