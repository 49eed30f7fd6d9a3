"""Cutting texts into chunks: recursive splitting by separators, Markdown sections, chunk records and their ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import headings, truncate

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """The parts of a text, each with the separator before it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [x for x in (first, *(separator + r for r in rest)) if x]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces of at most `size` characters; each begins with what the last one ended with, up to `overlap` characters."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    yield "".join(held).strip()


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that serves."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) <= size:
            short.append(piece)
            continue
        if short:
            out.extend(_merged(short, size, overlap))
            short = []
        out.extend(split_text(piece, size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [piece])
    if short:
        out.extend(_merged(short, size, overlap))
    return [x for x in out if x]


_HEADER = re.compile(r"(#{1,6})(?:\s+(.*))?$")


def sections(text: str) -> list[tuple[list[str], str]]:
    """(headings above, body) of each part of a Markdown text. Headings inside of code fences don't count."""
    out: list[tuple[list[str], str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fence = ""

    def close() -> None:
        joined = "  \n".join(body).strip()
        if joined:
            out.append(([t for _, t in path], joined))
        body.clear()

    for line in text.split("\n"):
        line = line.strip()
        mark = line[:3]
        if mark in ("```", "~~~") and (not fence or fence == mark):
            fence = "" if fence else mark
        header = None if fence else _HEADER.match(line)
        if header:
            close()
            level = len(header[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, (header[2] or "").strip()))
        elif line:
            body.append(line)
    close()
    return out


#: Characters of texts that a task cuts at once, and rows of chunks that it hands on at once.
CUT_CHARS, CUT_ROWS = 4 << 20, 10_000


def content_chunks(files: DataFrame, markdown: bool, settings: Settings = SETTINGS) -> DataFrame:
    """(filepath, chunk_idx, text, title_path) of each file: Markdown by its sections, other texts as a whole. Null and blank texts have none."""
    return _cut(files.select("filepath", "content"), markdown, settings)


def _cut(files: DataFrame, markdown: bool, settings: Settings) -> DataFrame:
    """chunk_idx, text and title_path of each file's chunks, in place of its content, the last column; its other columns go along."""
    kept = files.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files_, places, texts, titles = [], [], [], []

            def made() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(files_, type=pa.int64())) for i in range(len(kept))]
                new = [pa.array(places, type=pa.int32()), pa.array(texts, type=pa.string()), pa.array(titles, type=pa.list_(pa.string()))]
                for held in (files_, places, texts, titles):
                    held.clear()
                return pa.RecordBatch.from_arrays([*own, *new], names=[*kept, "chunk_idx", "text", "title_path"])

            held = 0
            for row, value in enumerate(batch.column(len(kept))):  # one text at a time
                content = (value.as_py() or "")[: settings.max_content]
                place = 0
                for title, body in sections(content) if markdown else [([], content)]:
                    for t in split_text(body, settings.chunk_size, settings.chunk_overlap):
                        if t.strip():
                            files_.append(row)
                            places.append(place)
                            texts.append(t)
                            titles.append(title)
                            place += 1
                held += len(content)
                if held >= CUT_CHARS or len(files_) >= CUT_ROWS:
                    yield made()
                    held = 0
            yield made()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema.fields)
    return files.mapInArrow(run, f"{fields}, chunk_idx int, text string, title_path array<string>")


def chunk_records(files: DataFrame, markdown: bool = False, settings: Settings = SETTINGS) -> DataFrame:
    """All chunks of all files: one for the name, one for the headings (if any), and those of the content.

    files has filepath, filename, source_type, mtime, ctime, content. Adds file_id, chunk_type, title_path, content, embedding_text and chunk_id.
    """
    own = files.select("filepath", "filename", "source_type", "mtime", "ctime", "content")
    read = F.col("content") if settings.max_content is None else F.substring("content", 1, settings.max_content)
    heads = F.array_distinct(headings(read))
    tag = F.concat(F.lit("["), F.col("filename"), F.lit("]\n"))
    none = F.array().cast("array<string>")
    base = ["filepath", "filename", "source_type", "mtime", "ctime"]
    name = own.select(*base, F.lit("filename").alias("chunk_type"), F.lit(0).alias("chunk_idx"), none.alias("title_path"), F.concat(F.lit("文件名: "), F.col("filename"), F.lit("\n路径: "), F.col("filepath")).alias("content"))
    titles = own.withColumn("heads", heads).where("size(heads) > 0").select(*base, F.lit("heading").alias("chunk_type"), F.lit(0).alias("chunk_idx"), F.col("heads").alias("title_path"), F.concat(tag, F.array_join("heads", "\n")).alias("content"))
    body = _cut(own, markdown, settings).select(*base, F.lit("content").alias("chunk_type"), "chunk_idx", "title_path", F.concat(tag, F.col("text")).alias("content"))
    return chunk_ids(name.unionByName(titles).unionByName(body)).withColumn("embedding_text", truncate(F.col("content"), settings.embed_max))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds file_id and chunk_id: fn for the name, h and x with an ordinal of their kind, c with the chunk's index."""
    ordinal = F.row_number().over(Window.partitionBy("filepath", "chunk_type").orderBy("chunk_idx", "content")) - 1
    kind = F.col("chunk_type")
    named = lambda df, end: df.withColumn("file_id", F.md5("filepath")).withColumn("chunk_id", F.concat(F.col("file_id"), F.lit("_"), end))
    # Content, nearly all there is, has its number already and isn't shuffled.
    numbered = F.coalesce(kind.isin("content", "filename"), F.lit(False))
    plain = named(chunks.where(numbered), F.when(kind == "content", F.concat(F.lit("c"), F.col("chunk_idx"))).otherwise(F.lit("fn")))
    return plain.unionByName(named(chunks.where(~numbered), F.concat(F.when(kind == "heading", F.lit("h")).otherwise(F.lit("x")), ordinal)))
