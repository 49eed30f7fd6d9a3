"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is the ordered list of its turns; a turn is a list of typed parts. One expression visits the parts of a turn
in order: text is escaped, other parts become numbered placeholders, recorded as attachments with the tokens they expand to.

The format, where control strings are the only places with "<":

    <turn role="ROLE">CONTENT</turn>\n

In content, backslash and "<" are written \\\\ and \\l; in roles and in the types of parts, quotes, line ends, ">" and "/" are \\q, \\n, \\g and
\\s too. So no text, role or type can hold a control string, and parsing gives back each of them as it was. A part that isn't text is
written <TYPE/>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .arrays import cut, own_prefix, pieces, scanned

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
#: Tokens that one part of a kind stands for: a fixed number for each part, and one for each so many units of its size.
EXPANSION = {"image": (64, 1024.0), "audio": (16, 0.5), "document": (8, 4.0)}
#: Roles whose text is learned.
LEARNED = ("assistant",)
PART = "struct<type:string,text:string,uri:string,size:double>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes, found from the left, separate the pieces in which the other escapes are undone."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


#: What is escaped in roles and types, besides what is escaped everywhere.
NAMED = (('"', "\\q"), ("\n", "\\n"), (">", "\\g"), ("/", "\\s"))


def _escape_name(name: Column) -> Column:
    out = escape(name)
    for plain, coded in NAMED:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def _unescape_name(name: Column) -> Column:
    def undo(piece: Column) -> Column:
        for plain, coded in (("<", "\\l"), *NAMED):
            piece = F.replace(piece, F.lit(coded), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(name, r"\\\\", -1), undo), "\\")


def _visit(parts: Column) -> Column:
    """Struct of content and attachments (kind, uri, tokens) of one turn's parts, in order."""

    def tokens(p: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, (fixed, unit) in EXPANSION.items():
            out = F.when(p["type"] == kind, (F.lit(fixed) + F.ceil(F.coalesce(p["size"], F.lit(0.0)) / unit)).cast("long")).otherwise(out)
        return out

    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(True))
    placed = F.transform(parts, lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _escape_name(p["type"]), F.lit("/>"))))
    files = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), tokens(p).alias("tokens")))
    return F.struct(F.array_join(placed, "").alias("content"), files.alias("files"))


def _has_parts(turns: DataFrame) -> bool:
    """Whether the table has a column of typed parts; another column of that name isn't read."""
    kind = turns.schema["parts"].dataType if "parts" in turns.columns else None
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"type", "text", "uri", "size"} <= set(kind.elementType.names)


def format_conversations(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One formatted text for each conversation of a table (conv_id, turn, role, text and perhaps parts).

    `parts` is an array of (type, text, uri, size); without that column, or where it's null, a turn's text is its only part. The turns
    are ordered by turn, then role, text (as they were, not escaped). Null texts are empty, null roles are empty, and null turns come
    first. Repeated rows are turns of their own. A null conv_id is a conversation of its own. An empty table gives an empty result; other
    columns aren't read, nor is a `parts` of another type. Parts of unknown types become placeholders of no tokens, those of no type are text.

    Returns conv_id, formatted, n_turns, mask (array of start and length, in code points of `formatted`: the contents of turns whose
    role is learned), attachments (number, turn, type, uri, tokens, in order of their placeholders), n_tokens_expanded.
    """
    text = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("size")))
    parts = text
    if _has_parts(turns):
        given = F.transform("parts", lambda x: F.struct(*(x[c].cast(t).alias(c) for c, t in (("type", "string"), ("text", "string"), ("uri", "string"), ("size", "double")))))
        parts = F.coalesce(given, text)
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), _visit(parts).alias("made")).alias("t"))
    # A conversation is one text, so its turns must meet; they come as single rows and are sorted in the array.
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    opened = lambda t: F.concat(F.lit(OPEN), _escape_name(t["role"]), F.lit(MIDDLE))
    out = grouped.withColumn("pieces", F.transform("turns", lambda t: F.struct(opened(t).alias("head"), t["made"]["content"].alias("content"), t["role"].isin(*learned).alias("learned"))))
    out = out.withColumn("lengths", F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["content"]) + len(CLOSE)))
    out = out.withColumn("ends", scanned("lengths", lambda x, y: x + y))
    placed = F.zip_with("pieces", "ends", lambda p, end: F.struct(p["learned"].alias("learned"), (end - len(CLOSE) - F.length(p["content"])).alias("start"), F.length(p["content"]).alias("length")))
    mask = F.transform(F.filter(placed, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    files = F.flatten(F.transform("turns", lambda t, i: F.transform(t["made"]["files"], lambda f: F.struct(i.alias("turn"), f["type"].alias("type"), f["uri"].alias("uri"), f["tokens"].alias("tokens")))))
    numbered = F.transform(files, lambda f, i: F.struct(i.alias("number"), f["turn"].alias("turn"), f["type"].alias("type"), f["uri"].alias("uri"), f["tokens"].alias("tokens")))
    return out.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(CLOSE))), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        mask.alias("mask"),
        numbered.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + f["tokens"]).alias("n_tokens_expanded"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds; placeholders stay in the text."""
    ended = F.split(formatted, "</turn>\n", -1)
    whole = F.slice(ended, F.lit(1), F.size(ended) - 1)
    body = F.transform(whole, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))
    return F.transform(body, lambda x: F.struct(_unescape_name(F.substring_index(x, MIDDLE, 1)).alias("role"), unescape(F.substring(x, F.instr(x, MIDDLE) + len(MIDDLE), F.length(x))).alias("text")))


def parse_parts(text: Column) -> Column:
    """The parts (type, text) of a turn's content as it's written, between the control strings: texts and placeholders in order."""
    first = F.substring_index(text, "<", 1)
    others = F.slice(F.split(text, "<", -1), F.lit(2), F.size(F.split(text, "<", -1)))
    kind = lambda x: F.struct(_unescape_name(F.substring_index(x, "/>", 1)).alias("type"), F.lit(None).cast("string").alias("text"))
    said = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"))
    after = lambda x: F.substring(x, F.instr(x, "/>") + 2, F.length(x))
    found = F.concat(F.array(said(first)), F.flatten(F.transform(others, lambda x: F.array(kind(x), said(after(x))))))
    return F.filter(found, lambda p: (p["type"] != "text") | (p["text"] != ""))


def contents(formatted: Column) -> Column:
    """The contents of the turns as they're written, for parse_parts."""
    ended = F.split(formatted, "</turn>\n", -1)
    return F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), lambda x: F.substring(x, F.instr(x, MIDDLE) + len(MIDDLE), F.length(x)))


def with_masked(made: DataFrame, out: str = "learned") -> DataFrame:
    """Adds the learned texts of each formatted conversation, in order, read under its mask."""
    p = own_prefix(made.columns)
    held = made.withColumn(f"{p}pieces", pieces(F.col("formatted")))
    held = held.withColumn(f"{p}cut", F.transform("mask", lambda m: cut(F.col(f"{p}pieces"), m["start"], m["start"] + m["length"])))
    return held.withColumn(out, F.transform(f"{p}cut", unescape)).drop(f"{p}pieces", f"{p}cut")
