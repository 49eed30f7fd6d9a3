"""Text as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ideographs: the unified block, extensions A and B.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"


def _fold_table() -> tuple[str, str]:
    """Characters with diacritics and their base characters, from the Unicode decompositions; marks, which go, stand at the end of the first."""
    accented, plain, marks = [], [], []
    for c in (c for block in (range(0xC0, 0xAC00), range(0xF900, 0x10000)) for c in block):  # all but syllables that would be composed again
        own = chr(c)
        if unicodedata.category(own).startswith("M"):
            marks.append(own)
            continue
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", own) if not unicodedata.category(x).startswith("M")))
        if len(bare) == 1 and bare != own:
            accented.append(own)
            plain.append(bare)
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, _ACCENTED, _PLAIN))


def words(text: Column) -> Column:
    """Runs of letters and numbers, folded, in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bigrams(text: Column) -> Column:
    """Each two neighbouring characters."""
    return F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def index_tokens(text: Column) -> Column:
    """Tokens of the inverted index: words, where each run of ideographs stands apart and adds its bigrams after all words."""
    apart = F.regexp_replace(text, f"([{CJK}]+)", " $1 ")
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}})"), F.lit(1))
    return F.concat(words(apart), F.flatten(F.transform(runs, bigrams)))


def truncate(text: Column, most: int) -> Column:
    """The first characters, or one space for a blank text: what is embedded is never empty."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(" ")).otherwise(F.substring(text, 1, most))


def headings(text: Column) -> Column:
    """Markdown headings of levels 1 to 6, also inside of code fences, spaces at their ends kept."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))


def html_headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))


def relative_path(path: Column, roots: list[str]) -> Column:
    """The path below the longest root that holds it; a path below none stays."""
    out = path
    for root in sorted(roots, key=len):
        root = root.rstrip("/") + "/"
        out = F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def nfc(path: pd.Series) -> pd.Series:
    """Composed Unicode form (NFC), in which paths are compared. Null stays null."""
    return path.str.normalize("NFC")


def page_headings(text: Column) -> Column:
    """Lines of a page's plain text that look like headings: trimmed, of 1 to 79 characters, without punctuation at the end."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 80) & ~F.substring(x, -1, 1).isin(*"。，；.,;"))


def safe_filename(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", " "))
    return F.when(clean == "", F.lit("Untitled")).otherwise(F.substring(clean, 1, 120))


def mark_terms(text: Column, terms: list[str]) -> Column:
    """Each term, whatever its case, in <mark> tags."""
    import re

    if not terms:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")", "<mark>$1</mark>")


def tokens_estimate(text: Column, most: int, chars_per_token: float) -> Column:
    """Tokens that embedding a text costs, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(truncate(text, most)) / F.lit(chars_per_token)).cast("long"))
