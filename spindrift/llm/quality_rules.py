"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import own_prefix

#: Fixed stop words of the four languages, lower case.
STOP_WORDS = {
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il avec".split(),
}

#: The rules: (name, measure, least, most). None leaves a side open; a measure that is null (no words) passes none of its rules.
RULES = (
    ("length", "n_words", 50, None),
    ("mean word length", "mean_word_chars", 2.0, 14.0),
    ("symbols per word", "symbols_per_word", None, 0.3),
    ("shouting", "exclamations_per_word", None, 0.3),
    ("stop words", "stop_words", 2, None),
    ("duplicate lines", "dup_line_ratio", None, 0.5),
    ("repeated words", "repeat_word_ratio", None, 0.5),
)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of each text; columns of the same names are replaced.

    n_words (runs of characters that aren't ASCII white space), word_chars (their code points), n_symbols (characters of
    #*$%&|<>), n_exclamations (!), n_lines (lines with a word), n_dup_lines (of these, equal to an earlier one), n_repeat_words (words in
    windows of three words that occur twice or more), stop_words (different stop words of the language with most of them), and
    ratios of these, which are null for a text without words. Null is an empty text.
    """
    p = own_prefix(docs.columns)
    # Each step is a projection of its own, so that arrays are made once.
    out = docs.withColumn(f"{p}text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(f"{p}trimmed", F.trim(F.regexp_replace(f"{p}text", r"[\x20\x09-\x0D]+", " ")))
    out = out.withColumn(f"{p}w", F.when(F.col(f"{p}trimmed") == "", F.array().cast("array<string>")).otherwise(F.split(f"{p}trimmed", " ")))
    left = {"n_symbols": r"[^#*$%&|<>]+", "n_exclamations": r"[^!]+"}
    lines = F.filter(F.split(f"{p}text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    triples = F.when(
        F.size(f"{p}w") >= 3, F.transform(F.sequence(F.lit(0), F.size(f"{p}w") - 3), lambda i: F.xxhash64(F.get(f"{p}w", i), F.get(f"{p}w", i + 1), F.get(f"{p}w", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({f"{p}lines": lines, f"{p}h": triples})
    found = [F.size(F.array_intersect(f"{p}w", F.array(*(F.lit(w) for w in words)))) for words in STOP_WORDS.values()]
    # Equal windows lie next to each other in the sorted array; in order of place, each adds up to three words.
    placed = F.array_sort(F.transform(f"{p}h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    out = out.withColumn(f"{p}sorted", F.when(F.size(F.array_distinct(f"{p}h")) < F.size(f"{p}h"), placed))
    same = F.filter(f"{p}sorted", lambda x, i: (x["h"] == F.get(f"{p}sorted", i - 1)["h"]) | (x["h"] == F.get(f"{p}sorted", i + 1)["h"]))
    out = out.withColumn(f"{p}at", F.array_sort(F.transform(same, lambda x: x["at"])))
    covered = F.aggregate(F.transform(f"{p}at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(f"{p}at", i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    out = out.withColumns(
        {
            "n_words": F.size(f"{p}w").cast("long"),
            "word_chars": F.length(F.array_join(f"{p}w", "")).cast("long"),
            **{name: F.length(F.regexp_replace(f"{p}text", others, "")).cast("long") for name, others in left.items()},
            "n_lines": F.size(f"{p}lines").cast("long"),
            "n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "stop_words": F.greatest(*found).cast("long"),
        }
    )
    ratios = {"mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "exclamations_per_word": ("n_exclamations", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_word_ratio": ("n_repeat_words", "n_words")}
    out = out.withColumns({name: F.try_divide(F.col(x), F.col(y)) for name, (x, y) in ratios.items()})
    return out.drop(f"{p}text", f"{p}trimmed", f"{p}w", f"{p}lines", f"{p}h", f"{p}sorted", f"{p}at")


def compiled(rules: tuple[tuple, ...] = RULES) -> Column:
    """The names of the rules that a row of measures fails, as one expression."""
    failed = []
    for name, measure, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(measure) >= least)
        if most is not None:
            ok = ok & (F.col(measure) <= most)
        failed.append(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)))
    return F.array_compact(F.array(*failed))


def judge(docs: DataFrame, rules: tuple[tuple, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds the measures, failed_rules (names, in the order of the table) and kept (none failed) to each row.

    Null, empty and wordless texts fail the rules on words. Repeated rows are judged alike, limits themselves pass, an empty
    table gives an empty result. All columns stay; columns with the names of measures or results are replaced.
    """
    return measures(docs, text_col).withColumn("failed_rules", compiled(rules)).withColumn("kept", F.size("failed_rules") == 0)
