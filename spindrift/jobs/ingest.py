"""From an inventory to chunks: cached chunks first, the rest parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental

#: Makes (filepath, chunks) of (filepath, content).
Parser = Callable[[DataFrame], DataFrame]


def scan_and_parse(inventory: DataFrame, contents: DataFrame, cache: DataFrame, parse: Parser) -> tuple[DataFrame, DataFrame]:
    """(filepath, mtime, chunks, hit) of every file of an inventory, and the cache afterwards (filepath, mtime, chunks).

    Where path and time agree with the cache, its chunks are taken and the content isn't read; the parser sees the other files
    only. Files without content, or of which the parser makes nothing, have no chunks. Rows of files that are gone leave the cache.
    """
    looked_up = incremental.cache_lookup(inventory.select("filepath", "mtime"), cache)
    missed = looked_up.where("not hit").select("filepath", "mtime")
    parsed = parse(contents.join(missed.select("filepath"), "filepath", "left_semi").select("filepath", "content"))
    none = F.array().cast(cache.schema["chunks"].dataType)
    made = missed.join(parsed.select("filepath", "chunks"), "filepath", "left").select("filepath", "mtime", F.coalesce("chunks", none).alias("chunks"), F.lit(False).alias("hit"))
    found = looked_up.where("hit").select("filepath", "mtime", "chunks", "hit").unionByName(made)
    return found, found.select("filepath", "mtime", "chunks")
