"""Notes: categories with their paths, tags, target files, front matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import safe_filename
from ..sources.stored import cut


def category_paths(categories: DataFrame, separator: str = "/") -> DataFrame:
    """(uuid, path) of categories (uuid, pid, name): names from the top down, whatever the depth and number of categories.

    Each round doubles how far up a category knows its path, so the logarithm of the depth sets the number of joins. Categories whose
    parents run in a circle are found first, by pointers alone; their paths, followed until a category comes again, are taken step by step.
    """
    own = categories.select("uuid", "pid", "name")
    known = own.select(F.col("uuid").alias("pid"))
    linked = own.join(known, "pid", "left_semi").select("uuid", "pid")
    base = cut(own.drop("pid").join(linked, "uuid", "left").select("uuid", F.col("pid").alias("next"), "name"))

    pointers, reach, n = base.select("uuid", "next"), 1, base.count()
    while reach <= n and not pointers.where("next IS NOT NULL").isEmpty():
        further = pointers.select(F.col("uuid").alias("next"), F.col("next").alias("then"))
        pointers, reach = cut(pointers.join(further, "next", "left").select("uuid", F.col("then").alias("next"))), 2 * reach
    # Whoever still has someone above after n steps is in a circle or below one.
    circling = pointers.where("next IS NOT NULL").select("uuid")

    paths = base.join(circling, "uuid", "left_anti").select("uuid", "next", F.col("name").alias("path"))
    while not paths.where("next IS NOT NULL").isEmpty():
        above = paths.select(F.col("uuid").alias("next"), F.col("next").alias("then"), F.col("path").alias("upper"))
        joined = paths.join(above, "next", "left")
        paths = cut(joined.select("uuid", F.col("then").alias("next"), F.when(F.col("upper").isNull(), F.col("path")).otherwise(F.concat("upper", F.lit(separator), "path")).alias("path")))
    if circling.isEmpty():
        return paths.select("uuid", "path")
    around = cut(base.join(circling, "uuid", "left_semi"))
    step = around.select("uuid", "next", F.col("name").alias("path"), F.array("uuid").alias("seen"))
    done = None
    while True:
        above = around.select(F.col("uuid").alias("up"), F.col("next").alias("then"), F.col("name").alias("upper"))
        again = F.array_contains("seen", F.col("next"))
        ended = step.where(again).select("uuid", "path")
        done = ended if done is None else done.unionByName(ended)
        going = step.where(~again)
        if going.isEmpty():
            return paths.select("uuid", "path").unionByName(done)
        step = cut(going.join(above, F.col("next") == F.col("up")).select("uuid", F.col("then").alias("next"), F.concat("upper", F.lit(separator), "path").alias("path"), F.concat("seen", F.array("up")).alias("seen")))


def grouped_names(articles: DataFrame, links: DataFrame, names: DataFrame, out: str) -> DataFrame:
    """Articles (aid) with the sorted names of what they link to (rid, aid; rid, name); none is an empty array."""
    named = links.join(names, "rid").groupBy("aid").agg(F.array_sort(F.collect_list("name")).alias(out))
    return articles.join(named, "aid", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def target_paths(notes: DataFrame, order: list[str]) -> DataFrame:
    """Adds `dest` to notes (folder, title): later notes of the same target get _1, _2 and so on, in the order given."""
    base = notes.withColumn("__base", F.concat(F.col("folder"), F.lit("/"), safe_filename(F.col("title"))))
    k = F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1
    return base.withColumn("dest", F.concat("__base", F.when(k > 0, F.concat(F.lit("_"), k)).otherwise(F.lit("")), F.lit(".md"))).drop("__base")


def front_matter(title: Column, tags: Column, categories: Column, uuid: Column) -> Column:
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('  - "'), x, F.lit('"\n'))), ""))).otherwise(F.lit(""))
    return F.concat(F.lit('---\ntitle: "'), title, F.lit('"\n'), listed("tags", tags), listed("categories", categories), F.lit("note_uuid: "), uuid.cast("string"), F.lit("\n---\n\n"))


def split_front_matter(text: Column) -> Column:
    """Struct of meta (text between the first two lines of ---, or null) and body; without an end mark the text is all body."""
    pattern = r"(?s)\A---\n(.*?\n)?---[ \t]*(?:\n|\z)(.*)\z"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("meta"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def note_heads(notes: DataFrame) -> DataFrame:
    """Adds title, category, uuid and body to notes (filepath, content with or without front matter).

    The title is that of the front matter, else the first heading of level 1, else the file's name without its extension; the
    category is the first one listed. Null content is empty; what isn't found is an empty string.
    """
    parts = notes.withColumn("__parts", split_front_matter(F.coalesce("content", F.lit(""))))
    meta = F.coalesce("__parts.meta", F.lit(""))
    named = lambda key: F.regexp_extract(meta, rf'(?m)^{key}:[ \t]*"?(.*?)"?[ \t]*$', 1)
    body = F.regexp_replace("__parts.body", r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    heading = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1))
    stem = F.regexp_extract("filepath", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.when(named("title") != "", named("title")).when(heading != "", heading).otherwise(stem)
    first = F.regexp_extract(meta, r'(?m)^categories:[ \t]*\n[ \t]*-[ \t]+"?(.*?)"?[ \t]*$', 1)
    return parts.withColumns({"title": title, "category": first, "uuid": named("note_uuid"), "body": body}).drop("__parts")


def export_plan(notes: DataFrame, state: DataFrame) -> DataFrame:
    """(uuid, dest, content_hash, media_hash, action, stale): what an export of notes does, given what the last one left.

    Both tables have uuid, dest, content_hash, media_hash. New notes, and those with another content, media or target, are written, the
    rest is skipped; notes that are gone are removed. stale is the earlier file to delete, if any. Missing media count as no media.
    """
    old = state.select("uuid", F.col("dest").alias("old_dest"), F.col("content_hash").alias("old_content"), F.coalesce("media_hash", F.lit("")).alias("old_media"))
    new = notes.select("uuid", "dest", "content_hash", F.coalesce("media_hash", F.lit("")).alias("media_hash"))
    both = new.join(old, "uuid", "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("old_content")) & (F.col("media_hash") == F.col("old_media")) & (F.col("dest") == F.col("old_dest"))
    action = F.when(F.col("dest").isNull(), "remove").when(same, "skip").otherwise("write")
    stale = F.when(F.col("dest").isNull() | (F.col("dest") != F.col("old_dest")), F.col("old_dest"))
    return both.select("uuid", "dest", "content_hash", "media_hash", action.alias("action"), stale.alias("stale"))


def write_manifest(plan: DataFrame, folder: str) -> None:
    """The state that the next export compares with, as JSON lines."""
    plan.where("action <> 'remove'").select("uuid", "dest", "content_hash", "media_hash").write.mode("error").json(folder)


def fingerprints(files: DataFrame) -> DataFrame:
    """(folder, hash): one hash over each folder's files (folder, name, content_hash) in the order of their names.

    Spark sorts the files, on disk if need be, and a running hash reads them; no folder is held in memory. Files without a name or hash don't count.
    """
    kind = files.schema["folder"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, state, lines = None, None, 0
        for batch in batches:
            done = []
            for own, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != folder:
                    if state is not None:
                        done.append((folder, state.hexdigest()))
                    folder, state, lines = own, hashlib.sha256(), 0
                if name is not None and content is not None:
                    state.update((("\n" if lines else "") + f"{name}:{content}").encode())
                    lines += 1
            yield closed(done, batch.schema.field(0).type)
        if state is not None:
            yield closed([(folder, state.hexdigest())], batch.schema.field(0).type)

    def closed(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], type=of), pa.array([h for _, h in rows], type=pa.string())], names=["folder", "hash"])

    ordered = files.select("folder", F.col("name").cast("string"), F.col("content_hash").cast("string")).repartition("folder").sortWithinPartitions("folder", "name", "content_hash")
    return ordered.mapInArrow(run, StructType([StructField("folder", kind), StructField("hash", StringType())]))
