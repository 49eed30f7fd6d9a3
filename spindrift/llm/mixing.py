"""Mixing sources to target weights by weighted fair queueing.

Every pass over a shuffled document gets a virtual finish time: the tokens of its source up to its end, divided by the
source's target. All passes are sorted by that time over the whole table and cut at the total budget, so that at any
point of the mix each source has given its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import own_prefix
from .checkpoints import cut
from .joins import skew_join
from .running import running_totals

WEIGHTS = (5, 2, 1)
SEED = 17


def _targets(sources: DataFrame, most_passes: int) -> tuple[DataFrame, int]:
    """Adds each source's target; returns the total of all sizes too.

    A source's target is level * weight, but at most most_passes * size; the level rises until the targets share the total.
    It's found from a few sums per round, each over the sources that the last level leaves below their limit.
    """
    limit = F.col("source_size") * most_passes
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        capped = limit < F.lit(level) * F.col("weight")
        x = sources.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"), F.count_if(capped).alias("n")
        ).first()
        if not x["open"]:
            break
        new = float(total - x["full"]) / x["open"]
        if new == level:
            break
        level = new
    target = F.when(limit < F.lit(level) * F.col("weight"), limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target), total


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What a mix of all sources takes of each document.

    A document's size is its number of words (runs of characters that aren't ASCII white space). The sources, in code-point
    order and null last, weigh `weights`, repeating. Their targets share the total of all sizes by weight, but none exceeds
    `most_passes` times its source's size; the excess is shared by the others. Whole documents are taken, up to
    `most_passes` times, in the order of virtual finish times and while their total stays within the total of all sizes.

    Returns one row per document: doc_id, text_key, source, size, source_size, target, passes, taken (passes * size).
    Null and empty texts have no words and are never taken; a null source is a source of its own. The order within a source
    is by a hash of the id, then by id, size and a hash of the text, so reruns agree, and repeated rows count each by itself.
    An empty table gives an empty result. Other columns aren't read.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("at"),
    )
    base = cut(base.withColumns({"source_none": F.col("source").isNull(), "source_name": F.coalesce("source", F.lit(""))}))
    by_source = ["source_none", "source_name"]
    sources = base.groupBy(*by_source).agg(F.sum("size").alias("source_size"), F.max("size").alias("largest")).withColumn("one", F.lit(1).cast("long"))
    sources = running_totals(sources, by_source, {"place": "one", "through": "source_size"})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight.cast("long")))
    sources, total = _targets(sources, most_passes)
    tail = sources.agg(F.coalesce(F.sum("largest"), F.lit(0))).first()[0]
    known = skew_join(base, sources.select(*by_source, "place", "source_size", "target", (F.col("through") - F.col("source_size")).alias("before")), by_source, "inner")
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target", "at", "place", "before"]
    queued = cut(running_totals(known.select(*columns), ["place", "at", "doc_id", "size", "text_key"], {"through": "size"}))

    def finish(k: F.Column) -> F.Column:
        return (k * F.col("source_size") + F.col("through") - F.col("before")).cast("double") / F.col("target")

    # The cut comes when the total is served. At time v each source has given v * target up to one document, so no later time
    # than this one can be within the budget.
    latest = 1 + tail / total if total else 0.0
    passes = queued.where("size > 0").select("place", "through", "size", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))).alias("k"), "source_size", "before", "target")
    passes = passes.select(finish(F.col("k")).alias("finish"), "place", "k", "through", "size").where(F.col("finish") <= latest)
    served = running_totals(passes, ["finish", "place", "k", "through"], {"served": "size"})
    last = served.where(F.col("served") <= total).agg(F.max(F.struct("finish", "place", "k", "through"))).first()[0]
    if last is None:
        taken = F.lit(0)
    else:
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["place"]).cast("long").alias("place"), F.lit(last["k"]).alias("k"), F.lit(last["through"]).cast("long").alias("through"))
        taken = sum((F.when((F.col("size") > 0) & (F.struct(finish(F.lit(k)).alias("finish"), "place", F.lit(k).alias("k"), "through") <= end), 1).otherwise(0) for k in range(most_passes)), F.lit(0))
    return queued.withColumn("passes", taken.cast("long")).select("doc_id", "text_key", "source", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, all columns, with `passes`: how many times each is to be read. Options as in mix."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    p = own_prefix(docs.columns)
    taken = mix(docs, **options).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("passes"), asc=False).alias(f"{p}passes"))
    own = docs.withColumn(f"{p}key", F.xxhash64(text_col))
    same = Window.partitionBy(F.col(id_col), f"{p}key").orderBy(F.lit(0))
    joined = own.join(
        taken.select(F.col("doc_id").alias(f"{p}id"), F.col("text_key").alias(f"{p}text_key"), f"{p}passes"), F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}text_key"))
    )
    # Repeated rows share out the passes that were counted for them.
    out = joined.withColumn("passes", F.element_at(f"{p}passes", F.row_number().over(same)))
    return out.where("passes > 0").select(*(c for c in docs.columns if c != "passes"), "passes")
