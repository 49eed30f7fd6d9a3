"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of bytes, so a key is the n-gram itself and nothing is hashed away. Their counts come from the trusted
documents that don't set thresholds (three in four): each task adds up its own, Spark sums them, and continuation counts, contexts,
discounts and probabilities of each order are joins and groupings of these counts. For scoring the model is taken apart into one
additive value for each n-gram. A fixed number of the most frequent n-grams is broadcast, whatever the model's size; the
n-grams of documents among all others are joined with the rest of the model, dealt by n-gram, and partial sums are added up per
document. A document is rejected if its bits per byte (the logarithm of its perplexity) exceed the quantile of its language among
trusted documents that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .arrays import own_prefix
from .checkpoints import cut
from .joins import skew_join
from .kernels import flat, lists, mix, slices

#: Bytes of the longest n-gram. Five bytes and an order fit into a long.
ORDER = 5
#: Most n-grams that are broadcast, the most frequent ones: 16 bytes each, so 32 MB whatever the model's size.
FREQUENT = 1 << 21
#: The bit table of all other n-grams: 2 ** 26 / 8 = 8 MB.
REST_BITS = 26
#: Of the trusted documents, one in so many only sets thresholds.
HELD_OUT = 4
#: Thresholds: this quantile of held-out trusted documents' bits per byte, and what a caller may add to it.
QUANTILE, MARGIN = 0.99, 0.0
#: Bits per byte are sorted into bins of this width for quantiles.
BIN = 0.001
#: Bins are searched in runs of so many first.
RUN = 256
#: A document's mean is drawn to its language's median as if that many bytes more had been read.
PRIOR_BYTES = 100
#: A language with fewer held-out documents takes the threshold of all languages together.
LEAST_DOCUMENTS = 20
#: The bit table of trusted documents' keys: 2 ** 26 / 8 = 8 MB.
BITS = 26
U = np.uint64
NEWLINE = 10


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each row, one for each byte and the end, with newlines before and after it; and how many per row."""
    lens = np.diff(offs)
    n = len(lens)
    padded = np.full(len(data) + ORDER * n, NEWLINE, dtype=np.uint8)
    row = np.repeat(np.arange(n), lens)
    padded[np.arange(len(data)) + (ORDER - 1) + ORDER * row] = data
    key = np.zeros(len(padded) - ORDER + 1 if n else 0, dtype=np.uint64)
    for k in range(ORDER):
        key = (key << U(8)) | padded[k : k + len(key)]
    # The last ORDER - 1 places of each row run into the next row.
    per_row = lens + 1
    first = offs[:-1] + ORDER * np.arange(n)
    at = np.repeat(first - (np.cumsum(per_row) - per_row), per_row) + np.arange(int(per_row.sum()))
    return key[at], per_row


def _count(texts: DataFrame) -> DataFrame:
    """(g, a): all n-grams of the longest order with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in slices(*flat(batch.column(0))):
                k, c = np.unique(_grams(data, offs)[0], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, c])).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["g", "a"])
                    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["g", "a"])

    return texts.mapInArrow(run, "g bigint, a bigint").groupBy("g").agg(F.sum("a").alias("a"))


def _discounts(orders: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from the numbers of n-grams counted once to four times."""
    union = None
    for k, counts in orders.items():
        own = counts.where("a <= 4").groupBy("a").count().select(F.lit(k).alias("k"), "a", "count")
        union = own if union is None else union.unionByName(own)
    n = {(r["k"], r["a"]): r["count"] for r in union.collect()}  # at most four numbers for each order
    out = {}
    for k in orders:
        n1, n2, n3, n4 = (n.get((k, a), 0) for a in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        # Where the counts are too few for the estimate, a discount stays between 0 and its count.
        out[k] = tuple(min(max(a - (a + 1) * y * more / most, 0.0), float(a)) if most else 0.5 for a, most, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return out


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model of a column of texts: (key, delta, back, a) for each n-gram of every order, and the value of any byte.

    A byte's log-probability is the common value, plus delta of each n-gram that ends in it, plus back of each context
    before it; n-grams that were never seen count as zero. The key holds the order above the n-gram's bytes; a tells how frequent it is.
    """
    orders = {ORDER: cut(_count(texts))}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders[k] = cut(orders[k + 1].groupBy(tail.alias("g")).agg(F.count(F.lit(1)).alias("a")))
    discounts = _discounts(orders)
    model, lower, empty = None, None, 0.0
    for k in range(1, ORDER + 1):
        d = discounts[k]
        counts = orders[k].withColumn("h", F.shiftright("g", 8))
        sums = counts.groupBy("h").agg(
            F.sum("a").alias("total"), F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"), F.count_if(F.col("a") > 2).alias("n3")
        )
        # A weight of zero would leave unseen bytes without probability.
        weight = F.greatest((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total"), F.lit(1e-9))
        contexts = cut(sums.select("h", "total", weight.alias("weight")))
        own = (F.col("a") - F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])) / F.col("total")
        joined = skew_join(counts, contexts, ["h"], "inner")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            joined = skew_join(joined.withColumn("tail", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))), lower.select(F.col("g").alias("tail"), F.col("p").alias("below")), ["tail"], "inner")
            below = F.col("below")
        p = own + F.col("weight") * below
        level = cut(joined.select("g", "a", p.alias("p"), F.log(p / (F.col("weight") * below)).alias("delta")))
        key = F.lit(k << 56).bitwiseOR(F.col("g"))
        part = level.select(key.alias("key"), "delta", F.lit(0.0).alias("back"), "a")
        if k == 1:
            first = contexts.first()
            empty = float(np.log(first["weight"])) if first else 0.0
        else:
            back = contexts.select(F.lit((k - 1) << 56).bitwiseOR(F.col("h")).alias("key"), F.lit(0.0).alias("delta"), F.log("weight").alias("back"), F.col("total").alias("a"))
            part = part.unionByName(back)
        model = part if model is None else model.unionByName(part)
        lower = level
    # Contexts that only begin texts (newlines) are no n-grams of their own: they keep a row too.
    return cut(model.groupBy("key").agg(F.sum("delta").alias("delta"), F.sum("back").alias("back"), F.max("a").alias("a"))), empty - float(np.log(256))


def _split(model: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame | None]:
    """The n-grams of a frequency or more, at most `most`, sorted by key, and a table of the others (None without any).

    Frequencies are counted by powers of two, of which there are few.
    """
    power = F.floor(F.log2("a")).cast("int")
    sizes = sorted(((r[0], r[1]) for r in model.groupBy(power.alias("power")).count().collect()), reverse=True)
    total, least = 0, None
    for power_of, n in sizes:
        if total + n > most:
            break
        total, least = total + n, power_of
    rows = model.where(power >= least if least is not None else F.lit(False)).sort("key").toArrow()
    frequent = tuple(rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(t) for c, t in (("key", np.int64), ("delta", np.float32), ("back", np.float32)))
    if total == sum(n for _, n in sizes):
        return frequent, None
    return frequent, model.where(power < least) if least is not None else model


def _lookups(grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Which keys add to the last byte of each n-gram: those of n-grams that end in it (0, delta) and of contexts before it (1, back)."""
    for kind, shift, orders in ((0, 0, range(1, ORDER + 1)), (1, 8, range(1, ORDER))):
        for k in orders:
            yield kind, (((grams >> U(shift)) & U((1 << 8 * k) - 1)) | U(k << 56)).view(np.int64)


def _values(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], rest: bytes | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """What frequent n-grams add to the log-probability of each n-gram's last byte; and (kind, places, keys) that may be in the rest."""
    keys, *values = frequent
    out, others = np.zeros(len(grams)), []
    for kind, key in _lookups(grams):
        known = np.zeros(len(key), dtype=bool)
        if len(keys):
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            known = keys[at] == key
            out += np.where(known, values[kind][at], 0)
        if rest is not None:
            places = np.flatnonzero(~known)
            places = places[bitmaps.probe(rest, bitmaps.cells(mix(key[places].view(np.uint64)), REST_BITS))]
            others.append((kind, places, key[places]))
    return out, others


def _rest_of(rows: np.ndarray, at: np.ndarray, others: list[tuple[int, np.ndarray, np.ndarray]], n_distinct: int, n_rows: int) -> pa.Array:
    """For each document its n-grams that may be in the rest, with how often each counts as delta and as back."""
    row, key, kind = [], [], []
    for k, places, keys in others:
        value = np.zeros(n_distinct, dtype=np.int64)
        hit = np.zeros(n_distinct, dtype=bool)
        value[places], hit[places] = keys, True
        where = np.flatnonzero(hit[at])
        row.append(rows[where])
        key.append(value[at[where]])
        kind.append(np.full(len(where), k))
    row, key, kind = (np.concatenate(x) for x in (row, key, kind))
    order = np.lexsort((key, row))
    row, key, kind = row[order], key[order], kind[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0, dtype=np.int64) for x in ((kind == 0).astype(np.int64), (kind == 1).astype(np.int64))]
    held = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(sums[0]), pa.array(sums[1])], names=["key", "d", "b"])
    return lists(held, np.searchsorted(row[first], np.arange(n_rows + 1)))


def score(docs: DataFrame, model: DataFrame, common: float, id_col: str, text_col: str, lang_col: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, text_key, lang, n_bytes and bits (minus log2 of the text's probability, its end included) of each document, in one scan."""
    kind, lang = (docs.schema[c].dataType.simpleString() for c in (id_col, lang_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    held, others = _split(model, frequent)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(held)
    table = context.broadcast(None)
    if others is not None:
        table = bitmaps.broadcast_cells(_with_cells(others), "c", REST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(3))):
                grams, per_row = _grams(data, offs)
                distinct, at = np.unique(grams, return_inverse=True)
                value, more = _values(distinct, sent.value, table.value)
                total = np.add.reduceat(value[at] + common, np.cumsum(per_row) - per_row)
                rows = batch.slice(i, j - i)
                out = [*rows.columns[:3], pa.array(per_row.astype(np.int64)), pa.array(total)]
                if table.value is not None:
                    out.append(_rest_of(np.repeat(np.arange(j - i), per_row), at, more, len(distinct), j - i))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_key", "lang", "n_bytes", "log_p", "rest"][: len(out)])

    schema = f"doc_id {kind}, text_key bigint, lang {lang}, n_bytes bigint, log_p double"
    bits = lambda log_p: (-log_p / float(np.log(2))).alias("bits")
    if others is None:
        return source.mapInArrow(run, schema).select("doc_id", "text_key", "lang", "n_bytes", bits(F.col("log_p")))
    found = cut(source.mapInArrow(run, f"{schema}, rest array<struct<key:bigint,d:bigint,b:bigint>>"))
    asked = found.where("size(rest) > 0").select("doc_id", "text_key", F.explode("rest").alias("x")).select("doc_id", "text_key", "x.*").distinct()
    sums = skew_join(asked, others.select("key", "delta", "back"), ["key"], "inner").groupBy("doc_id", "text_key").agg(F.sum(F.col("d") * F.col("delta") + F.col("b") * F.col("back")).alias("more"))
    sums = sums.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "more")
    joined = found.join(sums, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    return joined.select("doc_id", "text_key", "lang", "n_bytes", bits(F.col("log_p") + F.coalesce("more", F.lit(0.0))))


def _with_cells(model: DataFrame) -> DataFrame:
    """The cells of the keys' mixed hashes. The mixing of the kernels is done where the table is probed, so here too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(bitmaps.cells(mix(keys), REST_BITS))], names=["c"])

    return model.select("key").mapInArrow(run, "c bigint")


def _quantile(binned: DataFrame, by: list[str], q: float, out: str) -> DataFrame:
    """The least bin that holds at least the part q of each group's counted rows, as a mean of bits per byte.

    Runs of bins are counted first, then the bins of the run in which the quantile lies, so that a group is a few hundred counts.
    """
    group = Window.partitionBy(*by)
    binned = binned.withColumn("run", F.floor(F.col("bin") / RUN))

    def counted(rows: DataFrame, unit: str, *keep: str) -> DataFrame:
        sums = rows.groupBy(*by, *keep, unit).agg(F.count(F.lit(1)).alias("m"))
        return sums.withColumn("through", F.sum("m").over(group.orderBy(unit)))

    runs = counted(binned, "run").withColumn("all", F.sum("m").over(group)).where(F.col("through") >= F.col("all") * q)
    first = cut(runs.groupBy(*by).agg(F.min(F.struct("run", (F.col("through") - F.col("m")).alias("before"), "all")).alias("x")).select(*by, "x.*"))  # a row a group
    inside = counted(skew_join(binned, first, [*by, "run"], "inner"), "bin", "before", "all").where(F.col("before") + F.col("through") >= F.col("all") * q)
    return inside.groupBy(*by).agg((F.min("bin") * BIN).alias(out), F.first("all").alias("n_held_out"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say good quality and not toxic."""
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    return judged.agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic")).where("quality = 1 and toxic = 0").select("doc_id")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    held_out: int = HELD_OUT,
    frequent: int = FREQUENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Bits per byte of every document under a model of the trusted ones, and whether that passes its language's threshold.

    At most `frequent` n-grams are broadcast for scoring; the result doesn't depend on it. Trusted are the documents that all their labels call good and not toxic. One in `held_out` of them (by a hash of the id)
    is left out of the model; the threshold is the `quantile` of these documents' bits per byte plus `margin`.
    Returns one row per document: doc_id, text_key, lang, n_bytes (with the text's end), bits_per_byte (drawn to the median
    of the language by PRIOR_BYTES bytes), threshold, kept.

    A null text is empty; it is as likely as the end of a text and kept. A null language is a language of its own. Languages
    with few held-out documents share one threshold. Without trusted documents all are kept and have no threshold. Repeated
    rows get a row each; several labels of one document must agree. An empty table gives an empty result. Only the named
    columns are read.
    """
    trusted = trusted_ids(labels)
    key = F.xxhash64(F.col("doc_id"))
    table = bitmaps.broadcast_cells(trusted.select(bitmaps.cell(key, BITS).alias("c")), "c", BITS)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bitmaps.probe(table.value, bitmaps.cells(own, BITS))))

    kind = docs.schema[id_col].dataType.simpleString()
    maybe = docs.select(key.alias("key") if id_col == "doc_id" else F.xxhash64(id_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The bit table lets a few others pass; the join after it is exact.
    texts = maybe.mapInArrow(likely, f"key bigint, doc_id {kind}, text string").where(F.pmod("key", F.lit(held_out)) != 0).join(trusted, "doc_id", "left_semi")
    model, common = train(texts.select("text"))
    scored = cut(score(docs, model, common, id_col, text_col, lang_col, frequent))

    judges = trusted.where(F.pmod(key, F.lit(held_out)) == 0)
    mean = F.col("bits") / F.col("n_bytes")
    held = scored.join(judges, "doc_id", "left_semi").withColumn("language", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    held = cut(held.unionByName(held.withColumn("language", F.lit("*"))))  # the last for all languages
    # A row for each language; the limits' plan would hold that of the medians three times.
    medians = cut(_quantile(held.withColumn("bin", F.floor(mean / BIN)), ["language"], 0.5, "median"))
    smoothed = (F.col("bits") + F.col("median") * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)
    limits = _quantile(held.join(medians.drop("n_held_out"), "language").withColumn("bin", F.floor(smoothed / BIN) + 1), ["language"], quantile, "limit")
    limits = cut(limits.join(medians.drop("n_held_out"), "language"))
    every = limits.where("language = '*'").select(F.col("limit").alias("every_limit"), F.col("median").alias("every_median"))
    own = limits.where((F.col("language") != "*") & (F.col("n_held_out") >= LEAST_DOCUMENTS)).select("language", "limit", "median")
    overall = every.first()  # one row, or none without trusted documents
    if overall is None:
        return scored.select("doc_id", "text_key", "lang", "n_bytes", mean.alias("bits_per_byte"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    out = scored.withColumn("language", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    out = skew_join(out, own, ["language"], "left").withColumns({"limit": F.coalesce("limit", F.lit(overall["every_limit"])), "median": F.coalesce("median", F.lit(overall["every_median"]))})
    out = out.withColumns({"bits_per_byte": smoothed, "threshold": F.col("limit") + margin})
    return out.select("doc_id", "text_key", "lang", "n_bytes", "bits_per_byte", "threshold", ((F.col("n_bytes") <= 1) | (F.col("bits_per_byte") <= F.col("threshold"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that classify keeps, with all their columns. Options as in classify."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    p = own_prefix(docs.columns)
    bad = classify(docs, labels, **options).where("not kept").select(F.col("doc_id").alias(f"{p}id"), F.col("text_key").alias(f"{p}key")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text_col) == F.col(f"{p}key")), "left_anti")
