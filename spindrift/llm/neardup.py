"""Near-duplicate detection by weighted Jaccard similarity: BagMinHash signatures, bands, exact multiset overlap.

A text is the multiset of its word shingles. Each distinct shingle of weight w owns the Poisson process of the unit
intervals below w; weights are discretised to whole occurrences and halved into dyadic intervals (0, 1], (1, 2], (2, 4], ...
An event in (a, b] falls into a unit interval by the remaining bits of its hash, which is the process's descent by halves,
and counts only if that interval lies below w. Two texts share a signature component if its first event is the same one,
with probability min-sum / max-sum. Events are made in order of time and only up to the time by which all components of
the text are likely filled, so a signature costs about words + m * log(m) events, not words * m.

Texts that share a band are compared exactly. First every text of a band's bucket is compared with one centre, and the
links found are grouped into components; then only texts of the same bucket but of different components are compared with
each other. A bucket of n close copies so costs n comparisons, and no link between two components is lost. Shingles that
no other candidate has bound the similarity from above, which keeps texts with many edits of their own out of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .arrays import own_prefix
from .checkpoints import cut
from .joins import skew_join
from .kernels import ALNUM, Words, _M1, as_long, flat, in_row, lists, mix, powers, slices, window_hashes

U = np.uint64
#: 32 bands of 6 components: a pair of similarity 0.8 shares no band in 6 of 100,000 cases, one of 0.5 shares some in 4 of 10.
BANDS, ROWS = 32, 6
#: Ticks of a unit of time.
TICKS = float(1 << 32)
#: The bit table of nodes that need their shingles: 2 ** 24 / 8 = 2 MB.
BITS = 24
#: Cells of each row of the sketch of candidates' shingles: 2 * 2 ** 25 / 8 = 8 MB are broadcast.
SKETCH_BITS = 25


def shingled(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle; a text of fewer words, but not none, is one shingle."""
    starts = in_row(words.row_at, size)
    row = np.searchsorted(words.row_at, starts, "right") - 1
    h = window_hashes(words.hash, size)[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, mix(whole(words)[short])])
    return row, h


def whole(words: Words) -> np.ndarray:
    """A hash of each row's word sequence."""
    out = np.zeros(len(words.counts), dtype=np.uint64)
    full = np.flatnonzero(words.counts)
    if len(full):
        rel = np.arange(len(words.hash)) - np.repeat(words.row_at[:-1], words.counts)
        out[full] = np.add.reduceat(words.hash * powers(_M1, int(rel.max()) + 1)[rel], words.row_at[:-1][full])
    return mix(out + words.counts.astype(np.uint64))


def bags(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their weights."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _intervals(row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The dyadic intervals that reach below each weight: row, key, weight, lower end, length."""
    parts = [(row, h, weight, np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=np.int64))]
    low = 1
    while (more := weight > low).any():
        row, h, weight = row[more], h[more], weight[more]
        full = np.full(len(h), low, dtype=np.int64)
        parts.append((row, mix(h ^ U(low)), weight, full, full))
        low *= 2
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_rows, m) components of non-empty rows; a row without shingles keeps the largest value everywhere."""
    best = np.full((n_rows, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    ids = np.flatnonzero(total)
    scale = 1.0
    while len(ids):
        number = np.full(n_rows, -1)
        number[ids] = np.arange(len(ids))
        own = number[row] >= 0
        limit = scale * m * (np.log(m) + 6) / total[ids]
        best[ids] = _first_events(number[row[own]], h[own], weight[own], limit, m)
        ids = ids[(best[ids] == np.iinfo(np.uint64).max).any(axis=1)]
        scale *= 2
    return best


def _first_events(row: np.ndarray, h: np.ndarray, weight: np.ndarray, limit: np.ndarray, m: int) -> np.ndarray:
    best = np.full(len(limit) * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    row, key, weight, low, length = _intervals(row, h, weight)
    end = (limit[row] * TICKS).astype(np.int64)
    time = np.zeros(len(key), dtype=np.int64)
    k = np.zeros(len(key), dtype=np.uint64)
    while len(key):
        # As many events at once as most likely fit.
        n = np.maximum(1, ((end - time) / TICKS * length * 0.7).astype(np.int64))
        first = np.cumsum(n) - n
        each = np.repeat(np.arange(len(key)), n)
        event = mix(key[each] + (k[each] + (np.arange(len(each)) - first[each]).astype(np.uint64)) * U(0x9E3779B97F4A7C15))
        gap = (-np.log(((event >> U(11)) + U(1)) * 2.0**-53) * (TICKS / length[each])).astype(np.int64) + 1
        run = np.cumsum(gap)
        at = run - (run[first] - gap[first])[each] + time[each]
        other = mix(event ^ U(0xA0761D6478BD642F))
        slot = (other & U(0xFFFFFFFF)).astype(np.int64) * m >> 32
        unit = ((other >> U(32)) * length[each].astype(np.uint64)) >> U(32)  # which unit interval the descent ends in
        counts = (at <= end[each]) & (low[each] + unit.astype(np.int64) < weight[each])
        packed = (at[counts].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (event[counts] >> U(32))
        np.minimum.at(best, row[each[counts]] * m + slot[counts], packed)
        last = first + n - 1
        time, k = at[last], k + n.astype(np.uint64)
        more = time <= end
        row, key, weight, low, length, end, time, k = (x[more] for x in (row, key, weight, low, length, end, time, k))
    return best.reshape(len(limit), m)


def band_keys(best: np.ndarray) -> np.ndarray:
    ids = (best & U(0xFFFFFFFF)).reshape(len(best), BANDS, ROWS)
    return mix((ids * powers(_M1, ROWS + 1)[1:]).sum(axis=2, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def codes(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the k-th occurrence of a shingle has a hash of its own. Returns codes by row, and offsets."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    k = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    out = np.where(k == 0, h, mix(h + k.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
    return out, np.searchsorted(row, np.arange(n_rows + 1))


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, text_key, node (hash of the word sequence), n (shingles) and bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(1))):
                words = Words(data, offs, ALNUM, lower=True)
                row, h, weight = bags(*shingled(words, size))
                n = np.bincount(row, weights=weight, minlength=j - i).astype(np.int32)
                keys = band_keys(signatures(row, h, weight, j - i))[n > 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), as_long(whole(words)), pa.array(n), lists(as_long(keys.reshape(-1)), np.concatenate([[0], np.cumsum(n > 0)]) * BANDS)],
                    names=["doc_id", "text_key", "node", "n", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"doc_id {kind}, text_key bigint, node bigint, n int, bands array<bigint>")


def _shingles(docs: DataFrame, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """node and codes of each wanted text (and of a few others), once."""
    table = bitmaps.broadcast_cells(wanted.select(bitmaps.cell(F.col("node"), BITS).alias("c")), "c", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(0))):
                words = Words(data, offs, ALNUM, lower=True)
                node = whole(words)
                keep = []
                for k in np.flatnonzero(bitmaps.probe(table.value, bitmaps.cells(node, BITS))).tolist():
                    if (x := int(node[k])) not in seen:
                        seen.add(x)
                        keep.append(k)
                if keep:
                    own, at = codes(*shingled(words, size), j - i)
                    chosen = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([as_long(node).take(chosen), lists(as_long(own), at).take(chosen)], names=["node", "codes"])

    return docs.select(text_col).mapInArrow(run, "node bigint, codes array<bigint>").groupBy("node").agg(F.first("codes").alias("codes"))


def _shared_sizes(shingles: DataFrame, sketch: Broadcast) -> DataFrame:
    """node, n (shingles) and shared: how many of them any other candidate may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            n = rows.value_lengths().to_numpy(zero_copy_only=False)
            own = rows.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total = np.concatenate([[0], np.cumsum(bitmaps.seen_twice(sketch.value, own, SKETCH_BITS))])
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array((total[end] - total[end - n]).astype(np.int32))], names=["node", "n", "shared"])

    return shingles.mapInArrow(run, "node bigint, n int, shared int")


def _sketch(shingles: DataFrame) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = bitmaps.PartSketch(SKETCH_BITS)
        for batch in batches:
            yield from sketch.add(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        yield from sketch.rest()

    return bitmaps.broadcast_seen_twice(shingles.select("codes").mapInArrow(run, bitmaps.PartSketch.SCHEMA), SKETCH_BITS)


def _against_centres(pairs: DataFrame, shingles: DataFrame, sketch: Broadcast) -> DataFrame:
    """c, node, similarity, and the node's shingles in terms of its centre: common (bits over the centre's codes) and extra
    (its other codes, without those that no other candidate has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity, common, extra = [], [], []
            for c, pair in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ends = {x["node"].as_py(): np.sort(x["codes"].values.to_numpy(zero_copy_only=False)) for x in pair}
                centre = ends.pop(c)
                (own,) = ends.values()
                where = np.isin(centre, own, assume_unique=True)
                shared = int(where.sum())
                similarity.append(shared / (len(centre) + len(own) - shared))
                common.append(np.packbits(np.concatenate([where, np.zeros(-len(where) % 64, dtype=bool)])).view(np.int64))
                others = own[~np.isin(own, centre, assume_unique=True)]
                extra.append(others[bitmaps.seen_twice(sketch.value, others.view(np.uint64), SKETCH_BITS)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity, type=pa.float64()), pa.array(common, type=kind), pa.array(extra, type=kind)], names=["c", "node", "similarity", "common", "extra"])

    ends = pairs.select("c", F.col("node").alias("other"), F.explode(F.array("c", "node")).alias("node"))
    both = skew_join(ends, shingles, ["node"], "inner").groupBy("c", "other").agg(F.collect_list(F.struct("node", "codes")).alias("pair"))
    return both.mapInArrow(run, "c bigint, node bigint, similarity double, common array<bigint>, extra array<bigint>")


def _bound(x: str, y: str) -> F.Column:
    """The largest possible similarity of two rows with n and shared."""
    most = F.least(f"{x}.shared", f"{y}.shared")
    return most / (F.col(f"{x}.n") + F.col(f"{y}.n") - most)


def _links(docs: DataFrame, texts: DataFrame, text_col: str, size: int, threshold: float) -> DataFrame:
    """Links (a, b) that connect the same texts as all links between texts that share a bucket."""
    threshold -= 1e-12
    members = texts.select(F.explode("bands").alias("band"), "node")
    several = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    members = cut(skew_join(members, several, ["band"], "inner"))
    shingles = cut(_shingles(docs, text_col, size, members.select("node").distinct()))
    sketch = _sketch(shingles)
    sizes = _shared_sizes(shingles, sketch).where(F.col("shared") >= F.col("n") * threshold)
    members = cut(skew_join(members, sizes, ["node"], "inner"))
    # The centre is the text with the smallest part of its own.
    centre = members.groupBy("band").agg(F.min(F.struct((-F.col("shared") / F.col("n")).alias("ratio"), "node")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(skew_join(members, centre.select("band", F.col("x.node").alias("c")), ["band"], "inner"))
    star = cut(_against_centres(members.where("node != c").select("c", "node").distinct(), shingles, sketch))
    links = star.where(F.col("similarity") >= threshold).select(F.col("c").alias("a"), F.col("node").alias("b"))

    # Labels need not be complete here: texts of one label are linked, and those of different labels are compared.
    labelled = skew_join(members.where("node != c"), components(links, most_rounds=1), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    labelled = cut(labelled.select("band", "node", "n", "shared", "c", "label"))
    sums = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    main = sums.groupBy("band").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    labelled = cut(skew_join(labelled, main.select("band", "main"), ["band"], "inner"))
    # Each text outside of its bucket's main component meets those of other components. The overlap of two texts is told by
    # what each has of their common centre, and by the extras of both, so the join itself makes rows of links only.
    told = cut(skew_join(labelled, star.select("c", "node", "common", "extra"), ["c", "node"], "inner"))
    both = F.aggregate(F.zip_with("x.common", "y.common", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    shared = both + F.size(F.array_intersect("x.extra", "y.extra"))
    other = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    similar = (_bound("x", "y") >= threshold) & (shared >= (F.col("x.n") + F.col("y.n") - shared) * threshold)
    found = told.where("label != main").alias("x").join(told.alias("y"), (F.col("x.band") == F.col("y.band")) & other & similar)
    return links.unionByName(found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, label) of every node with a link: the label is the least node of its component, or with most_rounds one of its nodes.

    Each round takes the least label among a node and its neighbours and then the label's own label, so that the number
    of rounds grows with the logarithm of a component's diameter.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    rounds = 0
    while rounds != most_rounds:
        rounds += 1
        near = skew_join(both.withColumnRenamed("b", "node"), labels, ["node"], "inner").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        out = cut(skew_join(step, jump, ["to"], "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("label")))
        labels = out.select("node", "label")
        if rounds != most_rounds and out.where("label != was").isEmpty():
            break
    return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents connected by a weighted Jaccard similarity of at least `threshold` over shingles of `size` words.

    Words are runs of a-z, 0-9 and characters over U+007F after lower-casing A-Z. Returns one row per document: doc_id,
    node (hash of its word sequence), class_id (the least doc_id of its class, itself for a document without near copies).

    Texts of fewer words than `size` are one shingle, so they match equal word sequences only. Null, empty and wordless texts
    are copies of each other. Repeated rows fall into one class. The least id ignores nulls; a class of null ids only has a
    null class_id. An empty table gives an empty result. Other columns aren't read. Sequences are told apart by 64-bit hashes.
    """
    return _classes(docs, threshold, size, id_col, text_col).select("doc_id", "node", "class_id")


def _classes(docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str) -> DataFrame:
    signed = cut(_signed(docs, id_col, text_col, size))
    texts = cut(signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("bands").alias("bands")))
    labels = components(_links(docs, texts, text_col, size, threshold))
    rooted = cut(texts.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = skew_join(rooted.select("node", "root"), least, ["root"], "inner").select("node", "root", "class_id")
    return skew_join(signed.select("doc_id", "text_key", "node"), classes, ["node"], "inner")


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of near_duplicates, with all its columns: the one with the least id that isn't null.

    Of texts with that id the one with the least hash is kept, of rows equal in id and text any one.
    """
    classes = _classes(docs, threshold, size, id_col, text_col)
    chosen = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x"))
    p = own_prefix(docs.columns)
    keys = cut(chosen.select(F.col("x.doc_id").alias(f"{p}id"), F.col("x.text_key").alias(f"{p}key")))
    kept = docs.join(keys, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text_col) == F.col(f"{p}key")), "left_semi")
    same_row = Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.lit(0))
    copy = f"{p}copy"
    return kept.withColumn(copy, F.row_number().over(same_row)).where(F.col(copy) == 1).drop(copy)
