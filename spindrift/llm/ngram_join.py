"""N-gram Jaccard self-join with prefix trees.

A text is the set of its word n-grams. A fixed-size sketch tells which n-grams may stand in several sets; a set is a candidate if
enough of its n-grams do. Candidates are ordered globally, rare n-grams first, so that two similar sets share an n-gram of their
prefixes. Sets that share a prefix n-gram form a bucket, whose most shared set is its centre; the sets of all buckets of a centre are
stored in prefix trees of bounded size. A tree is traversed with a probe: sets below a node share its partial overlap, and a
subtree goes as soon as the lengths left on both sides can't reach the threshold.

First each centre probes its trees. Sets that are then connected with their centre need not meet each other; only the others probe
the trees of their centres. So a family of n close copies costs n comparisons, and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .checkpoints import cut
from .joins import skew_join
from .kernels import SPACED, Words, flat, lists, mix, slices
from .neardup import components, shingled

U = np.uint64
#: Cells of each of the sketch's two rows: 2 * 2 ** 27 / 8 = 32 MB are broadcast at any input size. A full sketch lets more sets pass.
SKETCH_BITS = 27
#: An n-gram's rarity is the number of these counts of candidate sets that it reaches; each has a bit table of 2 ** bits / 8 bytes (8 + 5 * 2 MB).
LEVELS = {2: 26, 4: 24, 16: 24, 64: 24, 256: 24, 4096: 24}
#: Sets and n-grams of a tree, at most (one larger set is a tree of its own).
TREE_SETS, TREE_TOKENS = 256, 1 << 19
#: Sets that a task remembers so as to pass over their copies.
REMEMBERED = 1 << 20


def _sets(words: Words, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of all rows in order of row, their offsets by row, and a 128-bit hash of each row's set."""
    row, h = shingled(words, size)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    at = np.searchsorted(row, np.arange(n_rows + 1))
    key = np.zeros((n_rows, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        key[full, 0] = np.add.reduceat(mix(h), at[full])
        key[full, 1] = np.add.reduceat(mix(h ^ U(0xD6E8FEB86659FD93)), at[full])
    return h, at, key


def _keys(key: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, 16 * len(key) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(key))])


def _rows_of(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which elements belong to the rows."""
    wanted = np.zeros(len(at) - 1, dtype=bool)
    wanted[rows] = True
    return np.repeat(wanted, np.diff(at))


class _New:
    """Which sets a task hasn't seen yet (of its last REMEMBERED ones)."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, key: np.ndarray) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out = np.zeros(len(key), dtype=bool)
        raw = key.tobytes()
        for i in range(len(key)):
            if (x := raw[16 * i : 16 * i + 16]) not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _sketch(docs: DataFrame, text_col: str, size: int) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, new = bitmaps.PartSketch(SKETCH_BITS), _New()
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(0))):
                h, at, key = _sets(Words(data, offs, SPACED, lower=True), size, j - i)
                yield from sketch.add(h[_rows_of(at, np.flatnonzero(new(key)))])
        yield from sketch.rest()

    return bitmaps.broadcast_seen_twice(docs.select(text_col).mapInArrow(run, bitmaps.PartSketch.SCHEMA), SKETCH_BITS)


def _candidates(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, sketch: Broadcast) -> DataFrame:
    """doc_id, key (of the set), n (its size), and of candidates their codes that may stand in other sets, once for each set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(1))):
                h, at, key = _sets(Words(data, offs, SPACED, lower=True), size, j - i)
                n = np.diff(at)
                shared = bitmaps.seen_twice(sketch.value, h, SKETCH_BITS)
                total = np.concatenate([[0], np.cumsum(shared)])[at]
                chosen = (n > 0) & (100 * np.diff(total) >= percent * n) & new(key)
                kept = h[shared & _rows_of(at, np.flatnonzero(chosen))]
                own = np.concatenate([[0], np.cumsum(np.where(chosen, np.diff(total), 0))])
                codes = pa.ListArray.from_arrays(pa.array(own, type=pa.int32()), pa.array(kept.view(np.int64)), mask=pa.array(~chosen))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _keys(key), pa.array(n), codes], names=["doc_id", "key", "n", "codes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, key binary, n long, codes array<bigint>")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """node, n and tokens of the sets that can be similar to another: the n-grams that others have, in the global order.

    A token is an n-gram's rarity in front of 60 bits of its hash, so the order of tokens is that of rarity.
    """
    counts = cut(sets.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    tables = [(bits, bitmaps.broadcast_cells(counts.where(F.col("sets") >= level).select(bitmaps.cell(F.col("code"), bits).alias("c")), "c", bits)) for level, bits in LEVELS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2)
            h = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy(zero_copy_only=False))
            n = batch.column(1).to_numpy(zero_copy_only=False)
            reached = np.zeros(len(h), dtype=np.int64)
            for bits, table in tables:
                reached += bitmaps.probe(table.value, bitmaps.cells(h, bits))
            shared = bitmaps.probe(tables[0][1].value, bitmaps.cells(h, tables[0][0]))
            enough = 100 * np.bincount(row[shared], minlength=len(n)) >= percent * n
            kept = shared & enough[row]
            token, row = (reached[kept].astype(np.uint64) << U(60)) | (h[kept] >> U(4)), row[kept]
            order = np.lexsort((token, row))
            numbers = np.flatnonzero(enough)
            at = np.searchsorted(row, np.append(numbers, len(n)))
            chosen = pa.array(numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), lists(pa.array(token[order].view(np.int64)), at)], names=["node", "n", "tokens"])

    return sets.select("node", "n", "codes").mapInArrow(run, "node long, n long, tokens array<bigint>")


class Tree:
    """A compressed prefix tree over sets, each an increasing array of tokens. A node's edge is a run of tokens of one of its sets."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.vocabulary, flat_ = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        coded = [flat_[e - len(x) : e].astype(">u4") for x, e in zip(sets, ends, strict=True)]
        order = sorted(range(len(sets)), key=lambda i: coded[i].tobytes())
        parent, depth, source = [-1], [0], [order[0]]
        self.at_node: list[list[int]] = [[]]
        stack, before = [0], None
        for i in order:
            own, shared = coded[i], 0
            if before is not None:
                k = min(len(own), len(before))
                differ = np.flatnonzero(own[:k] != before[:k])
                shared = int(differ[0]) if len(differ) else k
            last = None
            while depth[stack[-1]] > shared:
                last = stack.pop()
            if depth[stack[-1]] < shared:  # the last edge is split
                parent.append(stack[-1])
                depth.append(shared)
                source.append(source[last])
                self.at_node.append([])
                parent[last] = len(parent) - 1
                stack.append(len(parent) - 1)
            if len(own) > depth[stack[-1]]:
                parent.append(stack[-1])
                depth.append(len(own))
                source.append(i)
                self.at_node.append([])
                stack.append(len(parent) - 1)
            self.at_node[stack[-1]].append(i)
            before = own
        self.sizes = np.array(sizes, dtype=np.int64)
        self.depth = np.array(depth)
        nodes = np.argsort(self.depth, kind="stable").tolist()  # parents before children
        self.least, self.most, self.longest = np.full(len(depth), np.iinfo(np.int64).max), np.zeros(len(depth), dtype=np.int64), np.zeros(len(depth), dtype=np.int64)
        self.children: list[list[int]] = [[] for _ in depth]
        for v in reversed(nodes):
            for i in self.at_node[v]:
                self.least[v], self.most[v], self.longest[v] = min(self.least[v], sizes[i]), max(self.most[v], sizes[i]), max(self.longest[v], len(coded[i]))
            if (p := parent[v]) >= 0:
                self.children[p].append(v)
                self.least[p], self.most[p], self.longest[p] = min(self.least[p], self.least[v]), max(self.most[p], self.most[v]), max(self.longest[p], self.longest[v])
        edges = [coded[source[v]][depth[parent[v]] if parent[v] >= 0 else 0 : depth[v]] for v in range(len(depth))]
        self.edge_at = np.concatenate([[0], np.cumsum([len(x) for x in edges])])
        self.edges = np.concatenate(edges).astype(np.int64)

    def similar(self, probe: np.ndarray, size: int, percent: int) -> list[int]:
        """The sets whose Jaccard similarity with the probe (a set of `size` n-grams, of which others have these tokens) reaches percent."""
        place = np.minimum(np.searchsorted(self.vocabulary, probe), len(self.vocabulary) - 1)
        has = np.zeros(len(self.vocabulary), dtype=bool)
        has[place[self.vocabulary[place] == probe]] = True
        found: list[int] = []
        nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(nodes):
            below = [self.children[v] for v in nodes.tolist()]
            n = [len(x) for x in below]
            nodes, overlap = np.array([v for x in below for v in x], dtype=np.int64), np.repeat(overlap, n)
            # Lengths decide before any edge is read.
            fits = (100 * self.most[nodes] >= percent * size) & (percent * self.least[nodes] <= 100 * size)
            nodes, overlap = nodes[fits], overlap[fits]
            if not len(nodes):
                break
            low, length = self.edge_at[nodes], self.edge_at[nodes + 1] - self.edge_at[nodes]
            first = np.cumsum(length) - length
            at = np.arange(int(length.sum())) + np.repeat(low - first, length)
            overlap = overlap + np.add.reduceat(has[self.edges[at]], first, dtype=np.int64)
            left = len(probe) - np.searchsorted(probe, self.vocabulary[self.edges[low + length - 1]], "right")
            most = overlap + np.minimum(left, self.longest[nodes] - self.depth[nodes])
            fits = (100 + percent) * most >= percent * (size + self.least[nodes])
            nodes, overlap = nodes[fits], overlap[fits]
            for v, o in zip(nodes.tolist(), overlap.tolist(), strict=True):
                found += [i for i in self.at_node[v] if (100 + percent) * o >= percent * (size + int(self.sizes[i]))]
        return found


def _traversed(percent: int):
    """Rows of one tree after another, its sets before its probes: the links found, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, held = None, None, []
        for batch in batches:
            values = batch.column(6)
            tokens, at = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            a, b = [], []
            for k, (c, part, probes, node, label, n) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True)):
                if (c, part) != now:
                    now, tree, held = (c, part), None, []
                own = tokens[at[k] : at[k + 1]]
                if not probes:
                    held.append((node, label, n, own.copy()))
                elif held:
                    tree = tree or Tree([x[3] for x in held], [x[2] for x in held])
                    near = [held[i][0] for i in tree.similar(own, n, percent) if held[i][1] != label]
                    a += [node] * len(near)
                    b += near
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return run


def _tree_join(members: DataFrame, probes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between probes (c, node, label) and members (c, node, label, s) of the trees of the same centre that have another label."""
    rooms = members.groupBy("c").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TREE_SETS, F.sum("s") / TREE_TOKENS)).alias("trees"))
    dealt = skew_join(members, rooms, ["c"], "inner")
    dealt = dealt.select("c", F.pmod(F.xxhash64("node"), "trees").alias("part"), F.lit(False).alias("probes"), "node", "label")
    sent = skew_join(probes, rooms, ["c"], "inner")
    sent = sent.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("part"), F.lit(True).alias("probes"), "node", "label")
    rows = skew_join(dealt.unionByName(sent), sets.select("node", "n", "tokens"), ["node"], "inner").select("c", "part", "probes", "node", "label", "n", "tokens")
    return rows.repartition("c", "part").sortWithinPartitions("c", "part", "probes").mapInArrow(_traversed(percent), "a long, b long")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes that connect the same sets as all links of that similarity."""
    sets = cut(_ordered(sets, percent))
    s = F.size("tokens")
    # The n-grams that no other set has are the rarest; the prefix begins with them.
    prefix = F.greatest(s - F.ceil(F.col("n") * percent / 100) + 1, F.lit(0)).cast("int")
    spread = sets.select("node", s.cast("long").alias("s"), (-s / F.col("n")).alias("own"), F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token"))
    bucket = spread.groupBy("token").agg(F.min(F.struct("own", "node")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = skew_join(spread, bucket.select("token", F.col("x.node").alias("c")), ["token"], "inner").where("node != c")
    members = cut(members.select("c", "node", "s").distinct())
    centres = members.select("c").distinct()
    star = cut(_tree_join(members.withColumn("label", F.col("node")), centres.select("c", F.col("c").alias("node"), F.col("c").alias("label")), sets, percent))

    # Labels need not be complete: sets of one label are connected, and those of other labels are compared.
    labels = cut(components(star, most_rounds=1))
    labelled = skew_join(members, labels, ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    of_centre = centres.join(labels.select(F.col("node").alias("c"), F.col("label").alias("main")), "c", "left").withColumn("main", F.coalesce("main", "c"))
    labelled = cut(skew_join(labelled, of_centre, ["c"], "inner"))
    apart = labelled.where("label != main")
    some = apart.select("c").distinct()
    rest = _tree_join(skew_join(labelled.select("c", "node", "label", "s"), some, ["c"], "left_semi"), apart.select("c", "node", "label"), sets, percent)
    return cut(star.unionByName(rest))


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least percent / 100 of their sets of n-grams of `size` words.

    Words are runs of characters other than white space (U+0020, U+0009 to U+000D), after lower-casing A-Z. Returns one row per
    document: doc_id, n_shingles (size of its set) and component_id (the least doc_id that links reach from it, itself included).

    A text of fewer words than `size` is one n-gram, its whole sequence. Null, empty and wordless texts have no n-grams and are linked
    with nothing. Repeated rows and equal sets are linked. The least id ignores nulls; a component of null ids only has a null
    component_id. Whole texts of any length are read. An empty table gives an empty result. Other columns aren't read. Equal sets
    are told by 128-bit hashes, n-grams of two compared sets by 60-bit hashes.
    """
    signed = cut(_candidates(docs, id_col, text_col, size, percent, _sketch(docs, text_col, size)))
    full = signed.where("n > 0")
    ids = full.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    sets = full.where("codes IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("codes").alias("codes"))
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    labels = components(_links(sets, percent))
    rooted = cut(ids.join(sets.select("key", "node").join(labels, "node").select("key", "label"), "key", "left"))
    several = rooted.where("label IS NOT NULL")
    least = several.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = skew_join(several, least, ["label"], "inner").select("key", "component_id").unionByName(rooted.where("label IS NULL").select("key", F.col("first_id").alias("component_id")))
    linked = skew_join(full.select("doc_id", "key", "n"), found, ["key"], "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
