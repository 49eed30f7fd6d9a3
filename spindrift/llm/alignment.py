"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

Byte offsets at which tokens of both end are shared cuts; they divide a text into groups. They are found by divide and conquer:
a common end near the middle is located by bisecting both sequences of ends in turn, and both halves are searched likewise;
an interval without a common end is one group. All intervals of a level are searched at once.

Neither tokenizer joins what stands before a space or line feed with it (see `Pair.pieces`), so texts fall into pieces that are
encoded and aligned independently. A block of documents encodes and aligns each different piece once. Blocks are stored with
their documents as sequences of pieces; each block then gets the corpus-wide counts of its own pairs of ids and adds them up.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut, shared_folder
from .joins import skew_join

#: Vocabulary files; every function takes other paths.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a block's texts; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: How the byte-level tokenizer splits texts before its merges (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces longer than this are encoded by the slower library, whose time doesn't grow with the square of a piece.
LONG = 2_000
#: Pieces that are encoded at once.
RUN = 1_000

PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
_LOADED: dict[tuple[int, int], Pair] = {}


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _packed(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, their lengths, and where each begins."""
    lengths = np.array([len(x) for x in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), lengths, np.cumsum(lengths) - lengths


def _spelled(ids: np.ndarray, raw: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The bytes of a sequence of tokens."""
    n = lengths[ids]
    return raw[np.arange(int(n.sum())) + np.repeat(begins[ids] - (np.cumsum(n) - n), n)]


class Pair:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(byte_bpe)
        back = _byte_level()
        vocabulary = {bytes(map(back.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if all(c in back for c in token)}
        special = {x["id"] for x in model["added_tokens"]}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for t, i in vocabulary.items() if i not in special}, special_tokens={})
        self.file = byte_bpe
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.space = self.b.encode("\n")[:1]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        (self.a_raw, self.a_lengths, self.a_at), (self.b_raw, self.b_lengths, self.b_at) = map(_packed, (self.a_bytes, self.b_bytes))
        # Texts may be cut before a space or line feed only if no token of B holds one behind another character.
        plain = [x for i, x in enumerate(names) if not self.b.is_byte(i)]
        self.whole = any("▁" in x.lstrip("▁") or "\n" in x for x in plain)

    @cached_property
    def long_a(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.file.decode())
        made.encode_special_tokens = True
        return made

    def pieces(self, text: str) -> list[str]:
        """Space and text, cut before each space or line feed that follows a character other than white space.

        A's pattern never takes white space behind other characters, and B has no token with a space behind another character,
        so no token of either crosses such a place.
        """
        return [f" {text}"] if self.whole else PIECE.findall(f" {text}")

    def encode_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where those of each begin."""
        ids, lengths = [], []
        for k in range(0, len(pieces), RUN):
            some = pieces[k : k + RUN]
            run = "".join(some)
            if len(run) < RUN * 100 and not any(x[-1].isspace() or len(x) >= LONG for x in some):
                # What follows a piece begins with white space, so the run has the tokens of its pieces.
                found = np.array(self.a.encode_ordinary(run), dtype=np.int64)
                ends = np.cumsum([len(x.encode()) for x in some])
                ids.append(found)
                lengths.append(np.diff(np.searchsorted(np.cumsum(self.a_lengths[found]), ends), prepend=-1))
            else:
                each = [self.a.encode_ordinary(x) if len(x) < LONG else self.long_a.encode(x, add_special_tokens=False).ids for x in some]
                ids.append(np.fromiter(chain.from_iterable(each), dtype=np.int64))
                lengths.append([len(x) for x in each])
        return np.concatenate(ids or [np.zeros(0, dtype=np.int64)]), np.concatenate([[0], *lengths]).cumsum()

    def encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for k in range(0, len(pieces), RUN):
            some = pieces[k : k + RUN]
            # B adds a space of its own (but not to nothing): it stands for the piece's first one, or else is taken off again.
            found = self.b.encode([x[1:] if x[0] == " " else x for x in some], num_threads=1)
            own = [self.space if x == " " else y if x[0] == " " else y[1:] for x, y in zip(some, found, strict=True)]
            ids.append(np.fromiter(chain.from_iterable(own), dtype=np.int64))
            lengths.append([len(x) for x in own])
        return np.concatenate(ids or [np.zeros(0, dtype=np.int64)]), np.concatenate([[0], *lengths]).cumsum()


def load(files: tuple) -> Pair:
    """The tokenizers of two broadcast files, once for each Python worker."""
    key = (files[0].id if hasattr(files[0], "id") else id(files[0]), len(files[0].value), len(files[1].value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(files[0].value, files[1].value)
    return _LOADED[key]


def shared_cuts(a: np.ndarray, b: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] == b[j], both increasing, for i in [a_lo, a_hi) and j in [b_lo, b_hi) of each interval; in order."""
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while True:
        some = (a_lo < a_hi) & (b_lo < b_hi)
        a_lo, a_hi, b_lo, b_hi = a_lo[some], a_hi[some], b_lo[some], b_hi[some]
        if not len(a_lo):
            break
        middle = (a_lo + a_hi) // 2
        across = np.searchsorted(b, a[middle])
        i, j = _right_of(a, b, middle, across, a_hi, b_hi)
        right = i >= 0
        left = np.flatnonzero(~right)
        i[left], j[left] = _left_of(a, b, middle[left], a_lo[left], b_lo[left])
        hit = i >= 0
        found_i.append(i[hit])
        found_j.append(j[hit])
        # What was passed on the way holds no common end. One found to the left leaves nothing on its right side.
        r = right
        a_lo, a_hi, b_lo, b_hi = (
            np.concatenate(x) for x in ((a_lo[hit], i[r] + 1), (np.where(r, middle, i)[hit], a_hi[r]), (b_lo[hit], j[r] + 1), (np.where(r, across, j)[hit], b_hi[r]))
        )
    order = np.argsort(np.concatenate(found_i), kind="stable")
    return np.concatenate(found_i)[order], np.concatenate(found_j)[order]


def _right_of(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, a_hi: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first common end from a[i] on, or -1: each side is bisected for the other's next end."""
    out_i, out_j = np.full(len(i), -1), np.full(len(i), -1)
    open_ = np.arange(len(i))
    while len(open_):
        inside = j < b_hi[open_]
        open_, i, j = open_[inside], i[inside], j[inside]
        i = np.searchsorted(a, b[j])
        inside = i < a_hi[open_]
        open_, i, j = open_[inside], i[inside], j[inside]
        equal = a[i] == b[j]
        out_i[open_[equal]], out_j[open_[equal]] = i[equal], j[equal]
        open_, i = open_[~equal], i[~equal]
        j = np.searchsorted(b, a[i])
    return out_i, out_j


def _left_of(a: np.ndarray, b: np.ndarray, middle: np.ndarray, a_lo: np.ndarray, b_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last common end before a[middle], or -1."""
    out_i, out_j = np.full(len(middle), -1), np.full(len(middle), -1)
    open_, i = np.arange(len(middle)), middle - 1
    while len(open_):
        inside = i >= a_lo[open_]
        open_, i = open_[inside], i[inside]
        j = np.searchsorted(b, a[i], "right") - 1
        inside = j >= b_lo[open_]
        open_, i, j = open_[inside], i[inside], j[inside]
        i = np.searchsorted(a, b[j], "right") - 1
        inside = i >= a_lo[open_]
        open_, i, j = open_[inside], i[inside], j[inside]
        equal = a[i] == b[j]
        out_i[open_[equal]], out_j[open_[equal]] = i[equal], j[equal]
        open_, i = open_[~equal], i[~equal]
    return out_i, out_j


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets."""
    at = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=at[1:])
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(at[-1])), at


class Aligned:
    """Different pieces, encoded and aligned: by piece ok, n_a, n_b, n_groups, groups (text), and its links link_at[k]:link_at[k + 1]."""

    def __init__(self, pair: Pair, pieces: list[str]):
        (a, a_at), (b, b_at) = pair.encode_a(pieces), pair.encode_b(pieces)
        raw = "".join(pieces).encode()
        size = np.array([len(x.encode()) for x in pieces], dtype=np.int64)
        self.ok = np.ones(len(pieces), dtype=bool)
        for ids, at, own in ((a, a_at, (pair.a_raw, pair.a_lengths, pair.a_at)), (b, b_at, (pair.b_raw, pair.b_lengths, pair.b_at))):
            told = _spelled(ids, *own)
            if told.tobytes() != raw:
                end = np.concatenate([[0], np.cumsum(own[1][ids])])[at]
                stop = np.cumsum(size)
                self.ok &= [told[x:y].tobytes() == raw[z - n : z] for x, y, z, n in zip(end[:-1].tolist(), end[1:].tolist(), stop.tolist(), size.tolist(), strict=True)]
        # Tokens of pieces whose bytes differ are left out.
        keep_a, keep_b = np.repeat(self.ok, np.diff(a_at)), np.repeat(self.ok, np.diff(b_at))
        self.n_a, self.n_b = np.where(self.ok, np.diff(a_at), 0), np.where(self.ok, np.diff(b_at), 0)
        a, b = a[keep_a], b[keep_b]
        a_at, b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        a_end, b_end = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
        full = np.flatnonzero(self.n_a)
        i, j = shared_cuts(a_end, b_end, a_at[full], a_at[full + 1] - 1, b_at[full], b_at[full + 1] - 1)
        a_stop, b_stop = np.sort(np.concatenate([i, a_at[full + 1] - 1])) + 1, np.sort(np.concatenate([j, b_at[full + 1] - 1])) + 1
        group_at = np.searchsorted(a_stop, a_at, "right")
        self.n_groups = np.diff(group_at)
        self.groups = _named(a, b, a_stop, b_stop, group_at)
        # Each token of A overlaps a run of tokens of B.
        first = np.searchsorted(b_end, a_end - pair.a_lengths[a], "right")
        n = np.searchsorted(b_end, a_end) - first + 1
        link_a = np.repeat(np.arange(len(a)), n)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + first[link_a]
        self.link_at = np.concatenate([[0], np.cumsum(n)])[a_at]
        self.pairs, self.pair_of = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)


def _named(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, group_at: np.ndarray) -> list[str]:
    """The groups of each piece, in text. Most are of one token each, and few pairs of tokens differ, so these are named once."""
    a_from, b_from = np.concatenate([[0], a_stop[:-1]]), np.concatenate([[0], b_stop[:-1]])
    single = (a_stop - a_from == 1) & (b_stop - b_from == 1)
    names = np.empty(len(a_stop), dtype=object)
    kinds, which = np.unique(a[a_from[single]] << 32 | b[b_from[single]], return_inverse=True)
    names[single] = np.array([f"{x >> 32}|{x & 0xFFFFFFFF}" for x in kinds.tolist()], dtype=object)[which]
    several = np.flatnonzero(~single)
    names[several] = [
        f"{','.join(map(str, a[x:u].tolist()))}|{','.join(map(str, b[y:v].tolist()))}" for x, u, y, v in zip(a_from[several].tolist(), a_stop[several].tolist(), b_from[several].tolist(), b_stop[several].tolist(), strict=True)
    ]
    names, at = names.tolist(), group_at.tolist()
    return [";".join(names[u:v]) for u, v in zip(at[:-1], at[1:], strict=True)]


def _pack(values: np.ndarray) -> bytes:
    """Integers below 2 ** 32, byte by byte: the high bytes of small numbers are alike and pack well."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: pa.BinaryScalar, n: int) -> np.ndarray:
    raw = pa.decompress(packed.as_buffer(), 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _sums(values: np.ndarray, members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of members, the sum of their values."""
    return np.diff(np.concatenate([[0], np.cumsum(values[members])])[at])


BLOCK = (
    "block long, ids {ids}, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sizes array<long>, lengths binary, pieces binary, "
    "groups binary, links binary, pair_of binary, pairs array<long>, counts array<long>"
)


def _block(pair: Pair, number: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """A block of documents: each as a sequence of the block's different pieces (none if it has no tokens), and the pairs of ids of these."""
    index: dict[str, int] = defaultdict(count().__next__)
    own = [list(map(index.__getitem__, pair.pieces(x))) if x else [] for x in texts]
    members, at = _ragged(own)
    made = Aligned(pair, list(index))
    good = _sums((~made.ok).astype(np.int64), members, at) == 0
    members, lengths = members[np.repeat(good, np.diff(at))], np.where(good, np.diff(at), 0)
    at = np.concatenate([[0], np.cumsum(lengths)])
    times = np.bincount(members, minlength=len(index))
    counts = np.bincount(made.pair_of, weights=np.repeat(times, np.diff(made.link_at)), minlength=len(made.pairs)).astype(np.int64)
    # A pair that only documents without tokens have isn't counted, but keeps its place.
    rows = {
        "block": pa.array([number], type=pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids),
    }
    for name, values in (("n_a", made.n_a), ("n_b", made.n_b), ("n_groups", made.n_groups), ("n_links", np.diff(made.link_at))):
        rows[name] = pa.array([_sums(values, members, at)], type=pa.list_(pa.int64()))
    # Frequent pieces get small numbers.
    order = np.argsort(-times, kind="stable")
    number_of = np.empty(len(order), dtype=np.int64)
    number_of[order] = np.arange(len(order))
    names = "\n".join(map(made.groups.__getitem__, order.tolist())).encode()
    links = np.diff(made.link_at)
    pair_of = made.pair_of[np.arange(len(made.pair_of)) - np.repeat(np.cumsum(links[order]) - links[order] - made.link_at[:-1][order], links[order])]
    packed = {"lengths": _pack(lengths), "pieces": _pack(number_of[members]), "groups": pa.compress(names, codec="zstd", asbytes=True), "links": _pack(links[order]), "pair_of": _pack(pair_of)}
    rows["sizes"] = pa.array([[len(members), len(order), len(pair_of), len(names)]], type=pa.list_(pa.int64()))
    for name, value in packed.items():
        rows[name] = pa.array([value], type=pa.binary())
    rows["pairs"] = pa.array([made.pairs], type=pa.list_(pa.int64()))
    rows["counts"] = pa.array([counts], type=pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(rows)


def _blocks(docs: DataFrame, id_col: str, text_col: str, files: tuple, block_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(files)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        ids, texts, chars = [], [], 0
        for batch in batches:
            i = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                texts.append(text)
                chars += len(text or "")
                if chars >= block_chars:
                    ids.append(batch.column(0).slice(i, k + 1 - i))
                    i = k + 1
                    yield _block(pair, number, pa.concat_arrays(ids), texts)
                    number, ids, texts, chars = number + 1, [], [], 0
            if i < len(batch.column(0)):
                ids.append(batch.column(0).slice(i))
        if texts:
            yield _block(pair, number, pa.concat_arrays(ids), texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, BLOCK.format(ids=f"array<{kind}>"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """For each pair (id of A << 32 | id of B) its links in all documents, and whether no other id of A has more with that id of B."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("links"))
    pairs = cut(pairs.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The tokens of A (a byte-level BPE) and B (a BPE over pieces with byte fallback) of each text, grouped by the bytes they cover.

    Both encode a space and the text, without special tokens; their strings inside texts are plain text. Returns one row per
    document: doc_id, n_a, n_b, n_groups, n_links (pairs of overlapping tokens), groups (`a1,a2|b1;a3|b2,b3`: ids in order), n_best (links
    whose pair of ids has the most links among its B id's pairs in all documents, ties included) and count_sum (the pairs' links in
    all documents, over the document's links).

    Null and empty texts and texts whose tokens of A or B don't give back their bytes have no tokens: zeros and an empty `groups`.
    Repeated rows count as often as they occur; ids may be null or repeated. A long text is a block of its own, held by one task. An
    empty table gives an empty result. Other columns aren't read. The files are read on the driver and broadcast; their
    vocabularies have fixed sizes.
    """
    spark = docs.sparkSession
    files = tuple(spark.sparkContext.broadcast(open(path, "rb").read()) for path in (byte_bpe, piece_bpe))
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    _blocks(docs, id_col, text_col, files, block_chars).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    places = blocks.select(F.col("block").alias("own_block"), F.posexplode("pairs").alias("place", "pair"))
    known = skew_join(places, pair_counts(blocks), ["pair"], "inner").select("own_block", "place", "links", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return blocks.drop("pairs", "counts").groupBy("block").cogroup(known.groupBy("own_block")).applyInArrow(_told, out)


def _told(block: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a block, with the counts of its pairs."""
    links, best = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
    place = known["place"].to_numpy()
    links[place], best[place] = known["links"].to_numpy(), known["best"].to_numpy()
    row = {name: block[name].combine_chunks()[0] for name in block.column_names}
    n_members, n_pieces, n_links, n_names = row["sizes"].as_py()
    at, link_at = (np.concatenate([[0], np.cumsum(_unpack(row[x], n))]) for x, n in (("lengths", len(row["ids"].values)), ("links", n_pieces)))
    members, pair_of = _unpack(row["pieces"], n_members), _unpack(row["pair_of"], n_links)
    each = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[pair_of])])[link_at])
    n_best, count_sum = _sums(each(best), members, at), _sums(each(links), members, at)
    groups = pa.decompress(row["groups"].as_buffer(), n_names, codec="zstd", asbytes=True).decode().split("\n")
    ids, own = row["ids"].values, {name: row[name].values for name in ("n_a", "n_b", "n_groups", "n_links")}
    low, n, out = 0, len(ids), []
    while low < n:  # in batches, as the groups are several times as long as the texts
        high = max(low + 1, int(np.searchsorted(at, at[low] + 200_000, "right")) - 1)
        high = min(high, low + 5_000, n)
        some = slice(low, high)
        texts = [";".join(map(groups.__getitem__, members[u:v].tolist())) for u, v in zip(at[low:high].tolist(), at[low + 1 : high + 1].tolist(), strict=True)]
        out.append(pa.RecordBatch.from_pydict(
            {"doc_id": ids[some], **{name: x[some] for name, x in own.items()}, "groups": pa.array(texts, type=pa.string()), "n_best": pa.array(n_best[some]), "count_sum": pa.array(count_sum[some])}
        ))
        low = high
    return pa.Table.from_batches(out)
