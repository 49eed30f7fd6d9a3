"""Phrase collocation mining with weighted acyclic automata.

A phrase that occurs often has only words and word pairs that do. So words are counted first, then pairs of frequent words, then
longer n-grams of frequent pairs, these by hash; bit tables of fixed size tell which n-grams may be frequent. Each task then counts these exactly and builds an automaton
of its sorted n-grams for every range of first words. Automata of a range are united, their counts summed, and paths that are too
rare dropped. A phrase's beginnings lie on its own path; its other parts are looked up in the automata of their ranges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .automata import Counts, union
from .checkpoints import cut
from .joins import skew_join
from .kernels import Words, _mask, as_long, flat, mix, slices, window_hashes

U = np.uint64
#: Bytes that end a piece, and bytes of words.
ENDS = _mask(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
INSIDE = ~(ENDS | _mask(lambda b: b in b" \t"))
#: Bit tables of frequent words, pairs and longer n-grams: 2 ** 26 / 8 = 8 MB each. A full table lets more n-grams be counted exactly.
BITS = 26
#: Different n-grams a task holds before it passes them on.
HELD = 200_000
#: Hashes a task holds before it adds up equal ones.
HASHES = 1_000_000
#: Automata of a range that are united at once.
FAN = 64
#: Ranges for each shuffle partition, and words that are looked at for each bound between two.
RANGES, PER_BOUND = 4, 8
UNKNOWN = "und"


class Runs:
    """The words of some texts, and the runs of words that no piece's end divides."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: pa.Array):
        self.data = data
        words = self.words = Words(data, offs, INSIDE, lower=True)
        n = len(words.starts)
        first = np.zeros(n, dtype=bool)
        first[words.row_at[:-1][words.row_at[:-1] < n]] = True
        if n > 1:
            ended = np.cumsum(ENDS[data])
            first[1:] |= ended[words.starts[1:]] != ended[words.ends[:-1] - 1]
        self.first = first
        row = np.repeat(np.arange(len(offs) - 1), words.counts)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], dtype=np.uint64)
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[row]
        self.salt = salts[self.lang] if len(salts) else np.zeros(0, dtype=np.uint64)
        self.hash = mix(words.hash ^ self.salt)

    def joined(self, size: int) -> np.ndarray:
        """Whether the words from each place on are in one run (places where `size` words are left)."""
        n = max(len(self.first) - size + 1, 0)
        out = np.ones(n, dtype=bool)
        for k in range(1, size):
            out &= ~self.first[k : k + n]
        return out

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """The hashes of the n-grams that begin at some places."""
        return self.hash[at] if size == 1 else mix(window_hashes(self.words.hash, size)[at] ^ self.salt[at])

    def phrases(self, at: np.ndarray, size: int) -> list[str]:
        """The words from each place on, joined by spaces. They may be apart by any white space."""
        raw = self.data.tobytes()
        starts, ends = self.words.starts, self.words.ends
        columns = [[raw[x:y] for x, y in zip(starts[at + k].tolist(), ends[at + k].tolist(), strict=True)] for k in range(size)]
        # Only A-Z are lower-cased.
        return [b" ".join(x).lower().decode() for x in zip(*columns, strict=True)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    for batch in batches:
        langs = pc.fill_null(batch.column(1).cast(pa.string()), UNKNOWN)
        for i, j, data, offs in slices(*flat(batch.column(0))):
            yield Runs(data, offs, langs.slice(i, j - i))


def _words(texts: DataFrame) -> DataFrame:
    """lang, word, h (its hash) and n (occurrences)."""

    def told(held: list) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
        words, langs = pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held])
        return pa.RecordBatch.from_arrays([langs.take(pa.array(first)), words.take(pa.array(first)), as_long(h), pa.array(n)], names=["lang", "word", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for runs in _runs(batches):
            h, first, times = np.unique(runs.hash, return_index=True, return_counts=True)
            if len(h):
                held.append((h, times, pa.array(runs.phrases(first, 1), type=pa.string()), pa.array(runs.langs, type=pa.string()).take(pa.array(runs.lang[first]))))
                n += len(h)
            if n > HASHES:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    counted = texts.mapInArrow(run, "lang string, word string, h long, n long")
    return counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _table(hashes: DataFrame) -> Broadcast:
    return bitmaps.broadcast_cells(hashes.select(bitmaps.cell(F.col("h"), BITS).alias("c")), "c", BITS)


def _likely(h: np.ndarray, table: Broadcast) -> np.ndarray:
    """Which hashes may be those of frequent words or pairs."""
    bits = (8 * len(table.value)).bit_length() - 1
    return bitmaps.probe(table.value, bitmaps.cells(h, bits))


def _chains(runs: Runs, words: Broadcast, pairs: Broadcast | None) -> np.ndarray:
    """Where two words of one run stand that may both be frequent, and as a pair, if pairs are given."""
    often = _likely(runs.hash, words)
    out = np.zeros(len(often), dtype=bool)
    if len(often) > 1:
        out[:-1] = runs.joined(2) & often[:-1] & often[1:]
        if pairs is not None:
            where = np.flatnonzero(out)
            out[where] = _likely(runs.hashes(where, 2), pairs)
    return out


def _longer(chain: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes from 3 on, and the places of n-grams all of whose pairs stand in the chain."""
    fits = chain
    for size in range(3, most + 1):
        fits = fits[: len(fits) - 1] & chain[size - 2 :]
        if not fits.any():
            return
        yield size, np.flatnonzero(fits)


def _counted(texts: DataFrame, found) -> DataFrame:
    """h and n of the hashes that `found` makes of runs; each task adds up equal ones first."""

    def added(held: list) -> pa.RecordBatch:
        h, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([as_long(h), pa.array(n)], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for runs in _runs(batches):
            for h in found(runs):
                held.append(np.unique(h, return_counts=True))
                n += len(held[-1][0])
            if n > HASHES:
                yield added(held)
                held, n = [], 0
        if n:
            yield added(held)

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class _Tally:
    """Counts of n-grams by hash; the words of each are read once."""

    def __init__(self):
        self.h, self.n, self.place, self.keys = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def add(self, runs: Runs, at: np.ndarray, size: int) -> None:
        h, first, times = np.unique(runs.hashes(at, size), return_index=True, return_counts=True)
        place = np.searchsorted(self.h, h)
        known = np.zeros(len(h), dtype=bool)
        inside = place < len(self.h)
        known[inside] = self.h[place[inside]] == h[inside]
        self.n[place[known]] += times[known]
        if not known.all():
            some = at[first[~known]]
            langs = [runs.langs[k] for k in runs.lang[some].tolist()]
            new = np.arange(len(self.keys), len(self.keys) + len(some))
            self.keys += [(lang, *phrase.split(" ")) for lang, phrase in zip(langs, runs.phrases(some, size), strict=True)]
            where = place[~known]
            self.h, self.n, self.place = np.insert(self.h, where, h[~known]), np.insert(self.n, where, times[~known]), np.insert(self.place, where, new)

    def rows(self) -> list[tuple[tuple[str, ...], int]]:
        """All in order. Equal n-grams have one hash, so each is there once."""
        return sorted(zip(map(self.keys.__getitem__, self.place.tolist()), self.n.tolist(), strict=True))


def _shards(texts: DataFrame, words: Broadcast, pairs: Broadcast, longer: Broadcast, most: int, bounds: list[tuple[str, str]]) -> DataFrame:
    """range and automaton: the n-grams of up to `most` words that may be frequent, as each task counts them."""

    def told(tally: _Tally) -> pa.RecordBatch:
        rows = tally.rows()
        ranges, made, low = [], [], 0
        while low < len(rows):
            here = bisect_right(bounds, rows[low][0][:2])
            high = low + 1
            while high < len(rows) and (here == len(bounds) or rows[high][0][:2] < bounds[here]):
                high += 1
            ranges.append(here)
            made.append(Counts.build(rows[low:high]).dumps())
            low = high
        return pa.RecordBatch.from_arrays([pa.array(ranges, type=pa.int32()), pa.array(made, type=pa.binary())], names=["range", "automaton"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for runs in _runs(batches):
            tally.add(runs, np.flatnonzero(_likely(runs.hash, words)), 1)
            chain = _chains(runs, words, pairs)
            tally.add(runs, np.flatnonzero(chain), 2)
            for size, at in _longer(chain, most):
                tally.add(runs, at[_likely(runs.hashes(at, size), longer)], size)
            if len(tally.keys) > HELD:
                yield told(tally)
                tally = _Tally()
        if tally.keys:
            yield told(tally)

    return texts.mapInArrow(run, "range int, automaton binary")


def _united(shards: DataFrame, least: int) -> DataFrame:
    """range and automaton: one for each range, without paths below `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now: int, held: list[Counts]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], type=pa.int32()), pa.array([union(held, least).dumps()], type=pa.binary())], names=["range", "automaton"])

        now, held = None, []
        for batch in batches:
            for here, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here != now and held:
                    yield done(now, held)
                    held = []
                now = here
                held.append(Counts.loads(raw))
                if len(held) == FAN:
                    held = [union(held)]
        if held:
            yield done(now, held)

    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(run, "range int, automaton binary")


CUTS = "lang string, phrase string, n_words int, a long, k int, l long, rest string, rest_range int"


def _cuts(automata: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
    """The cuts of each phrase of two words or more: its count a, the count l of its first k words, and the rest with its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CUTS.split(", ")]
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = []
                for path, told in Counts.loads(raw).items():
                    for k in range(1, len(path) - 1):
                        rest = path[k + 1 :]
                        rows.append((path[0], " ".join(path[1:]), len(path) - 1, told[-1], k, told[k], " ".join(rest), bisect_right(bounds, (path[0], rest[0]))))
                    if len(rows) > 20_000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return automata.select("automaton").mapInArrow(run, CUTS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _looked_up(automata: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, rest and r: the counts of the wanted phrases, each range's by its automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for batch in batches:
            langs, rests, found = [], [], []
            for here, lang, rest, raw in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                if raw is not None:
                    now, automaton = here, Counts.loads(raw)
                elif here == now:
                    langs.append(lang)
                    rests.append(rest)
                    found.append(automaton.get((lang, *rest.split(" "))))
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(rests, type=pa.string()), pa.array(found, type=pa.int64())], names=["lang", "rest", "r"])

    rows = automata.select("range", F.lit("").alias("lang"), F.lit("").alias("rest"), "automaton").unionByName(wanted.select("range", "lang", "rest", F.lit(None).cast("binary").alias("automaton")))
    ordered = rows.repartition("range").sortWithinPartitions("range", F.col("automaton").isNull())
    return ordered.mapInArrow(run, "lang string, rest string, r long")


def collocations(
    docs: DataFrame, least: int = 100, most_words: int = 5, best: int = 2000, covered: int = 100, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The phrases of each language whose parts occur together most above chance.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and U+000A to U+000D into pieces, these at spaces and tabs into words. n is the
    number of a language's words, f(phrase) that of its occurrences within pieces. Candidates are phrases of 2 to `most_words` words
    with a = f(phrase) >= `least`. A cut into two parts of counts l and r scores floor(1000 * a * n / (l * r)); a phrase's score is
    its lowest (ties: the first cut), in exact arithmetic. A candidate inside a longer one L with 100 * f(L) >= `covered` * a is dropped. Returns of
    each language the first `best` by score, a (both descending) and phrase: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, a null text empty; languages whose texts have no candidates have no rows. Repeated rows count as often
    as they occur. Texts of any length are read whole. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)))
    words = cut(_words(texts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    frequent = _table(often)
    pairs = _table(_counted(texts, lambda runs: [runs.hashes(np.flatnonzero(_chains(runs, frequent, None)), 2)]).where(F.col("n") >= least))
    longer = _table(_counted(texts, lambda runs: (runs.hashes(at, size) for size, at in _longer(_chains(runs, frequent, pairs), most_words))).where(F.col("n") >= least))

    # Bounds between ranges only balance the work: some frequent words, which their hashes choose, in order.
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted((x["lang"], x["word"]) for x in often.select("lang", "word", "h").orderBy("h", "lang", "word").limit(ranges * PER_BOUND).collect())
    bounds = sample[PER_BOUND - 1 :: PER_BOUND]

    automata = cut(_united(_shards(texts, frequent, pairs, longer, most_words, bounds), least))
    cuts = cut(_cuts(automata, bounds))
    wanted = cuts.select(F.col("rest_range").alias("range"), "lang", "rest").distinct()
    parts = _looked_up(automata, wanted)
    scored = skew_join(skew_join(cuts.drop("rest_range"), parts, ["lang", "rest"], "inner"), totals, ["lang"], "inner")
    score = F.expr("(CAST(1000 AS decimal(4, 0)) * CAST(a AS decimal(15, 0)) * CAST(n AS decimal(18, 0))) div (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0)))")
    phrases = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "n_words")).alias("x")).select("lang", "phrase", "x.*")

    # Every shorter phrase inside a candidate, with the candidate's count.
    held = cuts.where("k = 1 AND n_words > 2").select("lang", "a", F.split("phrase", " ").alias("w"))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    longest = held.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = skew_join(phrases, longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))

    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
