"""The inverted index: how often each term occurs in each field of each chunk, where, and the statistics of the whole corpus.

It can be a plan over chunks (made) or tables whose files are sorted by term (write, read), of which a search reads the row groups of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_tokens


def _fields(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row for each chunk with an array of (field, tokens)."""
    return chunks.select("chunk_id", F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for f, c in fields.items())).alias("fields"))


def postings(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(term, chunk_id, field, pos) from chunks; `fields` names the column of each field. Made row by row, without a shuffle."""
    # The outer forms keep Spark from testing the arrays' sizes first, which would cut every text into tokens twice.
    rows = _fields(chunks, fields).select("chunk_id", F.explode_outer("fields").alias("f"))
    return rows.select("chunk_id", "f.field", F.posexplode_outer("f.tokens").alias("pos", "term")).where("term IS NOT NULL").select("term", "chunk_id", "field", "pos")


#: Characters and chunks whose terms one task sorts (the ids of so many chunks fit a dictionary page), and tokens that are turned into terms at once.
TASK_CHARS, TASK_CHUNKS, TOKENS = 8 << 20, 16_000, 1 << 20

#: Ids of chunks that are long texts stay in dictionaries of stored tables up to so many bytes; else each term of a chunk would have the whole id.
DICTIONARY_BYTES = 16 << 20


def inverted(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(term, chunk_id, field, tf, at) from chunks: each term once, with its places in order. Made row by row, without a shuffle."""
    names = list(fields)
    cut = chunks.select("chunk_id", *(index_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"__{i}") for i, c in enumerate(fields.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names):
                ends = np.cumsum(batch.column(i + 1).value_lengths().to_numpy(zero_copy_only=False))
                low = 0
                while low < batch.num_rows:
                    # Chunks of about so many tokens, one at least.
                    high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS, "right")))
                    yield _terms(batch.column(0).slice(low, high - low), batch.column(i + 1).slice(low, high - low), name)
                    low = high

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return cut.mapInArrow(run, f"term string, chunk_id {kind}, field string, tf bigint, at array<int>")


def _terms(chunk: pa.Array, tokens: pa.Array, field: str) -> pa.RecordBatch:
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    words = tokens.flatten().dictionary_encode()
    key = own * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    bounds = np.append(first, len(order))
    at = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(place[order], type=pa.int32()))
    term = words.dictionary.take(words.indices.take(pa.array(order[first])))
    return pa.RecordBatch.from_arrays(
        [term.cast(pa.string()), chunk.take(pa.array(own[order[first]])), pa.array([field] * len(first), type=pa.string()), pa.array(np.diff(bounds)), at], names=["term", "chunk_id", "field", "tf", "at"]
    )


def document_lengths(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(chunk_id, length) of chunks with any token: tokens over all fields, counted in place."""
    return _length(field_lengths(chunks, fields), list(fields))


def field_lengths(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """chunk_id and a column n_<field> for each field: its tokens."""
    rows = _fields(chunks, fields)
    return rows.select("chunk_id", *(F.size(F.get("fields", F.lit(i))["tokens"]).cast("long").alias(f"n_{f}") for i, f in enumerate(fields)))


def _length(lengths: DataFrame, fields: list[str]) -> DataFrame:
    total = sum((F.col(f"n_{f}") for f in fields[1:]), F.col(f"n_{fields[0]}"))
    return lengths.select("chunk_id", total.alias("length")).where("length > 0")


def corpus_stats(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length. Filters of a search never change these."""
    n = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    return lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")).crossJoin(n).select("n_chunks", (F.col("total") / F.col("n_chunks")).alias("mean_length"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, n_chunks, n_occurrences)."""
    return postings.groupBy("term").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count(F.lit(1)).alias("n_occurrences"))


@dataclass(frozen=True)
class Index:
    """terms (term, chunk_id, field, tf), positions (term, chunk_id, field, pos), vocabulary (term, fields), lengths (chunk_id, n_<field>),
    totals (n_chunks and the tokens of each field, one row), and the fields that a search is about."""

    terms: DataFrame
    positions: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    totals: DataFrame
    fields: tuple[str, ...]

    def of(self, fields: list[str]) -> Index:
        """The same index as if it had these fields only."""
        some = F.col("field").isin(fields)
        held = F.arrays_overlap("fields", F.array(*(F.lit(f) for f in fields)))
        return Index(self.terms.where(some), self.positions.where(some), self.vocabulary.where(held), self.lengths, self.totals, tuple(fields))

    def where_terms(self, test: F.Column) -> Index:
        """Only terms that pass; the test reaches the scans."""
        return Index(self.terms.where(test), self.positions.where(test), self.vocabulary.where(test), self.lengths, self.totals, self.fields)

    def document_lengths(self) -> DataFrame:
        return _length(self.lengths, list(self.fields))

    def stats(self) -> DataFrame:
        total = sum((F.col(f"n_{f}") for f in self.fields[1:]), F.col(f"n_{self.fields[0]}"))
        return self.totals.select("n_chunks", (total / F.col("n_chunks")).alias("mean_length"))


def _derived(rows: DataFrame, lengths: DataFrame, n_chunks: DataFrame, fields: dict[str, str]) -> Index:
    terms = rows.select("term", "chunk_id", "field", "tf")
    totals = lengths.agg(*(F.coalesce(F.sum(f"n_{f}"), F.lit(0)).alias(f"n_{f}") for f in fields)).crossJoin(n_chunks)  # one row each
    return Index(terms, occurring(rows), words(terms), lengths, totals, tuple(fields))


def occurring(rows: DataFrame) -> DataFrame:
    """(term, chunk_id, field, pos), a row for each place."""
    return rows.select("term", "chunk_id", "field", F.explode_outer("at").alias("pos"))


def words(terms: DataFrame) -> DataFrame:
    """(term, fields). Pairs are made single first, so that a task holds and sends each once."""
    return terms.select("term", "field").distinct().groupBy("term").agg(F.collect_list("field").alias("fields"))


def _counted(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"))


def made(chunks: DataFrame, fields: dict[str, str]) -> Index:
    """The index of chunks as a plan."""
    return _derived(inverted(chunks, fields), field_lengths(chunks, fields), _counted(chunks), fields)


def pieces(spark: SparkSession, chars: int | None, n_chunks: int) -> int:
    """Over how many tasks chunks are dealt: they grow with the texts, so that none has to spill."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // TASK_CHARS), -(-n_chunks // TASK_CHUNKS))


def write(chunks: DataFrame, fields: dict[str, str], path: str, partitions: int | None = None) -> None:
    """Stores the index of chunks. Each task sorts the terms of its own chunks, so no term, however common, fills a task, and a
    search reads in each file only the row groups that may hold its terms. Texts are cut into tokens once; the other tables come from the
    places, in the order they are stored in. Chunks are dealt evenly first, as files of texts may be few and uneven: this is the only
    shuffle of texts, and terms are not shuffled at all."""
    spark = chunks.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    columns = list(dict.fromkeys(fields.values()))
    if partitions is None:
        size = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0).cast("long"))
        partitions = pieces(spark, *chunks.agg(F.sum(size), F.count(F.lit(1))).first())
    dealt = chunks.select("chunk_id", *columns).repartition(partitions)
    rows = stored(inverted(dealt, fields).sortWithinPartitions("term", "chunk_id"), "positions")
    terms = stored(rows.select("term", "chunk_id", "field", "tf"), "terms")
    lengths = stored(terms.groupBy("chunk_id").agg(*(F.sum(F.when(F.col("field") == f, F.col("tf")).otherwise(0)).alias(f"n_{f}") for f in fields)), "lengths")
    stored(words(terms).sortWithinPartitions("term"), "vocabulary")
    stored(_derived(rows, lengths, _counted(chunks), fields).totals, "totals")


def read(spark: SparkSession, path: str) -> Index:
    """A stored index, of all its fields."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("terms", "positions", "vocabulary", "lengths", "totals")}
    tables["positions"] = occurring(tables["positions"])
    return Index(**tables, fields=tuple(c.removeprefix("n_") for c in tables["lengths"].columns if c.startswith("n_")))
