"""The engine's operators as queries over the given tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import MEDIA_EXTENSIONS, OFFICE_EXTENSIONS, QUERY_TYPES, SETTINGS, TEXT_EXTENSIONS
from .functions import text
from .jobs import ingest
from .jobs import search as search_job
from .operators import aggregate, chunking, dense, embed, evaluate, fusion, incremental, index, notes, planner, requests, rerank, segments, sparse, vector_index
from .sources import stored
from .sources.tables import FIRST_TIME, files, passage_queries, table
from .sources.tables import notes as note_files
from .streaming import maintenance

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# What the adapters make of the tables, in SQL.
FILES = f"""files AS (
  SELECT doc_id, '/corpus/' || source || '/' || doc_id || '.txt' AS filepath, doc_id || '.txt' AS filename, 'file' AS source_type,
    {FIRST_TIME} + 3600.0 * doc_id AS mtime, {FIRST_TIME} + 3600.0 * doc_id - 86400.0 AS ctime, text AS content, source FROM documents)"""
NOTES = """notes AS (
  SELECT conv_id, '/notes/' || conv_id || '.md' AS filepath, string_agg('## ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS content
  FROM conversations GROUP BY conv_id)"""


def words_sql(column: str) -> str:
    return rf"list_filter(string_split_regex(lower(strip_accents({column})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


ASKED = f"asked AS (SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:3], ' ') AS query FROM benchmark)"

# ---------------------------------------------------------------- scans, projections, filters


@query(f"""
WITH {FILES}
SELECT filepath, mtime, source_type FROM files
WHERE filename NOT LIKE '.%' AND NOT contains(filepath, '/.') AND regexp_extract(filename, '(\\.[^./]+)$', 1) IN ('.txt', '.md') AND (contains(filepath, '/src1') OR contains(filepath, '/src2'))""")
def inventory_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.indexable(files(spark, sf_dir), [".txt", ".md"], ["/src1", "/src2"]).select("filepath", "mtime", "source_type")


@query("""
SELECT doc_id, CASE WHEN source = 'src1' THEN doc_id || '.txt' ELSE source || '/' || doc_id || '.txt' END AS relative,
  CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 3 = 1 THEN 'office' ELSE 'media' END AS kind FROM documents""")
def relative_path_longest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".TXT"), F.lit(".docx"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int")))
    ext = text.extension(name)
    kind = F.when(ext.isin(TEXT_EXTENSIONS), "text").when(ext.isin(OFFICE_EXTENSIONS), "office").when(ext.isin(MEDIA_EXTENSIONS), "media")
    return rows.select("doc_id", text.relative_path(F.col("filepath"), ["/corpus", "/corpus/src1"]).alias("relative"), kind.alias("kind"))


@query(f"""
WITH {FILES}
SELECT md5(filepath) || '_fn' AS chunk_id, '文件名: ' || filename || chr(10) || '路径: ' || filepath AS content,
  CASE WHEN trim(coalesce(content, '')) = '' THEN ' ' ELSE substr(content, 1, 600) END AS embedding_text FROM files""")
def filename_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return rows.select(
        F.concat(F.md5("filepath"), F.lit("_fn")).alias("chunk_id"),
        F.concat(F.lit("文件名: "), F.col("filename"), F.lit("\n路径: "), F.col("filepath")).alias("content"),
        text.truncate(F.col("content"), SETTINGS.embed_max).alias("embedding_text"),
    )


@query(f"""
WITH {NOTES}
SELECT filepath, array_to_string(list_transform(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+(.+)$', 1), lambda h: h), '|') AS headings FROM notes""")
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_files(spark, sf_dir).select("filepath", F.array_join(text.headings(F.col("content")), "|").alias("headings"))


@query("""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g'))), '|') AS headings FROM pages""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.html_headings(F.col("html")), "|").alias("headings"))


@query(f"SELECT doc_id, {words_sql('text')} AS tokens FROM documents")
def tokenize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("tokens"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.content_chunks(files(spark, sf_dir), markdown=False)


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.content_chunks(note_files(spark, sf_dir), markdown=True)


@query(f"""
WITH {NOTES},
heads AS (SELECT filepath, list_distinct(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+(.+)$', 1)) AS h FROM notes)
SELECT md5(filepath) AS file_id, md5(filepath) || '_fn' AS chunk_id, 'filename' AS chunk_type FROM notes
UNION ALL SELECT md5(filepath), md5(filepath) || '_h0', 'heading' FROM heads WHERE len(h) > 0""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = note_files(spark, sf_dir).select("filepath", F.regexp_extract("filepath", "[^/]+$", 0).alias("filename"), "source_type", F.lit(0.0).alias("mtime"), F.lit(0.0).alias("ctime"), "content")
    return chunking.chunk_records(rows, markdown=True).where("chunk_type <> 'content'").select("file_id", "chunk_id", "chunk_type")


# ---------------------------------------------------------------- index and keyword retrieval


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("chunk_id"), F.md5("filepath").alias("file_id"), "filepath", "filename", "source_type", "source", F.lit("content").alias("chunk_type"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("title_path"), "content", "mtime", "ctime")


TOKENS = f"tokens AS (SELECT doc_id AS chunk_id, unnest({words_sql('text')}) AS term FROM documents)"
STATS = "stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tokens) / (SELECT count(*) FROM documents)::DOUBLE AS mean_length), lengths AS (SELECT chunk_id, count(*) AS length FROM tokens GROUP BY chunk_id)"


@query(f"WITH {TOKENS}, {STATS} SELECT n AS n_chunks, round(mean_length, 6) AS mean_length FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _doc_chunks(spark, sf_dir)
    stats = index.corpus_stats(chunks, index.document_lengths(chunks, {"content": "content"}))
    return stats.select("n_chunks", F.round("mean_length", 6).alias("mean_length"))


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_occurrences FROM tokens GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(index.postings(_doc_chunks(spark, sf_dir), {"content": "content"}))


TYPE_SQL = r"""CASE WHEN contains(q, '"') OR contains(q, chr(39)) THEN 'exact' WHEN regexp_matches(q, '\.[a-zA-Z0-9]{1,4}$') THEN 'filename'
  WHEN regexp_matches(q, '(def |class |import |Exception|Error|\.py)') THEN 'code' WHEN length(q) > 15 AND len(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')) > 4 THEN 'semantic' ELSE 'hybrid' END"""


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of all types: passages with marks by their number."""
    rows = passage_queries(spark, sf_dir, 2)
    k = F.col("query_id") % 5
    long = F.array_join(F.slice(text.words(F.col("t")), 1, 6), " ")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("t")).join(rows, "query_id")
    q = F.when(k == 0, F.concat(F.lit('"'), F.col("query"), F.lit('"'))).when(k == 1, F.concat(F.col("query"), F.lit(".txt"))).when(k == 2, F.concat(F.lit("class "), F.col("query"))).when(k == 3, long).otherwise(F.col("query"))
    return rows.select("query_id", q.alias("query"), (k == 0).alias("exact_focus"), (F.col("query_id") * 7 + 40).cast("int").alias("limit"))


VARIED = f"""base AS (SELECT item_id AS query_id, {words_sql('text')} AS w FROM benchmark),
varied AS (SELECT query_id, CASE query_id % 5 WHEN 0 THEN '"' || array_to_string(w[1:2], ' ') || '"' WHEN 1 THEN array_to_string(w[1:2], ' ') || '.txt' WHEN 2 THEN 'class ' || array_to_string(w[1:2], ' ')
  WHEN 3 THEN array_to_string(w[1:6], ' ') ELSE array_to_string(w[1:2], ' ') END AS q, query_id % 5 = 0 AS exact_focus, least(200, greatest(1, query_id * 7 + 40)) AS lim FROM base),
typed AS (SELECT *, {TYPE_SQL} AS query_type FROM varied)"""


def _budget(place: int) -> str:
    return "CASE query_type " + " ".join(f"WHEN '{k}' THEN {v[place]}" for k, v in QUERY_TYPES.items()) + " END"


@query(f"WITH {VARIED} SELECT query_id, q AS query, query_type, CASE WHEN exact_focus THEN 'high' ELSE 'medium' END AS exactness FROM typed WHERE length(trim(q)) > 0")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.plan(_varied(spark, sf_dir)).select("query_id", "query", "query_type", "exactness")


@query(f"""WITH {VARIED} SELECT query_id, {_budget(0)} AS sparse_k, {_budget(1)} AS dense_k, {_budget(2)}::DOUBLE AS sparse_weight, {_budget(3)}::DOUBLE AS dense_weight,
  greatest(50, lim)::INT AS rerank_k, greatest(200, 2 * greatest(50, lim))::INT AS fusion_k FROM typed WHERE length(trim(q)) > 0""")
def plan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.plan(_varied(spark, sf_dir)).select("query_id", "sparse_k", "dense_k", "sparse_weight", "dense_weight", "rerank_k", "fusion_k")


@query(f"WITH {ASKED} SELECT query_id, array_to_string(list_transform(list_filter(string_split(query, ' '), lambda w: w <> ''), lambda w: w || CASE WHEN regexp_full_match(w, '[a-zA-Z0-9]+') THEN '*' ELSE '' END), ' ') AS clauses FROM asked")
def build_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.transform(planner.clauses(F.col("query")), lambda alts: F.concat(F.array_join(alts[0]["tokens"], "+"), F.when(alts[0]["is_prefix"], "*").otherwise("")))
    return passage_queries(spark, sf_dir).select("query_id", F.array_join(made, " ").alias("clauses"))


def bm25_sql(asked: str, k: int, keep: str = "true", weights: dict[str, float] | None = None) -> str:
    """Prefix clauses joined by AND over one weighted set of fields."""
    fields = {"content": 1.0} if weights is None else weights
    columns = {"content": "text", "filename": "doc_id || '.txt'", "path": "'/corpus/' || source || '/' || doc_id || '.txt'"}
    union = " UNION ALL ".join(f"SELECT doc_id AS chunk_id, {w} AS weight, unnest({words_sql(columns[f])}) AS term FROM documents" for f, w in fields.items())
    return f"""
WITH asked AS ({asked}),
tokens AS ({union}), {STATS},
clauses AS (SELECT query_id, unnest(range(len(w))) AS clause, unnest(w) AS prefix FROM (SELECT query_id, list_filter(string_split(query, ' '), lambda x: x <> '') AS w FROM asked)),
vocabulary AS (SELECT DISTINCT term FROM tokens),
matched AS (SELECT query_id, clause, term FROM clauses JOIN vocabulary ON CASE WHEN regexp_full_match(prefix, '[a-zA-Z0-9]+') THEN starts_with(term, prefix) ELSE term = prefix END),
hits AS (SELECT query_id, clause, chunk_id, sum(weight) AS f FROM matched JOIN tokens USING (term) GROUP BY ALL),
spread AS (SELECT query_id, clause, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf, mean_length FROM hits, stats GROUP BY query_id, clause, n, mean_length),
scored AS (SELECT query_id, chunk_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score, count(*) AS m FROM hits JOIN spread USING (query_id, clause) JOIN lengths USING (chunk_id) GROUP BY query_id, chunk_id),
complete AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM scored s WHERE m = (SELECT count(*) FROM clauses c WHERE c.query_id = s.query_id) AND chunk_id IN (SELECT doc_id FROM documents WHERE {keep})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM complete)
SELECT query_id, chunk_id, score, rank::INT AS rank FROM ranked WHERE rank <= {k}"""


INDEXED = {"filename": "filename", "path": "filepath", "content": "content"}
_built: dict[tuple[str, str], str] = {}


def _index_path(spark: SparkSession, sf_dir: str, again: bool = False) -> str:
    """Where the documents' stored index lies. The first query of a session that needs it writes it; so does one after the table has changed."""
    key = (spark.sparkContext.applicationId, stored.fingerprint(spark, f"{sf_dir}/documents.parquet"))
    path = _built.get(key)
    if again or path is None or not stored.exists(spark, f"{path}/totals/_SUCCESS"):
        path = f"{stored.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        index.write(_doc_chunks(spark, sf_dir), INDEXED, path)
        _built[key] = path
    return path


@query(f"""WITH {TOKENS} SELECT count(*) AS n_positions, count(DISTINCT (term, chunk_id)) AS n_terms, count(DISTINCT term) AS n_words, (SELECT count(*) FROM documents) AS n_chunks FROM tokens""")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the stored index, also if there is one, and counts what it has of the content."""
    held = index.read(spark, _index_path(spark, sf_dir, again=True)).of(["content"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = count(held.positions, "n_positions").crossJoin(count(held.terms, "n_terms")).crossJoin(count(held.vocabulary, "n_words"))
    return parts.crossJoin(held.totals.select("n_chunks"))  # each is one row


def _bm25(spark: SparkSession, sf_dir: str, queries: DataFrame, fields: list[str], weights) -> DataFrame:
    return sparse.bm25(planner.plan(queries), index.read(spark, _index_path(spark, sf_dir)).of(fields), weights)


def _two_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "the th"), (2, "en er"), (3, "de que")], "query_id bigint, query string")


TWO = "SELECT * FROM (VALUES (1, 'the th'), (2, 'en er'), (3, 'de que')) AS v(query_id, query)"


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return sparse.top(rows, k).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql(TWO, 20))
def bm25_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_bm25(spark, sf_dir, _two_words(spark), ["content"], (("content", 1.0),)), 20)


@query(bm25_sql(f"SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:3], ' ') AS query FROM benchmark", 50))
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_bm25(spark, sf_dir, passage_queries(spark, sf_dir), ["content"], (("content", 1.0),)), 50)


FIELDED = "SELECT * FROM (VALUES (1, 'src3 the'), (2, 'txt 12'), (3, 'corpus src1 of')) AS v(query_id, query)"


@query(bm25_sql(FIELDED, 30, weights={"filename": 8.0, "path": 3.0, "content": 1.0}))
def bm25_fielded_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "src3 the"), (2, "txt 12"), (3, "corpus src1 of")], "query_id bigint, query string")
    return _ranked(_bm25(spark, sf_dir, queries, list(INDEXED), SETTINGS.field_weights), 30)


@query(bm25_sql(TWO, 20, keep=f"{FIRST_TIME} + 3600.0 * doc_id BETWEEN {FIRST_TIME + 360000} AND {FIRST_TIME + 1800000} AND contains('/corpus/' || source || '/' || doc_id || '.txt', '/src1')"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _bm25(spark, sf_dir, _two_words(spark), ["content"], (("content", 1.0),))
    return _ranked(sparse.filtered(scored, _doc_chunks(spark, sf_dir), "file", "mtime", FIRST_TIME + 360000, FIRST_TIME + 1800000, "/SRC1"), 20)


# ---------------------------------------------------------------- vectors, fusion, files


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def dense_sql(k: int, every: int, keep: str = "true") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(greatest(0.0, list_cosine_similarity(a.e, b.e)), 6) AS score FROM v a, v b WHERE a.vec_id % {every} = 0 AND b.vec_id IN (SELECT vec_id FROM v b WHERE {keep})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near)
SELECT query_id, chunk_id, score, rank::INT AS rank FROM ranked WHERE rank <= {k}"""


@query(dense_sql(36, 20))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return dense.nearest(rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), rows, 36)


@query(dense_sql(24, 20, "b.label % 2 = 0"))
def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return dense.nearest(rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), rows.where("label % 2 = 0"), 24)


@query("""
WITH asked AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 20 = 0), f(filtered) AS (VALUES (false), (true))
SELECT filtered, n AS n_queries, true AS reached FROM asked, f""")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approximate index after a change set, searched with ids divisible by 20 against all rows: whether 0.9 of the exact 36 neighbours are found, without and with a filter."""
    base = f"{stored.shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows = _vectors(spark, sf_dir).select(
        "chunk_id",
        F.concat(F.lit("/v/"), "chunk_id").alias("filepath"),
        "embedding",
        F.when(F.col("label") % 2 == 0, "file").otherwise("mweb").alias("source_type"),
        F.col("chunk_id").cast("double").alias("mtime"),
        F.col("chunk_id").cast("double").alias("ctime"),
    )
    old = F.col("chunk_id") % 3 == 1
    past = rows.where("chunk_id % 5 <> 2").withColumn("embedding", F.when(old, F.reverse("embedding")).otherwise(F.col("embedding")))
    past = past.unionByName(rows.where("chunk_id % 7 = 0").withColumns({"chunk_id": -F.col("chunk_id") - 1, "filepath": F.concat("filepath", F.lit(".old"))}))
    vector_index.write(past, base)
    change = F.when(F.col("chunk_id") % 5 == 2, "new").when(old, "modified").otherwise("unchanged")
    changed = rows.select("filepath", change.alias("change")).unionByName(past.where("chunk_id < 0").select("filepath", F.lit("deleted").alias("change")))
    vector_index.apply(spark, base, changed, rows, 1)
    probes = vector_index.calibrate(rows, base, 36)
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    out = None
    for filtered in (False, True):
        queries = asked.withColumn("source", F.lit("file")) if filtered else asked
        exact = dense.nearest(queries, rows.select("chunk_id", "embedding"), 36, files=rows if filtered else None)
        measured = vector_index.recall(vector_index.search(queries, base, 36, probes), exact)
        own = measured.select(F.lit(filtered).alias("filtered"), "n_queries", (F.col("recall") >= 0.9).alias("reached"))
        out = own if out is None else out.unionByName(own)
    return out


def _both_branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyword and vector hits of passage queries, where a query's vector is that of its number."""
    queries = passage_queries(spark, sf_dir, 2)
    words = _ranked(_bm25(spark, sf_dir, queries, ["content"], (("content", 1.0),)), 120)
    rows = _vectors(spark, sf_dir)
    asked = queries.join(rows, queries.query_id == rows.chunk_id).select("query_id", "embedding")
    return planner.plan(queries), words, dense.nearest(asked, rows, 120)


BRANCHES = f"""words AS ({bm25_sql(f"SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:2], ' ') AS query FROM benchmark", 120)}),
near AS ({dense_sql(120, 1)} AND query_id IN (SELECT item_id FROM benchmark)),
fused AS (
  SELECT query_id, chunk_id, w.rank AS sparse_rank, d.rank AS dense_rank, coalesce(1.0 / (60 + w.rank), 0) + coalesce(1.0 / (60 + d.rank), 0) AS fusion_score
  FROM words w FULL JOIN near d USING (query_id, chunk_id)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, sparse_rank NULLS LAST, dense_rank NULLS LAST, chunk_id)::INT AS fused_rank FROM fused QUALIFY fused_rank <= 200)"""


@query(f"WITH {BRANCHES} SELECT query_id, chunk_id, sparse_rank, dense_rank, round(fusion_score, 9) AS fusion_score, fused_rank FROM kept")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, words, near = _both_branches(spark, sf_dir)
    return fusion.fuse(words, near, plans).select("query_id", "chunk_id", "sparse_rank", "dense_rank", F.round("fusion_score", 9).alias("fusion_score"), "fused_rank")


def _file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents make one file here, so that files have several chunks."""
    kind = F.element_at(F.array(F.lit("content"), F.lit("heading"), F.lit("filename")), (F.col("chunk_id") % 3 + 1).cast("int"))
    return _doc_chunks(spark, sf_dir).withColumns({"file_id": F.concat(F.lit("f"), F.floor(F.col("chunk_id") / 10)), "chunk_type": kind})


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fused hits with their content."""
    plans, words, near = _both_branches(spark, sf_dir)
    return plans, stored.small(stored.cut(fusion.fuse(words, near, plans))).join(_file_chunks(spark, sf_dir).drop("source"), "chunk_id")


CANDIDATES = f"""{BRANCHES},
candidates AS (
  SELECT k.*, 'f' || (chunk_id // 10) AS file_id, ['content', 'heading', 'filename'][chunk_id % 3 + 1] AS chunk_type, text AS content, doc_id || '.txt' AS filename, {FIRST_TIME} + 3600.0 * doc_id AS mtime
  FROM kept k JOIN documents ON chunk_id = doc_id),
queries AS (SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:2], ' ') AS query FROM benchmark),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, substr(content, 1, 50) ORDER BY fused_rank) AS k FROM candidates QUALIFY k = 1),
first_50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS n FROM once QUALIFY n <= 50),
overlap AS (
  SELECT f.*, len(list_intersect(list_distinct({words_sql('query')}), list_distinct({words_sql('substr(content, 1, 2000)')}))) / len(list_distinct({words_sql('query')}))::DOUBLE AS rerank_score
  FROM first_50 f JOIN queries USING (query_id)),
judged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC NULLS LAST, fused_rank)::INT AS rerank_rank FROM overlap)"""


@query(f"WITH {CANDIDATES} SELECT query_id, chunk_id, fused_rank, n::INT AS place FROM first_50")
def rerank_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, fused = _fused(spark, sf_dir)
    return rerank.rerank(fused, plans, None).select("query_id", "chunk_id", "fused_rank", F.col("rerank_rank").alias("place"))


@query(f"WITH {CANDIDATES} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rerank_rank FROM judged")
def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, fused = _fused(spark, sf_dir)
    return rerank.rerank(fused, plans).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


FILE_SCORES = f"""{CANDIDATES},
placed AS (SELECT j.*, query, row_number() OVER (PARTITION BY query_id, file_id ORDER BY round(rerank_score, 12) DESC, chunk_id) AS r FROM judged j JOIN queries USING (query_id)),
scores AS (
  SELECT query_id, file_id AS file_key, count(*) AS n_hits, arg_min(filename, r) AS filename, arg_min(mtime, r) AS mtime, arg_min(chunk_type, r) AS best_chunk_type,
    0.70 * coalesce(sum(rerank_score) FILTER (r = 1), 0) + 0.15 * coalesce(sum(rerank_score) FILTER (r = 2), 0) + 0.05 * coalesce(sum(rerank_score) FILTER (r = 3), 0)
    + CASE WHEN bool_or(chunk_type = 'filename') THEN 0.10 ELSE 0 END + CASE WHEN bool_or(chunk_type = 'heading') THEN 0.05 ELSE 0 END
    + CASE WHEN bool_or(length(query) >= 2 AND contains(lower(content), lower(query))) THEN 0.10 ELSE 0 END
    + CASE WHEN count(*) > 3 THEN 0.05 * least(count(*) - 3, 5) ELSE 0 END
    + 0.05 * pow(0.5, greatest(0, {SETTINGS.now_ts} - arg_min(mtime, r)) / 86400.0 / 7.0) AS score,
    list(trim(content) ORDER BY r) FILTER (trim(content) <> '') AS texts
  FROM placed GROUP BY query_id, file_id)"""


@query(f"WITH {FILE_SCORES} SELECT query_id, file_key, n_hits, filename, mtime, best_chunk_type, round(score, 6) AS score FROM scores")
def file_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, fused = _fused(spark, sf_dir)
    return aggregate.file_scores(rerank.rerank(fused, plans), plans).select("query_id", "file_key", "n_hits", "filename", "mtime", "best_chunk_type", F.round("score", 6).alias("score"))


@query(f"""WITH {FILE_SCORES},
over_threshold AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_key)::INT AS rank FROM scores WHERE score >= 0.35)
SELECT query_id, rank, file_key, least(100, round_even(round(score, 9) * 100, 0))::INT || '%' AS relevance FROM over_threshold WHERE rank <= 50""")
def threshold_limit_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, fused = _fused(spark, sf_dir)
    return aggregate.results(aggregate.file_scores(rerank.rerank(fused, plans), plans), plans).select("query_id", "rank", "file_key", "relevance")


#: Filters by query: sources, dates of two kinds, parts of paths.
FILTERED_BY = f"""(SELECT item_id AS query_id, CASE item_id % 7 WHEN 6 THEN 'mweb' WHEN 5 THEN 'file' ELSE 'all' END AS source, CASE item_id % 4 WHEN 1 THEN 'ctime' ELSE 'mtime' END AS date_field,
  CASE WHEN item_id % 3 = 0 THEN {FIRST_TIME} + 3600.0 * 40 * (item_id % 5) END AS date_from, CASE WHEN item_id % 4 = 1 THEN {FIRST_TIME} + 3600.0 * 600 END AS date_to, CASE WHEN item_id % 2 = 0 THEN '/SRC1' END AS path_filter FROM benchmark)"""


def _passes(query: str, chunk: str) -> str:
    time = f"{FIRST_TIME} + 3600.0 * d.doc_id - CASE WHEN f.date_field = 'ctime' THEN 86400.0 ELSE 0.0 END"
    return f"""EXISTS (SELECT 1 FROM documents d, {FILTERED_BY} f WHERE d.doc_id = {chunk} AND f.query_id = {query} AND f.source IN ('all', 'file')
    AND (f.date_from IS NULL OR {time} >= f.date_from) AND (f.date_to IS NULL OR {time} <= f.date_to) AND (f.path_filter IS NULL OR contains(lower('/corpus/' || d.source || '/' || d.doc_id || '.txt'), lower(f.path_filter))))"""


FILTERED_BRANCHES = BRANCHES.replace("WHERE m = (SELECT", f"WHERE {_passes('s.query_id', 's.chunk_id')} AND m = (SELECT").replace("WHERE a.vec_id % 1 = 0 AND", f"WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND {_passes('a.vec_id', 'b.vec_id')} AND")


@query(f"""WITH {FILE_SCORES.replace(BRANCHES, FILTERED_BRANCHES)},
over_threshold AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_key)::INT AS rank FROM scores WHERE score >= 0.35)
SELECT query_id, rank, file_key, n_hits, round(score, 6) AS score FROM over_threshold WHERE rank <= 50""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over the stored index, where each query has filters of its own for both branches."""
    k = F.col("query_id")
    queries = passage_queries(spark, sf_dir, 2).withColumns(
        {
            "source": F.when(k % 7 == 6, "mweb").when(k % 7 == 5, "file").otherwise("all"),
            "date_field": F.when(k % 4 == 1, "ctime").otherwise("mtime"),
            "date_from": F.when(k % 3 == 0, FIRST_TIME + 3600.0 * 40 * (k % 5)),
            "date_to": F.when(k % 4 == 1, F.lit(FIRST_TIME + 3600.0 * 600)),
            "path_filter": F.when(k % 2 == 0, "/SRC1"),
        }
    )
    rows = _vectors(spark, sf_dir)
    asked = queries.join(rows, queries.query_id == rows.chunk_id).select("query_id", "embedding")
    held = index.read(spark, _index_path(spark, sf_dir))
    found = search_job.search(queries, _file_chunks(spark, sf_dir), rows, asked, stored=held, fields={"content": "content"})
    return found.select("query_id", "rank", "file_key", "n_hits", F.round("score", 6).alias("score"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(F.pmod("doc_id", F.lit(7)).alias("query_id"), "filepath", F.when(F.col("doc_id") % 11 != 0, F.col("mtime")).alias("mtime"), F.row_number().over(_by_query()).alias("rank"))


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy(F.pmod("doc_id", F.lit(7))).orderBy(F.length("content").desc(), "doc_id")


@query(f"""
WITH listed AS (SELECT doc_id % 7 AS query_id, '/corpus/' || source || '/' || doc_id || '.txt' AS filepath, CASE WHEN doc_id % 11 <> 0 THEN {FIRST_TIME} + 3600.0 * doc_id END AS mtime,
  row_number() OVER (PARTITION BY doc_id % 7 ORDER BY length(text) DESC, doc_id) AS rank FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(mtime, 0) DESC, rank)::INT AS place, greatest(1, ceil(count(*) OVER (PARTITION BY query_id) / 25.0))::INT AS pages FROM listed)
SELECT query_id, filepath, mtime, rank::INT AS rank, place, least(2, pages)::INT AS page, pages FROM placed WHERE place > (least(2, pages) - 1) * 25 AND place <= least(2, pages) * 25""")
def resort_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.resort(_listed(spark, sf_dir), "mtime_desc", page=2)


@query()
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over chunked documents, both branches."""
    base = f"{stored.shared_folder(spark)}/search-{uuid.uuid4().hex}"
    # Texts are cut once. The queries are asked once, so no index is made for them.
    chunking.chunk_records(files(spark, sf_dir)).drop("embedding_text").withColumn("heading", F.array_join("title_path", " ")).write.option("compression", "zstd").parquet(f"{base}/chunks")
    chunks = spark.read.parquet(f"{base}/chunks")
    rows = _vectors(spark, sf_dir)
    queries = passage_queries(spark, sf_dir)
    of_file = files(spark, sf_dir).select("doc_id", F.concat(F.md5("filepath"), F.lit("_c0")).alias("id"))
    vectors = rows.join(of_file, rows.chunk_id == of_file.doc_id).select(F.col("id").alias("chunk_id"), "embedding")
    asked = queries.join(rows, queries.query_id == rows.chunk_id).select("query_id", "embedding")
    return search_job.search(queries, chunks, vectors, asked).select("query_id", "rank", "filepath", F.round("score", 6).alias("score"), "n_hits", "relevance", "preview")


# ---------------------------------------------------------------- incremental maintenance

STATE = f"""state AS (
  SELECT filepath, mtime + CASE WHEN doc_id % 5 = 1 THEN 60.0 WHEN doc_id % 5 = 2 THEN 0.005 ELSE 0 END AS mtime, source_type FROM files WHERE doc_id % 7 <> 0
  UNION ALL SELECT filepath || '.old', mtime, source_type FROM files WHERE doc_id % 13 = 0),
changed AS (
  SELECT filepath, coalesce(f.mtime, s.mtime) AS mtime, coalesce(f.source_type, s.source_type) AS source_type,
    CASE WHEN s.mtime IS NULL THEN 'new' WHEN f.mtime IS NULL THEN 'deleted' WHEN abs(f.mtime - s.mtime) > 0.01 THEN 'modified' ELSE 'unchanged' END AS change
  FROM files f FULL JOIN state s USING (filepath))"""


def _state(rows: DataFrame) -> DataFrame:
    """A state in which some files are missing, older or gone."""
    shift = F.when(F.col("doc_id") % 5 == 1, 60.0).when(F.col("doc_id") % 5 == 2, 0.005).otherwise(0.0)
    known = rows.where("doc_id % 7 <> 0").select("filepath", (F.col("mtime") + shift).alias("mtime"), "source_type")
    return known.unionByName(rows.where("doc_id % 13 = 0").select(F.concat("filepath", F.lit(".old")).alias("filepath"), "mtime", "source_type"))


@query(f"WITH {FILES}, {STATE} SELECT * FROM changed")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return incremental.changes(rows, _state(rows))


@query(f"WITH {FILES}, {STATE} SELECT count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'modified') AS n_modified, count(*) FILTER (change = 'deleted') AS n_deleted, count(*) FILTER (change = 'unchanged') AS n_unchanged FROM changed")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return incremental.change_counts(incremental.changes(rows, _state(rows)))


@query(f"WITH {FILES}, {STATE} SELECT filepath FROM state ANTI JOIN files USING (filepath)")
def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return incremental.changes(rows, _state(rows)).where("change = 'deleted'").select("filepath")


@query(f"""
WITH {FILES}
SELECT filepath, doc_id % 2 = 0 AND doc_id % 6 <> 4 AS hit, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 4 THEN content END AS chunk FROM files""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    cache = rows.where("doc_id % 2 = 0").select("filepath", (F.col("mtime") + F.when(F.col("doc_id") % 6 == 4, 1.0).otherwise(0.004)).alias("mtime"), F.array("content").alias("chunks"))
    return incremental.cache_lookup(rows, cache).select("filepath", "hit", F.col("chunks")[0].alias("chunk"))


@query(f"WITH {FILES} SELECT filepath FROM files WHERE doc_id % 3 = 0")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    cache = rows.where("doc_id % 3 = 0").select("filepath").unionByName(rows.select(F.concat(F.lit("/gone"), F.col("filepath")).alias("filepath")))
    return incremental.prune(cache, rows)


@query("""
WITH cached AS (SELECT DISTINCT sha256('m::' || text) AS text_hash, doc_id % 2 AS v FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, sha256('m::' || text) AS text_hash, sha256('m::' || text) IN (SELECT text_hash FROM cached) AS hit FROM documents""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fresh = docs.where("doc_id % 2 = 0").select(incremental.embedding_key("m", F.col("text")).alias("text_hash"), F.array(F.lit(1.0)).alias("vector"), F.col("doc_id").cast("double").alias("created_at"))
    cache = incremental.put(fresh.limit(0), fresh, "text_hash", "created_at")
    return incremental.embedding_lookup(docs, cache, "m").select("doc_id", "text_hash", "hit")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("created_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = rows.agg(F.max("created_at")).first()[0]
    return incremental.expire(rows, now, 10.0).select("event_id", "user_id")


@query(f"""
WITH {FILES}, tokens AS (SELECT filepath, unnest({words_sql('content')}) AS term FROM files)
SELECT filepath, count(*) AS n_rows FROM (SELECT DISTINCT filepath, term FROM tokens) GROUP BY filepath""")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old index brought up to date; the SQL builds the new one from nothing."""
    rows = files(spark, sf_dir)

    def built(some: DataFrame) -> DataFrame:
        return index.postings(some.select(F.col("filepath").alias("chunk_id"), "content"), {"content": "content"}).select(F.col("chunk_id").alias("filepath"), "term", "pos")

    state = _state(rows)
    old = built(rows.join(state.select("filepath"), "filepath", "left_semi").withColumn("content", F.concat(F.lit("older "), F.col("content"))).where("doc_id % 5 = 1").unionByName(rows.where("doc_id % 7 <> 0 AND doc_id % 5 <> 1")))
    changed = incremental.changes(rows, state)
    fresh = built(rows.join(changed.where("change IN ('new', 'modified')").select("filepath"), "filepath", "left_semi"))
    return incremental.apply(old, fresh, changed).groupBy("filepath").agg(F.count_distinct("term").alias("n_rows"))


@query(f"""
WITH {FILES}, tokens AS (SELECT filepath, unnest({words_sql('content')}) AS term FROM files)
SELECT filepath, count(*) AS n_rows, count(DISTINCT term) AS n_terms FROM tokens GROUP BY filepath""")
def maintained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that a stream leaves: an older inventory and half of the present one come at once, then its other half and a part of a later one."""
    folder = f"{stored.shared_folder(spark)}/maintained-{uuid.uuid4().hex}"
    rows = files(spark, sf_dir).select("doc_id", "filepath", "mtime", "source_type", "content")
    past = rows.where("doc_id % 7 <> 0").withColumns({"mtime": F.col("mtime") - 60.0 * (F.col("doc_id") % 5), "content": F.concat(F.lit("older "), "content")})
    past = past.unionByName(rows.where("doc_id % 13 = 0").withColumn("filepath", F.concat("filepath", F.lit(".old"))))
    past = past.where("doc_id % 5 <> 0").unionByName(rows.where("doc_id % 5 = 0 AND doc_id % 7 <> 0"))

    def marked(some: DataFrame, number: int, whole: DataFrame, more: int = 0) -> DataFrame:
        return some.drop("doc_id").crossJoin(whole.agg((F.count(F.lit(1)) + more).alias("n_files"))).withColumn("inventory", F.lit(number).cast("long"))

    first = marked(past, 1, past).unionByName(marked(rows.where("doc_id % 2 = 0"), 2, rows))
    second = marked(rows.where("doc_id % 2 = 1"), 2, rows).unionByName(marked(past.where("doc_id % 3 = 0"), 3, past, 1))

    def built(some: DataFrame) -> DataFrame:
        terms = index.inverted(some.select(F.col("filepath").alias("chunk_id"), "content"), {"content": "content"})
        return terms.select(F.col("chunk_id").alias("filepath"), "term", "tf", "at")

    for part in (first, second):
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        maintenance.maintain(stream, f"{folder}/index", built, f"{folder}/progress", every=None, buckets=16).awaitTermination()
    return maintenance.read_index(spark, f"{folder}/index").groupBy("filepath").agg(F.sum("tf").alias("n_rows"), F.count("term").alias("n_terms"))


@query(bm25_sql(f"SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:3], ' ') AS query FROM benchmark", 50))
def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over an index that three change sets have brought up to date: new, modified and deleted files, and a merge of segments."""
    base = f"{stored.shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    now = _doc_chunks(spark, sf_dir)
    older = now.withColumn("content", F.concat(F.lit("older "), F.col("content"), F.lit(" zzz")))
    k = F.col("chunk_id")
    gone = older.where(k % 13 == 0).withColumns({"chunk_id": -k - 1, "filepath": F.concat("filepath", F.lit(".old"))})
    as_new, as_modified, as_deleted = (F.lit(x).alias("change") for x in ("new", "modified", "deleted"))
    first = now.where((k % 7 != 0) & (k % 5 != 1)).unionByName(older.where((k % 7 != 0) & (k % 5 == 1))).unionByName(gone)
    segments.apply(spark, base, first.select("filepath", as_new), first, INDEXED, 1, fan=2)
    second = now.where((k % 7 != 0) & (k % 5 == 1)).unionByName(older.where(k % 7 == 0))
    segments.apply(spark, base, second.select("filepath", F.when(k % 7 == 0, "new").otherwise("modified").alias("change")), second, INDEXED, 2, fan=2)
    third = now.where(k % 7 == 0)
    segments.apply(spark, base, third.select("filepath", as_modified).unionByName(gone.select("filepath", as_deleted)), third, INDEXED, 3, fan=2)
    return _ranked(sparse.bm25(planner.plan(passage_queries(spark, sf_dir)), segments.read(spark, base).of(["content"]), (("content", 1.0),)), 50)


@query(f"""
WITH a AS (SELECT 'a' || doc_id AS filepath, doc_id::DOUBLE AS mtime FROM documents),
b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'c' END || doc_id AS filepath, doc_id + 0.5 AS mtime FROM documents)
SELECT coalesce(b.filepath, a.filepath) AS filepath, coalesce(b.mtime, a.mtime)::DOUBLE AS mtime, CASE WHEN b.filepath IS NULL THEN 'file' ELSE 'mweb' END AS source_type FROM a FULL JOIN b ON a.filepath = b.filepath""")
def inventory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on both sides: a third of the right ones have the path of a left one."""
    rows = table(spark, sf_dir, "documents")
    left = rows.select(F.concat(F.lit("a"), "doc_id").alias("filepath"), F.col("doc_id").cast("double").alias("mtime"), F.lit("file").alias("source_type"))
    side = F.when(F.col("doc_id") % 3 == 0, "a").otherwise("c")
    right = rows.select(F.concat(side, "doc_id").alias("filepath"), (F.col("doc_id") + 0.5).cast("double").alias("mtime"), F.lit("mweb").alias("source_type"))
    return incremental.union_inventories(left, right)


@query("""
WITH a AS (SELECT 'a' || doc_id AS filepath, doc_id::DOUBLE AS mtime FROM documents),
b AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END || doc_id AS filepath, doc_id + 0.5 AS mtime FROM documents)
SELECT coalesce(b.filepath, a.filepath) AS filepath, coalesce(b.mtime, a.mtime)::DOUBLE AS mtime, CASE WHEN b.filepath IS NULL THEN 'file' ELSE 'mweb' END AS source_type FROM a FULL JOIN b ON a.filepath = b.filepath""")
def inventory_union_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on both sides: half of the right ones have the path of a left one and another time, half have other paths."""
    rows = table(spark, sf_dir, "documents")
    left = rows.select(F.concat(F.lit("a"), F.col("doc_id")).alias("filepath"), F.col("doc_id").cast("double").alias("mtime"), F.lit("file").alias("source_type"))
    side = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    right = rows.select(F.concat(side, F.col("doc_id")).alias("filepath"), (F.col("doc_id") + 0.5).cast("double").alias("mtime"), F.lit("mweb").alias("source_type"))
    return incremental.union_inventories(left, right)


# ---------------------------------------------------------------- notes


@query("""
SELECT s_suppkey AS aid, list_sort([n_name, r_name]) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def note_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    names = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("rid"), F.col("n_name").alias("name")).unionByName(region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("rid"), F.col("r_name").alias("name")))
    own = supplier.select(F.col("s_suppkey").alias("aid"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("rid"))
    top = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("aid"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("rid"))
    return notes.grouped_names(supplier.select(F.col("s_suppkey").alias("aid")), own.unionByName(top), names, "names")


@query("""
SELECT p_partkey AS aid, coalesce(list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)), []) AS tags FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey""")
def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rid"), F.col("l_partkey").alias("aid")).distinct()
    return notes.grouped_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("aid")), links, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_name").alias("name")), "tags")


@query("""
SELECT 'r' || r_regionkey AS uuid, r_name AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("uuid"), F.lit(None).cast("string").alias("pid"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("uuid"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("pid"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("uuid"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("pid"), F.col("c_name").alias("name"))
    return notes.category_paths(region.unionByName(nation).unionByName(customer))


@query("""
WITH named AS (SELECT doc_id, '/out/' || lang AS folder, substr(trim(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')), 1, 120) AS t FROM documents),
placed AS (SELECT doc_id, folder || '/' || CASE WHEN t = '' THEN 'Untitled' ELSE t END AS base, row_number() OVER (PARTITION BY folder || '/' || CASE WHEN t = '' THEN 'Untitled' ELSE t END ORDER BY doc_id) - 1 AS k FROM named)
SELECT doc_id, base || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.md' AS dest FROM placed""")
def path_collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/out/"), F.col("lang")).alias("folder"), F.col("text").alias("title"))
    return notes.target_paths(rows, ["doc_id"]).select("doc_id", "dest")


@query("""
SELECT lang AS folder, sha256(string_agg(name || ':' || sha256(text), chr(10) ORDER BY name)) AS hash FROM (SELECT lang, text, doc_id || '.txt' AS name FROM documents) GROUP BY lang""")
def folder_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("folder"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("name"), F.sha2("text", 256).alias("content_hash"))
    return notes.fingerprints(rows)


@query("""
SELECT conv_id, '---' || chr(10) || 'title: "' || conv_id || '"' || chr(10) AS head, body, true AS same FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with front matter, split again."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))
    none = F.array().cast("array<string>")
    made = turns.withColumn("file", F.concat(notes.front_matter(F.col("conv_id").cast("string"), none, none, F.col("conv_id")), F.col("body")))
    parted = made.withColumn("x", notes.split_front_matter(F.col("file")))
    return parted.select("conv_id", F.substring_index("file", "note_uuid", 1).alias("head"), F.expr("substring(x.body, 2)").alias("body"), (F.expr("substring(x.body, 2)") == F.col("body")).alias("same"))


# ---------------------------------------------------------------- evaluation and requests

EVAL = f"""results AS (
  SELECT query_id, chunk_id AS path, rank FROM ({bm25_sql(f"SELECT item_id AS query_id, array_to_string({words_sql('text')}[1:3], ' ') AS query FROM benchmark", 50)})),
qrels AS (SELECT item_id AS query_id, d.doc_id AS path, 1 + coalesce(quality, 0) AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id)),
graded AS (SELECT r.*, coalesce(grade, 0) AS grade FROM results r LEFT JOIN qrels USING (query_id, path)),
got AS (SELECT query_id, max(CASE WHEN rank = 1 AND grade > 0 THEN 1.0 ELSE 0 END) AS top1, count(*) FILTER (grade > 0 AND rank <= 10) AS h10, count(*) FILTER (grade > 0 AND rank <= 50) AS h50,
  min(rank) FILTER (grade > 0 AND rank <= 10) AS first, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM graded GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS n, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS place FROM qrels) GROUP BY query_id),
metrics AS (SELECT item_id AS query_id, coalesce(top1, 0)::DOUBLE AS top1, coalesce(h10 / n, 0)::DOUBLE AS recall_10, coalesce(h50 / n, 0)::DOUBLE AS recall_50, coalesce(1.0 / first, 0)::DOUBLE AS mrr_10, coalesce(dcg / idcg, 0)::DOUBLE AS ndcg_10
  FROM benchmark LEFT JOIN got ON item_id = got.query_id LEFT JOIN ideal ON item_id = ideal.query_id)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage queries judged by the documents that hold the passage: their ids come from a join on the passage's first line, then a test of the whole."""
    queries = passage_queries(spark, sf_dir)
    results = bm25_batch_topk(spark, sf_dir).select("query_id", "rank", F.col("chunk_id").alias("filepath"))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Both sides meet on the passages' rarest pair of neighbouring words.
    pair = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1))))
    inner = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 2, F.lit(0)))  # noqa: E731  the outer words may be parts of longer ones in a document
    asked = passages.withColumn("w", F.split("passage", " ")).select("query_id", "passage", F.explode(pair(inner(F.col("w")))).alias("pair"))
    held = docs.withColumn("w", F.split("text", " ")).select("doc_id", F.explode(pair(F.col("w"))).alias("pair"))
    # The passages' pairs go to the documents' pairs, and the pairs found to the texts: neither is shuffled.
    counts = held.join(stored.small(stored.cut(asked.select("pair").distinct())), "pair", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rarest = stored.cut(asked.join(counts, "pair", "left").groupBy("query_id", "passage").agg(F.min_by("pair", F.coalesce("n", F.lit(0))).alias("pair")))
    met = stored.cut(held.join(stored.small(rarest), "pair").select("doc_id", "query_id", "passage"))
    found = docs.join(stored.small(met), "doc_id").where(F.contains("text", F.col("passage")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    qrels = found.join(labels, "doc_id", "left").select("query_id", F.col("doc_id").alias("filepath"), (1 + F.coalesce("quality", F.lit(0))).alias("grade"))
    return evaluate.case_metrics(queries, results, qrels)


@query(f"WITH {EVAL} SELECT query_id, top1, round(recall_10, 6) AS recall_10, round(recall_50, 6) AS recall_50, round(mrr_10, 6) AS mrr_10, round(ndcg_10, 6) AS ndcg_10 FROM metrics")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query_id", "top1", *(F.round(c, 6).alias(c) for c in ("recall_10", "recall_50", "mrr_10", "ndcg_10")))


@query(f"WITH {EVAL} SELECT count(*) AS n_cases, round(avg(top1), 6) AS top1, round(avg(recall_10), 6) AS recall_10, round(avg(recall_50), 6) AS recall_50, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM metrics")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_metrics(spark, sf_dir)).select("n_cases", *(F.round(c, 6).alias(c) for c in ("top1", "recall_10", "recall_50", "mrr_10", "ndcg_10")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", F.round("p50", 6).alias("p50"), "p95", "n")


@query("""
SELECT count(*) AS n_chunks, sum(greatest(1, ceil(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE least(600, length(text)) END / 1.5)))::BIGINT AS n_tokens, round(count(*) / count(DISTINCT doc_id // 4), 6) AS chunks_per_file FROM documents""")
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("text", F.floor(F.col("doc_id") / 4).alias("file_id"))
    return evaluate.chunk_tokens(rows).withColumn("chunks_per_file", F.round("chunks_per_file", 6))


@query("SELECT count(*) AS n_files, ceil(count(*) * 2.5)::BIGINT AS n_chunks, ceil(count(*) * 2.5 * 400)::BIGINT AS n_tokens, round(count(*) * 0.2, 6) AS seconds FROM documents")
def index_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.estimate(table(spark, sf_dir, "documents"), 2.5, 0.2).select("n_files", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_tokens").cast("long").alias("n_tokens"), F.round("seconds", 6).alias("seconds"))


@query("""
WITH RECURSIVE own AS (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (
  SELECT event_id, ts, user_id, k, true AS allowed, NULL::TIMESTAMP AS earlier, ts::TIMESTAMP AS last FROM own WHERE k = 1
  UNION ALL
  SELECT o.event_id, o.ts, o.user_id, o.k, coalesce(o.ts - w.earlier >= INTERVAL 1 DAY, true),
    CASE WHEN coalesce(o.ts - w.earlier >= INTERVAL 1 DAY, true) THEN w.last ELSE w.earlier END, CASE WHEN coalesce(o.ts - w.earlier >= INTERVAL 1 DAY, true) THEN o.ts::TIMESTAMP ELSE w.last END
  FROM walk w JOIN own o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT event_id, ts, user_id, allowed FROM walk""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events of a user a day."""
    return requests.rate_limit(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), ["user_id"], "ts", 2, 86400.0, ["event_id"])


@query("""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k = 1),
placed AS (SELECT user_id || ':' || event_type AS query, ts, event_id, row_number() OVER (ORDER BY ts DESC, user_id || ':' || event_type) AS place FROM latest)
SELECT query, ts, event_id, place::INT AS place FROM placed WHERE place <= 50""")
def history_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("query"), "ts", "event_id")
    return requests.history(rows, "query", "ts")


# Phrases round whole texts, by the number of the turn; the last has none.
SAID = (("帮我搜索一下 ", "的资料吧。"), ("请搜", "相关文件"), ("help me find ", " please"), ("Could you search ", " thanks!"), ("麻烦帮我，", " 。"), ("", ""))
_LONGEST = {name: "|".join(sorted(own, key=len, reverse=True)) for name, own in (("prefix", requests.PREFIXES), ("suffix", requests.SUFFIXES))}
SAID_SQL = "CASE (conv_id + turn) % {n} " + " ".join(f"WHEN {k} THEN '{x}' || line || '{y}'" for k, (x, y) in enumerate(SAID)) + " END"


def _stripped_sql(text: str) -> str:
    """The rule as nested replacements."""
    out = f"regexp_replace(trim({text}), '^(?:{_LONGEST['prefix']})[ ，。、\\t]*', '')"
    out = f"regexp_replace({out}, '(.)(?:{_LONGEST['suffix']})$', '\\1')"
    out = f"regexp_replace({out}, '[ ，。、\\t]+$', '')"
    for pattern in (requests.PARTICLES, requests.ENGLISH_PREFIX, requests.ENGLISH_SUFFIX):
        out = f"trim(regexp_replace({out}, '{pattern}', ''))"
    return out


@query(f"""
WITH lines AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\\x09-\\x0D]+', ' ', 'g') AS line FROM conversations),
said AS (SELECT conv_id, turn, {SAID_SQL.format(n=len(SAID))} AS said FROM lines)
SELECT conv_id, turn, said, {_stripped_sql('said')} AS stripped FROM said""")
def strip_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts between the phrases of requests in two languages, without these again."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]+", " ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    said = F.lit(None)
    for k, (x, y) in enumerate(SAID):
        said = F.when((F.col("conv_id") + F.col("turn")) % len(SAID) == k, F.concat(F.lit(x), "line", F.lit(y))).otherwise(said)
    rows = rows.select("conv_id", "turn", said.alias("said"))
    return rows.withColumn("stripped", requests.strip_filler(F.col("said")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mweb' WHEN doc_id % 3 = 1 THEN 'file' ELSE 'all' END AS source, CASE WHEN doc_id % 4 = 0 THEN least(200, greatest(1, doc_id)) ELSE 50 END::INT AS "limit",
  CASE WHEN doc_id % 5 = 0 THEN epoch(DATE '2024-03-01' + (doc_id % 28)::INT) END::DOUBLE AS date_from, CASE WHEN doc_id % 5 = 0 THEN epoch(DATE '2024-03-01' + (doc_id % 28)::INT) + 86399 END::DOUBLE AS date_to,
  'mtime' AS date_field FROM documents""")
def slot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    day = F.when(k % 5 == 0, F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd")).otherwise("no day")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 3 == 0, "mweb").alias("slot_source"), F.when(k % 3 == 1, "file").alias("ui_source"), F.when(k % 4 == 0, k.cast("string")).otherwise("many").alias("slot_limit"),
        F.lit("sometime").alias("ui_date_field"), requests.day_bound(day, False).alias("slot_date_from"), requests.day_bound(day, True).alias("slot_date_to"),
    )
    merged = requests.merge_slots(rows, {"source": "all", "limit": "50", "date_field": "mtime", "date_from": None, "date_to": None})
    return requests.clean_request(merged).select("doc_id", "source", "limit", "date_from", "date_to", "date_field")


@query("SELECT event_id, round(epoch(ts) - d * 86400.0, 3) AS date_from, d FROM events, (VALUES (7), (30), (90), (365)) AS v(d)")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), F.explode(F.array(*(F.lit(d) for d in (7, 30, 90, 365)))).alias("d"))
    return rows.select("event_id", F.round(requests.preset_range(F.col("d"), F.col("now")), 3).alias("date_from"), "d")


@query("SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY l_partkey")
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.reverse_map(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "suppliers")


@query("""SELECT doc_id, replace(replace(regexp_replace(text, '(?i)(the|de|en)', '<mark>\\1</mark>', 'g'), chr(0), ''), chr(1), '') AS marked FROM documents""")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.mark_terms(F.col("text"), ["de", "the", "en"]).alias("marked"))


@query("""SELECT doc_id, replace(replace(regexp_replace(text, '(?i)(the|de|en)', '<mark>\\1</mark>', 'g'), chr(0), ''), chr(1), '') AS marked FROM documents""")
def highlight_terms_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms marked in whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.mark_terms(F.col("text"), ["de", "the", "en"]).alias("marked"))


# ---------------------------------------------------------------- ingestion, export, presentation


@query(f"""
WITH {FILES}, cached AS (SELECT *, doc_id % 2 = 0 AND doc_id % 6 <> 4 AS hit FROM files)
SELECT filepath, hit, CASE WHEN hit THEN 'cached' ELSE coalesce(array_to_string(list_filter(string_split(content, chr(10)), lambda x: x <> ''), '|'), '') END AS chunks FROM cached""")
def scan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cached chunks still fit keep them, the lines of the others become chunks."""
    rows = files(spark, sf_dir)
    cache = rows.where("doc_id % 2 = 0").select("filepath", (F.col("mtime") + F.when(F.col("doc_id") % 6 == 4, 1.0).otherwise(0.004)).alias("mtime"), F.array(F.lit("cached")).alias("chunks"))
    lines = lambda some: some.select("filepath", F.filter(F.split("content", "\n"), lambda x: x != "").alias("chunks"))
    found, _ = ingest.scan_and_parse(rows, rows, cache, lines)
    return found.select("filepath", "hit", F.array_join("chunks", "|").alias("chunks"))


CELLS = [f"len(list_filter(w, lambda x: substr(md5(x), 1, 1) = '{d:x}'))" for d in range(16)]


@query(f"""
WITH cut AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN ' ' ELSE substr(text, 1, 600) END AS t FROM documents),
counted AS (SELECT doc_id, t, [{", ".join(c.replace("w,", f"{words_sql('t')},") for c in CELLS)}] AS n FROM cut),
normed AS (SELECT *, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS norm FROM counted)
SELECT doc_id, sha256('m::' || t) AS text_hash, sha256('m::' || t) IN (SELECT sha256('m::' || t) FROM cut WHERE doc_id % 3 = 0) AS hit,
  array_to_string(list_transform(n, lambda x: CASE WHEN norm > 0 THEN round(1000 * x / norm) ELSE 0 END::BIGINT), ',') AS vector FROM normed""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with vectors, where the cache knows the texts of a third of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    empty = docs.limit(0).select(F.lit("").alias("text_hash"), F.array(F.lit(0.0)).alias("vector"))
    _, cache = embed.embed(docs.where("doc_id % 3 = 0"), empty, "m")
    found, _ = embed.embed(docs, cache, "m")
    return found.select("doc_id", "text_hash", "hit", F.array_join(F.transform("vector", lambda x: F.round(1000 * x).cast("bigint")), ",").alias("vector"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS path FROM documents")
def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which two letters have been taken apart, put together again."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return table(spark, sf_dir, "documents").select("doc_id", text.nfc(apart).alias("path"))


@query(r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')),
  lambda x: length(x) > 0 AND length(x) < 80 AND right(x, 1) NOT IN ('。', '，', '；', '.', ',', ';')), '|') AS headings FROM documents""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.page_headings(F.col("text")), "|").alias("headings"))


@query("""
WITH bodies AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT '/notes/' || conv_id || '.md' AS filepath, CASE conv_id % 3 WHEN 0 THEN 'Note ' || conv_id WHEN 1 THEN 'Talk ' || conv_id ELSE conv_id::VARCHAR END AS title,
  CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id % 5 ELSE '' END AS category, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE '' END AS uuid, length(said) AS n_said FROM bodies""")
def note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the notes have front matter, a third a heading of level 1, a third neither."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("said"))
    k, name = F.col("conv_id"), F.col("conv_id").cast("string")
    listed = F.array(F.concat(F.lit("c"), (k % 5).cast("string")), F.lit("other"))
    front = notes.front_matter(F.concat(F.lit("Note "), name), F.array().cast("array<string>"), listed, k)
    made = turns.select("conv_id", "said", F.concat(F.lit("/notes/"), name, F.lit(".md")).alias("filepath"), F.concat(F.when(k % 3 == 0, front).when(k % 3 == 1, F.concat(F.lit("# Talk "), name, F.lit("\n"))).otherwise(F.lit("> ")), F.lit("["), "said", F.lit("]")).alias("content"))
    before = F.when(k % 3 == 1, F.length(name) + 8).when(k % 3 == 2, 2).otherwise(0)
    return notes.note_heads(made).select("filepath", "title", "category", "uuid", (F.length("body") - before - 2).cast("long").alias("n_said"))


@query("""
WITH fresh AS (SELECT 'n' || doc_id AS uuid, '/out/' || lang || '/' || doc_id || '.md' AS dest, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0),
state AS (SELECT 'n' || doc_id AS uuid, '/out/' || lang || '/' || CASE WHEN doc_id % 5 = 1 THEN 'old/' ELSE '' END || doc_id || '.md' AS dest, CASE WHEN doc_id % 4 = 1 THEN 'x' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 3 <> 0)
SELECT uuid, f.dest AS dest, CASE WHEN f.dest IS NULL THEN 'remove' WHEN f.content_hash = s.content_hash AND f.dest = s.dest THEN 'skip' ELSE 'write' END AS action,
  CASE WHEN f.dest IS NULL OR f.dest <> s.dest THEN s.dest END AS stale FROM fresh f FULL JOIN state s USING (uuid)""")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export after a seventh of the notes has gone, some have moved, and some have other content; a third is new."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")

    def noted(some: DataFrame, moved, content) -> DataFrame:
        return some.select(F.concat(F.lit("n"), k).alias("uuid"), F.concat(F.lit("/out/"), F.col("lang"), F.lit("/"), moved, k, F.lit(".md")).alias("dest"), content.alias("content_hash"), F.lit(None).cast("string").alias("media_hash"))

    fresh = noted(docs.where("doc_id % 7 <> 0"), F.lit(""), F.sha2("text", 256))
    state = noted(docs.where("doc_id % 3 <> 0"), F.when(k % 5 == 1, "old/").otherwise(""), F.when(k % 4 == 1, "x").otherwise(F.sha2("text", 256)))
    return notes.export_plan(fresh, state).select("uuid", "dest", "action", "stale")


@query("""
SELECT lang, round(avg(length(coalesce(text, ''))), 6) AS avg_chars, CASE WHEN avg(length(coalesce(text, ''))) > 400 THEN 25 WHEN avg(length(coalesce(text, ''))) > 200 THEN 40 ELSE 55 END AS batch_size,
  CASE WHEN avg(length(coalesce(text, ''))) > 400 THEN 25 WHEN avg(length(coalesce(text, ''))) > 200 THEN 40 ELSE 50 END AS dense_batch_size FROM documents GROUP BY lang""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.batch_sizes(table(spark, sf_dir, "documents"), "text", ["lang"]).withColumn("avg_chars", F.round("avg_chars", 6))


SHOWN = f"""shown AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id)::INT AS rank, doc_id,
  '/corpus/' || source || '/' || doc_id || '.txt' AS filepath, doc_id || '.txt' AS filename, {FIRST_TIME} + 3600.0 * doc_id AS mtime, text FROM documents)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a result of its source, longest first."""
    order = Window.partitionBy("source").orderBy(F.length(F.coalesce("content", F.lit(""))).desc(), "doc_id")
    rows = files(spark, sf_dir).withColumn("rank", F.row_number().over(order))
    return rows.select(F.col("source").alias("query_id"), "rank", "doc_id", "filepath", "filename", "mtime", F.col("doc_id").cast("double").alias("score"), F.concat(F.pmod("doc_id", F.lit(100)).cast("string"), F.lit("%")).alias("relevance"), F.col("content").alias("preview"))


@query(f"WITH {SHOWN} SELECT query_id, rank, filepath, doc_id::DOUBLE AS score, '' AS snippet, mtime FROM shown")
def result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.listing(_shown(spark, sf_dir))


@query(f"WITH {SHOWN} SELECT query_id, rank - 1 AS index, filename, doc_id % 100 || '%' AS relevance, substr(coalesce(text, ''), 1, 200) AS preview FROM shown WHERE rank <= 10")
def interpret_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.interpretable(_shown(spark, sf_dir))


@query("""
WITH listed AS (SELECT user_id AS query_id, event_type AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_id FROM events WHERE user_id % 10 <> 3),
first AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), path) AS rank FROM listed GROUP BY query_id, path),
qrels AS (SELECT user_id AS query_id, event_type AS path, CASE WHEN max(value) > 100 THEN 2 ELSE 1 END AS grade FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type),
got AS (SELECT query_id, max(CASE WHEN rank = 1 AND grade > 0 THEN 1.0 ELSE 0 END) AS top1, count(grade) FILTER (rank <= 10) AS h10, count(grade) FILTER (rank <= 50) AS h50, min(rank) FILTER (grade > 0 AND rank <= 10) AS first,
  coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM first LEFT JOIN qrels USING (query_id, path) GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS n, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS place FROM qrels) GROUP BY query_id),
runs AS (SELECT user_id, min(value) AS ms FROM events GROUP BY user_id)
SELECT count(*) AS n_cases, round(avg(coalesce(top1, 0)), 6) AS top1, round(avg(coalesce(h10 / n, 0)), 6) AS recall_10, round(avg(coalesce(h50 / n, 0)), 6) AS recall_50, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_10,
  round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg_10, round(avg(CASE WHEN user_id % 4 = 1 THEN 1.0 ELSE 0 END), 6) AS rerank_fallback_rate, round(quantile_cont(ms, 0.5), 6) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms
FROM runs LEFT JOIN got ON user_id = got.query_id LEFT JOIN ideal ON user_id = ideal.query_id""")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the results of a case (kinds of events are the paths, named again and again); some cases failed, some fell back."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "query_id")
    results = events.select("query_id", F.col("event_type").alias("filepath"), F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "event_id")).alias("rank"))
    qrels = events.where("event_id % 2 = 0").groupBy("query_id", F.col("event_type").alias("filepath")).agg(F.when(F.max("value") > 100, 2).otherwise(1).alias("grade"))
    runs = events.groupBy("query_id").agg(F.min("value").alias("latency_ms")).withColumns({"fallback": F.col("query_id") % 4 == 1, "failed": F.col("query_id") % 10 == 3})
    found = evaluate.benchmark(runs.select("query_id"), results, qrels, runs)
    return found.select("n_cases", *(F.round(c, 6).alias(c) for c in ("top1", "recall_10", "recall_50", "mrr_10", "ndcg_10", "rerank_fallback_rate", "p50_ms")), "p95_ms")
