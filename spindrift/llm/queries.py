"""The queries of the numbered operators: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, collocations, decontaminate, html_text, mixing, neardup, ngram_join, quality_model, quality_rules, secrets, substrings, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"].isin(*secrets.BASE))

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    # Each text goes to the visitor as a typed part.
    part = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("size"))
    made = chat.with_masked(chat.format_conversations(turns.unionByName(extra).withColumn("parts", F.array(part))))
    back = made.select("*", chat.parse(F.col("formatted")).alias("turns"), F.array_join("learned", "").alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, payloads=False))
    length = F.coalesce(F.col("capture.fields")["payload-length"], F.col("metadata.fields")["payload-length"])
    return captures.select(
        F.col("metadata.fields")["page-id"].try_cast("long").alias("page_id"),
        length.cast("long").alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.regexp_extract("capture.refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long").alias("refers_to"),
    )


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "lang", "n_bytes", F.round("bits_per_byte", 4).alias("bits_per_byte"), "threshold", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_html_text": op8_html_text,
    "op9_warc": op9_warc,
    "op10_quality_model": op10_quality_model,
    "op11_token_alignment": op11_token_alignment,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_collocations": op13_collocations,
}

#: What both tokenisations look like in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The kinds of op 3 as RE2 patterns: that of random strings takes whole runs, which are tested afterwards, as RE2 can't look around.
FINDERS = {
    "assign": (secrets.ASSIGN, 2, "length(v) >= 8"),
    "access": (r"AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
    "hex": (r"[0-9a-f]+", 0, "length(v) >= 32"),
    "identifier": (secrets.IDENTIFIER.replace("(?<![A-Za-z0-9_])", r"\b"), 0, "true"),
    "random": (r"[A-Za-z0-9+/=_-]+", 0, "regexp_full_match(v, '[A-Za-z0-9+/]{40}')"),
    "endpoint": (secrets.ENDPOINT.replace("(?<![A-Za-z0-9_])", r"\b"), 0, "true"),
}


def _finder(place: int, kind: str, pattern: str, group: int, test: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    # Each match goes with its two strings and the text before it, not with the lists of all.
    return f"""SELECT r, '{kind}' AS kind, {place} AS place, start, start + length(m) AS stop FROM (
  SELECT r, x[1] AS m, x[2] AS v, (sum(length(x[3]) + length(x[1])) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) - length(x[1]))::BIGINT AS start
  FROM (SELECT r, unnest(z) AS x, unnest(range(1, len(z) + 1)) AS k
    FROM (SELECT r, [[c[1], c[2], c[3]] FOR c IN list_zip(m, v, g[:len(m)])] AS z
      FROM (SELECT r, regexp_extract_all(text, {quoted}, 0) AS m, regexp_extract_all(text, {quoted}, {group}) AS v, string_split_regex(text, {quoted}) AS g FROM docs)))) WHERE {test}"""


def _near(role: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in secrets.KINDS if secrets.ROLES[k] == role)
    return f"EXISTS (SELECT 1 FROM parts y WHERE y.r = x.r AND y.kind IN ({kinds}) AND y.start < x.stop + {secrets.SCOPE} AND x.start - {secrets.SCOPE} < y.stop)"


ORACLE_SQL = {
    "op3_secrets": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_finder(n, k, *x) for n, (k, x) in enumerate(FINDERS.items()))}),
parts AS (
  SELECT * FROM found x WHERE place < 3 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.r = x.r AND b.place < 3 AND b.start < x.stop AND x.start < b.stop)),
linked AS (
  SELECT * FROM parts x WHERE place < 3 OR kind = 'identifier' AND {_near("secret")} OR kind = 'random' AND ({_near("identifier")} OR {_near("endpoint")})
    OR kind = 'endpoint' AND {_near("identifier")} AND {_near("secret")}),
told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM linked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (r)""",
    "op1_decontaminate": f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS u(s)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS words
  FROM docs, (SELECT DISTINCT size FROM windows), unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(s)),
hits AS (SELECT doc_id, item_id, s, s + p.size AS e FROM places p JOIN windows v ON p.size = v.size AND p.words = v.words),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hits, unnest(range(s, e)) AS u(x) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op5_substring_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {SPACED} AS w FROM documents),
places AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS words FROM docs, unnest(range(1, greatest(len(w) - 33, 1))) AS u(s)),
repeated AS (SELECT words FROM places GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, x FROM places SEMI JOIN repeated USING (words), unnest(range(s, s + 35)) AS u(x)),
words AS (SELECT r, x, w[x] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(x)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
    "op2_mixing": f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len({SPACED})::BIGINT AS size, md5('17:' || doc_id::VARCHAR) AS mark FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS most FROM sources),
levels AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, ((SELECT sum(source_size) FROM weighted) - coalesce((SELECT sum(most) FROM weighted WHERE most < level * weight), 0))::DOUBLE
                    / (SELECT sum(weight) FROM weighted WHERE most >= level * weight)
  FROM levels WHERE round < 40),
target AS (
  SELECT source, source_size, place, CASE WHEN most < level * weight THEN most::DOUBLE ELSE level * weight END AS target
  FROM weighted, (SELECT level FROM levels WHERE round = 40)),
queued AS (
  SELECT doc_id, size, source_size, target, place, sum(size) OVER (PARTITION BY place ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING) AS through
  FROM docs JOIN target ON docs.source IS NOT DISTINCT FROM target.source),
passes AS (
  SELECT doc_id, size, place, k, through, (k * source_size + through)::DOUBLE / target AS finish FROM queued, range(3) AS r(k) WHERE size > 0),
served AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, k, through ROWS UNBOUNDED PRECEDING) AS served FROM passes),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM served WHERE served <= (SELECT sum(size) FROM docs) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (doc_id)""",
    "op6_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {SPACED} AS w FROM documents),
triples AS (SELECT r, s, w[s:s + 2] AS t FROM docs, unnest(range(1, greatest(len(w) - 1, 1))) AS u(s)),
repeated AS (SELECT r, t FROM triples GROUP BY r, t HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT x) AS n FROM triples SEMI JOIN repeated USING (r, t), unnest(range(s, s + 3)) AS u(x) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS n_different
          FROM docs, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n - l.n_different, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_loud,
    greatest({", ".join("len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in words) + "]))" for words in quality_rules.STOP_WORDS.values())}) AS stop_words
  FROM docs LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3 AND n_loud / n_words <= 0.3
    AND stop_words >= 2 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5, false) AS kept
FROM judged""",
    "op7_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + (length(text) - length(replace(replace(text, '\', ''), '<', ''))) + 22)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM pieces, (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, f AS a, unnest(range(1, k)) AS j FROM often WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, a, j, p.f AS l, q.f AS r, n, 1000::HUGEINT * a * n // (p.f::HUGEINT * q.f) AS score
  FROM cuts c JOIN often p ON p.lang = c.lang AND p.phrase = x JOIN often q ON q.lang = c.lang AND q.phrase = y JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
shorter AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM often WHERE k > 2)) GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM lowest LEFT JOIN shorter USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true))
SELECT * FROM ranked WHERE rank <= 2000""",
    "op9_warc": r"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, list_aggregate(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), 'string_agg', '') AS b
  FROM digests),
coded AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, (5 * k + 1)::INT, 1)::INT + 8 * substr(b, (5 * k + 2)::INT, 1)::INT + 4 * substr(b, (5 * k + 3)::INT, 1)::INT + 2 * substr(b, (5 * k + 4)::INT, 1)::INT + substr(b, (5 * k + 5)::INT, 1)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM bits),
latest AS (SELECT payload_digest, max(page_id) AS latest FROM coded GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM coded JOIN latest USING (payload_digest)""",
}
