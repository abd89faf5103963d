"""Named queries of the operators in this package, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundplan.llm import alignment, chat, collocations, decontam, html, langid, linedup, minhash, packing, passages, quality, token_counts, toxicity

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(build: Plan) -> Plan:
        PLANS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@plan("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


@plan("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


LINE_DEDUP_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), filled AS (
  SELECT doc_id, i, line, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM split WHERE regexp_matches(line, '[^ \\t\\v\\f\\r]')
), reach AS (
  -- every run of 50 characters whose lines but the first hold fewer, or but the last; longer runs are made up of these
  SELECT a.doc_id, a.k, b.k AS last FROM filled a JOIN filled b
  ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k <= a.k + 50 AND b.upto - a.upto + a.size >= 50
  WHERE b.upto - a.upto < 50 OR b.upto - a.upto + a.size - b.size < 50
), run AS (
  SELECT r.doc_id, r.k, r.last, string_agg(f.line, chr(10) ORDER BY f.k) AS content
  FROM reach r JOIN filled f ON f.doc_id = r.doc_id AND f.k BETWEEN r.k AND r.last GROUP BY ALL
), later AS (
  SELECT doc_id, k, last, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS copy FROM run
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM filled f JOIN later l ON f.doc_id = l.doc_id AND f.k BETWEEN l.k AND l.last WHERE l.copy > 1
), marked AS (
  SELECT s.doc_id, s.i, s.line, f.i IS NOT NULL AS is_filled, g.i IS NOT NULL AS is_gone
  FROM split s LEFT JOIN filled f ON s.doc_id = f.doc_id AND s.i = f.i LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i
)
SELECT doc_id,
       CASE WHEN count(*) FILTER (is_filled) > 0 AND count(*) FILTER (is_filled AND NOT is_gone) = 0 THEN ''
            ELSE string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_gone) END AS text,
       count(*) FILTER (is_filled) AS n_lines, count(*) FILTER (is_gone) AS n_deleted
FROM marked GROUP BY doc_id
"""


@plan("op10_line_dedup", LINE_DEDUP_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.delete_repeated_runs(_table(spark, folder, "documents").select("doc_id", "text"))


@plan("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), size=3, percent=85)


@plan("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@plan("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return quality.score_quality(documents, quality.fit(documents, _table(spark, folder, "labels")))


@plan("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@plan("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(_table(spark, folder, "pages"))


# a conversation whose texts hold the template's own marks
MARKED = r"\### Assistant: </turn> ok"


@plan("op2_chat_formatting")
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.format_conversations(conversations.unionByName(marked)))


# the template adds '### ', ': ' and ' </turn>' and a line end to a turn, and a backslash before backslashes, number signs and </
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(regexp_replace(text, '[\\#]|</', 'x\0', 'g')) + length(regexp_replace(role, '[\\#:]|</', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
SQL["op2_chat_formatting"] = CHAT_SQL


@plan("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.by_document(passages.find_passages(_table(spark, folder, "documents")))


@plan("op13_token_counts")
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"))


@plan("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(_table(spark, folder, "documents"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents)
), words AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY 1
), counts AS (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM (
    SELECT lang, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase FROM (
      SELECT lang, w, size, unnest(range(len(w) - size + 1)) AS i FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score, k
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.tail JOIN words ON words.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


@plan("op11_phrase_collocations", COLLOCATION_SQL)
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))
