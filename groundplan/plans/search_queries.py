"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions import text as X
from groundplan.operators import chunking, context, graph, search, vectors
from groundplan.plans.document_queries import CHUNKS_SQL, SECTIONS_SQL, manual_docs
from groundplan.plans.programme_queries import sql_any
from groundplan.plans.registry import Registry
from groundplan.session import stored
from groundplan.sources import chunk_store

REGISTRY = Registry()
query = REGISTRY.add

# --- keyword search -----------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
TOKENS_SQL = rf"""
tokens AS (SELECT doc_id AS chunk_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND w NOT IN ({_STOP}))) AS token FROM documents),
postings AS (SELECT token, chunk_id, count(*) AS tf FROM tokens GROUP BY ALL)"""
HITS_SQL = TOKENS_SQL + rf""",
asked AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND w NOT IN ({_STOP}))) AS token FROM benchmark),
wanted AS (SELECT query_id, token, count(*) AS times FROM asked GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, CAST(sum(tf * times) AS BIGINT) AS hits FROM postings JOIN wanted USING (token) GROUP BY ALL)"""


def document_chunks(docs):
    return docs.select(F.col("doc_id").alias("chunk_id"), "text")


def item_queries(items):
    return items.select(F.col("item_id").alias("query_id"), "text")


@query("tokens_postings", "documents", "SELECT token, chunk_id, tf FROM postings", TOKENS_SQL)
def tokens_postings(docs):
    return search.postings(document_chunks(docs))


@query("keyword_score", "documents benchmark", """
SELECT query_id, chunk_id, hits, round(hits / max(hits) OVER (PARTITION BY query_id), 6) AS keyword_score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS INT) AS rank
FROM hits QUALIFY rank <= 20""", HITS_SQL)
def keyword_score(docs, items):
    return search.keyword_topk(item_queries(items), document_chunks(docs)).selectExpr(
        "query_id", "chunk_id", "hits", "round(keyword_score, 6) keyword_score", "rank"
    )


# --- vector search ------------------------------------------------------

CENTRES_SQL = """
spread AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM spread GROUP BY ALL),
centres AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY label),
scored AS (SELECT query_id, c.chunk_id, c.target_index, c.content_type, c.document_type, c.clause_id,
                  round(list_inner_product(q, CAST(embedding AS DOUBLE[])) / sqrt(list_inner_product(q, q) * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 12) AS score
           FROM centres CROSS JOIN vector_chunks c)"""
TOP_SQL = """
SELECT query_id, chunk_id, target_index, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id, target_index ORDER BY score DESC, chunk_id) n FROM scored WHERE score >= 0.3 {where}) WHERE n <= 20)
WHERE rank <= 10"""


def class_queries(embeddings):
    """One query per class: the mean of all its vectors."""
    return vectors.class_centres(embeddings, "label").select(F.col("label").cast("bigint").alias("query_id"), "embedding")


def _shown(hits):
    return hits.selectExpr("query_id", "chunk_id", "target_index", "round(score, 6) score", "rank")


@query("vector_topk", "embeddings vector_chunks", TOP_SQL.format(where=""), CENTRES_SQL)
def vector_topk(embeddings, chunks):
    return _shown(vectors.vector_topk(class_queries(embeddings), chunks))


@query("vector_topk_filtered", "embeddings vector_chunks", TOP_SQL.format(where="AND document_type = 'code' AND content_type = 'table'"), CENTRES_SQL)
def vector_topk_filtered(embeddings, chunks):
    wanted = chunk_store.matching(chunks, document_type="code", content_type="table")
    return _shown(vectors.vector_topk(class_queries(embeddings), wanted))


@query("collection_union", "vector_chunks", """
SELECT target_index, count(*) AS chunks, count(DISTINCT clause_id) AS clauses FROM vector_chunks GROUP BY 1""")
def collection_union(chunks):
    parts = [chunks.filter(F.col("target_index") == name) for name in ("main", "section", "rule")]
    return chunk_store.all_collections(*parts).groupBy("target_index").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("clause_id").alias("clauses")
    )


def asked_sql(asked, shift="a.label"):
    """Vectors of items or questions: the centre of their class, shifted by the vector of their number."""
    return f"""
spread AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM spread GROUP BY ALL),
centres AS (SELECT label, list(x ORDER BY i) AS c FROM means GROUP BY label),
asked_vectors AS (SELECT a.query_id, a.text, list_transform(c.c, lambda x, i: x + CAST(e.embedding[i] AS DOUBLE)) AS q
                  FROM {asked} a JOIN centres c ON c.label = {shift} JOIN embeddings e ON e.vec_id = a.vec_id)"""


def asked_vectors(embeddings, asked, shift="label"):
    """Every item or question with a vector: the centre of its class, shifted by the vector of its number."""
    centres = vectors.class_centres(embeddings, "label").select(F.col("label").cast("bigint").alias("_label"), F.col("embedding").alias("_centre"))
    own = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("_own"))
    rows = asked.withColumn("_label", F.expr(shift)).join(centres, "_label").join(own, "vec_id")
    return rows.select("query_id", "text", F.zip_with("_centre", "_own", lambda a, b: a + b).alias("embedding"))


_COSINE = "round(list_inner_product(q, CAST(embedding AS DOUBLE[])) / sqrt(list_inner_product(q, q) * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 12)"
NEAR_SQL = HITS_SQL + ",\n" + asked_sql("asked_items").strip() + f""",
near AS (SELECT query_id, chunk_id, {_COSINE} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE} DESC, chunk_id) AS rank
         FROM asked_vectors CROSS JOIN text_chunks WHERE {_COSINE} >= 0.3 QUALIFY rank <= 20)"""
FUSION_SQL = NEAR_SQL + """,
fused AS (SELECT n.query_id, n.chunk_id, n.score AS semantic_score, coalesce(h.hits / m.most, 0) AS keyword_score,
                 0.7 * n.score + 0.3 * coalesce(h.hits / m.most, 0) AS combined_score
          FROM near n LEFT JOIN hits h ON h.query_id = n.query_id AND h.chunk_id = n.chunk_id
          LEFT JOIN (SELECT query_id, max(hits) AS most FROM hits GROUP BY 1) m ON m.query_id = n.query_id),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 12) DESC, chunk_id) rank FROM fused QUALIFY rank <= 10)"""


@query("hybrid_fusion", "embeddings asked_items text_chunks", """
SELECT query_id, chunk_id, round(semantic_score, 6) semantic_score, round(keyword_score, 6) keyword_score, round(combined_score, 6) combined_score, CAST(rank AS INT) rank FROM final""", FUSION_SQL, also="documents")
def hybrid_fusion(embeddings, items, chunks):
    return search.hybrid_search(asked_vectors(embeddings, items), chunks).selectExpr(
        "query_id", "chunk_id", "round(semantic_score, 6) semantic_score", "round(keyword_score, 6) keyword_score",
        "round(combined_score, 6) combined_score", "rank",
    )


@query("two_stage_search", "embeddings asked_items text_chunks", rf"""
SELECT query_id, chunk_id, shared AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, chunk_id) AS INT) AS rank
FROM (SELECT f.query_id, f.chunk_id, count(DISTINCT w.token) AS shared FROM final f LEFT JOIN wanted w ON w.query_id = f.query_id
        AND EXISTS (SELECT 1 FROM postings p WHERE p.chunk_id = f.chunk_id AND p.token = w.token) GROUP BY ALL)
QUALIFY rank <= 5""", FUSION_SQL, also="documents")
def two_stage_search(embeddings, items, chunks):
    questions = asked_vectors(embeddings, items)
    shared = F.size(F.array_intersect(X.tokens(F.col("query_text")), X.tokens(F.col("chunk_text")))).cast("bigint")
    first = search.hybrid_search(questions, chunks)
    return search.second_stage(first, questions, chunks, shared, k=5).select("query_id", "chunk_id", "rerank_score", "rank")


@query("rank_fusion", "embeddings asked_items text_chunks", f"""
SELECT query_id, chunk_id, round(combined_score, 9) AS combined_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 12) DESC, chunk_id) AS INT) AS rank FROM (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (rank + {V.RECIPROCAL_RANK_OFFSET})) AS combined_score FROM (
    SELECT query_id, chunk_id, rank FROM near UNION ALL
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 20) GROUP BY ALL)
QUALIFY rank <= 10""", NEAR_SQL, also="documents")
def rank_fusion(embeddings, items, chunks):
    questions = asked_vectors(embeddings, items)
    semantic = vectors.vector_topk(questions, chunks, k=20)
    return search.fuse_by_rank(semantic, search.keyword_topk(questions, chunks, k=20)).selectExpr("query_id", "chunk_id", "round(combined_score, 9) combined_score", "rank")


SECTION_HITS_SQL = CENTRES_SQL.strip() + """,
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM scored
         WHERE score >= 0.3 AND target_index = 'section' AND content_type = 'section_overview' QUALIFY rank <= 3),
allowed AS (SELECT DISTINCT query_id, unnest([string_split(clause_id, '.')[1], clause_id]) AS clause FROM near),
rules AS (SELECT *, 'rule' AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM scored s
          WHERE score >= 0.3 AND target_index = 'rule' AND query_id IN (SELECT query_id FROM near) {prefix} QUALIFY rank <= 5),
rest AS (SELECT *, 'semantic' AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM scored
         WHERE score >= 0.3 AND query_id NOT IN (SELECT query_id FROM rules) QUALIFY rank <= 5)"""
_BOTH = """SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank, stage FROM rules
UNION ALL SELECT query_id, chunk_id, round(score, 6), CAST(rank AS INT), stage FROM rest"""


@query("hierarchical_search", "embeddings vector_chunks", _BOTH, SECTION_HITS_SQL.format(prefix=""))
def hierarchical_search(embeddings, chunks):
    return search.hierarchical_search(class_queries(embeddings), chunks).selectExpr("query_id", "chunk_id", "round(score, 6) score", "rank", "stage")


@query("hierarchical_prefix_search", "embeddings vector_chunks", _BOTH, SECTION_HITS_SQL.format(
    prefix="AND EXISTS (SELECT 1 FROM allowed a WHERE a.query_id = s.query_id AND a.clause IN (string_split(s.clause_id, '.')[1], s.clause_id))"))
def hierarchical_prefix_search(embeddings, chunks):
    found = search.hierarchical_search(class_queries(embeddings), chunks, apply_prefix=True)
    return found.selectExpr("query_id", "chunk_id", "round(score, 6) score", "rank", "stage")


# fixed words of the routes stand in ROUTE_SQL's text; here a route is read from each text
_ROUTE = f"""CASE WHEN {sql_any('lower(text)', V.DESIGN_TERMS)} THEN 'comprehensive_design' WHEN {sql_any('lower(text)', V.DATA_TERMS)} THEN 'data_lookup'
                  WHEN {sql_any('lower(text)', V.DEFINITION_TERMS)} THEN 'definition' ELSE 'general' END"""


def retrieval_sql(p, asked, k):
    """Primary results of the rows of ``asked`` (query_id, text, q) by their routes, as ``{p}found``."""
    best = lambda where, n: f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}scored WHERE {where} QUALIFY rank <= {n}"""
    return f"""
{p}scored AS (SELECT * FROM (SELECT query_id, {_ROUTE} AS query_type, chunk_id, target_index, content_type, {_COSINE} AS score FROM {asked} CROSS JOIN vector_chunks) WHERE score >= 0.3),
{p}near AS ({best("query_type = 'comprehensive_design' AND target_index = 'section' AND content_type = 'section_overview'", 3)}),
{p}rules AS ({best(f"target_index = 'rule' AND query_id IN (SELECT query_id FROM {p}near)", k)}),
{p}rest AS ({best(f"query_type = 'comprehensive_design' AND query_id NOT IN (SELECT query_id FROM {p}rules)", k)}),
{p}data AS ({best("query_type = 'data_lookup' AND content_type = 'table'", k)}),
{p}other AS ({best("query_type IN ('definition', 'general')", k)}),
{p}design AS (SELECT * FROM {p}rules UNION ALL SELECT * FROM {p}rest),
{p}plain AS (SELECT * FROM {p}data UNION ALL SELECT * FROM {p}other)"""


ROUTED_SQL = asked_sql("asked_questions").strip() + "," + retrieval_sql("", "asked_vectors", 5) + """,
steps AS (SELECT d.query_id, d.rank, d.chunk_id, list_sort(list_distinct(list(CAST(e.dst AS VARCHAR)) FILTER (e.dst <> d.chunk_id))) AS refs
          FROM design d LEFT JOIN vector_edges e ON e.src = d.chunk_id GROUP BY ALL),
fold AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS froms FROM steps
  UNION ALL
  SELECT f.query_id, s.rank,
         CASE WHEN list_contains(f.ids, CAST(s.chunk_id AS VARCHAR)) THEN f.ids ELSE list_concat(list_append(f.ids, CAST(s.chunk_id AS VARCHAR)), list_filter(coalesce(s.refs, []), lambda r: NOT list_contains(f.ids, r))) END,
         CASE WHEN list_contains(f.ids, CAST(s.chunk_id AS VARCHAR)) THEN f.froms ELSE list_concat(list_append(f.froms, ''), list_transform(list_filter(coalesce(s.refs, []), lambda r: NOT list_contains(f.ids, r)), lambda r: CAST(s.chunk_id AS VARCHAR))) END
  FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.rank = f.rank + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1),
expanded AS (SELECT query_id, unnest(generate_series(1, len(ids))) AS rank, CAST(unnest(ids) AS BIGINT) AS chunk_id, unnest(froms) AS referenced_from FROM done),
retrieved AS (
  SELECT query_id, 'comprehensive_design' AS query_type, chunk_id, rank, CASE referenced_from WHEN '' THEN 'primary' ELSE 'reference' END AS role, referenced_from FROM expanded
  UNION ALL SELECT query_id, query_type, chunk_id, rank, 'primary', '' FROM plain)"""


@query("routed_retrieval", "embeddings vector_chunks vector_edges asked_questions", """
SELECT query_id, query_type, chunk_id, CAST(rank AS INT) AS rank, role, referenced_from, CAST(CASE role WHEN 'primary' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS relevance_score
FROM retrieved""", ROUTED_SQL)
def routed_retrieval(embeddings, chunks, edges, questions):
    found = search.retrieve(asked_vectors(embeddings, questions), chunks, edges=edges)
    return found.selectExpr("query_id", "query_type", "chunk_id", "rank", "role", "coalesce(cast(referenced_from as string), '') referenced_from", "relevance_score")


@query("equation_retrieval", "embeddings vector_chunks vector_edges asked_questions", """
SELECT query_id, chunk_id, role, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS INT) AS merged_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, document_type, clause_id, label ORDER BY l, rank) AS n FROM (
    SELECT 0 AS l, query_id, chunk_id, rank, role FROM retrieved
    UNION ALL SELECT 1, query_id, chunk_id, rank, 'primary' FROM (SELECT * FROM eq_design UNION ALL SELECT * FROM eq_plain)) JOIN vector_chunks USING (chunk_id))
WHERE n = 1 QUALIFY merged_rank <= 12""", ROUTED_SQL + "," + asked_sql("asked_questions", "(a.label + 1) % 10").strip().replace("spread", "eq_spread").replace("means", "eq_means").replace("centres", "eq_centres").replace("asked_vectors", "eq_vectors").replace("a.text", f"concat(a.text, '{V.EQUATION_SUFFIX}') AS text") + "," + retrieval_sql("eq_", "eq_vectors", 12))
def equation_retrieval(embeddings, chunks, edges, questions):
    """Both retrievals of each question; chunks of one document type, clause and class share a merge key."""
    formulas = asked_vectors(embeddings, questions, "(label + 1) % 10").select("query_id", F.col("embedding").alias("equation_embedding"))
    asked = asked_vectors(embeddings, questions).join(formulas, "query_id")
    keyed = chunks.withColumns({
        "document_name": F.col("document_type"), "section_title": F.col("clause_id"), "page_number": F.col("label"), "text": F.lit("see the page"),
    })
    return search.retrieve_equations(asked, keyed, edges=edges).select("query_id", "chunk_id", "role", F.col("merged_rank").cast("int").alias("merged_rank"))


@query("code_support", "embeddings vector_chunks", """
SELECT query_id AS method_id, CASE WHEN count(*) FILTER (score >= 0.3 AND document_type = 'code') > 0 THEN 'pass' ELSE 'warning' END AS status FROM scored GROUP BY 1""", CENTRES_SQL)
def code_support(embeddings, chunks):
    from groundplan.operators.validation import code_support_checks

    return code_support_checks(class_queries(embeddings).withColumnRenamed("query_id", "method_id"), chunks).select("method_id", "status")


# --- routing ------------------------------------------------------------


def _listed(table):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {sql_any('lower(question)', words)} THEN '{name}' END" for name, words in table.items()) + ")"


ROUTE_SQL = f"""
routed AS (SELECT question_id, question, CASE WHEN {sql_any('lower(question)', V.DESIGN_TERMS)} THEN 'comprehensive_design'
                  WHEN {sql_any('lower(question)', V.DATA_TERMS)} THEN 'data_lookup'
                  WHEN {sql_any('lower(question)', V.DEFINITION_TERMS)} THEN 'definition' ELSE 'general' END AS query_type,
                  {_listed(V.ELEMENT_TERMS)} AS target_elements, {_listed(V.ACTION_TERMS)} AS target_actions FROM questions)"""


@query("query_routing", "questions", """
SELECT question_id, query_type, CASE query_type WHEN 'comprehensive_design' THEN 'hierarchical_graph' WHEN 'data_lookup' THEN 'table_first'
       WHEN 'definition' THEN 'atomic_lookup' ELSE 'semantic_search' END AS strategy FROM routed""", ROUTE_SQL)
def query_routing(questions):
    return search.route_queries(questions, "question").select("question_id", "query_type", "strategy")


@query("query_elements", "questions", "SELECT question_id, target_elements, target_actions FROM routed", ROUTE_SQL)
def query_elements(questions):
    return search.route_queries(questions, "question").selectExpr(
        "question_id", "array_join(target_elements, ',') target_elements", "array_join(target_actions, ',') target_actions"
    )


_VARIANTS = ", ".join(
    f"CASE WHEN contains(lower(question), '{t}') THEN replace(lower(question), '{t}', '{o}') END" for t, os in V.SYNONYMS.items() for o in os[:2]
)


@query("query_expansion", "questions", """
SELECT question_id, CAST(i - 1 AS INT) AS variant, all_texts[i] AS text FROM
  (SELECT question_id, list_filter(texts, lambda x, i: list_position(texts, x) = i)[1:4] AS all_texts,
          unnest(generate_series(1, len(list_filter(texts, lambda x, i: list_position(texts, x) = i)[1:4]))) AS i FROM made)""", f"""
made AS (SELECT question_id, list_concat([question], list_filter([{_VARIANTS}], lambda x: x IS NOT NULL AND x <> lower(question))) AS texts FROM questions)""")
def query_expansion(questions):
    return search.expand_queries(questions.withColumnRenamed("question", "text"))


@query("equation_queries", "questions", f"SELECT question_id, concat(question, '{V.EQUATION_SUFFIX}') AS text FROM questions")
def equation_queries(questions):
    from groundplan.functions.routing import equation_query

    return questions.select("question_id", equation_query(F.col("question")).alias("text"))


# --- result lists -------------------------------------------------------

LISTS_SQL = CHUNKS_SQL.strip() + """,
base AS (SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_count DESC, section_no, part_no) AS rank, document_name, title AS section_title,
                page AS page_number, text, char_count / 10000 AS score FROM chunks),
extra AS (SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part_no) AS rank, document_name, title AS section_title, page AS page_number, text, 0.5 AS score
          FROM chunks WHERE level <= 2)"""


def _ordered(chunks, *order):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy(*order)
    return chunks.select(
        F.col("document_id").alias("query_id"), F.row_number().over(w).alias("rank"), "document_name", "section_title", "page_number", "text",
        (F.col("char_count") / 10000).alias("score"), "section_level",
    )


@query("merge_chunks", "md_docs", """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS INT) AS merged_rank, section_title, md5(text) AS text_md5 FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, document_name, section_title, page_number, left(text, 160) ORDER BY l, rank) n
   FROM (SELECT 0 AS l, * FROM base UNION ALL SELECT 1, * FROM extra)) WHERE n = 1 QUALIFY merged_rank <= 12""", LISTS_SQL)
def merge_chunks(docs):
    chunks = chunking.section_chunks(manual_docs(docs))
    base = _ordered(chunks, F.desc("char_count"), "section_no", "part_no")
    extra = _ordered(chunks.filter("section_level <= 2"), "section_no", "part_no")
    return search.merge_results(base, extra).selectExpr("query_id", "merged_rank", "section_title", "md5(text) text_md5")


@query("source_dedupe", "md_docs", """
SELECT query_id, document_name, section_title, CAST(rank AS INT) AS rank, round(score, 3) AS relevance_score FROM base
QUALIFY row_number() OVER (PARTITION BY query_id, document_name, section_title ORDER BY rank) = 1""", LISTS_SQL)
def source_dedupe(docs):
    chunks = chunking.section_chunks(manual_docs(docs))
    rows = search.distinct_sources(_ordered(chunks, F.desc("char_count"), "section_no", "part_no"))
    return rows.select("query_id", "document_name", "section_title", "rank", "relevance_score")


@query("result_rank", "md_docs", """
SELECT doc_id AS query_id, section_no, part_no, char_count / 10000 AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_count DESC, section_no * 1000000 + part_no) AS INT) AS rank FROM chunks""", CHUNKS_SQL)
def result_rank(docs):
    rows = chunking.section_chunks(manual_docs(docs)).selectExpr(
        "document_id query_id", "section_no", "part_no", "char_count / 10000 combined_score", "section_no * 1000000 + part_no chunk_id"
    )
    return search.result_scores(search.ranked(rows, F.col("combined_score"))).select("query_id", "section_no", "part_no", "score", "rank")


@query("prompt_context", "md_docs", """
SELECT query_id, md5(string_agg(concat('[Source: ', document_name, ' | Section: ', section_title, ' | Page: ', coalesce(page_number, 'N/A'), ']', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank)) AS context_md5
FROM base GROUP BY 1""", LISTS_SQL)
def prompt_context(docs):
    chunks = chunking.section_chunks(manual_docs(docs))
    best = _ordered(chunks, F.desc("char_count"), "section_no", "part_no")
    return context.source_blocks(best).selectExpr("query_id", "md5(context) context_md5")


# --- graph --------------------------------------------------------------

GRAPH_SQL = SECTIONS_SQL.strip() + r""",
nodes AS (SELECT doc_id, concat(doc_id, ':', coalesce(nullif(regexp_extract(title, '^(\d+(?:\.\d+)*)', 1), ''), 'unknown')) AS chunk_id, section_no, title,
                 nullif(regexp_extract(title, '(?i)Page\s+(\d+)', 1), '') AS page, text, regexp_extract_all(text, '(?i)Clause\s+(\d+(?:\.\d+)+)', 1) AS refs, length(text) AS size FROM sections),
edges AS (SELECT DISTINCT chunk_id AS src, concat(doc_id, ':', ref) AS dst FROM (SELECT chunk_id, doc_id, unnest(refs) AS ref FROM nodes))"""


def graph_chunks(docs, reused=False):
    """Whole clauses of each document, with references to its other clauses."""
    sections = chunking.section_table(docs.select(F.col("doc_id").alias("document_id"), "text"), ["document_id"])
    prefix = F.col("document_id").cast("string")
    key = lambda c: F.concat(prefix, F.lit(":"), c)
    rows = sections.withColumn("clause_id", X.clause_of(F.col("title"))).select(
        "document_id", key(F.col("clause_id")).alias("chunk_id"), "clause_id", F.col("title").alias("clause_title"),
        F.coalesce(X.page_of_title(F.col("title")), F.lit(0)).alias("page_number"), "section_no", "text", F.length("text").alias("char_count"),
        F.transform(X.cross_references(F.col("text")), key).alias("references"),
    )
    return stored(rows) if reused else rows


@query("graph_edges", "md_docs", "SELECT src, dst FROM edges", GRAPH_SQL)
def graph_edges(docs):
    return graph.edges_of(graph_chunks(docs))


@query("graph_neighbours", "md_docs", """
SELECT src AS node, 'references' AS direction, dst AS neighbour FROM edges UNION ALL SELECT dst, 'referenced_by', src FROM edges""", GRAPH_SQL)
def graph_neighbours(docs):
    return graph.neighbours(graph.edges_of(graph_chunks(docs)))


@query("graph_degrees", "md_docs", """
SELECT chunk_id, (SELECT count(*) FROM edges WHERE src = chunk_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = chunk_id) AS in_degree,
       chunk_id IN (SELECT src FROM edges) AS has_references FROM nodes""", GRAPH_SQL)
def graph_degrees(docs):
    chunks = graph_chunks(docs, reused=True)
    return graph.degrees(chunks, graph.edges_of(chunks))


@query("graph_stats", "md_docs", "SELECT count(DISTINCT src) AS total_nodes, count(*) AS total_edges FROM edges", GRAPH_SQL)
def graph_stats(docs):
    return graph.graph_stats(graph.edges_of(graph_chunks(docs)))


@query("edge_upsert", "md_docs", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", GRAPH_SQL)
def edge_upsert(docs):
    edges = graph.edges_of(graph_chunks(docs, reused=True))
    return graph.add_edges(edges, edges.selectExpr("dst src", "src dst"))


EXPAND_SQL = GRAPH_SQL + """,
primaries AS (SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY size, section_no) AS rank, chunk_id FROM nodes),
targets AS (SELECT p.query_id, p.rank, list(DISTINCT e.dst ORDER BY e.dst) AS refs FROM primaries p JOIN edges e ON e.src = p.chunk_id
            WHERE e.dst IN (SELECT chunk_id FROM nodes) GROUP BY ALL),
steps AS (SELECT p.query_id, p.rank, p.chunk_id, coalesce(t.refs, CAST([] AS VARCHAR[])) AS refs FROM primaries p LEFT JOIN targets t ON t.query_id = p.query_id AND t.rank = p.rank),
fold AS (
  SELECT query_id, 0 AS rank, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS roles, CAST([] AS VARCHAR[]) AS froms FROM (SELECT DISTINCT query_id FROM steps)
  UNION ALL
  SELECT f.query_id, s.rank,
         CASE WHEN list_contains(f.ids, s.chunk_id) THEN f.ids ELSE list_concat(list_concat(f.ids, [s.chunk_id]), list_filter(s.refs, lambda r: NOT list_contains(f.ids, r) AND r <> s.chunk_id)) END,
         CASE WHEN list_contains(f.ids, s.chunk_id) THEN f.roles ELSE list_concat(list_concat(f.roles, ['primary']), list_transform(list_filter(s.refs, lambda r: NOT list_contains(f.ids, r) AND r <> s.chunk_id), lambda r: 'reference')) END,
         CASE WHEN list_contains(f.ids, s.chunk_id) THEN f.froms ELSE list_concat(list_concat(f.froms, ['']), list_transform(list_filter(s.refs, lambda r: NOT list_contains(f.ids, r) AND r <> s.chunk_id), lambda r: s.chunk_id)) END
  FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.rank = f.rank + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1),
expanded AS (SELECT query_id, CAST(unnest(generate_series(1, len(ids))) - 1 AS INT) AS position, unnest(ids) AS chunk_id, unnest(roles) AS role, unnest(froms) AS referenced_from FROM done)"""


def expansion(docs):
    """Each document's clauses, shortest first, as primaries of one query."""
    from pyspark.sql import Window

    chunks = graph_chunks(docs, reused=True)
    by_size = Window.partitionBy("document_id").orderBy("char_count", "section_no")
    primaries = chunks.select(F.col("document_id").alias("query_id"), F.row_number().over(by_size).alias("rank"), "chunk_id", "references")
    return graph.expand(primaries, graph.edges_of(chunks), chunks), chunks


@query("graph_expand", "md_docs", """
SELECT query_id, position, chunk_id, role, referenced_from, CAST(CASE role WHEN 'reference' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS relevance_score FROM expanded""", EXPAND_SQL)
def graph_expand(docs):
    return expansion(docs)[0].selectExpr("query_id", "position", "chunk_id", "role", "coalesce(referenced_from, '') referenced_from", "cast(relevance_score as double) relevance_score")


@query("graph_expand_counts", "md_docs", """
SELECT query_id, count(*) FILTER (role = 'primary') AS primary_count, count(*) FILTER (role = 'reference') AS reference_count FROM expanded GROUP BY 1""", EXPAND_SQL)
def graph_expand_counts(docs):
    return graph.expansion_counts(expansion(docs)[0])


_RULES_TEXT = V.CITATION_RULES.replace("'", "''")


@query("context_assembly", "md_docs", f"""
SELECT query_id, md5(concat('Query: question ', query_id, chr(10), chr(10), '## Retrieved Engineering Knowledge', chr(10), chr(10), string_agg(part, '' ORDER BY clause_id), '{_RULES_TEXT}')) AS context_md5
FROM (SELECT query_id, clause_id, concat('### [', clause_id, '] ', min(title), ' (Page ', min(coalesce(page, '0')), ')', chr(10),
             string_agg(concat(CASE role WHEN 'primary' THEN '[PRIMARY]' ELSE '[REFERENCED]' END, ':', chr(10), text, chr(10), chr(10)), '' ORDER BY position)) AS part
      FROM (SELECT e.*, string_split(e.chunk_id, ':')[2] AS clause_id, n.title, n.page, n.text FROM expanded e JOIN nodes n ON n.chunk_id = e.chunk_id) GROUP BY query_id, clause_id)
GROUP BY query_id""", EXPAND_SQL)
def context_assembly(docs):
    results, chunks = expansion(docs)
    rows = results.join(chunks.select("chunk_id", "clause_id", "clause_title", "page_number", "text"), "chunk_id")
    texts = context.assemble(rows.withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string"))))
    return texts.selectExpr("query_id", "md5(context) context_md5")


@query("clause_prefixes", "md_docs", r"""
SELECT DISTINCT doc_id, array_to_string(string_split(clause_id, '.')[1:i], '.') AS clause FROM (SELECT doc_id, clause_id, unnest(generate_series(1, len(string_split(clause_id, '.')))) AS i FROM chunks)""", CHUNKS_SQL)
def clause_prefixes(docs):
    chunks = chunking.section_chunks(manual_docs(docs))
    return chunks.select(F.col("document_id").alias("doc_id"), F.explode(search.clause_prefixes(F.col("clause_id"))).alias("clause")).distinct()
