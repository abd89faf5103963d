"""Keyword scores, fusion, routed retrieval and result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions import routing
from groundplan.functions import text as X
from groundplan.operators import graph
from groundplan.operators.keyword import chunks_above, keyword_topk, pair_hits, postings
from groundplan.operators.sizes import broadcast_if_small
from groundplan.operators.vectors import vector_topk
from groundplan.session import cut_lineage, stored

# --- keyword scores -----------------------------------------------------


def write_postings(chunks: DataFrame, table: str, buckets: int = 256) -> None:
    """Store postings bucketed by token, so that searches join without a shuffle of them."""
    postings(chunks).write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").saveAsTable(table)


def query_tokens(queries: DataFrame) -> DataFrame:
    """Tokens of each query and how often it repeats them."""
    rows = queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))


def keyword_hits(queries: DataFrame, chunks: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """Summed term frequency of the query tokens in each chunk.

    Without stored postings the chunks' tokens meet the query vocabulary before
    any shuffle, which drops most of them, and are then counted per query and
    chunk; all tokens of a chunk sit in one task, so this combines map-side.
    """
    wanted = broadcast_if_small(query_tokens(queries))
    if stored is None:
        rows = chunks.select("chunk_id", F.explode(X.tokens(F.col("text"))).alias("token"), F.lit(1).alias("tf"))
    else:
        rows = stored
    matched = rows.join(wanted, "token")
    return matched.groupBy("query_id", "chunk_id").agg(F.sum(F.col("tf") * F.col("times")).alias("hits"))


def keyword_scores(hits: DataFrame) -> DataFrame:
    """Hits as a share of the query's largest; one number per query is joined back."""
    top = hits.groupBy("query_id").agg(F.max("hits").alias("most"))
    return hits.join(top, "query_id").withColumn("keyword_score", F.col("hits") / F.col("most")).drop("most")


# --- fusion -------------------------------------------------------------


def fuse(
    semantic: DataFrame,
    hits: DataFrame,
    *,
    k: int = 10,
    semantic_weight: float = V.SEMANTIC_WEIGHT,
    keyword_weight: float = V.KEYWORD_WEIGHT,
) -> DataFrame:
    """Semantic candidates re-scored with their keyword scores.

    A candidate with no semantic but some keyword score gets a reciprocal rank,
    where the rank counts the chunks of the query with a higher keyword score.

    The candidates, a few rows per query, are stored and sent to the hits, so
    that the hits are read once: they are counted per query and score, and a
    candidate rides along with the count of its score.
    """
    found = cut_lineage(semantic.select("query_id", "chunk_id", "score").dropDuplicates(["query_id", "chunk_id"]))
    marked = hits.join(broadcast_if_small(found.withColumn("_mine", F.col("chunk_id"))), ["query_id", "chunk_id"], "left")
    per_score = marked.groupBy("query_id", "hits").agg(F.count(F.lit(1)).alias("_chunks"), F.collect_list("_mine").alias("_mine"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("hits"))
    above = by_score.rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_score.select(
        "query_id",
        "_mine",
        "hits",
        (F.coalesce(F.sum("_chunks").over(above), F.lit(0)) + 1).alias("keyword_rank"),
        F.max("hits").over(by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("most"),
    )
    scored = ranks.select("query_id", F.explode("_mine").alias("chunk_id"), "hits", "keyword_rank", "most")
    rows = found.join(scored, ["query_id", "chunk_id"], "left")
    return _combined(rows, semantic_weight, keyword_weight, k)


def _combined(rows: DataFrame, semantic_weight: float, keyword_weight: float, k: int) -> DataFrame:
    """Ranked candidates from score, hits, keyword_rank and most."""
    keyword = F.coalesce(F.col("hits") / F.col("most"), F.lit(0.0))
    lone = (keyword > 0) & (F.col("score") == 0)
    score = F.when(lone, 1.0 / (F.col("keyword_rank") + V.RECIPROCAL_RANK_OFFSET)).otherwise(F.col("score"))
    combined = score * semantic_weight + keyword * keyword_weight
    rows = rows.select(
        "query_id", "chunk_id", score.alias("semantic_score"), keyword.alias("keyword_score"), combined.alias("combined_score")
    )
    return ranked(rows, F.round("combined_score", 12), k=k)


def fuse_indexed(
    semantic: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int = 10,
    semantic_weight: float = V.SEMANTIC_WEIGHT,
    keyword_weight: float = V.KEYWORD_WEIGHT,
    lone: bool = True,
) -> DataFrame:
    """``fuse`` without the hits of all chunks.

    The most hits of a query are those of its best chunk in the index, those of a
    candidate are read from its own text, and the chunks above a lone candidate are
    counted in the parts of the index. ``lone`` false leaves the latter out, where
    no candidate can have a semantic score of 0.
    """
    found = cut_lineage(semantic.select("query_id", "chunk_id", "score").dropDuplicates(["query_id", "chunk_id"]))
    most = keyword_topk(queries, chunks, k=1).select("query_id", F.col("hits").alias("most"))
    rows = found.join(pair_hits(found, queries, chunks), ["query_id", "chunk_id"], "left").join(most, "query_id", "left")
    rank = F.lit(None).cast("long")
    if lone:
        rows = cut_lineage(rows)
        asked = rows.filter((F.col("score") == 0) & F.col("hits").isNotNull()).select("query_id", F.col("hits").alias("least")).distinct()
        above = chunks_above(asked.join(queries.select("query_id", "text"), "query_id"), chunks)
        rows = rows.join(above.withColumnRenamed("least", "hits"), ["query_id", "hits"], "left")
        rank = F.coalesce("n", F.lit(0)) + 1
    return _combined(rows.withColumn("keyword_rank", rank), semantic_weight, keyword_weight, k)


def fuse_by_rank(semantic: DataFrame, words: DataFrame, *, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of the semantic and the keyword top lists (query_id, chunk_id, rank)."""
    both = semantic.select("query_id", "chunk_id", "rank").unionByName(words.select("query_id", "chunk_id", "rank"))
    share = F.sum(1.0 / (F.col("rank") + V.RECIPROCAL_RANK_OFFSET))
    return ranked(both.groupBy("query_id", "chunk_id").agg(share.alias("combined_score")), F.round("combined_score", 12), k=k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, *, k: int = 10, threshold: float = V.SCORE_THRESHOLD) -> DataFrame:
    """Vector candidates fused with keyword scores (query_id, text, embedding)."""
    semantic = vector_topk(queries, chunks, k=2 * k, threshold=threshold)
    return fuse_indexed(semantic, queries, chunks, k=k, lone=threshold <= 0)


# --- result lists -------------------------------------------------------


def ranked(rows: DataFrame, score: Column, *, k: int | None = None, tie: str = "chunk_id") -> DataFrame:
    """Rank 1..n per query by score, cut at ``k``."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), tie)
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def second_stage(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Column | None, *, k: int = 10) -> DataFrame:
    """Re-score first stage candidates with ``scorer`` and keep the best ``k``.

    ``scorer`` is any expression over query_text and chunk_text, such as a
    pandas UDF around a model. Texts are only fetched for the candidates.
    Without one the first stage order stays.
    """
    if scorer is None:
        return candidates.filter(F.col("rank") <= k)
    asked = broadcast_if_small(queries.select("query_id", F.col("text").alias("query_text")))
    texts = chunks.select("chunk_id", F.col("text").alias("chunk_text"))
    rows = candidates.drop("rank").join(asked, "query_id").join(texts, "chunk_id")
    return ranked(rows.withColumn("rerank_score", scorer).drop("query_text", "chunk_text"), F.col("rerank_score"), k=k)


def result_scores(rows: DataFrame) -> DataFrame:
    """One ``score`` per result: the second stage's, else the combined one, else 0."""
    present = [F.col(c) for c in ("rerank_score", "combined_score") if c in rows.columns]
    return rows.withColumn("score", F.coalesce(*present, F.lit(0.0)))


def merge_results(base: DataFrame, extra: DataFrame, *, k: int = 10) -> DataFrame:
    """Ordered union of two result lists without repeats.

    Results count as equal when document, section, page and the first
    characters of the text agree; the list is cut at max(k, 12).
    """
    both = base.withColumn("_list", F.lit(0)).unionByName(extra.withColumn("_list", F.lit(1)), allowMissingColumns=True)
    key = [
        F.coalesce("document_name", F.lit("")), F.coalesce("section_title", F.lit("")),
        F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.substring("text", 1, V.MERGE_KEY_CHARS),
    ]
    first = Window.partitionBy("query_id", *key).orderBy("_list", "rank")
    # both windows run on one shuffle
    kept = both.repartition("query_id").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    order = Window.partitionBy("query_id").orderBy("_list", "rank")
    out = kept.withColumn("merged_rank", F.row_number().over(order)).filter(F.col("merged_rank") <= max(k, V.EQUATION_TOP_K))
    return out.drop("_list")


def distinct_sources(results: DataFrame) -> DataFrame:
    """First result of each document and section of a query, with its relevance."""
    first = Window.partitionBy("query_id", "document_name", "section_title").orderBy("rank")
    rows = results.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    return rows.withColumn("relevance_score", F.round("score", 3))


# --- routing ------------------------------------------------------------


def route_queries(queries: DataFrame, column: str = "text") -> DataFrame:
    text = F.col(column)
    return queries.withColumns(
        {
            "query_type": routing.query_type(text),
            "strategy": routing.strategy(routing.query_type(text)),
            "target_elements": routing.target_elements(text),
            "target_actions": routing.target_actions(text),
        }
    )


def expand_queries(queries: DataFrame, column: str = "text") -> DataFrame:
    """One row per query variant; variant 0 is the query itself."""
    others = [c for c in queries.columns if c != column]
    return queries.select(*others, F.posexplode(routing.expansions(F.col(column))).alias("variant", column))


def clause_prefixes(clause: Column) -> Column:
    """A dotted clause number and all its parents, shortest first."""
    parts = F.split(clause, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def hierarchical_search(queries: DataFrame, chunks: DataFrame, *, k: int = 5, sections: int = 3, apply_prefix: bool = False) -> DataFrame:
    """Rules of the sections nearest to each query, with a semantic fallback.

    First the ``sections`` best section overviews, then the best rules for the
    queries that found a section; the others, and those without a rule, fall
    back to all chunks. ``apply_prefix`` keeps the rules below the clauses of
    the sections found. The result of each stage, a few rows per query, is
    stored, as the next stage's queries depend on it.
    """
    overviews = chunks.filter((F.col("target_index") == "section") & (F.col("content_type") == "section_overview"))
    near = vector_topk(queries, overviews, k=sections).join(overviews.select("chunk_id", "clause_id"), "chunk_id")
    near = cut_lineage(near)
    named = near.filter(F.coalesce("clause_id", F.lit("")) != "")
    clauses = named.select("query_id", F.explode(clause_prefixes(F.col("clause_id"))).alias("clause")).distinct() if apply_prefix else None
    rules = chunks.filter(F.col("target_index") == "rule")
    guided = queries.join(named.select("query_id").distinct(), "query_id", "left_semi")
    best = vector_topk(guided, rules, k=k, within=clauses)
    best = cut_lineage(best.withColumn("stage", F.lit("rule")))
    rest = queries.join(best.select("query_id").distinct(), "query_id", "left_anti")
    return best.unionByName(vector_topk(rest, chunks, k=k).withColumn("stage", F.lit("semantic")))


def retrieve(queries: DataFrame, chunks: DataFrame, *, k: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """Results of each query (query_id, text, embedding) by the way its route asks for.

    Design questions search sections first, data questions tables, all others
    everything. With ``edges`` (src, dst) the results of design questions are
    followed by the chunks they refer to; ``rank`` counts both.
    """
    routed = stored(route_queries(queries).select("query_id", "query_type", "embedding"))
    of = lambda *kinds: routed.filter(F.col("query_type").isin(*kinds)).select("query_id", "embedding")
    design = hierarchical_search(of("comprehensive_design"), chunks, k=k).select("query_id", "chunk_id", "rank")
    tables = vector_topk(of("data_lookup"), chunks.filter(F.col("content_type") == "table"), k=k)
    other = vector_topk(of("definition", "general"), chunks, k=k)
    kind = chunks.schema["chunk_id"].dataType
    plain = lambda rows: rows.select(
        "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit("primary").alias("role"), F.lit(None).cast(kind).alias("referenced_from"),
        F.lit(1.0).alias("relevance_score"),
    )
    if edges is None:
        first = plain(design)
    else:
        first = graph.expand(design, edges, chunks.select("chunk_id")).select(
            "query_id", F.col("chunk_id").cast(kind).alias("chunk_id"), (F.col("position") + 1).alias("rank"), "role",
            F.col("referenced_from").cast(kind).alias("referenced_from"), F.col("relevance_score").cast("double").alias("relevance_score"),
        )
    found = first.unionByName(plain(tables)).unionByName(plain(other))
    return found.join(routed.select("query_id", "query_type"), "query_id")


def retrieve_equations(queries: DataFrame, chunks: DataFrame, *, k: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """``retrieve`` followed by a second retrieval for formulas, merged without repeats.

    ``queries`` also has equation_embedding, the vector of the text that
    ``routing.equation_query`` makes. The second retrieval takes its own route, at
    least 12 results and no references. ``chunks`` has the columns of the merge key.
    """
    wide = max(k, V.EQUATION_TOP_K)
    again = queries.select("query_id", routing.equation_query(F.col("text")).alias("text"), F.col("equation_embedding").alias("embedding"))
    key = broadcast_if_small(chunks.select("chunk_id", "document_name", "section_title", "page_number", "text"))
    base = retrieve(queries, chunks, k=k, edges=edges).join(key, "chunk_id")
    extra = retrieve(again, chunks, k=wide).join(key, "chunk_id")
    return merge_results(base, extra, k=wide)
