"""Context texts from result lists. A query's results are few, so each fits one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan import fixed_values as V


def _joined(rows: Column, part: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[part]), separator)


def assemble(results: DataFrame) -> DataFrame:
    """Context of each query, results grouped by clause in text order of clauses.

    Reads query_id, query, position, role, clause_id, clause_title,
    page_number and text.
    """
    tag = F.when(F.col("role") == "primary", "[PRIMARY]").otherwise("[REFERENCED]")
    block = F.concat(tag, F.lit(":\n"), F.col("text"), F.lit("\n\n")).alias("block")
    groups = results.groupBy("query_id", "query", "clause_id").agg(
        F.min_by(F.struct("clause_title", "page_number"), "position").alias("head"),
        _joined(F.struct("position", block), "block", "").alias("blocks"),
    )
    head = F.concat(
        F.lit("### ["), F.col("clause_id"), F.lit("] "), F.col("head.clause_title"), F.lit(" (Page "),
        F.col("head.page_number").cast("string"), F.lit(")\n"),
    )
    parts = groups.select("query_id", "query", "clause_id", F.concat(head, "blocks").alias("part"))
    texts = parts.groupBy("query_id", "query").agg(_joined(F.struct("clause_id", "part"), "part", "").alias("body"))
    context = F.concat(
        F.lit("Query: "), "query", F.lit("\n\n## Retrieved Engineering Knowledge\n\n"), "body", F.lit(V.CITATION_RULES)
    )
    return texts.select("query_id", context.alias("context"))


def source_blocks(results: DataFrame) -> DataFrame:
    """Results of each query as headed source blocks, in rank order."""
    shown = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    block = F.concat(
        F.lit("[Source: "), shown("document_name", "Unknown"), F.lit(" | Section: "), shown("section_title", "N/A"),
        F.lit(" | Page: "), shown("page_number", "N/A"), F.lit("]\n"), F.col("text"),
    ).alias("block")
    return results.groupBy("query_id").agg(_joined(F.struct("rank", block), "block", "\n\n---\n\n").alias("context"))
