"""Citation checks of answers against the chunks they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions import citations as C


def extract_citations(answers: DataFrame) -> DataFrame:
    """One row per citation of an answer (answer_id, answer)."""
    rows = answers.select("answer_id", F.posexplode(C.extract(F.col("answer"))).alias("citation_no", "c"))
    return rows.select("answer_id", "citation_no", "c.form", "c.document", "c.clause_id", "c.page", "c.raw")


def check_citations(citations: DataFrame, context: DataFrame) -> DataFrame:
    """Best match of each citation among the chunks given to its answer.

    ``context`` has answer_id, chunk_id, document_name, clause_id and
    section_title. A pair meets on answer_id, and an answer has few of both.
    """
    section = F.col("section") if "section" in citations.columns else F.lit(None).cast("string")
    asked = citations.select("answer_id", "citation_no", "document", "clause_id", section.alias("section"), "raw").withColumn(
        "_clause", C.normal_clause(F.col("clause_id"))
    )
    given = context.select(
        "answer_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_name").alias("_document"),
        C.normal_clause(F.col("clause_id")).alias("_chunk_clause"), F.col("section_title").alias("_section"),
    )
    document = C.documents_match(F.col("document"), F.col("_document"))
    clause = C.clauses_match(F.col("_clause"), F.col("_chunk_clause"))
    in_section = C.sections_match(F.col("section"), F.col("_section"))
    pairs = asked.join(given, "answer_id", "left").withColumn("_confidence", C.confidence(document, clause, in_section))
    matched = F.when(F.col("_confidence") >= V.CONFIDENCE_DOCUMENT, F.col("chunk_id"))
    best = pairs.groupBy("answer_id", "citation_no", "document", "clause_id", "raw").agg(
        F.coalesce(F.max("_confidence"), F.lit(0.0)).alias("confidence"), F.array_sort(F.collect_list(matched)).alias("matched_chunk_ids")
    )
    value = F.col("confidence")
    return best.withColumns({"verified": value >= V.VERIFIED_FROM, "notes": C.note(value)})


def citation_report(answers: DataFrame, checks: DataFrame, *, strict: bool = True) -> DataFrame:
    """Counts and mean confidence per answer; 1.0 for an answer without citations."""
    value, verified = F.col("confidence"), F.col("verified")
    count = lambda test: F.count(F.when(test, 1))
    warning = F.concat(
        F.lit("Unverified citation: "), "raw", F.lit(" (document: "), "document", F.lit(", clause: "), "clause_id", F.lit(")")
    )
    warned = F.when(~verified, F.struct("citation_no", warning.alias("text"))) if strict else F.lit(None)
    sums = checks.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("total_citations"),
        count(verified).alias("verified_count"),
        count(~verified & (value > V.HALLUCINATED_TO)).alias("unverified_count"),
        count(value <= V.HALLUCINATED_TO).alias("hallucinated_count"),
        F.avg(value).alias("overall_confidence"),
        F.array_sort(F.collect_list(warned)).alias("_warned") if strict else F.array().alias("_warned"),
    )
    rows = answers.select("answer_id").join(sums, "answer_id", "left")
    warnings = F.transform("_warned", lambda w: w["text"]) if strict else F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("warnings", F.coalesce(warnings, F.expr("cast(array() as array<string>)"))).drop("_warned")
    return rows.fillna(0, ["total_citations", "verified_count", "unverified_count", "hallucinated_count"]).fillna(1.0, ["overall_confidence"])
