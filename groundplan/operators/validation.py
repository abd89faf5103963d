"""Report validation: checks per report, verdicts, completeness, code support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions import rules as R
from groundplan.functions.words import let, strip
from groundplan.operators.vectors import vector_topk


def code_support_checks(methods: DataFrame, chunks: DataFrame, *, k: int = 3) -> DataFrame:
    """Pass for the design methods (method_id, embedding) that find a code chunk."""
    code = chunks.filter(F.col("document_type") == "code")
    found = vector_topk(methods.withColumnRenamed("method_id", "query_id"), code, k=k).select(F.col("query_id").alias("method_id")).distinct()
    rows = methods.drop("embedding").join(found.withColumn("_found", F.lit(True)), "method_id", "left")
    return rows.withColumn("status", F.when(F.col("_found"), "pass").otherwise("warning")).drop("_found")


def rule_checks(reports: DataFrame, rules: list[R.Rule] = R.ALL_RULES) -> DataFrame:
    """One row per report (report_id, report_text) and rule.

    All rules of a report are evaluated in its own row and then unpacked, so
    the reports are read once and nothing is shuffled.
    """
    entries = [
        F.struct(
            F.lit(i).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"),
            F.lit(r.severity).alias("severity"), F.lit(r.reference).alias("reference"), r.check(F.col("report_text")).alias("outcome"),
        )
        for i, r in enumerate(rules)
    ]
    rows = reports.select("report_id", F.explode(F.array(*entries)).alias("c")).select("report_id", "c.*")
    passed = F.col("outcome.passed")
    failed = passed.isNull() & F.col("outcome.details").startswith(V.RULE_ERROR)
    status = F.when(passed, "pass").when(failed, "not_checked").when(F.col("severity") == "critical", "fail").when(passed.isNull(), "not_checked").otherwise("warning")
    return rows.select(
        "report_id", "rule_no", "rule_id", "rule_name", "category", "severity", "reference", status.alias("status"),
        F.col("outcome.details").alias("details"),
    )


def readable(report_text: str = "report_text", *, line_ends: bool = False) -> Column:
    """Whether a report holds enough text; ``line_ends`` counts those at its ends, blanks never count there."""
    text = F.coalesce(report_text, F.lit(""))
    return F.length(F.trim(text) if line_ends else strip(text)) >= V.MIN_REPORT_CHARS


def report_checks(reports: DataFrame, rules: list[R.Rule] = R.ALL_RULES, *, line_ends: bool = False) -> DataFrame:
    """Check rows of all reports; an unreadable report gets one critical fail."""
    enough = readable(line_ends=line_ends)
    short = reports.filter(~enough).select(
        "report_id", F.lit(0).alias("rule_no"), F.lit("extraction").alias("category"), F.lit("Document readability").alias("item"),
        F.lit("fail").alias("status"), F.lit("Could not extract meaningful text from PDF.").alias("details"), F.lit("").alias("reference"),
        F.lit("critical").alias("severity"),
    )
    checked = rule_checks(reports.filter(enough), rules).select(
        "report_id", "rule_no", F.concat(F.lit("rule_"), "category").alias("category"), F.col("rule_name").alias("item"),
        F.when(F.col("status") == "not_checked", "warning").otherwise(F.col("status")).alias("status"), "details", "reference", "severity",
    )
    return checked.unionByName(short)


def validation_report(checks: DataFrame) -> DataFrame:
    """Counts and the overall verdict of each report."""
    count = lambda test: F.count(F.when(test, 1))
    status = F.col("status")
    sums = checks.groupBy("report_id").agg(
        count(status == "pass").alias("pass_count"), count(status == "fail").alias("fail_count"),
        count(status == "warning").alias("warning_count"), count((status == "fail") & (F.col("severity") == "critical")).alias("critical_fails"),
    )
    verdict = F.when(F.col("critical_fails") > 0, "rejected").when(F.col("fail_count") > 0, "revisions_needed").otherwise("acceptable")
    return sums.withColumn("overall_status", verdict)


def validation_text(checks: DataFrame) -> DataFrame:
    """Review report of each document: head, counts and one line per check."""
    line = F.concat(
        F.lit("| "), F.upper("status"), F.lit(" | "), "category", F.lit(" | "), "item", F.lit(" | "), "details", F.lit(" |")
    )
    lines = checks.groupBy("report_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("body")
    )
    rows = validation_report(checks).join(lines, "report_id")
    total = F.col("pass_count") + F.col("fail_count") + F.col("warning_count")
    text = F.concat_ws(
        "\n",
        F.lit("# SUBMISSION REVIEW REPORT\n"),
        F.concat(F.lit("**Document Reviewed:** "), F.col("report_id").cast("string")),
        F.concat(F.lit("**Overall Status:** "), F.replace(F.upper("overall_status"), F.lit("_"), F.lit(" "))),
        F.concat(
            F.lit("**Checks Performed:** "), total.cast("string"), F.lit(" (✓ "), F.col("pass_count").cast("string"), F.lit(" | ✗ "),
            F.col("fail_count").cast("string"), F.lit(" | ⚠ "), F.col("warning_count").cast("string"), F.lit(")"),
        ),
        F.lit("\n---\n\n## Detailed Findings\n\n| Status | Category | Item | Details |\n|--------|----------|------|---------|"),
        F.col("body"),
        F.lit("\n---\n\n## Recommended Actions\n\nAddress all FAIL items before acceptance."),
    )
    return rows.select("report_id", text.alias("text"))


def _names(title: str):
    return lambda heading: heading.contains(title.lower())


def section_completeness(reports: DataFrame, sections: list[tuple[str, str, bool]] = V.REPORT_SECTIONS) -> DataFrame:
    """Whether each expected section has a heading with its title, per report."""
    headings = F.transform(
        F.regexp_extract_all("report_text", F.lit(r"(?md)^#{1,4}[ \t]+(.+)$"), F.lit(1)), lambda h: F.lower(h)
    )

    def unpack(found: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(number).alias("number"), F.lit(title).alias("title"), F.lit(required).alias("required"),
                    F.exists(found, _names(title)).alias("present"),
                )
                for number, title, required in sections
            ]
        )

    return reports.select("report_id", F.explode(let(headings, unpack)).alias("s")).select("report_id", "s.*")


def completeness_counts(completeness: DataFrame) -> DataFrame:
    count = lambda test: F.count(F.when(test, 1))
    needed, present = F.col("required"), F.col("present")
    return completeness.groupBy("report_id").agg(
        count(needed).alias("required"), count(needed & present).alias("present"), count(needed & ~present).alias("absent")
    )
