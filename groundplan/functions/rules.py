"""Report rules: each rule is a function from the text column to passed and details."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.words import let, strip

_ANY_CASE = "(?iu)"
_RESULT = "struct<passed: boolean, details: string>"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    severity: str
    check: Callable[[Column], Column]
    reference: str = ""


def result(passed: Column | bool, details: Column | str) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(passed).alias("passed"), as_column(details).alias("details")).cast(_RESULT)


def found_numbers(text: Column, patterns: list[str]) -> Column:
    """Numbers that the patterns capture, pattern by pattern; other captures are dropped."""
    captured = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(_ANY_CASE + p), F.lit(1)) for p in patterns]))
    return F.filter(F.transform(captured, lambda v: v.try_cast("double")), lambda v: v.isNotNull())


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(_ANY_CASE + p) for p in patterns])


def first_capture(text: Column, patterns: list[str]) -> Column:
    """Capture of the first pattern that matches; null without one."""
    return F.coalesce(
        *[F.when(text.rlike(_ANY_CASE + p), F.regexp_extract(text, _ANY_CASE + p, 1)) for p in patterns]
    )


def minimum_check(rule: dict) -> Callable[[Column], Column]:
    """The smallest value found must reach the minimum; none found fails."""

    def check(text: Column) -> Column:
        def judge(least: Column) -> Column:
            enough = least >= rule["minimum"]
            sign = F.when(enough, F.lit(f" >= {rule['minimum']} (OK)")).otherwise(f" < {rule['minimum']} (FAIL)")
            details = F.concat(F.lit(f"{rule['label']} = "), F.format_string("%.2f", least), sign)
            return F.when(least.isNull(), result(False, rule["missing"])).otherwise(result(enough, details))

        return let(F.array_min(found_numbers(text, rule["patterns"])), judge)

    return check


def presence_check(rule: dict) -> Callable[[Column], Column]:
    def check(text: Column) -> Column:
        return F.when(matches_any(text, rule["patterns"]), result(True, rule["found"])).otherwise(result(False, rule["missing"]))

    return check


def range_check(rule: dict) -> Callable[[Column], Column]:
    """All values found must lie in the range; none found passes."""
    shown = lambda values: F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))

    def check(text: Column) -> Column:
        def judge(values: Column) -> Column:
            outside = F.filter(values, lambda v: (v < rule["low"]) | (v > rule["high"]))
            return (
                F.when(F.size(values) == 0, result(True, rule["none"]))
                .when(F.size(outside) > 0, result(False, F.concat(F.lit(rule["outside"]), shown(outside))))
                .otherwise(result(True, F.concat(F.lit(rule["inside"]), shown(values))))
            )

        return let(found_numbers(text, rule["patterns"]), judge)

    return check


def project_name_check(text: Column) -> Column:
    name = F.substring(strip(first_capture(text, V.PROJECT_NAME_PATTERNS)), 1, V.PROJECT_NAME_SHOWN_CHARS)
    found = result(True, F.concat(F.lit("Project name found: "), name))
    return F.when(name.isNotNull(), found).otherwise(result(False, "No project name found"))


def report_date_check(text: Column) -> Column:
    date = first_capture(text, V.REPORT_DATE_PATTERNS)
    return F.when(date.isNotNull(), result(True, F.concat(F.lit("Date found: "), date))).otherwise(result(False, "No report date found"))


def author_check(text: Column) -> Column:
    return F.when(matches_any(text, V.AUTHOR_PATTERNS), result(True, "Author/company information found")).otherwise(
        result(False, "No author or company information found")
    )


FOS_RULES = [Rule(r["rule_id"], r["name"], "parameter", "critical", minimum_check(r), r["reference"]) for r in V.FOS_RULES]
SECTION_RULES = [Rule(r["rule_id"], r["name"], "completeness", r["severity"], presence_check(r)) for r in V.SECTION_RULES]
RANGE_RULES = [Rule(r["rule_id"], r["name"], "parameter", "medium", range_check(r)) for r in V.RANGE_RULES]
INFO_RULES = [
    Rule("info_project_name", "Project Name", "completeness", "low", project_name_check),
    Rule("info_date", "Report Date", "completeness", "low", report_date_check),
    Rule("info_author", "Author/Company Information", "completeness", "low", author_check),
]
ALL_RULES = [*FOS_RULES, *SECTION_RULES, *RANGE_RULES, *INFO_RULES]


def python_rule(check: Callable[[str], tuple[bool, str]]) -> Callable[[Column], Column]:
    """A rule from a plain function of the text, run on Arrow batches.

    Where the function fails, ``passed`` is null and the details say why.
    """

    def outcome(text: str) -> tuple[bool | None, str]:
        try:
            return check(text)
        except Exception as error:  # a rule of the user's own must not stop the others
            return None, f"{V.RULE_ERROR}{error}"

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(t) for t in texts], columns=["passed", "details"]).astype({"passed": "boolean"})

    return lambda text: run(text)
