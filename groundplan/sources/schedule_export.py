"""Schedule export files: tab separated sections of tasks, relations, resources."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundplan.functions.words import places, strip
from groundplan.operators.running import carry_forward
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import stored

# fixed values: section names of an export and the tables they fill
SECTIONS = {"TASK": "tasks", "TASKPRED": "relationships", "TASKRSRC": "resources"}
_LINES_PER_PART = 65_536
# marks in a file up to which its lines look for theirs among them
_MARKS_PER_FILE = 512


def parse_date(text: Column) -> Column:
    """A date with or without a time; null when it is neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with their file, project and position.

    The project is the file's name, with the folders below ``path`` that it is in. Line numbers follow the byte order of a file: the position is the start of
    the split a line came from, then its order inside the split.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    root = re.sub(r"^[a-z]+:/*|^/*|/+$", "", path)
    # file:///a/b and /a/b name the same folder; a path to one file leaves its name
    below = F.regexp_replace(file, "^.*?/" + re.escape(root) + "/", "") if "*" not in root else F.substring_index(file, "/", -1)
    name = F.when(below == file, F.substring_index(file, "/", -1)).otherwise(below)
    return lines.select(
        F.regexp_replace(F.url_decode(F.regexp_replace(name, r"\+", "%2B")), r"\.[^.]*$", "").alias("project_id"), file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        strip(F.col("value")).alias("line"),
    )


def section_rows(lines: DataFrame, *, legacy: bool = False) -> DataFrame:
    """Data lines with the section and the field names that apply to them.

    ``%T`` opens a section, ``%F`` names its fields, ``%R`` is a row. In
    ``legacy`` files the field names follow the section name on its own line,
    rows have no mark, the project section holds the tasks, and any other line
    with a percent sign, or an empty one, ends the section.
    """
    mark = F.substring("line", 1, 2)
    parts = F.split("line", "\t")
    if legacy:
        name = (
            F.when(F.col("line").contains("PROJECT"), "TASK").when(F.col("line").contains("TASKPRED"), "TASKPRED")
            .when(F.col("line").contains("RES"), "TASKRSRC")
        )
        ends = (F.col("line") == "") | F.col("line").startswith("%")
        opened = F.when(mark == "%T", F.struct(name.alias("section"), F.slice(parts, 2, F.size(parts)).alias("fields"))).when(
            ends, F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("array<string>").alias("fields"))
        )
        values = {"state": opened}
    else:
        values = {
            "section": F.when(mark == "%T", F.struct(parts[1].alias("name"))),
            "fields": F.when(mark == "%T", F.struct(F.lit(None).cast("array<string>").alias("names"))).when(
                mark == "%F", F.struct(F.slice(parts, 2, F.size(parts)).alias("names"))
            ),
        }
    part = F.struct("block", F.floor(F.col("at") / _LINES_PER_PART).alias("part"))
    carried = lambda rows: carry_forward(rows, ["project_id", "file"], part, F.struct("block", "at"), values)
    marks = stored(lines.filter(reduce(lambda a, b: a | b, [v.isNotNull() for v in values.values()])))
    is_data = (F.col("line") != "") & ~F.col("line").startswith("%") if legacy else mark == "%R"
    own = parts if legacy else F.slice(parts, 2, F.size(parts))
    section, fields = ("state.section", "state.fields") if legacy else ("section.name", "fields.names")
    named = lambda rows: rows.withColumns({"section": F.col(section), "fields": F.col(fields)})
    of_file = marks.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if of_file <= _MARKS_PER_FILE:
        # the marks are few next to the lines: each line finds the last one ahead of it, and no line is shuffled
        after = Window.partitionBy("file").orderBy("block", "at")
        spans = named(carried(marks)).select(
            "project_id", F.col("file").alias("_file"), "section", "fields", places(F.col("fields")).alias("places"), F.col("block").alias("_block"), F.col("at").alias("_at"),
            F.lead("block").over(after).alias("_to_block"), F.lead("at").over(after).alias("_to_at"),
        )
        begun = (F.col("block") > F.col("_block")) | ((F.col("block") == F.col("_block")) & (F.col("at") > F.col("_at")))
        open_ = F.col("_to_at").isNull() | (F.col("block") < F.col("_to_block")) | ((F.col("block") == F.col("_to_block")) & (F.col("at") < F.col("_to_at")))
        spans = broadcast_if_small(stored(spans))
        # split ahead of the join, which would repeat it in its condition
        rows = lines.filter(is_data).select("file", "block", "at", own.alias("values")).join(spans, (F.col("file") == F.col("_file")) & begun & open_)
    else:
        rows = named(carried(lines)).filter(is_data).withColumns({"places": places(F.col("fields")), "values": own})
    return rows.select("project_id", "section", "fields", "places", "values")


def _records(rows: DataFrame, section: str) -> DataFrame:
    """Rows of a section with the places of their fields; rows with too few values are left out."""
    return rows.filter((F.col("section") == section) & (F.size("values") >= F.size("fields"))).select("project_id", "values", "places")


def _value(name: str) -> Column:
    return F.get("values", F.col("places")[name] - 1)


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(_value(name), F.lit(default))


def _number(name: str, kind: str = "double", default: float = 0) -> Column:
    """A number; ``default`` when absent or empty, null when it is no number."""
    value = F.coalesce(F.nullif(_value(name), F.lit("")), F.lit(str(default)))
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("int")) if kind == "int" else value.try_cast("double")


def _complete(df: DataFrame, *needed: str) -> DataFrame:
    """Drop the rows with a value that could not be read."""
    return df.dropna(subset=list(needed))


def tasks_of(rows: DataFrame) -> DataFrame:
    table = _records(rows, "TASK").select(
        "project_id", _text("task_id").alias("task_id"), _text("task_name").alias("task_name"), _text("wbs_id").alias("wbs"),
        parse_date(_value("task_start_date")).alias("start_date"), parse_date(_value("task_finish_date")).alias("end_date"),
        _number("task_duration", "int").alias("original_duration"), _number("task_remaining_drtn", "int").cast("double").alias("remaining_duration"),
        _number("task_pct_complete").alias("percent_complete"), _number("task_cost").alias("budget_cost"),
        _number("task_actual_cost").alias("actual_cost"), _number("task_total_float").alias("total_float"),
        (_text("task_critical", "N") == "Y").alias("critical"), F.lit(None).cast("string").alias("resource_crew"),
        _text("task_status", "NOT STARTED").alias("status"),
    )
    return _complete(table, "original_duration", "remaining_duration", "percent_complete", "budget_cost", "actual_cost", "total_float")


def relationships_of(rows: DataFrame) -> DataFrame:
    table = _records(rows, "TASKPRED").select(
        "project_id", _text("pred_task_id").alias("pred_task_id"), _text("succ_task_id").alias("succ_task_id"),
        _text("pred_task_type", "FS").alias("relationship_type"), F.floor(_number("lag_hr_cnt", "int") / 24).cast("int").alias("lag_days"),
    )
    return _complete(table, "lag_days")


def resources_of(rows: DataFrame) -> DataFrame:
    table = _records(rows, "TASKRSRC").select(
        "project_id", _text("task_id").alias("task_id"), _text("resource_id").alias("resource_id"), _text("resource_name").alias("resource_name"),
        _number("resource_units", default=1).alias("units"), _number("resource_cost_per_unit").alias("cost_per_unit"),
    )
    return _complete(table, "units", "cost_per_unit")


def read_schedules(spark: SparkSession, path: str, *, legacy: bool = False) -> dict[str, DataFrame]:
    """Tasks, relationships and resources of all export files below ``path``."""
    rows = section_rows(read_lines(spark, path), legacy=legacy)
    return {"tasks": tasks_of(rows), "relationships": relationships_of(rows), "resources": resources_of(rows)}
