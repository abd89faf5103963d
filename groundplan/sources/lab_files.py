"""Directories of laboratory and borehole files.

CSV columns are taken by the names in a file's first line. A file that cannot be
read as what it claims to be is listed with its error and gives no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan import schemas
from groundplan.functions.words import places
from groundplan.operators.labdata import borehole_logs, lab_results
from groundplan.operators.sizes import broadcast_if_small
from groundplan.session import stored

_CORRUPT = "_corrupt_record"
# the columns that must hold numbers
_LAB_NUMBERS = ["Depth_m", "Value"]
_HOLE_NUMBERS = ["Depth_From", "Depth_To", "SPT_N"]


def _csv_lines(spark: SparkSession, paths: str | list[str], only: DataFrame | None = None) -> DataFrame:
    """Values of the lines of CSV files, of those in ``only`` (file), in their order, with the places that their file's first line gives the names.

    What is known of a file, one row, goes to its lines, so that these are not shuffled.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,CSV}")
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("ord"), "value"
    )
    # the first line of a file is the first of the split that begins it: one row a file
    first = lines.filter(F.col("_at") == 0).groupBy("file").agg(F.min(F.struct("ord", "value")).alias("_first"))
    names = F.transform(F.split(F.regexp_replace("_first.value", "^﻿", ""), ","), lambda n: F.btrim(n, F.lit(" \"\r")))
    heads = first.select(F.col("file").alias("_file"), F.col("_first.ord").alias("_head"), places(names).alias("places"))
    heads = broadcast_if_small(stored(heads))
    if only is not None:
        lines = lines.join(only, "file", "left_semi")
    # split ahead of the join, which would repeat it in its condition
    rows = lines.filter(F.btrim("value") != "").select("file", "ord", _values(F.col("value")).alias("values"))
    return rows.join(heads, (F.col("file") == F.col("_file")) & (F.col("ord") != F.col("_head"))).drop("_file", "_head")


def _values(line: Column) -> Column:
    trimmed = lambda v: F.btrim(v, F.lit(" \r"))
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), F.lit(1))
    quoted = F.transform(raw, lambda v: F.when(v.startswith('"'), F.replace(F.substring(v, 2, F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(trimmed(v)))
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ","), trimmed))


def _value(name: str) -> Column:
    """The value of a line by column name; null for an empty one and one beyond the line."""
    return F.nullif(F.get("values", F.col("places")[name] - 1), F.lit(""))


def _bad_number(names: list[str]) -> Column:
    """Message for the first of the named columns whose value is no number; null if all are."""
    wrong = lambda n: _value(n).isNotNull() & _value(n).try_cast("double").isNull()
    return F.coalesce(*[F.when(wrong(n), F.concat(F.lit(f"{n} is not a number: "), _value(n))) for n in names])


def file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with its kind: lab_data, borehole_csv, borehole_json, or none.

    The kind of a CSV file shows in its first line alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"))
    ending = F.lower(F.substring_index("path", ".", -1))
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,CSV}").text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("ord"), "value")
    )
    head = lines.filter(F.col("at") == 0).groupBy("path").agg(F.min(F.struct("ord", "value"))["value"].alias("head"))
    named = files.join(head, "path", "left")
    has = lambda name: F.coalesce(F.col("head").contains(name), F.lit(False))
    kind = (
        F.when((ending == "csv") & (has("Sample_ID") | has("Test_Type")), "lab_data")
        .when((ending == "csv") & (has("Type") | has("Depth_From")), "borehole_csv")
        .when(ending == "json", "borehole_json")
    )
    return named.select("path", kind.alias("kind"), F.when(kind.isNull(), F.concat(F.lit("Unsupported file format: ."), ending)).alias("error"))


def _lab_rows(fields: DataFrame) -> DataFrame:
    return fields.select(
        "file", "ord", _value("Sample_ID").alias("sample_id"), _value("Depth_m").try_cast("double").alias("depth_m"), _value("Test_Type").alias("test_type"),
        _value("Parameter_Name").alias("parameter_name"), _value("Value").try_cast("double").alias("value"), _value("Unit").alias("unit"),
    )


def _hole_rows(fields: DataFrame) -> DataFrame:
    numbers = [_value(n).try_cast("double").alias(n.lower()) for n in _HOLE_NUMBERS]
    return fields.select("file", F.col("ord").alias("line_no"), _value("Type").alias("type"), *numbers, _value("Description").alias("description"), _value("Key").alias("key"), _value("Value").alias("value"))


def read_lab_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of lab CSV files with their file and their order in it; what is no number is null."""
    return _lab_rows(_csv_lines(spark, paths))


def _results(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_sample", F.struct("file", "sample_id"))
    return lab_results(keyed, sample="_sample").select("_sample.file", "_sample.sample_id", "test_type", "depth_m", "parameters")


def read_lab_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _results(read_lab_rows(spark, paths))


def read_borehole_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return borehole_logs(_hole_rows(_csv_lines(spark, paths)))


def _json_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    reader = spark.read.schema(f"{schemas.BOREHOLE_JSON}, {_CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", _CORRUPT)
    rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,JSON}").json(paths)
    empty = f"cast(array() as {schemas.BOREHOLE_LAYERS})"
    # Spark does not answer from the corrupt column alone, so another takes part in a test that always holds
    broken = F.col(_CORRUPT).isNotNull() & F.coalesce(F.col("borehole_id") != "\0", F.lit(True))
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.coalesce("borehole_id", F.lit("Unknown")).alias("borehole_id"),
        F.coalesce("location", F.expr("cast(map() as map<string, double>)")).alias("location"),
        F.coalesce("ground_level_m", F.lit(0.0)).alias("ground_level_m"), "water_level_m", F.coalesce("layers", F.expr(empty)).alias("layers"), broken.alias("broken"),
    )


def read_borehole_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Borehole logs from JSON files, absent fields filled in; broken files are left out."""
    return _json_files(spark, paths).filter("NOT broken").drop("broken")


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(bad.select("file")), "file", "left_anti")


def read_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lab results, borehole logs and a table of files that could not be used.

    Files are routed by a join on their path, not by listing them one by one. A
    CSV file with a value that is no number where one belongs, or a JSON file
    that cannot be parsed, goes to the table of errors as a whole.
    """
    kinds = stored(file_kinds(spark, folder))
    of = lambda kind: broadcast_if_small(kinds.filter(F.col("kind") == kind).select(F.col("path").alias("file")))
    wrong = lambda rows, names: stored(rows.select("file", "ord", _bad_number(names).alias("error")).filter("error is not null").groupBy("file").agg(F.min_by("error", "ord").alias("error")))

    lab = _csv_lines(spark, folder, of("lab_data"))
    bad_lab = wrong(lab, _LAB_NUMBERS)
    hole = _csv_lines(spark, folder, of("borehole_csv"))
    bad_hole = wrong(hole.filter(_value("Type") == "layer"), _HOLE_NUMBERS)
    json = _json_files(spark, folder)
    bad_json = json.filter("broken").select("file", F.lit("Broken JSON").alias("error")).distinct()

    logs = borehole_logs(_hole_rows(_without(hole, bad_hole))).unionByName(_without(json, bad_json).drop("location", "broken"))
    errors = kinds.filter(F.col("kind").isNull()).select(F.col("path").alias("file"), "error")
    return _results(_lab_rows(_without(lab, bad_lab))), logs, errors.unionByName(bad_lab).unionByName(bad_hole).unionByName(bad_json)
