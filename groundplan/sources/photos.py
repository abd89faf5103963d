"""Site photo listings and their links to activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.words import contains_any


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the image files below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return image_files(files)


def image_files(files: DataFrame) -> DataFrame:
    ending = F.lower(F.substring_index("path", ".", -1))
    return files.filter(F.col("path").contains(".") & ending.isin(*V.PHOTO_EXTENSIONS))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def link_photos(photos: DataFrame) -> DataFrame:
    """One row per photo and activity prefix whose words its name contains."""
    name = F.lower(file_name(F.col("path")))
    prefixes = F.array_compact(F.array(*[F.when(contains_any(name, words), p) for p, words in V.PHOTO_WORDS.items()]))
    keys = [c for c in photos.columns if c != "path"]
    return image_files(photos).select(*keys, "path", F.explode(prefixes).alias("prefix"))


def photo_counts(links: DataFrame, tasks: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Photos per prefix with the first task whose id starts with it.

    All prefixes have four characters, so the prefix match is an equality.
    """
    counts = links.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("photos"))
    first = (
        tasks.withColumn("prefix", F.substring("task_id", 1, 4))
        .filter(F.col("prefix").isin(*V.PHOTO_WORDS))
        .groupBy(*keys, "prefix")
        .agg(F.min_by(F.struct("task_name", "percent_complete"), F.struct("start_date", "task_id")).alias("first"))
    )
    return counts.join(first, [*keys, "prefix"], "left").select(
        *keys,
        "prefix",
        F.coalesce("first.task_name", F.lit("Unknown")).alias("task_name"),
        F.coalesce("first.percent_complete", F.lit(0.0)).alias("percent_complete"),
        "photos",
    )


def photo_report_lines(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Photo map of every project as ordered lines: a head, then per prefix a head line, its photos and an empty line.

    Joined by line ends in order of section, prefix, pos and photo they are the text.
    """
    projects = tasks.select("project_id").distinct()
    found = links.select("project_id").distinct()
    number = F.col("percent_complete").cast("double").cast("string")
    title = F.lit(f"PROGRESS PHOTO MAPPING REPORT\n{'=' * 60}\n")
    line = lambda rows, section, prefix, pos, photo, text: rows.select(
        "project_id", F.lit(section).alias("section"), prefix.alias("prefix"), F.lit(pos).alias("pos"), photo.alias("photo"), text.alias("line")
    )
    none, name, prefix = F.lit(""), file_name(F.col("path")), F.col("prefix")
    heads = photo_counts(links, tasks)
    headed = F.concat(
        F.lit("["), prefix, F.lit("xxx] "), F.col("task_name"), F.lit("\n   Progress: "), number, F.lit("%\n   Photos: "), F.col("photos").cast("string"),
    )
    return (
        line(found, 0, none, 0, none, title)
        .unionByName(line(projects.join(found, "project_id", "left_anti"), 0, none, 0, none, F.lit(V.NO_PHOTO)))
        .unionByName(line(heads, 1, prefix, 0, none, headed))
        .unionByName(line(links, 1, prefix, 1, name, F.concat(F.lit("      - "), name)))
        .unionByName(line(heads, 1, prefix, 2, none, none))
    )


def task_prefix(task_id: Column) -> Column:
    """First four characters of a task id, two for shorter ids."""
    return F.when(F.length(task_id) >= 4, F.substring(task_id, 1, 4)).otherwise(F.substring(task_id, 1, 2))


def activity_photos(links: DataFrame, task_id: str) -> DataFrame:
    """Photos of one task."""
    return links.filter(F.col("prefix") == task_prefix(F.lit(task_id))).select("path", file_name(F.col("path")).alias("photo"))


def activity_photo_counts(tasks: DataFrame, links: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Number of photos of every task, from counts per prefix rather than pairs."""
    counts = links.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("photos"))
    rows = tasks.select(*keys, "task_id", task_prefix(F.col("task_id")).alias("prefix"))
    return rows.join(counts, [*keys, "prefix"], "left").select(
        *keys, "task_id", F.coalesce("photos", F.lit(0)).alias("photos")
    )
