"""Laboratory tests and borehole logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lab_results(rows: DataFrame, *, sample: str = "sample_id", order: str = "ord") -> DataFrame:
    """One row per sample: first test type and depth, last value per parameter.

    A sample holds few parameters, and the last value of each is found by a
    map-side maximum before they are put into one map.
    """
    by_parameter = rows.filter(F.col("value").isNotNull()).groupBy(sample, F.coalesce("parameter_name", F.lit("unknown")).alias("parameter_name"))
    last = by_parameter.agg(F.max(F.struct(order, "value"))["value"].alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("parameter_name", "value")))
    maps = last.groupBy(sample).agg(F.map_from_entries(entries).alias("parameters"))
    first = rows.groupBy(sample).agg(F.min(F.struct(order, "depth_m", "test_type")).alias("_first"))
    head = first.select(sample, F.coalesce("_first.test_type", F.lit("Unknown")).alias("test_type"), F.coalesce("_first.depth_m", F.lit(0.0)).alias("depth_m"))
    return head.join(maps, sample, "left").withColumn("parameters", F.coalesce("parameters", F.expr("cast(map() as map<string, double>)")))


def lab_pivot(rows: DataFrame, parameters: list[str], *, sample: str = "sample_id", order: str = "ord") -> DataFrame:
    """One column per named parameter with its last value, in one aggregation."""
    last = lambda p: F.max(F.when((F.col("parameter_name") == p) & F.col("value").isNotNull(), F.struct(order, "value")))["value"]
    return rows.groupBy(sample).agg(*[last(p).alias(p) for p in parameters])


def _number(text: Column) -> Column:
    return text.try_cast("double")


def borehole_logs(rows: DataFrame, *, file: str = "file", order: str = "line_no") -> DataFrame:
    """One log per file from its layer and metadata rows. A log has few rows."""
    is_layer, is_fact = F.col("type") == "layer", F.col("type") == "metadata"
    layer = F.struct(
        F.col(order).alias("line_no"),
        F.struct(
            F.coalesce("depth_from", F.lit(0.0)).alias("depth_from_m"), F.coalesce("depth_to", F.lit(0.0)).alias("depth_to_m"),
            F.coalesce("description", F.lit("")).alias("description"), F.col("spt_n").alias("spt_n"),
        ).alias("layer"),
    )
    fact = lambda name: F.max_by(F.when(is_fact & (F.col("key") == name), F.col("value")), F.when(is_fact & (F.col("key") == name), F.col(order)))
    logs = rows.groupBy(file).agg(
        fact("borehole_id").alias("borehole_id"), fact("ground_level_m").alias("ground_level_m"), fact("water_level_m").alias("water_level_m"),
        F.array_sort(F.collect_list(F.when(is_layer, layer))).alias("_layers"),
    )
    return logs.select(
        file,
        F.coalesce("borehole_id", F.lit("Unknown")).alias("borehole_id"),
        F.coalesce(_number(F.col("ground_level_m")), F.lit(0.0)).alias("ground_level_m"),
        _number(F.col("water_level_m")).alias("water_level_m"),
        F.transform("_layers", lambda x: x["layer"]).alias("layers"),
    )
