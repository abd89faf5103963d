"""Operators on data where one key, day or text holds most of the rows."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundplan.operators import cache, programme, usage, versions


def test_running_value_with_one_hot_day(spark):
    rows = spark.range(3000).selectExpr(
        "if(id % 10 < 8, 'hot', concat('p', id % 3)) project_id", "cast(id as string) task_id",
        "date_add(date '2024-01-01', if(id % 10 < 7, 0, cast(id % 50 as int))) start_date", "cast(id % 97 as double) budget_cost", "cast(id % 21 * 5 as double) percent_complete",
    )
    order = Window.partitionBy("project_id").orderBy("start_date", "task_id")
    total = F.sum("budget_cost").over(order.rowsBetween(Window.unboundedPreceding, 0))
    plain = rows.select("task_id", total.alias("cumulative_budget"))
    ours = programme.evm_trend(rows).select("task_id", "cumulative_budget")
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_one_event_written_over_and_over(spark):
    writes = spark.range(2000).selectExpr("if(id % 5 < 4, 'hot', concat('e', id)) event_id", "timestamp_seconds(id) ts", "id x")
    last = {r.event_id: r.x for r in usage.latest_events(writes).collect()}
    assert last["hot"] == 1998 and len(last) == 401


def test_one_text_asked_over_and_over(spark):
    asked = spark.range(1000).selectExpr("id", "if(id % 4 < 3, 'same', concat('t', id)) text").withColumn("key", cache.embedding_key(F.col("text")))
    stored = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    missing = cache.misses(asked, stored, as_of="2024-01-01 00:00:00")
    assert missing.count() == 251
    flagged = cache.lookup(asked, missing.withColumn("expires_at", F.lit(dt.datetime(2025, 1, 1))), as_of="2024-01-01 00:00:00")
    assert flagged.filter("hit").count() == 1000


def test_one_report_with_most_versions(spark):
    drafts = spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', concat('r', id % 7)) report_id", "timestamp_seconds(id * 60) created_at", "'c' content")
    made = versions.number_versions(drafts)
    plain = drafts.withColumn("n", F.row_number().over(Window.partitionBy("report_id").orderBy("created_at")))
    key = lambda df, n: sorted((r.report_id, r.created_at, r[n]) for r in df.collect())
    assert key(made, "version_number") == key(plain, "n")


def test_trend_of_a_full_day(spark, monkeypatch):
    """One day holds most tasks and is cut by the beginning of the id; null days come first."""
    from groundplan.operators import programme

    monkeypatch.setattr(programme, "_TASKS_PER_DAY", 50)
    rows = [("P", f"{i:05d}", None if i % 17 == 0 else dt.date(2024, 1, 1 + (i % 20 if i % 3 == 0 else 4)), float(i % 7), 50.0) for i in range(600)]
    tasks = spark.createDataFrame(rows, "project_id string, task_id string, start_date date, budget_cost double, percent_complete double")
    got = [(r.task_id, r.cumulative_budget, r.cumulative_ev) for r in programme.evm_trend(tasks).orderBy("start_date", "task_id").collect()]
    total, want = 0.0, []
    for _, task, _, cost, _ in sorted(rows, key=lambda r: (r[2] or dt.date(1900, 1, 1), r[1])):
        total += cost
        want.append((task, total, total / 2))
    assert got == want
