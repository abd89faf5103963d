"""Programme controls: earned value, curves, delay and weather risk, claims.

Every operator takes many projects at once; ``keys`` names the project columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.functions import risk
from groundplan.functions.words import days_between
from groundplan.operators.running import running_totals
from groundplan.operators.sizes import broadcast_if_small

PROJECT = ["project_id"]


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def _count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


# --- earned value -------------------------------------------------------


def evm_metrics(tasks: DataFrame, *, as_of, keys: list[str] = PROJECT) -> DataFrame:
    """Planned, earned and actual value with the indices built on them."""
    earned = F.col("budget_cost") * F.col("percent_complete") / 100
    sums = tasks.groupBy(*keys).agg(
        _total(F.when(F.col("start_date") <= _day(as_of), F.col("budget_cost"))).alias("pv"),
        _total(earned).alias("ev"),
        _total("actual_cost").alias("ac"),
        _total("budget_cost").alias("bac"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    left = F.col("bac") - F.col("ac")
    return (
        sums.withColumn("spi", ratio("ev", "pv"))
        .withColumn("cpi", ratio("ev", "ac"))
        .withColumn("eac", F.when(F.col("cpi") > 0, F.col("bac") / F.col("cpi")).otherwise(F.col("bac")))
        .withColumn("vac", F.col("bac") - F.col("eac"))
        .withColumn("tcpi", F.when(left > 0, (F.col("bac") - F.col("ev")) / left).otherwise(1.0))
        .withColumn("sv", F.col("ev") - F.col("pv"))
        .withColumn("cv", F.col("ev") - F.col("ac"))
        .withColumn("schedule_status", risk.schedule_status(F.col("spi")))
        .withColumn("cost_status", risk.cost_status(F.col("cpi")))
        .withColumn("percent_complete", F.when(F.col("bac") > 0, F.col("ev") / F.col("bac") * 100).otherwise(0.0))
    )


# tasks of one project and day that are ordered in one task
_TASKS_PER_DAY = 100_000


def evm_trend(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    """Running budget and earned value along (start_date, task_id).

    The parts are days, so a project has few of them; a day on which very many
    tasks start, which is counted first, is cut by the beginning of the id, which
    keeps the order.
    """
    rows = tasks.select(*keys, "task_id", "start_date", "budget_cost", "percent_complete")
    full = rows.groupBy(*keys, "start_date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _TASKS_PER_DAY)
    full = broadcast_if_small(full.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "start_date")], F.lit(True).alias("_full")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "start_date")])
    marked = rows.join(full, same, "left").select(*rows.columns, "_full")
    part = F.when(F.col("_full"), F.substring("task_id", 1, 3)).otherwise("")
    return running_totals(
        marked,
        keys,
        bucket=F.struct(F.col("start_date").alias("start"), part.alias("part")),
        order=[F.col("task_id")],
        totals={
            "cumulative_budget": F.col("budget_cost"),
            "cumulative_ev": F.col("budget_cost") * F.col("percent_complete") / 100,
        },
    ).drop("_full")


def s_curve(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    """Planned and earned value for each day from first start to last end.

    Each task is two changes, at its start and its end; the daily sums of the
    changes, few per project, are then accumulated.
    """
    start, end = F.to_date("start_date"), F.to_date("end_date")
    budget = F.coalesce(F.col("budget_cost"), F.lit(0.0))
    partial = F.when(start < end, budget * F.coalesce(F.col("percent_complete"), F.lit(0.0)) / 100).otherwise(0.0)
    change = lambda day, pv, ev, first, last: F.struct(
        day.alias("day"), pv.alias("pv"), ev.alias("ev"), first.alias("first"), last.alias("last")
    )
    no_day = F.lit(None).cast("date")
    changes = tasks.select(
        *keys,
        F.inline(
            F.array(
                change(start, budget, partial, start, no_day),
                change(end, F.lit(0.0), budget - partial, no_day, end),
            )
        ),
    ).filter(F.col("day").isNotNull())
    daily = changes.groupBy(*keys, "day").agg(
        F.sum("pv").alias("pv"), F.sum("ev").alias("ev"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    calendar = daily.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    days = calendar.filter(F.col("first") <= F.col("last")).select(
        *keys, F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"), F.lit(True).alias("in_calendar")
    )
    upto = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(daily.select(*keys, "day", "pv", "ev"), [*keys, "day"], "full")
    curve = filled.select(
        *keys,
        "day",
        "in_calendar",
        F.coalesce(F.sum("pv").over(upto), F.lit(0.0)).alias("planned_value"),
        F.coalesce(F.sum("ev").over(upto), F.lit(0.0)).alias("earned_value"),
    )
    return curve.filter("in_calendar").drop("in_calendar")


# --- summaries ----------------------------------------------------------


def schedule_summary(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    percent = F.col("percent_complete")
    sums = tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        _count_if(percent == 100).alias("completed"),
        _count_if((percent > 0) & (percent < 100)).alias("in_progress"),
        _count_if(percent == 0).alias("not_started"),
        _count_if(F.col("critical")).alias("critical_tasks"),
        _total("budget_cost").alias("total_budget"),
        _total("actual_cost").alias("actual_spent"),
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
    )
    spent = F.when(F.col("total_budget") > 0, F.col("actual_spent") / F.col("total_budget") * 100).otherwise(0.0)
    return sums.withColumn("percent_spent", spent)


def budget_by_wbs(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    return tasks.groupBy(*keys, "wbs").agg(_total("budget_cost").alias("budget_cost"), _total("actual_cost").alias("actual_cost"))


def budget_rollup(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    """Budgets of every work package, project and all projects in one pass; ``level`` counts the columns summed over."""
    sums = tasks.rollup(*keys, "wbs").agg(
        F.grouping_id().alias("_over"), _total("budget_cost").alias("budget_cost"), _total("actual_cost").alias("actual_cost"), F.count(F.lit(1)).alias("tasks")
    )
    return sums.select(*keys, "wbs", F.bit_count("_over").cast("int").alias("level"), "budget_cost", "actual_cost", "tasks")


def crew_allocation(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    rows = tasks.filter(F.col("resource_crew").isNotNull())
    return rows.groupBy(*keys, "resource_crew").agg(
        _total("budget_cost").alias("total_budget"),
        F.avg("percent_complete").alias("avg_progress"),
        F.count("task_id").alias("task_count"),
    )


def resource_cost(resources: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    return resources.groupBy(*keys, "resource_name").agg(F.sum("cost_per_unit").alias("cost_per_unit"))


def status_distribution(tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    status = F.col("status") if "status" in tasks.columns else risk.task_status(F.col("percent_complete"))
    return tasks.withColumn("status", status).groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("tasks"))


def crew_coordination(tasks: DataFrame, *, keys: list[str] = PROJECT, shown: int = 2) -> DataFrame:
    """Work period, progress and first task names of each crew.

    The names come from a per-crew top ``shown``, which Spark cuts before the
    shuffle; the other columns are plain sums. No crew is gathered whole.
    """
    crew = F.coalesce(F.col("resource_crew"), F.lit("Unassigned"))
    rows = tasks.withColumn("crew", crew)
    sums = rows.groupBy(*keys, "crew").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.min("start_date").alias("first_start"),
        F.max("end_date").alias("last_end"),
        F.avg("percent_complete").alias("avg_progress"),
        _count_if(F.col("critical")).alias("critical_tasks"),
    )
    by_start = Window.partitionBy(*keys, "crew").orderBy("start_date", "task_id")
    first = rows.select(*keys, "crew", "task_name", F.row_number().over(by_start).alias("n")).filter(F.col("n") <= shown)
    names = first.groupBy(*keys, "crew").agg(F.array_sort(F.collect_list(F.struct("n", "task_name"))).alias("named"))
    names = names.withColumn("first_tasks", F.expr("transform(named, x -> x.task_name)")).drop("named")
    return sums.join(names, [*keys, "crew"], "left")


def crew_handoffs(crews: DataFrame, *, keys: list[str] = PROJECT, days: int = 7) -> DataFrame:
    """Crew pairs, in name order, where one ends within ``days`` of the other's start.

    Dates are put into bins of ``days`` + 1, so that a pair can only meet in the
    same or a neighbouring bin: an equality join, not all pairs of crews.
    """
    width = days + 1
    bin_of = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width).cast("int")
    giving = crews.select(
        *keys,
        F.col("crew").alias("from_crew"),
        F.col("last_end").alias("handoff_date"),
        F.col("first_tasks").alias("from_tasks"),
        bin_of(F.col("last_end")).alias("bin"),
    )
    taking = crews.select(
        *keys,
        F.col("crew").alias("to_crew"),
        F.col("first_start").alias("to_start"),
        F.col("first_tasks").alias("to_tasks"),
        F.explode(F.sequence(bin_of(F.col("first_start")) - 1, bin_of(F.col("first_start")) + 1)).alias("bin"),
    )
    gap = days_between(F.col("handoff_date"), F.col("to_start"))
    return (
        giving.join(taking, [*keys, "bin"])
        .filter((F.col("from_crew") < F.col("to_crew")) & (F.abs(gap) <= days))
        .select(*keys, "from_crew", "to_crew", "handoff_date", "to_start", "from_tasks", "to_tasks")
    )


# --- task lists ---------------------------------------------------------


def critical_path(tasks: DataFrame) -> DataFrame:
    rows = tasks.filter(F.col("critical"))
    return rows.select("project_id", "task_id", "task_name", "start_date", "end_date", "percent_complete").orderBy(
        "start_date", "task_id"
    )


def critical_from_float(tasks: DataFrame) -> DataFrame:
    """Critical flag and path label, from the float where the flag is missing."""
    critical = F.col("critical") if "critical" in tasks.columns else F.lit(None).cast("boolean")
    rows = tasks.withColumn("critical", risk.is_critical(critical, F.col("total_float")))
    return rows.withColumn("path_status", F.when(F.col("critical"), "Critical Path").otherwise("Non-Critical"))


def milestones(tasks: DataFrame) -> DataFrame:
    duration = days_between(F.col("end_date"), F.col("start_date"))
    short_critical = F.col("critical") & (duration <= 5)
    return tasks.withColumns(
        {"duration_days": duration, "is_milestone": (duration <= 1) | short_critical, "is_critical_milestone": short_critical}
    )


def progress_dates(tasks: DataFrame) -> DataFrame:
    """Tasks under way, with the moment their progress bar ends."""
    rows = tasks.filter((F.col("percent_complete") > 0) & (days_between(F.col("end_date"), F.col("start_date")) > 0))
    return rows.withColumn(
        "progress_end", risk.progress_end(F.col("start_date"), F.col("end_date"), F.col("percent_complete"))
    )


def with_status(tasks: DataFrame) -> DataFrame:
    """Tasks with the status and remaining duration that follow from their progress."""
    percent = F.col("percent_complete")
    return tasks.withColumns(
        {"status": risk.task_status(percent), "remaining_duration": risk.remaining_duration(F.col("original_duration"), percent)}
    )


def activity_list(tasks: DataFrame) -> DataFrame:
    """Tasks in work breakdown and start order."""
    return tasks.orderBy("wbs", "start_date", "task_id")


def activity_table(tasks: DataFrame) -> DataFrame:
    """The display table of activities; write it with ``write_activity_csv``."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return tasks.select(
        "project_id",
        F.col("task_id").alias("Task ID"),
        F.col("task_name").alias("Task Name"),
        text("start_date").alias("Start"),
        text("end_date").alias("Finish"),
        F.datediff("end_date", "start_date").alias("Duration"),
        F.col("percent_complete").alias("% Complete"),
        F.col("total_float").alias("Total Float"),
        F.when(F.col("critical"), "Yes").otherwise("No").alias("Critical"),
    )


def write_activity_csv(tasks: DataFrame, path: str) -> None:
    activity_table(tasks).write.mode("overwrite").option("header", True).partitionBy("project_id").csv(path)


def potential_delays(tasks: DataFrame, *, as_of) -> DataFrame:
    """Started, unfinished tasks past their end date."""
    percent, end = F.col("percent_complete"), F.col("end_date")
    behind = days_between(_day(as_of), end)
    return (
        tasks.filter((percent > 0) & (percent < 100) & (end < _day(as_of)))
        .select(
            "project_id", "task_id", "task_name", "percent_complete", "end_date",
            behind.alias("days_behind"), risk.delay_severity(behind).alias("delay_severity"), "critical", "budget_cost",
        )
        .orderBy(F.desc("days_behind"), "task_id")
    )


def behind_plan(tasks: DataFrame, *, as_of) -> DataFrame:
    """Started, unfinished tasks with less than 80 % of their planned progress, and their stored status.

    Tables without a status get the one that follows from the progress.
    """
    percent = F.col("percent_complete")
    status = F.col("status") if "status" in tasks.columns else risk.task_status(percent)
    planned = risk.planned_percent(F.col("start_date"), F.col("original_duration"), _day(as_of))
    return (
        tasks.filter((percent > 0) & (percent < 100))
        .withColumn("planned_progress", planned)
        .filter(percent < F.col("planned_progress") * 0.8)
        .select("project_id", "task_id", "task_name", "percent_complete", "planned_progress", status.alias("status"))
    )


def lookahead(tasks: DataFrame, *, as_of, weeks: int = 4) -> DataFrame:
    """Tasks that start in, end in or span the coming weeks."""
    day, start, end = _day(as_of), F.col("start_date"), F.col("end_date")
    last, week = F.date_add(day, 7 * weeks), F.date_add(day, 7)
    wanted = start.between(day, last) | end.between(day, last) | ((start <= day) & (end >= day))
    period = F.when((start <= week) & (end >= day), "this_week").when((start > week) & (start <= last), "upcoming")
    return tasks.filter(wanted).withColumn("period", period.otherwise("other"))


def lookahead_crews(tasks: DataFrame, *, as_of, weeks: int = 4, keys: list[str] = PROJECT) -> DataFrame:
    rows = lookahead(tasks, as_of=as_of, weeks=weeks).filter(F.col("resource_crew").isNotNull())
    return rows.groupBy(*keys, "resource_crew").agg(F.count("task_name").alias("activities"))


# --- risk ---------------------------------------------------------------


def with_predecessors(tasks: DataFrame, relationships: DataFrame | None, *, keys: list[str] = PROJECT) -> DataFrame:
    """Flag the tasks that follow another task."""
    if relationships is None:
        return tasks.withColumn("has_predecessors", F.lit(False))
    on = [*keys, "task_id"]
    followed = relationships.select(*keys, F.col("succ_task_id").cast("string").alias("task_id")).distinct()
    flagged = tasks.join(followed.withColumn("_followed", F.lit(True)), on, "left")
    return flagged.withColumn("has_predecessors", F.col("_followed").isNotNull()).drop("_followed")


def delay_risk(tasks: DataFrame, relationships: DataFrame | None, *, as_of, keys: list[str] = PROJECT) -> DataFrame:
    """Delay risk score, level and factors of each unfinished task."""
    rows = with_predecessors(tasks.filter(F.col("percent_complete") < 100), relationships, keys=keys)
    parts = risk.delay_score_parts(
        F.coalesce(F.col("task_name"), F.lit("")),
        F.coalesce(F.col("critical"), F.lit(False)),
        F.col("has_predecessors"),
        F.col("percent_complete"),
        F.coalesce(days_between(F.col("start_date"), _day(as_of)), F.lit(0)),
    )
    return rows.select(
        *keys, "task_id", "task_name", "start_date", "end_date", "percent_complete", "critical",
        *[c.alias(n) for n, c in parts.items()],
    )


def _risk_counts(rows: DataFrame, keys: list[str], total: str) -> DataFrame:
    level = F.col("risk_level")
    score = [F.coalesce(F.avg("delay_risk_score"), F.lit(0.0)).alias("avg_risk_score")] if "delay_risk_score" in rows.columns else []
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        _count_if(level == "HIGH").alias("high_risk"),
        _count_if(level == "MEDIUM").alias("medium_risk"),
        _count_if(level == "LOW").alias("low_risk"),
        _count_if(F.col("critical") & level.isin("HIGH", "MEDIUM")).alias("critical_at_risk"),
        *score,
    )


def delay_risk_summary(scored: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    return _risk_counts(scored, keys, "total_at_risk")


def delay_risk_top(scored: DataFrame, *, top_n: int = 15, keys: list[str] = PROJECT) -> DataFrame:
    """The ``top_n`` riskiest tasks of each project."""
    by_score = Window.partitionBy(*keys).orderBy(F.desc("delay_risk_score"), "task_id")
    return scored.withColumn("risk_rank", F.row_number().over(by_score)).filter(F.col("risk_rank") <= top_n)


def weather_risk(tasks: DataFrame, *, as_of, days_ahead: int = 60) -> DataFrame:
    """Weather risk of the unfinished tasks that start in the coming days."""
    day, start = _day(as_of), F.col("start_date")
    rows = tasks.filter(start.between(day, F.date_add(day, days_ahead)) & (F.col("percent_complete") < 100))
    rows = rows.withColumns({"is_outdoor": risk.is_outdoor(F.col("task_name")), "rain_days": risk.rain_days(start)})
    return rows.withColumns(
        {"risk_level": risk.weather_level(F.col("rain_days"), F.col("is_outdoor")), "month_name": risk.month_name(start)}
    )


def weather_risk_summary(scored: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    return _risk_counts(scored, keys, "total_activities")


def weather_medium_list(scored: DataFrame, *, shown: int = 10, keys: list[str] = PROJECT) -> DataFrame:
    """The first ``shown`` medium risk tasks of each project, most rain first."""
    by_rain = Window.partitionBy(*keys).orderBy(F.desc("rain_days"), "task_id")
    rows = scored.filter(F.col("risk_level") == "MEDIUM")
    return rows.withColumn("list_rank", F.row_number().over(by_rain)).filter(F.col("list_rank") <= shown)


# --- claims -------------------------------------------------------------


def delay_claims(events: DataFrame, event_tasks: DataFrame, tasks: DataFrame, *, keys: list[str] = PROJECT) -> DataFrame:
    """Impact of delay events on the tasks they name, or on the whole project.

    An event that names no task takes its figures from project totals, so that
    no event is ever multiplied with all tasks.
    """
    figures = [
        F.count(F.lit(1)).alias("affected"),
        _count_if(F.col("critical")).alias("critical_affected"),
        F.sum("budget_cost").alias("affected_budget"),
        F.avg("original_duration").alias("avg_duration"),
    ]
    names = ["affected", "critical_affected", "affected_budget", "avg_duration"]
    needed = tasks.select(*keys, "task_id", "critical", "budget_cost", "original_duration")
    pairs = event_tasks.select("event_id", *keys, "task_id").distinct()
    hit = pairs.join(needed, [*keys, "task_id"], "left")
    found = F.col("budget_cost").isNotNull() | F.col("original_duration").isNotNull() | F.col("critical").isNotNull()
    named = hit.groupBy("event_id", *keys).agg(
        _count_if(found).alias("affected"),
        *[f for f in figures[1:]],
        F.lit(True).alias("has_list"),
    )
    whole = needed.groupBy(*keys).agg(*figures).select(*keys, *[F.col(n).alias(f"all_{n}") for n in names])
    rows = events.join(named, ["event_id", *keys], "left").join(whole, keys, "left")
    pick = lambda n: F.coalesce(F.when(F.col("has_list"), F.col(n)).otherwise(F.col(f"all_{n}")), F.lit(0))
    rows = rows.select(*events.columns, *[pick(n).alias(n) for n in names])
    duration = days_between(F.col("event_end"), F.col("event_start"))
    rows = rows.withColumn("duration_days", duration)
    impact = F.when(F.col("critical_affected") > 0, F.col("duration_days")).otherwise(0)
    cost = F.when(
        F.col("avg_duration") > 0, F.col("affected_budget") * (F.col("duration_days") / F.col("avg_duration"))
    ).otherwise(0.0)
    rows = rows.withColumns(
        {
            "schedule_impact_days": impact,
            "cost_impact_estimate": cost,
            "claim_eligibility": risk.claim_eligibility(F.col("cause")),
            "claim_type": risk.claim_type(F.col("cause")),
        }
    )
    action = risk.claim_action(F.col("schedule_impact_days"), F.col("claim_eligibility"), F.col("critical_affected"))
    return rows.withColumn("recommended_action", action)
