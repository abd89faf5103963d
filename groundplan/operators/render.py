"""Report texts.

Reports with a bounded number of lines per key become one text per key
(``render_report``). Reports that list every task of a project stay a table of
ordered lines, so that no project has to fit into one value; ``write_lines``
stores them as one sorted text folder per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.operators import programme

PROJECT = ["project_id"]


def render_report(df: DataFrame, keys: list[str], order: list[Column], line: Column, separator: str = "\n") -> DataFrame:
    """Join the lines of each key, in order, to one text."""
    part = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["line"])
    return df.groupBy(*keys).agg(F.array_join(lines, separator).alias("text"))


def write_lines(lines: DataFrame, keys: list[str], order: list[str], path: str) -> None:
    """Write ordered lines as text, one folder per key, sorted across its files."""
    sorted_lines = lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    sorted_lines.select(*keys, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def _date(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def _marker() -> Column:
    return F.when(F.col("critical"), "[CRITICAL]").otherwise("")


def _heading(title: str, width: int) -> str:
    return f"{title}\n{'-' * width}"


def _closing(title: str, width: int, lines: list[str]) -> str:
    return "\n".join([f"\n{_heading(title, width)}", *lines])


def _fixed(value: Column) -> Column:
    """One decimal, ties to even, without separators."""
    return F.replace(F.format_number(value.cast("double"), 1), F.lit(","), F.lit(""))


def _progress() -> Column:
    """Progress as it is stored, not rounded."""
    return F.col("percent_complete").cast("double").cast("string")


def _others(projects: DataFrame | None, present: DataFrame, keys: list[str], text: str) -> DataFrame | None:
    """One row with a fixed text for each project that has nothing to report."""
    return None if projects is None else projects.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti").withColumn("line", F.lit(text))


def _with(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    return rows if more is None else rows.unionByName(more, allowMissingColumns=True)


def delay_risk_report(scored: DataFrame, *, top_n: int = 15, keys: list[str] = PROJECT, projects: DataFrame | None = None) -> DataFrame:
    """Summary, top tasks and advice of each project, as one text; ``projects`` names those that get a text even without a task at risk."""
    head = programme.delay_risk_summary(scored, keys=keys).select(
        *keys,
        F.lit(0).alias("pos"),
        F.format_string(
            f"DELAY RISK PREDICTION REPORT\n{'=' * 70}\n\nRISK SUMMARY\n{'-' * 70}\n  Total Tasks at Risk: %d\n  High Risk: %d\n  Medium Risk: %d\n  Low Risk: %d\n"
            f"  Critical Tasks at Risk: %d\n  Average Risk Score: %s\n\n{_heading(f'TOP {top_n} HIGHEST RISK ACTIVITIES', 70)}",
            "total_at_risk", "high_risk", "medium_risk", "low_risk", "critical_at_risk",
            _fixed(F.col("avg_risk_score")),
        ).alias("line"),
    )
    top = programme.delay_risk_top(scored, top_n=top_n, keys=keys).select(
        *keys,
        F.col("risk_rank").alias("pos"),
        F.format_string(
            "\n%d. %s [%s] %s\n   Risk Score: %d/100 (%s)\n   Start: %s | Progress: %s%%\n   Risk Factors: %s",
            F.col("risk_rank"), _marker(), F.col("task_id"), F.col("task_name"), F.col("delay_risk_score"),
            F.col("risk_level"), _date("start_date"), _progress(), F.array_join("risk_factors", ", "),
        ).alias("line"),
    )
    advice = "\n".join(["", "-" * 70, _heading("RECOMMENDATIONS", 70), *V.DELAY_REPORT_ADVICE])
    end = head.select(*keys, F.lit(top_n + 1).alias("pos"), F.lit(advice).alias("line"))
    lines = _with(head.unionByName(top).unionByName(end), _others(projects, head, keys, V.NO_TASK_AT_RISK))
    return render_report(lines, keys, [F.col("pos")], F.col("line"))


def claim_report(claims: DataFrame) -> DataFrame:
    """One text per delay event; each row holds all it needs."""
    rule = "-" * 70
    text = F.format_string(
        f"DELAY CLAIM ANALYSIS REPORT\n{'=' * 70}\n\nEvent: %s\nCause: %s\nDuration: %d days\n\n{rule}\nIMPACT ANALYSIS\n{rule}\n  Activities Affected: %d\n"
        f"  Critical Activities Affected: %d\n  Schedule Impact: %d days\n  Estimated Cost Impact: $%s\n\n{rule}\nCLAIM ASSESSMENT\n{rule}\n"
        f"  Claim Type: %s\n  Eligibility: %s\n  Recommended Action: %s\n\n{rule}\n{_heading('REQUIRED DOCUMENTATION', 70)}\n" + "\n".join(V.CLAIM_REPORT_DOCUMENTS),
        F.col("event_id"), F.col("cause"), F.col("duration_days"), F.col("affected"), F.col("critical_affected"),
        F.col("schedule_impact_days"), F.format_number("cost_impact_estimate", 2), F.col("claim_type"),
        F.col("claim_eligibility"), F.col("recommended_action"),
    )
    return claims.select("event_id", text.alias("text"))


def _piece(rows: DataFrame, section: int, pos: int, line, **keys) -> DataFrame:
    """A line of a report of each project; ``section`` and ``pos`` order it ahead of the keys of listed rows."""
    return rows.select("project_id", F.lit(section).alias("section"), F.lit(pos).alias("pos"), *[c.alias(n) for n, c in keys.items()], (F.lit(line) if isinstance(line, str) else line).alias("line"))


def lookahead_lines(tasks: DataFrame, *, as_of, weeks: int = 4) -> DataFrame:
    """Look-ahead report of every project as ordered lines: head, this week, upcoming, crews needed.

    Joined by line ends in order of section, pos, start_date and key they are the text.
    """
    rows = programme.lookahead(tasks, as_of=as_of, weeks=weeks)
    projects = tasks.select("project_id").distinct()
    day = F.lit(str(as_of)).cast("date")
    shown = lambda days: F.date_format(F.date_add(day, days), "yyyy-MM-dd")
    now, crew = F.col("period") == "this_week", F.coalesce("resource_crew", F.lit("N/A"))
    title = F.concat(F.lit(f"{weeks}-WEEK LOOK-AHEAD REPORT\nGenerated: "), shown(0), F.lit(" | Period: "), shown(0), F.lit(" to "), shown(7 * weeks), F.lit("\n" + "=" * 70 + "\n"))
    this_week = F.concat(F.lit("THIS WEEK ("), shown(0), F.lit(" to "), shown(7), F.lit("):\n" + "-" * 70))
    item = F.format_string(
        "  %s [%s] %s\n      Crew: %s | Progress: %s%%\n      %s to %s\n",
        _marker(), F.col("task_id"), F.col("task_name"), crew, _progress(), _date("start_date"), _date("end_date"),
    )
    later = F.format_string("  %s [%s] %s\n      Starts: %s | Crew: %s", _marker(), F.col("task_id"), F.col("task_name"), _date("start_date"), crew)
    in_week, upcoming = rows.filter(now), rows.filter("period = 'upcoming'")
    crews = programme.lookahead_crews(tasks, as_of=as_of, weeks=weeks)
    keys = {"start_date": F.col("start_date"), "task_id": F.col("task_id")}
    of = lambda listed: listed.select("project_id").distinct()
    parts = [
        _piece(projects, 0, 0, title), _piece(projects, 1, 0, this_week),
        _piece(projects.join(of(in_week), "project_id", "left_anti"), 1, 1, V.NO_TASK_THIS_WEEK),
        _piece(in_week, 1, 1, item, **keys),
        _piece(of(upcoming), 2, 0, f"\n{_heading(f'UPCOMING (Next {weeks - 1} Weeks):', 70)}"), _piece(upcoming, 2, 1, later, **keys),
        _piece(projects, 3, 0, f"\n{_heading('REQUIRED RESOURCES:', 70)}"),
        _piece(crews, 3, 1, F.format_string("  %s: %d activities", "resource_crew", "activities"), task_id=F.col("resource_crew")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def weather_lines(scored: DataFrame, *, shown: int = 10, days: int = 60, projects: DataFrame | None = None) -> DataFrame:
    """Weather report as ordered lines: head, every high risk task, the first medium ones, advice.

    Joined by line ends in order of section, pos, rain_days (most first) and key they
    are the text. ``projects`` names those that get a line even without a task.
    """
    counts = scored.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("risk_level") == level, 1)).alias(level) for level in ("HIGH", "MEDIUM")]
    )
    number = lambda c: F.col(c).cast("string")
    keys = {"rain_days": F.col("rain_days"), "task_id": F.col("task_id")}
    title = F.concat(F.lit(f"WEATHER RISK ANALYSIS REPORT\n{'=' * 60}\nPeriod: Next {days} days\nTotal upcoming activities: "), number("n"), F.lit("\n"))
    headed = lambda name, before: F.concat(F.lit(f"{before}{name} RISK ACTIVITIES ("), number(name), F.lit("):\n" + "-" * 40))
    high = F.format_string(
        "  [%s] %s\n      Start: %s (%s)\n      Expected rain days: %d\n      Recommendation: Plan indoor work or add contingency\n",
        F.col("task_id"), F.col("task_name"), _date("start_date"), F.col("month_name"), F.col("rain_days"),
    )
    parts = [
        _piece(counts, 0, 0, title),
        _piece(counts.filter("HIGH > 0"), 1, 0, headed("HIGH", "")), _piece(scored.filter("risk_level = 'HIGH'"), 1, 1, high, **keys),
        _piece(counts.filter("MEDIUM > 0"), 2, 0, headed("MEDIUM", "\n")),
        _piece(programme.weather_medium_list(scored, shown=shown), 2, 1, F.format_string("  [%s] %s - %s (%d rain days)", "task_id", "task_name", "month_name", "rain_days"), **keys),
        _piece(counts, 3, 0, _closing("RECOMMENDATIONS:", 40, V.WEATHER_REPORT_ADVICE)),
    ]
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    none = _others(projects, counts, PROJECT, V.NO_UPCOMING_TASK)
    return lines if none is None else lines.unionByName(none.withColumns({"section": F.lit(0), "pos": F.lit(0)}), allowMissingColumns=True)


def coordination_lines(tasks: DataFrame) -> DataFrame:
    """Crew summary of each project as ordered lines, with the number of hand-offs and the first ten."""
    crews = programme.crew_coordination(tasks)
    projects = tasks.select("project_id").distinct()
    pairs = programme.crew_handoffs(crews)
    counts = projects.join(pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), "project_id", "left").fillna(0)
    by_name = Window.partitionBy("project_id").orderBy("from_crew", "to_crew")
    first = pairs.withColumn("_n", F.row_number().over(by_name)).filter("_n <= 10")
    named = lambda mark, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n    {mark}: "), F.array_join(c, ", "))).otherwise("")
    summary = F.format_string(
        "\n%s:\n  Tasks: %d | Avg Progress: %s%%\n  Period: %s to %s",
        F.col("crew"), F.col("tasks"), _fixed(F.col("avg_progress")), _date("first_start"), _date("last_end"),
    )
    handed = F.concat(
        F.lit("\n  "), _date("handoff_date"), F.lit(": "), "from_crew", F.lit(" -> "), "to_crew", named("From", F.col("from_tasks")), named("To", F.col("to_tasks")),
    )
    parts = [
        _piece(projects, 0, 0, f"SUBCONTRACTOR COORDINATION REPORT\n{'=' * 60}\n\n{_heading('CREW SCHEDULE SUMMARY:', 60)}"),
        _piece(crews, 1, 0, summary, key=F.col("crew"), second_key=F.lit("")),
        _piece(counts, 2, 0, F.format_string(f"\n\nUPCOMING HANDOFFS (%d identified):\n{'-' * 60}", "n")),
        _piece(counts.filter("n = 0"), 2, 1, V.NO_HANDOFF),
        _piece(first, 2, 1, handed, key=F.col("from_crew"), second_key=F.col("to_crew")),
        _piece(projects, 3, 0, _closing("COORDINATION ACTIONS:", 60, V.COORDINATION_ACTIONS)),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def schedule_context(tasks: DataFrame, resources: DataFrame | None = None, *, shown: int = 50) -> DataFrame:
    """Summary, first ``shown`` tasks and resource costs of each project, as one text."""
    from groundplan.functions.risk import remaining_duration, task_status

    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    number = lambda c: _fixed(F.col(c) if isinstance(c, str) else c)
    head = programme.schedule_summary(tasks).select(
        "project_id", F.lit(0).alias("section"), F.lit(0).alias("pos"),
        F.concat_ws(
            "\n",
            F.lit("=== CONSTRUCTION SCHEDULE DATA ===\n\nSchedule Summary:"),
            F.format_string("- Total Tasks: %d", "total_tasks"), F.format_string("- Completed: %d", "completed"),
            F.format_string("- In Progress: %d", "in_progress"), F.format_string("- Not Started: %d", "not_started"),
            F.format_string("- Critical Tasks: %d", "critical_tasks"),
            F.concat(F.lit("- Total Budget: "), money("total_budget")), F.concat(F.lit("- Actual Spent: "), money("actual_spent")),
            F.concat(F.lit("- Overall Progress: "), number("percent_spent"), F.lit("%")),
            F.concat(F.lit("- Project Start: "), F.coalesce(_date("start_date"), F.lit("N/A"))),
            F.concat(F.lit("- Project End: "), F.coalesce(_date("end_date"), F.lit("N/A"))),
            F.lit("\n=== TASK DETAILS ==="),
        ).alias("line"),
    )
    first = Window.partitionBy("project_id").orderBy("start_date", "task_id")
    rows = tasks.withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= shown)
    detail = rows.select(
        "project_id", F.lit(1).alias("section"), "pos",
        F.concat(
            F.when(F.col("pos") > 1, "\n").otherwise(""),
            F.concat_ws(
                "\n",
                F.format_string("Task %s: %s", "task_id", "task_name"),
                F.format_string("  WBS: %s, Status: %s, Progress: %s%%", F.col("wbs"), task_status(F.col("percent_complete")), _progress()),
                F.concat(
                    F.lit("  Duration: "), F.col("original_duration").cast("string"), F.lit(" days, Remaining: "),
                    number(remaining_duration(F.col("original_duration"), F.col("percent_complete"))), F.lit(" days"),
                ),
                F.concat(F.lit("  Budget: "), money("budget_cost"), F.lit(", Actual: "), money("actual_cost")),
                F.concat(F.lit("  Start: "), _date("start_date"), F.lit(", End: "), _date("end_date")),
                F.concat(
                    F.lit("  Critical: "), F.when(F.col("critical"), "Yes").otherwise("No"), F.lit(", Float: "),
                    number("total_float"), F.lit(" days"),
                ),
                F.concat(F.lit("  Crew: "), F.coalesce("resource_crew", F.lit("N/A"))),
            ),
        ).alias("line"),
    )
    lines = head.unionByName(detail)
    if resources is not None:
        # two columns, right-aligned to their widest value
        cost = programme.resource_cost(resources).withColumn("cost", number("cost_per_unit"))
        widths = cost.groupBy("project_id").agg(
            F.greatest(F.max(F.length("resource_name")), F.lit(13)).alias("_name"), F.greatest(F.max(F.length("cost")), F.lit(13)).alias("_cost")
        )
        row = lambda name, value: F.concat(F.expr(f"lpad({name}, _name)"), F.lit(" "), F.expr(f"lpad({value}, _cost)"))
        titles = F.concat(F.lit("\n=== RESOURCE ALLOCATIONS ===\n"), row("'resource_name'", "'cost_per_unit'"))
        by_name = Window.partitionBy("project_id").orderBy("resource_name")
        listed = cost.join(widths, "project_id").select("project_id", F.lit(2).alias("section"), F.row_number().over(by_name).alias("pos"), row("resource_name", "cost").alias("line"))
        lines = lines.unionByName(_piece(widths, 2, 0, titles)).unionByName(listed)
    return render_report(lines, ["project_id"], [F.col("section"), F.col("pos")], F.col("line"))
