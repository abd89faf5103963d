"""Programme labels, risk scores and claim texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.words import contains_any, days_between, label, listed


def task_status(percent: Column) -> Column:
    return F.when(percent == 100, "Complete").when(percent > 0, "In Progress").otherwise("Not Started")


def remaining_duration(duration: Column, percent: Column) -> Column:
    return duration * (1 - percent / 100)


def schedule_status(spi: Column) -> Column:
    return F.when(spi > 1.0, "Ahead of Schedule").when(spi >= 0.95, "On Schedule").otherwise("Behind Schedule")


def cost_status(cpi: Column) -> Column:
    return F.when(cpi > 1.0, "Under Budget").when(cpi >= 0.95, "On Budget").otherwise("Over Budget")


def is_critical(critical: Column, total_float: Column) -> Column:
    """The critical flag, derived from the float where it is missing."""
    return F.coalesce(critical, total_float.isNull() | (total_float <= 0))


def delay_severity(days_behind: Column) -> Column:
    return label(days_behind, [(30, "HIGH"), (14, "MEDIUM")], "LOW", strict=True)


def delay_score_parts(name: Column, critical: Column, has_predecessors: Column, percent: Column, until_start: Column) -> dict[str, Column]:
    """Score, level and factor names of one task."""
    lowered = F.lower(name)
    outdoor = contains_any(lowered, V.DELAY_OUTDOOR_WORDS)
    sensitive = contains_any(lowered, V.WEATHER_SENSITIVE_WORDS)
    soon = until_start > 0
    points = [
        F.when(critical, 30).otherwise(0),
        F.when(outdoor, 20).otherwise(0),
        F.when(sensitive, 15).otherwise(0),
        F.when(has_predecessors, 15).otherwise(0),
        F.when(percent == 0, 20).when(percent < 50, 10).otherwise(0),
        F.when(soon & (until_start < 7), 10).when(soon & (until_start < 14), 5).otherwise(0),
    ]
    score = sum(points[1:], points[0])
    factors = listed(
        (critical, "Critical Path"),
        (outdoor, "Outdoor Work"),
        (sensitive, "Weather Sensitive"),
        (has_predecessors, "Has Predecessors"),
        (percent == 0, "Not Started"),
        ((percent != 0) & (percent < 50), "Low Progress"),
        (soon & (until_start < 14), "Imminent Start"),
    )
    return {"delay_risk_score": score, "risk_level": label(score, [(50, "HIGH"), (30, "MEDIUM")], "LOW"), "risk_factors": factors}


def month_lookup(month: Column, field: int) -> Column:
    """A field of the month weather table; null for an unknown month."""
    pairs = [F.lit(v) for row in V.MONTH_WEATHER for v in (row[0], row[field])]
    return F.create_map(*pairs)[month]


def rain_days(date: Column) -> Column:
    return F.coalesce(month_lookup(F.month(date), 1), F.lit(V.DEFAULT_RAIN_DAYS))


def month_name(date: Column) -> Column:
    return F.coalesce(month_lookup(F.month(date), 4), F.lit("Unknown"))


def is_outdoor(name: Column) -> Column:
    return contains_any(F.lower(name), V.WEATHER_OUTDOOR_WORDS)


def weather_level(rain: Column, outdoor: Column) -> Column:
    return F.when(~outdoor, "LOW").otherwise(label(rain, [(10, "HIGH"), (7, "MEDIUM")], "LOW"))


def _claim(cause: Column, field: int) -> Column:
    lowered = F.lower(F.coalesce(cause, F.lit("Unknown")))
    chain = F
    for kind in V.CLAIM_KINDS:
        chain = chain.when(contains_any(lowered, kind[0]), kind[field])
    return chain.otherwise(V.CLAIM_OTHER[field - 1])


def claim_eligibility(cause: Column) -> Column:
    return _claim(cause, 1)


def claim_type(cause: Column) -> Column:
    return _claim(cause, 2)


def claim_action(impact_days: Column, eligibility: Column, critical_count: Column) -> Column:
    text = V.CLAIM_ACTIONS
    return (
        F.when(impact_days == 0, text["no_impact"])
        .when((eligibility == "High") & (critical_count > 0), text["High"])
        .when(eligibility == "High", text["High, no critical task"])
        .when(eligibility == "Medium-High", text["Medium-High"])
        .when(eligibility == "Medium", text["Medium"])
        .otherwise(text["other"])
    )


def progress_end(start: Column, end: Column, percent: Column) -> Column:
    """The moment up to which a task is done, at even progress."""
    first = start.cast("timestamp").cast("double")
    last = end.cast("timestamp").cast("double")
    return F.timestamp_seconds(first + (last - first) * percent / 100)


def planned_percent(start: Column, duration: Column, as_of: Column) -> Column:
    """Percent that should be done by ``as_of``; 0 without a start or duration."""
    share = days_between(as_of, start) / duration * 100
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))
    return F.when(start.isNotNull() & (duration > 0), clamped).otherwise(0.0)
