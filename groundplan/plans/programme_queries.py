"""Queries of the programme family."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.operators import programme, render
from groundplan.plans.registry import Registry
from groundplan.sources import photos
from groundplan.sources.schedule_export import parse_date
from groundplan.sources.tables import AS_OF_DATE

REGISTRY = Registry()
query = REGISTRY.add

DAY = f"DATE '{AS_OF_DATE}'"


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


EVM_SQL = f"""
sums AS (SELECT project_id, sum(CASE WHEN start_date <= {DAY} THEN budget_cost ELSE 0 END) pv,
                sum(budget_cost * percent_complete / 100) ev, sum(actual_cost) ac, sum(budget_cost) bac
         FROM tasks GROUP BY project_id),
ratios AS (SELECT *, CASE WHEN pv > 0 THEN ev / pv ELSE 1 END spi, CASE WHEN ac > 0 THEN ev / ac ELSE 1 END cpi FROM sums),
evm AS (SELECT *, CASE WHEN cpi > 0 THEN bac / cpi ELSE bac END eac FROM ratios)
"""


@query("evm_metrics", "tasks", """
SELECT project_id, round(pv, 2) pv, round(ev, 2) ev, round(ac, 2) ac, round(bac, 2) bac, round(spi, 6) spi, round(cpi, 6) cpi,
       round(eac, 2) eac, round(bac - eac, 2) vac, round(CASE WHEN bac - ac > 0 THEN (bac - ev) / (bac - ac) ELSE 1 END, 6) tcpi,
       round(ev - pv, 2) sv, round(ev - ac, 2) cv,
       CASE WHEN spi > 1 THEN 'Ahead of Schedule' WHEN spi >= 0.95 THEN 'On Schedule' ELSE 'Behind Schedule' END schedule_status,
       CASE WHEN cpi > 1 THEN 'Under Budget' WHEN cpi >= 0.95 THEN 'On Budget' ELSE 'Over Budget' END cost_status,
       round(CASE WHEN bac > 0 THEN ev / bac * 100 ELSE 0 END, 6) percent_complete
FROM evm""", EVM_SQL)
def evm_metrics(tasks):
    money, ratios = ["pv", "ev", "ac", "bac", "eac", "vac", "sv", "cv"], ["spi", "cpi", "tcpi", "percent_complete"]
    return programme.evm_metrics(tasks, as_of=AS_OF_DATE).selectExpr(
        "project_id", "schedule_status", "cost_status",
        *[f"round({c}, 2) {c}" for c in money], *[f"round({c}, 6) {c}" for c in ratios],
    )


@query("evm_trend", "tasks", """
SELECT project_id, task_id, CAST(start_date AS VARCHAR) start_date,
       round(sum(budget_cost) OVER w, 2) cumulative_budget,
       round(sum(budget_cost * percent_complete / 100) OVER w, 2) cumulative_ev
FROM tasks WINDOW w AS (PARTITION BY project_id ORDER BY start_date, task_id ROWS UNBOUNDED PRECEDING)""")
def evm_trend(tasks):
    return programme.evm_trend(tasks).selectExpr(
        "project_id", "task_id", "cast(start_date as string) start_date",
        "round(cumulative_budget, 2) cumulative_budget", "round(cumulative_ev, 2) cumulative_ev",
    )


@query("s_curve", "tasks", """
SELECT project_id, CAST(day AS VARCHAR) "day",
       round(sum(pv) OVER w, 2) planned_value, round(sum(ev) OVER w, 2) earned_value
FROM by_day WINDOW w AS (PARTITION BY project_id ORDER BY day ROWS UNBOUNDED PRECEDING)""", """
spans AS (SELECT project_id, min(start_date) lo, max(end_date) hi FROM tasks GROUP BY project_id),
days AS (SELECT project_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
starts AS (SELECT project_id, start_date AS day, sum(budget_cost) pv, sum(budget_cost * percent_complete / 100) ev FROM tasks GROUP BY ALL),
ends AS (SELECT project_id, end_date AS day, sum(budget_cost - budget_cost * percent_complete / 100) ev FROM tasks GROUP BY ALL),
by_day AS (SELECT d.project_id, d.day, coalesce(s.pv, 0) pv, coalesce(s.ev, 0) + coalesce(e.ev, 0) ev
           FROM days d LEFT JOIN starts s ON s.project_id = d.project_id AND s.day = d.day
           LEFT JOIN ends e ON e.project_id = d.project_id AND e.day = d.day)""")
def s_curve(tasks):
    return programme.s_curve(tasks).selectExpr(
        "project_id", "cast(day as string) day", "round(planned_value, 2) planned_value", "round(earned_value, 2) earned_value"
    )


SUMMARY_SQL = """
summary AS (SELECT project_id, count(*) total_tasks, count(*) FILTER (percent_complete = 100) completed,
       count(*) FILTER (percent_complete > 0 AND percent_complete < 100) in_progress,
       count(*) FILTER (percent_complete = 0) not_started, count(*) FILTER (critical) critical_tasks,
       sum(budget_cost) total_budget, sum(actual_cost) actual_spent, min(start_date) start_date, max(end_date) end_date
FROM tasks GROUP BY project_id)"""


@query("schedule_summary", "tasks", """
SELECT project_id, total_tasks, completed, in_progress, not_started, critical_tasks, round(total_budget, 2) total_budget,
       round(actual_spent, 2) actual_spent, round(actual_spent / total_budget * 100, 6) percent_spent,
       CAST(start_date AS VARCHAR) start_date, CAST(end_date AS VARCHAR) end_date
FROM summary""", SUMMARY_SQL)
def schedule_summary(tasks):
    return programme.schedule_summary(tasks).selectExpr(
        "project_id", "total_tasks", "completed", "in_progress", "not_started", "critical_tasks",
        "round(total_budget, 2) total_budget", "round(actual_spent, 2) actual_spent", "round(percent_spent, 6) percent_spent",
        "cast(start_date as string) start_date", "cast(end_date as string) end_date",
    )


@query("budget_by_wbs", "tasks", """
SELECT project_id, wbs, round(sum(budget_cost), 2) budget_cost, round(sum(actual_cost), 2) actual_cost
FROM tasks GROUP BY project_id, wbs""")
def budget_by_wbs(tasks):
    return programme.budget_by_wbs(tasks).selectExpr(
        "project_id", "wbs", "round(budget_cost, 2) budget_cost", "round(actual_cost, 2) actual_cost"
    )


@query("budget_rollup", "tasks", """
SELECT project_id, wbs, CAST(GROUPING(project_id) + GROUPING(wbs) AS INT) AS level, round(sum(budget_cost), 2) budget_cost, round(sum(actual_cost), 2) actual_cost, count(*) AS tasks
FROM tasks GROUP BY ROLLUP (project_id, wbs)""")
def budget_rollup(tasks):
    return programme.budget_rollup(tasks).selectExpr("project_id", "wbs", "level", "round(budget_cost, 2) budget_cost", "round(actual_cost, 2) actual_cost", "tasks")


@query("crew_allocation", "tasks", """
SELECT project_id, resource_crew, round(sum(budget_cost), 2) total_budget, round(avg(percent_complete), 6) avg_progress, count(*) task_count
FROM tasks GROUP BY project_id, resource_crew""")
def crew_allocation(tasks):
    return programme.crew_allocation(tasks).selectExpr(
        "project_id", "resource_crew", "round(total_budget, 2) total_budget", "round(avg_progress, 6) avg_progress", "task_count"
    )


@query("resource_cost", "resources", """
SELECT project_id, resource_name, CAST(sum(cost_per_unit) AS BIGINT) cost_per_unit FROM resources GROUP BY project_id, resource_name""")
def resource_cost(resources):
    return programme.resource_cost(resources).selectExpr("project_id", "resource_name", "cast(cost_per_unit as bigint) cost_per_unit")


@query("status_distribution", "tasks", """
SELECT project_id, CASE WHEN percent_complete = 100 THEN 'Complete' WHEN percent_complete > 0 THEN 'In Progress' ELSE 'Not Started' END status,
       count(*) tasks
FROM tasks GROUP BY 1, 2""")
def status_distribution(tasks):
    return programme.status_distribution(tasks)


CREWS_SQL = """
crews AS (SELECT project_id, coalesce(resource_crew, 'Unassigned') crew, count(*) tasks, min(start_date) first_start, max(end_date) last_end,
                 avg(percent_complete) avg_progress, count(*) FILTER (critical) critical_tasks,
                 array_to_string(list_slice(list(task_name ORDER BY start_date, task_id), 1, 2), ', ') first_tasks
          FROM tasks GROUP BY 1, 2)"""


@query("crew_coordination", "tasks", """
SELECT project_id, crew, tasks, CAST(first_start AS VARCHAR) first_start, CAST(last_end AS VARCHAR) last_end,
       round(avg_progress, 6) avg_progress, critical_tasks, first_tasks FROM crews""", CREWS_SQL)
def crew_coordination(tasks):
    return programme.crew_coordination(tasks).selectExpr(
        "project_id", "crew", "tasks", "cast(first_start as string) first_start", "cast(last_end as string) last_end",
        "round(avg_progress, 6) avg_progress", "critical_tasks", "array_join(first_tasks, ', ') first_tasks",
    )


# crews of a customer's project finish far apart, so the hand-offs are taken per site and work package
@query("crew_handoffs", "tasks", """
SELECT a.project_id, a.crew from_crew, b.crew to_crew, CAST(a.last_end AS VARCHAR) handoff_date, a.first_tasks from_tasks, b.first_tasks to_tasks
FROM crews a JOIN crews b ON a.project_id = b.project_id AND a.crew < b.crew AND abs(a.last_end - b.first_start) <= 7""", """
periods AS (SELECT * REPLACE (concat(project_id, '/', CAST(year(start_date) * 12 + month(start_date) AS VARCHAR)) AS project_id) FROM tasks),
""" + CREWS_SQL.strip().replace("FROM tasks", "FROM periods"))
def crew_handoffs(tasks):
    monthly = tasks.selectExpr(
        "* except (project_id)",
        "concat(project_id, '/', cast(year(start_date) * 12 + month(start_date) as string)) project_id",
    )
    return programme.crew_handoffs(programme.crew_coordination(monthly)).selectExpr(
        "project_id", "from_crew", "to_crew", "cast(handoff_date as string) handoff_date",
        "array_join(from_tasks, ', ') from_tasks", "array_join(to_tasks, ', ') to_tasks",
    )


@query("critical_path", "tasks", """
SELECT project_id, task_id, task_name, CAST(start_date AS VARCHAR) start_date, CAST(end_date AS VARCHAR) end_date, percent_complete
FROM tasks WHERE critical""")
def critical_path(tasks):
    return programme.critical_path(tasks).selectExpr(
        "project_id", "task_id", "task_name", "cast(start_date as string) start_date", "cast(end_date as string) end_date", "percent_complete"
    )


@query("critical_from_float", "tasks", """
SELECT project_id, task_id, total_float IS NULL OR total_float <= 0 AS critical,
       CASE WHEN total_float IS NULL OR total_float <= 0 THEN 'Critical Path' ELSE 'Non-Critical' END path_status
FROM tasks""")
def critical_from_float(tasks):
    return programme.critical_from_float(tasks.drop("critical")).select("project_id", "task_id", "critical", "path_status")


@query("milestones", "tasks", """
SELECT project_id, task_id, end_date - start_date AS duration_days,
       (end_date - start_date) <= 1 OR (critical AND (end_date - start_date) <= 5) AS is_milestone,
       critical AND (end_date - start_date) <= 5 AS is_critical_milestone
FROM tasks""")
def milestones(tasks):
    return programme.milestones(tasks).selectExpr(
        "project_id", "task_id", "cast(duration_days as bigint) duration_days", "is_milestone", "is_critical_milestone"
    )


@query("progress_dates", "tasks", """
SELECT project_id, task_id, strftime(CAST(start_date AS TIMESTAMP) + to_seconds(CAST((end_date - start_date) * 86400 * percent_complete / 100 AS BIGINT)), '%Y-%m-%d %H:%M:%S') progress_end
FROM tasks WHERE percent_complete > 0 AND end_date > start_date""")
def progress_dates(tasks):
    return programme.progress_dates(tasks).selectExpr(
        "project_id", "task_id", "date_format(progress_end, 'yyyy-MM-dd HH:mm:ss') progress_end"
    )


@query("potential_delays", "tasks", f"""
SELECT project_id, task_id, task_name, percent_complete, CAST(end_date AS VARCHAR) end_date, {DAY} - end_date AS days_behind,
       CASE WHEN {DAY} - end_date > 30 THEN 'HIGH' WHEN {DAY} - end_date > 14 THEN 'MEDIUM' ELSE 'LOW' END delay_severity, critical, budget_cost
FROM tasks WHERE percent_complete > 0 AND percent_complete < 100 AND end_date < {DAY}""")
def potential_delays(tasks):
    return programme.potential_delays(tasks, as_of=AS_OF_DATE).selectExpr(
        "project_id", "task_id", "task_name", "percent_complete", "cast(end_date as string) end_date",
        "cast(days_behind as bigint) days_behind", "delay_severity", "critical", "budget_cost",
    )


@query("behind_plan", "tasks", """
SELECT project_id, task_id, task_name, percent_complete, round(planned, 6) planned_progress, 'In Progress' AS status
FROM planned WHERE percent_complete < planned * 0.8""", f"""
planned AS (SELECT *, greatest(0.0, least(100.0, CAST({DAY} - start_date AS DOUBLE) / original_duration * 100)) planned
            FROM tasks WHERE percent_complete > 0 AND percent_complete < 100)""")
def behind_plan(tasks):
    return programme.behind_plan(tasks, as_of=AS_OF_DATE).selectExpr(
        "project_id", "task_id", "task_name", "percent_complete", "round(planned_progress, 6) planned_progress", "status"
    )


LOOKAHEAD_SQL = f"""
ahead AS (SELECT *, CASE WHEN start_date <= {DAY} + 7 AND end_date >= {DAY} THEN 'this_week'
                         WHEN start_date > {DAY} + 7 AND start_date <= {DAY} + 28 THEN 'upcoming' ELSE 'other' END period
          FROM tasks WHERE (start_date >= {DAY} AND start_date <= {DAY} + 28) OR (end_date >= {DAY} AND end_date <= {DAY} + 28)
                        OR (start_date <= {DAY} AND end_date >= {DAY}))"""


@query("lookahead", "tasks", """
SELECT project_id, task_id, CAST(start_date AS VARCHAR) start_date, CAST(end_date AS VARCHAR) end_date, period FROM ahead""", LOOKAHEAD_SQL)
def lookahead(tasks):
    return programme.lookahead(tasks, as_of=AS_OF_DATE).selectExpr(
        "project_id", "task_id", "cast(start_date as string) start_date", "cast(end_date as string) end_date", "period"
    )


@query("lookahead_crews", "tasks", """
SELECT project_id, resource_crew, count(*) activities FROM ahead GROUP BY 1, 2""", LOOKAHEAD_SQL)
def lookahead_crews(tasks):
    return programme.lookahead_crews(tasks, as_of=AS_OF_DATE)


DELAY_SQL = f"""
followed AS (SELECT DISTINCT project_id, succ_task_id FROM relationships),
marked AS (SELECT t.*, f.succ_task_id IS NOT NULL AS has_pred, {sql_any('lower(task_name)', V.DELAY_OUTDOOR_WORDS)} AS outdoor,
                  {sql_any('lower(task_name)', V.WEATHER_SENSITIVE_WORDS)} AS sensitive, start_date - {DAY} AS until
           FROM tasks t LEFT JOIN followed f ON f.project_id = t.project_id AND f.succ_task_id = t.task_id WHERE percent_complete < 100),
scores AS (SELECT *, CAST(critical AS INT) * 30 + CAST(outdoor AS INT) * 20 + CAST(sensitive AS INT) * 15 + CAST(has_pred AS INT) * 15
                  + CASE WHEN percent_complete = 0 THEN 20 WHEN percent_complete < 50 THEN 10 ELSE 0 END
                  + CASE WHEN until > 0 AND until < 7 THEN 10 WHEN until > 0 AND until < 14 THEN 5 ELSE 0 END AS score FROM marked),
scored AS (SELECT *, CASE WHEN score >= 50 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END risk_level,
                  concat_ws(', ', CASE WHEN critical THEN 'Critical Path' END, CASE WHEN outdoor THEN 'Outdoor Work' END,
                            CASE WHEN sensitive THEN 'Weather Sensitive' END, CASE WHEN has_pred THEN 'Has Predecessors' END,
                            CASE WHEN percent_complete = 0 THEN 'Not Started' WHEN percent_complete < 50 THEN 'Low Progress' END,
                            CASE WHEN until > 0 AND until < 14 THEN 'Imminent Start' END) risk_factors FROM scores),
counts AS (SELECT project_id, count(*) total_at_risk, count(*) FILTER (risk_level = 'HIGH') high_risk, count(*) FILTER (risk_level = 'MEDIUM') medium_risk,
                  count(*) FILTER (risk_level = 'LOW') low_risk, count(*) FILTER (critical AND risk_level IN ('HIGH', 'MEDIUM')) critical_at_risk,
                  avg(score) avg_risk_score FROM scored GROUP BY project_id),
top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, task_id) risk_rank FROM scored QUALIFY risk_rank <= 15)"""


@query("delay_risk", "tasks relationships", """
SELECT project_id, task_id, score delay_risk_score, risk_level, risk_factors FROM scored""", DELAY_SQL)
def delay_risk(tasks, relationships):
    return programme.delay_risk(tasks, relationships, as_of=AS_OF_DATE).selectExpr(
        "project_id", "task_id", "delay_risk_score", "risk_level", "array_join(risk_factors, ', ') risk_factors"
    )


@query("has_predecessors", "tasks relationships", """
SELECT t.project_id, t.task_id, EXISTS (SELECT 1 FROM relationships r WHERE r.project_id = t.project_id AND r.succ_task_id = t.task_id) AS has_predecessors
FROM tasks t""")
def has_predecessors(tasks, relationships):
    return programme.with_predecessors(tasks, relationships).select("project_id", "task_id", "has_predecessors")


@query("delay_risk_summary", "tasks relationships", """
SELECT project_id, total_at_risk, high_risk, medium_risk, low_risk, critical_at_risk, round(avg_risk_score, 6) avg_risk_score FROM counts""", DELAY_SQL)
def delay_risk_summary(tasks, relationships):
    scored = programme.delay_risk(tasks, relationships, as_of=AS_OF_DATE)
    return programme.delay_risk_summary(scored).selectExpr("* except (avg_risk_score)", "round(avg_risk_score, 6) avg_risk_score")


@query("delay_risk_top", "tasks relationships", """
SELECT project_id, CAST(risk_rank AS INT) risk_rank, task_id, task_name, score delay_risk_score, risk_level FROM top""", DELAY_SQL)
def delay_risk_top(tasks, relationships):
    scored = programme.delay_risk(tasks, relationships, as_of=AS_OF_DATE)
    return programme.delay_risk_top(scored).select("project_id", "risk_rank", "task_id", "task_name", "delay_risk_score", "risk_level")


def _sql_lines(lines):
    """Lines as one SQL text."""
    return "concat_ws(chr(10), " + ", ".join("'" + line.replace("'", "''") + "'" for line in lines) + ")"


@query("report_text", "tasks relationships", """
SELECT project_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY project_id""", DELAY_SQL + f""",
lines AS (
  SELECT project_id, 0 pos, concat('DELAY RISK PREDICTION REPORT', chr(10), repeat('=', 70), chr(10), chr(10), 'RISK SUMMARY', chr(10), repeat('-', 70), chr(10),
         '  Total Tasks at Risk: ', total_at_risk, chr(10), '  High Risk: ', high_risk, chr(10), '  Medium Risk: ', medium_risk, chr(10), '  Low Risk: ', low_risk, chr(10),
         '  Critical Tasks at Risk: ', critical_at_risk, chr(10), '  Average Risk Score: ', printf('%.1f', avg_risk_score), chr(10), chr(10), 'TOP 15 HIGHEST RISK ACTIVITIES', chr(10), repeat('-', 70)) AS line FROM counts
  UNION ALL
  SELECT project_id, risk_rank, concat(chr(10), risk_rank, '. ', CASE WHEN critical THEN '[CRITICAL]' ELSE '' END, ' [', task_id, '] ', task_name, chr(10),
         '   Risk Score: ', score, '/100 (', risk_level, ')', chr(10), '   Start: ', CAST(start_date AS VARCHAR), ' | Progress: ', CAST(percent_complete AS VARCHAR), '%', chr(10),
         '   Risk Factors: ', risk_factors) FROM top
  UNION ALL
  SELECT project_id, 99, concat(chr(10), repeat('-', 70), chr(10), 'RECOMMENDATIONS', chr(10), repeat('-', 70), chr(10), {_sql_lines(V.DELAY_REPORT_ADVICE)}) FROM counts
  UNION ALL
  SELECT DISTINCT project_id, 0, '{V.NO_TASK_AT_RISK}' FROM tasks WHERE project_id NOT IN (SELECT project_id FROM counts))""")
def report_text(tasks, relationships):
    return render.delay_risk_report(programme.delay_risk(tasks, relationships, as_of=AS_OF_DATE), projects=tasks)


_MONTHS = ", ".join(f"({m}, {rain}, '{name}')" for m, rain, _, _, name in V.MONTH_WEATHER)
WEATHER_SQL = f"""
months(m, rain, name) AS (VALUES {_MONTHS}),
outside AS (SELECT t.*, {sql_any('lower(task_name)', V.WEATHER_OUTDOOR_WORDS)} AS is_outdoor, coalesce(rain, 5) rain_days, coalesce(name, 'Unknown') month_name
            FROM tasks t LEFT JOIN months ON m = month(start_date)
            WHERE start_date >= {DAY} AND start_date <= {DAY} + 60 AND percent_complete < 100),
weather AS (SELECT *, CASE WHEN NOT is_outdoor THEN 'LOW' WHEN rain_days >= 10 THEN 'HIGH' WHEN rain_days >= 7 THEN 'MEDIUM' ELSE 'LOW' END risk_level FROM outside),
medium AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rain_days DESC, task_id) n FROM weather WHERE risk_level = 'MEDIUM' QUALIFY n <= 10)"""


@query("weather_risk", "tasks", """
SELECT project_id, task_id, is_outdoor, rain_days, month_name, risk_level FROM weather""", WEATHER_SQL)
def weather_risk(tasks):
    return programme.weather_risk(tasks, as_of=AS_OF_DATE).select("project_id", "task_id", "is_outdoor", "rain_days", "month_name", "risk_level")


@query("weather_risk_summary", "tasks", """
SELECT project_id, count(*) total_activities, count(*) FILTER (risk_level = 'HIGH') high_risk, count(*) FILTER (risk_level = 'MEDIUM') medium_risk,
       count(*) FILTER (risk_level = 'LOW') low_risk, count(*) FILTER (critical AND risk_level IN ('HIGH', 'MEDIUM')) critical_at_risk
FROM weather GROUP BY project_id""", WEATHER_SQL)
def weather_risk_summary(tasks):
    return programme.weather_risk_summary(programme.weather_risk(tasks, as_of=AS_OF_DATE))


@query("weather_report", "tasks", f"""
SELECT project_id, 0 AS section, 0 AS pos, NULL AS task_id, concat('WEATHER RISK ANALYSIS REPORT', chr(10), repeat('=', 60), chr(10), 'Period: Next 60 days', chr(10), 'Total upcoming activities: ', count(*), chr(10)) AS line
FROM weather GROUP BY 1
UNION ALL SELECT DISTINCT project_id, 0, 0, NULL, '{V.NO_UPCOMING_TASK}' FROM tasks WHERE project_id NOT IN (SELECT project_id FROM weather)
UNION ALL SELECT project_id, 1, 0, NULL, concat('HIGH RISK ACTIVITIES (', count(*), '):', chr(10), repeat('-', 40)) FROM weather WHERE risk_level = 'HIGH' GROUP BY 1
UNION ALL
SELECT project_id, 1, 1, task_id, concat('  [', task_id, '] ', task_name, chr(10), '      Start: ', CAST(start_date AS VARCHAR), ' (', month_name, ')', chr(10),
       '      Expected rain days: ', rain_days, chr(10), '      Recommendation: Plan indoor work or add contingency', chr(10)) FROM weather WHERE risk_level = 'HIGH'
UNION ALL SELECT project_id, 2, 0, NULL, concat(chr(10), 'MEDIUM RISK ACTIVITIES (', count(*), '):', chr(10), repeat('-', 40)) FROM weather WHERE risk_level = 'MEDIUM' GROUP BY 1
UNION ALL
SELECT project_id, 2, 1, task_id, concat('  [', task_id, '] ', task_name, ' - ', month_name, ' (', rain_days, ' rain days)') FROM medium
UNION ALL SELECT DISTINCT project_id, 3, 0, NULL, concat(chr(10), 'RECOMMENDATIONS:', chr(10), repeat('-', 40), chr(10), {_sql_lines(V.WEATHER_REPORT_ADVICE)}) FROM weather""", WEATHER_SQL)
def weather_report(tasks):
    return render.weather_lines(programme.weather_risk(tasks, as_of=AS_OF_DATE), projects=tasks).select("project_id", "section", "pos", "task_id", "line")


@query("lookahead_report", "tasks", f"""
SELECT DISTINCT project_id, 0 AS section, 0 AS pos, NULL AS task_id, concat('4-WEEK LOOK-AHEAD REPORT', chr(10), 'Generated: ', {DAY}, ' | Period: ', {DAY}, ' to ', {DAY} + 28, chr(10), repeat('=', 70), chr(10)) AS line FROM tasks
UNION ALL SELECT DISTINCT project_id, 1, 0, NULL, concat('THIS WEEK (', {DAY}, ' to ', {DAY} + 7, '):', chr(10), repeat('-', 70)) FROM tasks
UNION ALL SELECT DISTINCT project_id, 1, 1, NULL, '{V.NO_TASK_THIS_WEEK}' FROM tasks WHERE project_id NOT IN (SELECT project_id FROM ahead WHERE period = 'this_week')
UNION ALL
SELECT project_id, 1, 1, task_id, concat('  ', CASE WHEN critical THEN '[CRITICAL]' ELSE '' END, ' [', task_id, '] ', task_name, chr(10),
       '      Crew: ', resource_crew, ' | Progress: ', CAST(percent_complete AS VARCHAR), '%', chr(10), '      ', CAST(start_date AS VARCHAR), ' to ', CAST(end_date AS VARCHAR), chr(10))
FROM ahead WHERE period = 'this_week'
UNION ALL SELECT DISTINCT project_id, 2, 0, NULL, concat(chr(10), 'UPCOMING (Next 3 Weeks):', chr(10), repeat('-', 70)) FROM ahead WHERE period = 'upcoming'
UNION ALL
SELECT project_id, 2, 1, task_id, concat('  ', CASE WHEN critical THEN '[CRITICAL]' ELSE '' END, ' [', task_id, '] ', task_name, chr(10),
       '      Starts: ', CAST(start_date AS VARCHAR), ' | Crew: ', resource_crew) FROM ahead WHERE period = 'upcoming'
UNION ALL SELECT DISTINCT project_id, 3, 0, NULL, concat(chr(10), 'REQUIRED RESOURCES:', chr(10), repeat('-', 70)) FROM tasks
UNION ALL
SELECT project_id, 3, 1, resource_crew, concat('  ', resource_crew, ': ', count(*), ' activities') FROM ahead GROUP BY 1, resource_crew""", LOOKAHEAD_SQL)
def lookahead_report(tasks):
    return render.lookahead_lines(tasks, as_of=AS_OF_DATE).select("project_id", "section", "pos", "task_id", "line")


@query("coordination_report", "tasks", f"""
SELECT DISTINCT project_id, 0 AS section, 0 AS pos, NULL AS key, NULL AS second_key, concat('SUBCONTRACTOR COORDINATION REPORT', chr(10), repeat('=', 60), chr(10), chr(10), 'CREW SCHEDULE SUMMARY:', chr(10), repeat('-', 60)) AS line FROM crews
UNION ALL
SELECT project_id, 1, 0, crew, '', concat(chr(10), crew, ':', chr(10), '  Tasks: ', tasks, ' | Avg Progress: ', printf('%.1f', avg_progress), '%', chr(10),
       '  Period: ', CAST(first_start AS VARCHAR), ' to ', CAST(last_end AS VARCHAR)) line FROM crews
UNION ALL
SELECT p.project_id, 2, 0, NULL, NULL, concat(chr(10), chr(10), 'UPCOMING HANDOFFS (', count(h.n), ' identified):', chr(10), repeat('-', 60)) FROM (SELECT DISTINCT project_id FROM crews) p LEFT JOIN handed h ON h.project_id = p.project_id GROUP BY 1
UNION ALL SELECT DISTINCT project_id, 2, 1, NULL, NULL, '{V.NO_HANDOFF}' FROM crews WHERE project_id NOT IN (SELECT project_id FROM handed)
UNION ALL
SELECT project_id, 2, 1, from_crew, to_crew, concat(chr(10), '  ', CAST(day AS VARCHAR), ': ', from_crew, ' -> ', to_crew, chr(10), '    From: ', from_tasks, chr(10), '    To: ', to_tasks)
FROM handed WHERE n <= 10
UNION ALL SELECT DISTINCT project_id, 3, 0, NULL, NULL, concat(chr(10), 'COORDINATION ACTIONS:', chr(10), repeat('-', 60), chr(10), {_sql_lines(V.COORDINATION_ACTIONS)}) FROM crews""", CREWS_SQL.strip() + """,
handed AS (SELECT a.project_id, a.crew from_crew, b.crew to_crew, a.last_end AS day, a.first_tasks from_tasks, b.first_tasks to_tasks, row_number() OVER (PARTITION BY a.project_id ORDER BY a.crew, b.crew) n
           FROM crews a JOIN crews b ON a.project_id = b.project_id AND a.crew < b.crew AND abs(a.last_end - b.first_start) <= 7)""")
def coordination_report(tasks):
    return render.coordination_lines(tasks).select("project_id", "section", "pos", "key", "second_key", "line")


CLAIM_SQL = """
pairs AS (SELECT DISTINCT event_id, project_id, task_id FROM event_tasks),
hits AS (SELECT p.event_id, count(*) affected, count(*) FILTER (critical) critical_affected, sum(budget_cost) budget, avg(original_duration) mean
         FROM pairs p JOIN tasks t ON t.project_id = p.project_id AND t.task_id = p.task_id GROUP BY 1),
impact AS (SELECT e.*, affected, critical_affected, event_end - event_start AS days, budget * ((event_end - event_start) / mean) AS cost,
                  CASE WHEN critical_affected > 0 THEN event_end - event_start ELSE 0 END AS impact_days,
                  CASE WHEN lower(cause) LIKE '%owner%' OR lower(cause) LIKE '%design%' THEN 'High'
                       WHEN lower(cause) LIKE '%force majeure%' OR lower(cause) LIKE '%weather%' THEN 'Medium-High'
                       WHEN lower(cause) LIKE '%contractor%' THEN 'Low' ELSE 'Medium' END AS eligibility
           FROM delay_events e JOIN hits USING (event_id)),
claims AS (SELECT *, CASE eligibility WHEN 'High' THEN 'EOT (Extension of Time)' WHEN 'Medium-High' THEN 'EOT + Acceleration Costs'
                                      WHEN 'Low' THEN 'None - Contractor responsible' ELSE 'EOT Review Required' END AS kind,
                  CASE WHEN impact_days = 0 THEN 'Monitor for cumulative impact. No immediate action required.'
                       WHEN eligibility = 'High' THEN 'Submit time extension request with CPM analysis immediately. Document all impacts.'
                       WHEN eligibility = 'Medium-High' THEN 'Document delay with daily logs and weather records. Prepare contingency claim.'
                       WHEN eligibility = 'Medium' THEN 'Review contract terms for notification requirements. File preliminary notice.'
                       ELSE 'Accelerate to recover schedule. No delay claim available.' END AS action FROM impact)"""


@query("delay_claims", "delay_events event_tasks tasks", """
SELECT event_id, project_id, cause, affected, critical_affected, days AS duration_days, impact_days AS schedule_impact_days, round(cost, 4) cost_impact_estimate,
       eligibility AS claim_eligibility, kind AS claim_type, action AS recommended_action FROM claims""", CLAIM_SQL)
def delay_claims(events, event_tasks, tasks):
    return programme.delay_claims(events, event_tasks, tasks).selectExpr(
        "event_id", "project_id", "cause", "affected", "critical_affected", "cast(duration_days as bigint) duration_days",
        "cast(schedule_impact_days as bigint) schedule_impact_days", "round(cost_impact_estimate, 4) cost_impact_estimate",
        "claim_eligibility", "claim_type", "recommended_action",
    )


@query("claim_report", "delay_events event_tasks tasks", f"""
SELECT event_id, concat('DELAY CLAIM ANALYSIS REPORT', chr(10), repeat('=', 70), chr(10), chr(10), 'Event: ', event_id, chr(10), 'Cause: ', cause, chr(10), 'Duration: ', days, ' days', chr(10), chr(10),
       repeat('-', 70), chr(10), 'IMPACT ANALYSIS', chr(10), repeat('-', 70), chr(10),
       '  Activities Affected: ', affected, chr(10), '  Critical Activities Affected: ', critical_affected, chr(10), '  Schedule Impact: ', impact_days, ' days', chr(10),
       '  Estimated Cost Impact: $', format('{{:,.2f}}', cost), chr(10), chr(10), repeat('-', 70), chr(10), 'CLAIM ASSESSMENT', chr(10), repeat('-', 70), chr(10),
       '  Claim Type: ', kind, chr(10), '  Eligibility: ', eligibility, chr(10), '  Recommended Action: ', action, chr(10), chr(10),
       repeat('-', 70), chr(10), 'REQUIRED DOCUMENTATION', chr(10), repeat('-', 70), chr(10), {_sql_lines(V.CLAIM_REPORT_DOCUMENTS)}) AS text FROM claims""", CLAIM_SQL)
def claim_report(events, event_tasks, tasks):
    return render.claim_report(programme.delay_claims(events, event_tasks, tasks))


@query("activity_table", "tasks", """
SELECT project_id, task_id AS "Task ID", task_name AS "Task Name", CAST(start_date AS VARCHAR) AS "Start", CAST(end_date AS VARCHAR) AS "Finish",
       CAST(end_date - start_date AS INT) AS "Duration", percent_complete AS "% Complete", total_float AS "Total Float", CASE WHEN critical THEN 'Yes' ELSE 'No' END AS "Critical"
FROM tasks""")
def activity_table(tasks):
    return programme.activity_table(programme.activity_list(tasks))


@query("task_status", "tasks", """
SELECT project_id, task_id, CASE WHEN percent_complete = 100 THEN 'Complete' WHEN percent_complete > 0 THEN 'In Progress' ELSE 'Not Started' END AS status,
       round(original_duration * (1 - percent_complete / 100), 6) AS remaining_duration FROM tasks""")
def task_status(tasks):
    return programme.with_status(tasks).selectExpr("project_id", "task_id", "status", "round(remaining_duration, 6) remaining_duration")


@query("date_parsing", "tasks", """
SELECT project_id, task_id, CASE WHEN task_no % 3 = 2 THEN 'none' ELSE CAST(start_date AS VARCHAR) END AS start_date FROM tasks""")
def date_parsing(tasks):
    text = F.expr("case task_no % 3 when 0 then cast(start_date as string) when 1 then concat(cast(start_date as string), ' 07:30:00') else 'soon' end")
    return tasks.select("project_id", "task_id", F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), F.lit("none")).alias("start_date"))


@query("schedule_context", "tasks resources", """
SELECT project_id, string_agg(line, chr(10) ORDER BY section, pos) AS text FROM lines GROUP BY project_id""", SUMMARY_SQL.strip() + """,
firsts AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_date, task_id) pos FROM tasks QUALIFY pos <= 50),
costs AS (SELECT project_id, resource_name, concat(CAST(sum(cost_per_unit) AS BIGINT), '.0') cost FROM resources GROUP BY 1, 2),
wide AS (SELECT project_id, greatest(max(length(resource_name)), 13) AS a, greatest(max(length(cost)), 13) AS b FROM costs GROUP BY 1),
lines AS (
  SELECT project_id, 0 AS section, 0 AS pos, concat_ws(chr(10), '=== CONSTRUCTION SCHEDULE DATA ===', '', 'Schedule Summary:', '- Total Tasks: ' || total_tasks, '- Completed: ' || completed,
         '- In Progress: ' || in_progress, '- Not Started: ' || not_started, '- Critical Tasks: ' || critical_tasks, '- Total Budget: $' || format('{:,.2f}', total_budget),
         '- Actual Spent: $' || format('{:,.2f}', actual_spent), '- Overall Progress: ' || printf('%.1f', CASE WHEN total_budget > 0 THEN actual_spent / total_budget * 100 ELSE 0 END) || '%',
         '- Project Start: ' || CAST(start_date AS VARCHAR), '- Project End: ' || CAST(end_date AS VARCHAR), '', '=== TASK DETAILS ===') AS line FROM summary
  UNION ALL
  SELECT project_id, 1, pos, concat(CASE WHEN pos > 1 THEN chr(10) ELSE '' END, concat_ws(chr(10), concat('Task ', task_id, ': ', task_name),
         concat('  WBS: ', wbs, ', Status: ', CASE WHEN percent_complete = 100 THEN 'Complete' WHEN percent_complete > 0 THEN 'In Progress' ELSE 'Not Started' END, ', Progress: ', CAST(percent_complete AS VARCHAR), '%'),
         concat('  Duration: ', original_duration, ' days, Remaining: ', printf('%.1f', original_duration * (1 - percent_complete / 100)), ' days'),
         concat('  Budget: $', format('{:,.2f}', budget_cost), ', Actual: $', format('{:,.2f}', actual_cost)),
         concat('  Start: ', CAST(start_date AS VARCHAR), ', End: ', CAST(end_date AS VARCHAR)),
         concat('  Critical: ', CASE WHEN critical THEN 'Yes' ELSE 'No' END, ', Float: ', printf('%.1f', total_float), ' days'), concat('  Crew: ', resource_crew))) FROM firsts
  UNION ALL
  SELECT project_id, 2, 0, concat(chr(10), '=== RESOURCE ALLOCATIONS ===', chr(10), lpad('resource_name', CAST(a AS INT), ' '), ' ', lpad('cost_per_unit', CAST(b AS INT), ' ')) FROM wide
  UNION ALL
  SELECT c.project_id, 2, row_number() OVER (PARTITION BY c.project_id ORDER BY resource_name), concat(lpad(resource_name, CAST(a AS INT), ' '), ' ', lpad(cost, CAST(b AS INT), ' ')) FROM costs c JOIN wide w ON w.project_id = c.project_id)""")
def schedule_context(tasks, resources):
    return render.schedule_context(tasks, resources)


_LINK_SQL = " UNION ALL ".join(
    f"SELECT project_id, path, '{p}' AS prefix FROM images WHERE {sql_any('lower(name)', words)}" for p, words in V.PHOTO_WORDS.items()
)
PHOTO_SQL = f"""
images AS (SELECT project_id, path, string_split(path, '/')[-1] AS name FROM photos WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|bmp)$')),
links AS ({_LINK_SQL})"""


@query("photo_links", "photos", "SELECT project_id, path, prefix FROM links", PHOTO_SQL)
def photo_links(found):
    return photos.link_photos(found)


@query("photo_report", "photos tasks", """
SELECT n.project_id, n.prefix, coalesce(f.task_name, 'Unknown') AS task_name, coalesce(f.percent_complete, 0) AS percent_complete, n.photos
FROM (SELECT project_id, prefix, count(*) photos FROM links GROUP BY 1, 2) n LEFT JOIN firsts f ON f.project_id = n.project_id AND f.prefix = n.prefix""",
       PHOTO_SQL.strip() + """,
firsts AS (SELECT project_id, left(task_id, 4) AS prefix, task_name, percent_complete FROM tasks WHERE length(task_id) >= 4
           QUALIFY row_number() OVER (PARTITION BY project_id, left(task_id, 4) ORDER BY start_date, task_id) = 1)""")
def photo_report(found, tasks):
    return photos.photo_counts(photos.link_photos(found), tasks)


@query("activity_photos", "photos tasks", """
SELECT t.project_id, t.task_id, coalesce(n.photos, 0) AS photos
FROM tasks t LEFT JOIN (SELECT project_id, prefix, count(*) photos FROM links GROUP BY 1, 2) n
  ON n.project_id = t.project_id AND n.prefix = CASE WHEN length(t.task_id) >= 4 THEN left(t.task_id, 4) ELSE left(t.task_id, 2) END""", PHOTO_SQL)
def activity_photos(found, tasks):
    return photos.activity_photo_counts(tasks, photos.link_photos(found))


@query("photo_report_text", "photos tasks", f"""
SELECT DISTINCT project_id, 0 AS section, '' AS prefix, 0 AS pos, '' AS photo, concat('PROGRESS PHOTO MAPPING REPORT', chr(10), repeat('=', 60), chr(10)) AS line, 1 AS copies FROM links
UNION ALL SELECT DISTINCT project_id, 0, '', 0, '', '{V.NO_PHOTO}', 1 FROM tasks WHERE project_id NOT IN (SELECT project_id FROM links)
UNION ALL SELECT project_id, 1, prefix, 0, '', concat('[', prefix, 'xxx] ', task_name, chr(10), '   Progress: ', CAST(percent_complete AS VARCHAR), '%', chr(10), '   Photos: ', photos), 1 FROM heads
UNION ALL SELECT project_id, 1, prefix, 1, string_split(path, '/')[-1], concat('      - ', string_split(path, '/')[-1]), count(*) FROM links GROUP BY ALL
UNION ALL SELECT project_id, 1, prefix, 2, '', '', 1 FROM heads""", PHOTO_SQL.strip() + """,
firsts AS (SELECT project_id, left(task_id, 4) AS prefix, task_name, percent_complete FROM tasks WHERE length(task_id) >= 4
           QUALIFY row_number() OVER (PARTITION BY project_id, left(task_id, 4) ORDER BY start_date, task_id) = 1),
heads AS (SELECT n.project_id, n.prefix, coalesce(f.task_name, 'Unknown') AS task_name, coalesce(f.percent_complete, CAST(0 AS DOUBLE)) AS percent_complete, n.photos
FROM (SELECT project_id, prefix, count(*) photos FROM links GROUP BY 1, 2) n LEFT JOIN firsts f ON f.project_id = n.project_id AND f.prefix = n.prefix)""")
def photo_report_text(found, tasks):
    lines = photos.photo_report_lines(photos.link_photos(found), tasks)
    return lines.groupBy("project_id", "section", "prefix", "pos", "photo", "line").agg(F.count(F.lit(1)).alias("copies"))
