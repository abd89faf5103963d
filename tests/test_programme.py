import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundplan.operators import programme
from groundplan.sources import photos

TASKS = (
    "project_id string, task_id string, task_name string, wbs string, start_date date, end_date date, original_duration int, "
    "percent_complete double, budget_cost double, actual_cost double, total_float double, critical boolean, resource_crew string"
)


def day(text):
    return dt.date.fromisoformat(text)


def task(task_id, start, end, percent=0.0, budget=100.0, actual=0.0, critical=False, crew="A", name="Concrete Pour", project="P1"):
    first, last = day(start), day(end)
    return (project, task_id, name, "1.0", first, last, (last - first).days, percent, budget, actual, 0.0 if critical else 5.0, critical, crew)


@pytest.fixture()
def tasks(frame):
    return frame(
        [
            task("1", "2024-01-01", "2024-01-11", 100.0, 100.0, 90.0, True, "A", "Excavation"),
            task("2", "2024-01-05", "2024-01-25", 50.0, 200.0, 110.0, False, "A"),
            task("3", "2024-01-20", "2024-02-20", 0.0, 400.0, 0.0, True, "B", "Interior fit-out"),
            task("4", "2024-03-01", "2024-03-02", 0.0, 50.0, 0.0, False, None, "Handover"),
        ],
        TASKS,
    )


def test_evm_identities(tasks):
    r = programme.evm_metrics(tasks, as_of="2024-01-31").first()
    assert (r.pv, r.ev, r.ac, r.bac) == (700.0, 200.0, 200.0, 750.0)
    assert r.spi == pytest.approx(200 / 700) and r.cpi == 1.0
    assert r.schedule_status == "Behind Schedule" and r.cost_status == "On Budget"
    assert r.eac == r.bac / r.cpi and r.vac == r.bac - r.eac and r.sv == r.ev - r.pv and r.cv == r.ev - r.ac
    assert r.tcpi == pytest.approx(550 / 550)


def test_evm_without_value_is_neutral(frame):
    rows = frame([task("1", "2025-01-01", "2025-01-02", 0.0, 0.0, 0.0)], TASKS)
    r = programme.evm_metrics(rows, as_of="2024-01-31").first()
    assert (r.spi, r.cpi, r.tcpi, r.percent_complete) == (1.0, 1.0, 1.0, 0.0)


def test_s_curve_follows_its_definition(tasks):
    rows = {r.day: r for r in programme.s_curve(tasks).collect()}
    source = tasks.collect()
    assert min(rows) == day("2024-01-01") and max(rows) == day("2024-03-02") and len(rows) == 62
    for d, r in rows.items():
        pv = sum(t.budget_cost for t in source if t.start_date <= d)
        ev = sum(t.budget_cost for t in source if t.end_date <= d)
        ev += sum(t.budget_cost * t.percent_complete / 100 for t in source if t.start_date <= d < t.end_date)
        assert r.planned_value == pytest.approx(pv) and r.earned_value == pytest.approx(ev)
    assert rows[max(rows)].planned_value == 750.0


def test_potential_delays_of_nothing_keep_their_columns(tasks):
    out = programme.potential_delays(tasks, as_of="2020-01-01")
    assert out.count() == 0 and "delay_severity" in out.columns


def test_behind_plan(tasks):
    r = programme.behind_plan(tasks, as_of="2024-01-21").collect()
    assert [(x.task_id, x.planned_progress) for x in r] == [("2", 80.0)]
    assert programme.behind_plan(tasks, as_of="2024-01-17").collect() == []


def test_crew_without_a_name_is_unassigned(tasks):
    crews = {r.crew: r for r in programme.crew_coordination(tasks).collect()}
    assert set(crews) == {"A", "B", "Unassigned"}
    assert crews["A"].tasks == 2 and crews["A"].critical_tasks == 1 and crews["A"].first_tasks == ["Excavation", "Concrete Pour"]


def test_handoffs_equal_all_pairs(spark, frame):
    import random

    rng = random.Random(3)
    crews = []
    for i in range(60):
        start = day("2024-01-01") + dt.timedelta(days=rng.randrange(200))
        crews.append((f"P{i % 2}", f"crew{i:02d}", start, start + dt.timedelta(days=rng.randrange(40)), ["x"]))
    df = frame(crews, "project_id string, crew string, first_start date, last_end date, first_tasks array<string>")
    expected = {
        (a[0], a[1], b[1]) for a in crews for b in crews if a[0] == b[0] and a[1] < b[1] and abs((a[3] - b[2]).days) <= 7
    }
    got = [(r.project_id, r.from_crew, r.to_crew) for r in programme.crew_handoffs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_delay_risk_scores(tasks, frame):
    links = frame([("P1", "1", "3")], "project_id string, pred_task_id string, succ_task_id string")
    rows = {r.task_id: r for r in programme.delay_risk(tasks, links, as_of="2024-01-15").collect()}
    assert set(rows) == {"2", "3", "4"}
    # critical 30, follower 15, not started 20, starts in five days 10
    assert rows["3"].delay_risk_score == 75 and rows["3"].risk_level == "HIGH"
    assert rows["3"].risk_factors == ["Critical Path", "Has Predecessors", "Not Started", "Imminent Start"]
    assert rows["2"].delay_risk_score == 35 and rows["2"].risk_level == "MEDIUM"
    assert rows["4"].delay_risk_score == 20 and rows["4"].risk_level == "LOW"
    bare = {r.task_id: r.delay_risk_score for r in programme.delay_risk(tasks, None, as_of="2024-01-15").collect()}
    assert bare["3"] == 60


def test_claim_without_listed_tasks_takes_the_whole_project(tasks, frame):
    events = frame(
        [("e1", "P1", "Owner design change", day("2024-01-01"), day("2024-01-11")), ("e2", "P1", "Storm", day("2024-01-01"), day("2024-01-05"))],
        "event_id string, project_id string, cause string, event_start date, event_end date",
    )
    listed = frame([("e2", "P1", "2"), ("e2", "P1", "2"), ("e2", "P1", "gone")], "event_id string, project_id string, task_id string")
    rows = {r.event_id: r for r in programme.delay_claims(events, listed, tasks).collect()}
    whole, one = rows["e1"], rows["e2"]
    assert (whole.affected, whole.critical_affected, whole.schedule_impact_days, whole.claim_eligibility) == (4, 2, 10, "High")
    assert whole.cost_impact_estimate == pytest.approx(750 * 10 / ((10 + 20 + 31 + 1) / 4))
    assert whole.recommended_action.startswith("Submit time extension")
    assert (one.affected, one.critical_affected, one.schedule_impact_days, one.claim_type) == (1, 0, 0, "EOT Review Required")
    assert one.cost_impact_estimate == pytest.approx(200 * 4 / 20) and one.recommended_action.startswith("Monitor")


def test_lookahead_periods(tasks):
    rows = {r.task_id: r.period for r in programme.lookahead(tasks, as_of="2024-01-10").collect()}
    assert rows == {"1": "this_week", "2": "this_week", "3": "upcoming"}


def test_critical_flag_from_float(frame):
    rows = frame([("a", None), ("b", 0.0), ("c", 2.0)], "task_id string, total_float double")
    got = {r.task_id: r.path_status for r in programme.critical_from_float(rows).collect()}
    assert got == {"a": "Critical Path", "b": "Critical Path", "c": "Non-Critical"}


def test_photo_files(spark, tmp_path):
    for name in ("excavation_north.JPG", "steel_beam.png", "notes.txt", "lunch.jpg"):
        (tmp_path / name).write_bytes(b"x")
    found = photos.list_photos(spark, str(tmp_path))
    links = photos.link_photos(found.withColumn("project_id", F.lit("P1")))
    assert {(r.prefix, r.path.rsplit("/", 1)[1]) for r in links.collect()} == {("2000", "excavation_north.JPG"), ("3000", "steel_beam.png")}
    assert [r.photo for r in photos.activity_photos(links, "20001").collect()] == ["excavation_north.JPG"]


def test_activity_csv(spark, tasks, tmp_path):
    programme.write_activity_csv(tasks, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 4 and "Task Name" in back.columns and {r.Critical for r in back.collect()} == {"Yes", "No"}


def test_whole_reports(spark):
    import datetime as dt

    from groundplan.operators import programme, render

    day = lambda n: dt.date(2024, 7, 1) + dt.timedelta(days=n)
    tasks = spark.createDataFrame(
        [("P", "t1", "Excavation Zone", day(2), day(9), 12.5, True, "A"), ("P", "t2", "Painting", day(12), day(20), 0.0, False, "B"), ("Q", "t3", "Done", day(-90), day(-80), 100.0, False, "C")],
        "project_id string, task_id string, task_name string, start_date date, end_date date, percent_complete double, critical boolean, resource_crew string",
    )
    rows = render.lookahead_lines(tasks, as_of="2024-07-01").orderBy("project_id", "section", "pos", "start_date", "task_id").collect()
    text = {p: "\n".join(r.line for r in rows if r.project_id == p) for p in "PQ"}
    assert text["P"] == (
        "4-WEEK LOOK-AHEAD REPORT\nGenerated: 2024-07-01 | Period: 2024-07-01 to 2024-07-29\n" + "=" * 70 + "\n\nTHIS WEEK (2024-07-01 to 2024-07-08):\n" + "-" * 70
        + "\n  [CRITICAL] [t1] Excavation Zone\n      Crew: A | Progress: 12.5%\n      2024-07-03 to 2024-07-10\n\n\nUPCOMING (Next 3 Weeks):\n" + "-" * 70
        + "\n   [t2] Painting\n      Starts: 2024-07-13 | Crew: B\n\nREQUIRED RESOURCES:\n" + "-" * 70 + "\n  A: 1 activities\n  B: 1 activities"
    )
    assert "  No activities scheduled this week." in text["Q"] and "UPCOMING" not in text["Q"]
    weather = render.weather_lines(programme.weather_risk(tasks, as_of="2024-07-01"), projects=tasks).orderBy("project_id", "section", "pos").collect()
    assert [r.line for r in weather if r.project_id == "Q"] == ["No upcoming activities in the specified period."]
    assert weather[0].line.endswith("Total upcoming activities: 2\n") and weather[-2].line.startswith("\nRECOMMENDATIONS:\n")
    coordination = render.coordination_lines(tasks).filter("project_id = 'P'").orderBy("section", "pos", "key").collect()
    assert coordination[3].line == "\n\nUPCOMING HANDOFFS (1 identified):\n" + "-" * 60
    assert coordination[4].line == "\n  2024-07-10: A -> B\n    From: Excavation Zone\n    To: Painting"


def test_budget_rollup(spark):
    from groundplan.operators import programme

    tasks = spark.createDataFrame([("P", "1", 2.0, 1.0), ("P", "2", 3.0, 1.0), ("Q", "1", 5.0, None), ("Q", None, 7.0, 1.0)], "project_id string, wbs string, budget_cost double, actual_cost double")
    got = {(r.project_id, r.wbs, r.level): (r.budget_cost, r.tasks) for r in programme.budget_rollup(tasks).collect()}
    assert got[None, None, 2] == (17.0, 4) and got["Q", None, 1] == (12.0, 2) and got["Q", None, 0] == (7.0, 1) and got["P", "2", 0] == (3.0, 1)
