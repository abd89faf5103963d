import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from groundplan.operators import usage
from groundplan.sources import chunk_store, lab_files, schedule_export, sessions
from groundplan.streaming import events as stream

EXPORT = """ERMHDR\t1
%T\tPROJECT
%F\tproj_id
%R\t1
%T\tTASK
%F\ttask_id\ttask_name\twbs_id\ttask_start_date\ttask_finish_date\ttask_duration\ttask_pct_complete\ttask_cost\ttask_critical\ttask_status
%R\t10\tDig\t1.0\t2024-01-01\t2024-01-05 08:00:00\t4\t50\t100.5\tY\tActive
%R\t11\tPour\t1.1\tsoon\t\t\t\t\tN\tActive
%R\t12\tBad\t1.1\t2024-01-01\t2024-01-05\tx\t50\t1\tN\tActive
%R\t13\tShort
%T\tTASKPRED
%F\tpred_task_id\tsucc_task_id\tpred_task_type\tlag_hr_cnt
%R\t10\t11\tSS\t-30
%T\tTASKRSRC
%F\ttask_id\tresource_id\tresource_name\tresource_units\tresource_cost_per_unit
%R\t10\tR1\tCrane\t\t12.5
%E
"""
# the section name counts as the first field of its rows
LEGACY = """%T\tPROJECT\ttask_id\ttask_name\ttask_critical
P\t10\tDig\tY
P\t11\tPour\tN
11\tToo short

P\t12\tAfter a gap\tN
%T\tTASKPRED\tpred_task_id\tsucc_task_id
P\t10\t11
%T\tRES\ttask_id\tresource_id
P\t10\tR1
"""


def test_schedule_export(spark, tmp_path):
    (tmp_path / "alpha.xer").write_text(EXPORT)
    (tmp_path / "beta.xer").write_text(EXPORT.replace("\t10\tDig", "\t90\tDig"))
    got = schedule_export.read_schedules(spark, str(tmp_path))
    tasks = {(r.project_id, r.task_id): r for r in got["tasks"].collect()}
    assert set(tasks) == {("alpha", "10"), ("alpha", "11"), ("beta", "90"), ("beta", "11")}
    dig, pour = tasks["alpha", "10"], tasks["alpha", "11"]
    assert (dig.task_name, dig.end_date, dig.original_duration, dig.budget_cost, dig.critical) == ("Dig", dt.datetime(2024, 1, 5, 8), 4, 100.5, True)
    assert (pour.start_date, pour.original_duration, pour.percent_complete, pour.critical) == (None, 0, 0.0, False)
    link = got["relationships"].filter("project_id = 'alpha'").first()
    assert (link.pred_task_id, link.succ_task_id, link.relationship_type, link.lag_days) == ("10", "11", "SS", -2)
    use = got["resources"].filter("project_id = 'alpha'").first()
    assert (use.resource_name, use.units, use.cost_per_unit) == ("Crane", 1.0, 12.5)


def test_legacy_schedule_export(spark, tmp_path):
    (tmp_path / "old.xer").write_text(LEGACY)
    got = schedule_export.read_schedules(spark, str(tmp_path), legacy=True)
    assert {(r.task_id, r.critical) for r in got["tasks"].collect()} == {("10", True), ("11", False)}
    assert got["relationships"].first().relationship_type == "FS" and got["resources"].count() == 1


LAB = "Sample_ID,Depth_m,Test_Type,Parameter_Name,Value,Unit\nS1,1.5,Triaxial,cohesion,10,kPa\nS1,1.5,Triaxial,phi,,deg\nS1,1.5,Triaxial,cohesion,12,kPa\nS2,3,Shear,phi,30,deg\n"
HOLE = "Type,Depth_From,Depth_To,Description,SPT_N,Key,Value\nmetadata,,,,,borehole_id,BH1\nmetadata,,,,,water_level_m,2.5\nlayer,0,2,Fill,,,\nlayer,2,5,Clay,12,,\n"


def test_lab_and_borehole_directory(spark, tmp_path):
    (tmp_path / "lab.csv").write_text(LAB)
    (tmp_path / "hole.csv").write_text(HOLE)
    (tmp_path / "deep.json").write_text(json.dumps({"borehole_id": "BH2", "layers": [{"depth_from_m": 0, "depth_to_m": 1}]}))
    (tmp_path / "other.pdf").write_text("x")
    results, logs, errors = lab_files.read_directory(spark, str(tmp_path))
    rows = {r.sample_id: r for r in results.collect()}
    assert rows["S1"].parameters == {"cohesion": 12.0} and rows["S1"].depth_m == 1.5 and rows["S2"].parameters == {"phi": 30.0}
    holes = {r.borehole_id: r for r in logs.collect()}
    assert set(holes) == {"BH1", "BH2"}
    assert (holes["BH1"].water_level_m, holes["BH1"].ground_level_m) == (2.5, 0.0)
    assert [(x.description, x.spt_n) for x in holes["BH1"].layers] == [("Fill", None), ("Clay", 12.0)]
    assert [r.file.rsplit("/", 1)[1] for r in errors.collect()] == ["other.pdf"]
    again = {r.sample_id: r.parameters for r in lab_files.read_lab_results(spark, str(tmp_path / "lab.csv")).collect()}
    assert again == {"S1": {"cohesion": 12.0}, "S2": {"phi": 30.0}}
    assert lab_files.read_borehole_csv(spark, str(tmp_path / "hole.csv")).first().borehole_id == "BH1"
    assert lab_files.read_borehole_json(spark, str(tmp_path / "deep.json")).first().location == {}


def test_columns_by_name_and_broken_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "lab.csv").write_text("Unit,Value,Parameter_Name,Test_Type,Depth_m,Sample_ID,Remark\nkPa,10,cohesion,Triaxial,1.5,S1,\"a, b\"\n\n")
    (tmp_path / "badlab.csv").write_text("Sample_ID,Depth_m,Value\nS9,x,1\n")
    (tmp_path / "hole.csv").write_text("Key,Value,Type,Description,Depth_From,Depth_To,SPT_N\nborehole_id,BH1,metadata,,,,\n,,layer,see Test_Type of Sample_ID,0,2,7\n")
    (tmp_path / "badhole.csv").write_text("Type,Depth_From,Depth_To\nlayer,0,deep\n")
    (tmp_path / "foreign.csv").write_text("name,kind\nx,Type\n")
    (tmp_path / "bad.json").write_text('{"borehole_id": "BH')
    results, logs, errors = lab_files.read_directory(spark, str(tmp_path))
    assert [(r.sample_id, r.depth_m, r.test_type, r.parameters) for r in results.collect()] == [("S1", 1.5, "Triaxial", {"cohesion": 10.0})]
    assert [(r.borehole_id, [(x.description, x.spt_n) for x in r.layers]) for r in logs.collect()] == [("BH1", [("see Test_Type of Sample_ID", 7.0)])]
    assert {r.file.rsplit("/", 1)[1]: r.error for r in errors.collect()} == {
        "badlab.csv": "Depth_m is not a number: x", "badhole.csv": "Depth_To is not a number: deep", "foreign.csv": "Unsupported file format: .csv", "bad.json": "Broken JSON",
    }
    assert lab_files.read_borehole_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_equal_file_names_are_projects_of_their_own(spark, tmp_path):
    for folder, task in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "plan.xer").write_text(EXPORT.replace("\t10\tDig", f"\t{task}\tDig"))
    tasks = schedule_export.read_schedules(spark, str(tmp_path))["tasks"].collect()
    assert {(r.project_id, r.task_id) for r in tasks} == {("a/plan", "1"), ("a/plan", "11"), ("b/plan", "2"), ("b/plan", "11")}


def test_sessions(spark, tmp_path):
    for name, saved, chats in (("a", "2024-01-01", 1), ("b", "2024-02-01", 0)):
        data = {"session_id": name, "saved_at": saved, "chat_history": [{"role": "user", "content": "x"}] * chats, "designer_messages": []}
        (tmp_path / f"session_{name}.json").write_text(json.dumps(data))
    (tmp_path / "session_bad.json").write_text("{")
    stored = sessions.read_sessions(spark, str(tmp_path))
    rows = [r for r in sessions.session_sizes(stored).collect() if r.saved_at]
    assert [(r.session_id, r.chat_count, r.designer_count) for r in rows] == [("b", 0, 0), ("a", 1, 0)]
    assert sessions.load_session(stored, "a").count() == 1
    assert "a" not in {r.session_id for r in sessions.without_session(stored, "a").collect()}


def test_ingest_job_isolates_failures(spark, tmp_path):
    (tmp_path / "Good File.txt").write_text("a b c")
    (tmp_path / "bad.txt").write_text("!")

    def count(path, text):
        if text == "!":
            raise ValueError("no text")
        return len(text.split())

    docs = sessions.read_documents(spark, str(tmp_path))
    assert {r.document_id for r in docs.collect()} == {"good_file", "bad"}
    results = sessions.process_files(docs.withColumn("job_id", F.lit("j")), count)
    job = sessions.job_status(results).first()
    assert (job.total_files, job.processed_files, job.failed_files, job.status, job.progress_percent) == (2, 1, 1, "completed_with_errors", 50.0)
    assert len(job.errors) == 1 and job.errors[0].endswith("bad.txt: no text")


CHUNK = "chunk_id string, document_id string, document_name string, document_type string, target_index string, clause_id string, content_type string, regulatory_strength string, text string, clause_title string, section_title string, page_number int, page_no int"


def _chunk(i, doc, index="rule"):
    return (f"c{i}", doc, f"Doc {doc}", "code", index, "1.1", "design_rule", "mandatory", f"text {i} ", "Title", "Title", None, 4)


def test_chunk_store(spark, frame, tmp_path):
    path = str(tmp_path / "chunks")
    chunk_store.add_chunks(frame([_chunk(1, "a"), _chunk(2, "a", "section"), _chunk(3, "b")], CHUNK), path)
    chunk_store.add_chunks(frame([_chunk(4, "c")], CHUNK), path)
    stored = chunk_store.read_chunks(spark, path)
    assert stored.count() == 4 and chunk_store.by_chunk_id(stored, "c3").first().document_id == "b"
    assert {(r.document_id, r.chunk_count) for r in chunk_store.list_documents(stored).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert chunk_store.matching(stored, document_id="a", clause_id=None).count() == 2
    chunk_store.delete_document(spark, path, "a")
    assert {r.chunk_id for r in chunk_store.read_chunks(spark, path).select("chunk_id").collect()} == {"c3", "c4"}
    chunk_store.delete_document(spark, path, "b")
    chunk_store.add_chunks(frame([_chunk(5, "a", "section")], CHUNK), path)
    assert {r.chunk_id for r in chunk_store.read_chunks(spark, path).collect()} == {"c4", "c5"}
    chunk_store.delete_document(spark, path, "absent")
    assert chunk_store.read_chunks(spark, path).count() == 2


def test_chunk_dump(spark, frame, tmp_path):
    chunks = frame([_chunk(1, "a"), _chunk(2, "a")], CHUNK)
    text = "".join(r.block for r in chunk_store.dump_blocks(chunks, order=["chunk_id"]).orderBy("piece").collect())
    assert text.startswith("Document: Doc a\nTotal Chunks: 2\n" + "=" * 80) and "Index: rule | Page: 4 | Clause: 1.1 | Type: design_rule\nTitle: Title" in text
    chunk_store.write_dumps(chunks, str(tmp_path / "dump"), order=["chunk_id"])
    files = sorted((tmp_path / "dump" / "document=Doc_a").glob("part-*"))
    assert "".join(f.read_text() for f in files) == text


def test_long_dump_lies_in_pieces(spark, frame, tmp_path):
    chunks = frame([_chunk(100 + i, "a") for i in range(400)], CHUNK).withColumn("n", F.substring("chunk_id", 2, 9).cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunk_store.write_dumps(chunks, str(tmp_path / "dump"), order=["n"], bucket=F.floor(F.col("n") / 7))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "dump" / "document=Doc_a").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert len(files) > 1 and [int(n) for n in re.findall(r"CHUNK (\d+)\n", text)] == list(range(1, 401))
    assert re.findall(r"text (\d+)\n", text) == [str(100 + i) for i in range(400)]


def test_totals_are_observed_while_results_are_written(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(path, text):
        calls.add(1)
        if "7" in path:
            raise ValueError("a seven")
        return len(text.split())

    files = spark.range(40).selectExpr("'j' job_id", "concat('f', id) path", "repeat('w ', cast(id as int)) text")
    totals = sessions.write_results(sessions.process_files(files, count), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert calls.value == 40 and rows.count() == 40 and calls.value == 40
    assert (totals["files"], totals["failed"], totals["chunks"]) == (40, 4, sum(i for i in range(40) if "7" not in str(i))) and totals["milliseconds"] > 0
    assert sessions.job_status(rows).first().processing_time_ms == pytest.approx(totals["milliseconds"])


def test_batches_fold_in_place(spark, frame, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: frame(list(r), "event_id string, ts timestamp, x int")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    stream.write_batch(rows(("a", at(1), 1), ("b", at(1), 2)), 0, path, 2)
    stream.write_batch(rows(("b", at(0), 3)), 1, path, 2)
    before = {(r.event_id, r.x) for r in stream.current_events(spark, path).collect()}
    stream.fold_events(spark, path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.is_dir()) == ["folded=1"]
    stream.write_batch(rows(("c", at(2), 4), ("a", at(2), 5)), 2, path, 2)
    assert before == {("a", 1), ("b", 3)} and {(r.event_id, r.x) for r in stream.current_events(spark, path).collect()} == {("a", 5), ("b", 3), ("c", 4)}
    stream.fold_events(spark, path)
    stream.fold_events(spark, path)
    assert {(r.event_id, r.x) for r in stream.current_events(spark, path).collect()} == {("a", 5), ("b", 3), ("c", 4)}


# --- streams ------------------------------------------------------------


def _event(i, kind, ts, ms):
    return {"event_id": f"e{i}", "event_type": kind, "ts": ts, "user_id": "u", "session_id": "s", "metadata": {"k": "v"}, "duration_ms": ms, "success": True}


def test_event_upsert_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write = lambda name, events: (source / name).write_text("\n".join(json.dumps(e) for e in events))
    args = [str(tmp_path / "table"), str(tmp_path / "state")]
    write("1.json", [_event(1, "query", "2024-01-01T00:00:00Z", 1), _event(2, "query", "2024-01-01T01:00:00Z", 2), _event(1, "query", "2024-01-01T02:00:00Z", 3)])
    stream.upsert_events(stream.read_events(spark, str(source)), *args, available_now=True, buckets=4).awaitTermination()
    write("2.json", [_event(2, "answer", "2024-01-01T00:30:00Z", 9), _event(3, "answer", "2024-01-02T00:00:00Z", 4)])
    stream.upsert_events(stream.read_events(spark, str(source)), *args, available_now=True, buckets=4).awaitTermination()
    got = {r.event_id: r.duration_ms for r in stream.current_events(spark, args[0]).collect()}
    assert got == {"e1": 3, "e2": 9, "e3": 4}
    # a batch that runs again replaces its own rows only
    again = spark.createDataFrame([("e3", "answer", dt.datetime(2024, 1, 2), "u", "s", {"k": "v"}, 4, True)], stream.schemas.USAGE_EVENTS)
    stream.write_batch(again, 1, args[0], 4)
    assert {r.event_id for r in stream.current_events(spark, args[0]).collect()} == {"e1", "e2", "e3"}
    stream.compact_events(spark, args[0], str(tmp_path / "compact"), 4)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_daily_usage_stream_equals_the_table(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    days = [f"2024-01-{d:02d}T0{h}:00:00Z" for d in (1, 2, 3) for h in (1, 5)]
    (source / "1.json").write_text("\n".join(json.dumps(_event(i, "query", ts, i)) for i, ts in enumerate(days)))
    (source / "2.json").write_text(json.dumps(_event(99, "query", "2024-01-09T00:00:00Z", 0)))
    events = stream.read_events(spark, str(source), max_files=1)
    stream.write_daily_usage(events, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    got = {(str(r.day), r.events, r.duration_ms) for r in stream.current_daily_usage(spark, str(tmp_path / "out")).collect()}
    table = usage.daily_usage(spark.read.schema(stream.schemas.USAGE_EVENTS).json(str(source)))
    assert got == {(str(r.day), r.events, r.duration_ms) for r in table.collect()}


def test_distinct_event_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(_event(i % 3, "query", "2024-01-01T00:00:00Z", 1)) for i in range(9)))
    query = stream.distinct_events(stream.read_events(spark, str(source))).writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_merge_and_feedback(spark, frame, tmp_path):
    rows = lambda *r: frame(list(r), "event_id string, ts timestamp, x int")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    merged = usage.merge_events(rows(("a", at(1), 1), ("b", at(1), 1)), rows(("b", at(2), 2), ("b", at(3), 3), ("c", at(1), 4)))
    assert {(r.event_id, r.x) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    usage.append_feedback(merged, str(tmp_path / "f"))
    usage.append_feedback(merged, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 6


def test_whole_dump_texts_join_their_pieces_in_order(frame):
    chunks = frame([_chunk(100 + i, "ab"[i % 2]) for i in range(40)], CHUNK).withColumn("n", F.substring("chunk_id", 2, 9).cast("int"))
    blocks = chunk_store.dump_blocks(chunks, order=["n"], bucket=F.floor(F.col("n") / 7)).cache()
    got = {r.document_id: r.text for r in chunk_store.dump_texts(blocks).collect()}
    for name in "ab":
        assert got[name] == "".join(r.block for r in blocks.filter(F.col("document_id") == name).orderBy("piece").collect())
    assert re.findall(r"text (\d+)\n", got["a"]) == [str(100 + i) for i in range(0, 40, 2)]


def test_lines_find_their_section_without_a_shuffle(spark, tmp_path, monkeypatch):
    lines = ["%T\tTASK", "%F\ttask_id\ttask_name\ttask_id", "%R\t1\ta\t2", "%R\t3\tb", "%T\tTASKPRED", "%F\tpred_task_id\tsucc_task_id", "%R\t1\t2", "%T\tTASK", "%R\tno names", "%F\ttask_name", "%R\tc"]
    for name in "xy":
        (tmp_path / f"{name}.xer").write_text("\n".join(lines) + "\n")
    show = lambda df: sorted(map(str, df.drop("start_date", "end_date").collect()))
    found = schedule_export.read_schedules(spark, str(tmp_path))
    assert "Exchange hash" not in found["tasks"]._jdf.queryExecution().executedPlan().toString()
    rows = [show(found[n]) for n in ("tasks", "relationships")]
    assert [len(r) for r in rows] == [4, 2] and "task_id='2', task_name='a'" in rows[0][0] + rows[0][1]
    monkeypatch.setattr(schedule_export, "_MARKS_PER_FILE", 0)
    found = schedule_export.read_schedules(spark, str(tmp_path))
    assert rows == [show(found[n]) for n in ("tasks", "relationships")]


def test_lines_of_lab_files_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Sample_ID,Value,Parameter_Name,Value,Depth_m\ns1,7,"x, ""y""",2, 1.5\r\n\ns1,1,plain,,2\n')
    (tmp_path / "b.csv").write_text("Depth_m,Sample_ID\n3,s2,beyond\n")
    rows = lab_files.read_lab_rows(spark, str(tmp_path))
    assert "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.sample_id, r.depth_m, r.parameter_name, r.value) for r in rows.collect())
    assert [g for g in got if g[0] == "s2"] == [("s2", 3.0, None, None)]
    assert [g for g in got if g[0] == "s1"] == [("s1", 1.5, 'x, "y"', 2.0), ("s1", 2.0, "plain", None)]
