"""Input tables and the views that give the operators their data.

``VIEWS`` holds one SQL text per view, over tables and other views in braces.
The same text runs in Spark (``view``) and, as a common table expression, in a
checking engine (``view_ctes``), so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF_DATE = "1998-08-02"
AS_OF_TIME = "2024-01-25 00:00:00"

_PERCENT = "CAST(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 0 ELSE (o_orderkey * 7) % 20 * 5 END AS DOUBLE)"
_CLAUSE = "CAST(doc_id % 9 + 1 AS VARCHAR(5))"

VIEWS: dict[str, str] = {
    "tasks": f"""
        SELECT concat('P', CAST(c_nationkey AS VARCHAR(10))) AS project_id,
               CAST(o_orderkey AS VARCHAR(20)) AS task_id, o_orderkey AS task_no, o_custkey,
               CASE o_orderkey % 10 WHEN 0 THEN 'Excavation Zone' WHEN 1 THEN 'Concrete Pour' WHEN 2 THEN 'Steel Columns'
                    WHEN 3 THEN 'Roofing System' WHEN 4 THEN 'Painting Finishes' WHEN 5 THEN 'Waterproofing Works'
                    WHEN 6 THEN 'Drywall Installation' WHEN 7 THEN 'HVAC Ductwork' WHEN 8 THEN 'Parking Lot Paving'
                    ELSE 'Final Inspection' END AS task_name,
               concat(CAST(o_orderkey % 8 + 1 AS VARCHAR(10)), '.0') AS wbs,
               CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 30 AS INT) AS end_date,
               CAST(1 + o_orderkey % 30 AS INT) AS original_duration,
               {_PERCENT} AS percent_complete,
               CAST(floor(o_totalprice) AS DOUBLE) AS budget_cost,
               CAST(floor(o_totalprice) AS DOUBLE) * {_PERCENT} / CAST(100 AS DOUBLE)
                 * (CAST(80 + o_orderkey % 3 * 20 AS DOUBLE) / CAST(100 AS DOUBLE)) AS actual_cost,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS critical,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(0 AS DOUBLE)
                    ELSE CAST(1 + o_orderkey % 30 AS DOUBLE) * CAST(3 AS DOUBLE) / CAST(10 AS DOUBLE) END AS total_float,
               c_mktsegment AS resource_crew
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "relationships": """
        SELECT t.project_id, CAST(l_partkey AS VARCHAR(20)) AS pred_task_id, t.task_id AS succ_task_id,
               'FS' AS relationship_type, CAST(0 AS INT) AS lag_days
        FROM {lineitem} JOIN {tasks} t ON l_orderkey = t.task_no""",
    "resources": """
        SELECT project_id, task_id, concat('RES_', resource_crew) AS resource_id,
               concat(resource_crew, ' Crew') AS resource_name, CAST(1 AS DOUBLE) AS units,
               floor(budget_cost / original_duration) AS cost_per_unit
        FROM {tasks}""",
    "delay_events": """
        SELECT CAST(o_custkey AS VARCHAR(20)) AS event_id, min(project_id) AS project_id, min(start_date) AS event_start,
               min(start_date) + CAST(o_custkey % 25 AS INT) AS event_end,
               CASE o_custkey % 5 WHEN 0 THEN 'Owner-initiated design change' WHEN 1 THEN 'Force Majeure - Weather'
                    WHEN 2 THEN 'Contractor delay' WHEN 3 THEN 'Permit delay' ELSE 'Utility delay' END AS cause
        FROM {tasks} GROUP BY o_custkey""",
    "event_tasks": "SELECT CAST(o_custkey AS VARCHAR(20)) AS event_id, project_id, task_id FROM {tasks}",
    "photos": """
        SELECT project_id, concat('site/', project_id, '/', replace(task_name, ' ', '_'), '_', task_id,
                                  CASE task_no % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpg' END) AS path
        FROM {tasks}""",
    "usage_events": """
        SELECT CAST(event_id AS VARCHAR(20)) AS event_id,
               CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'answer' WHEN 'purchase' THEN 'document_ingest'
                    WHEN 'signup' THEN 'report_generate' ELSE 'validation' END AS event_type,
               ts, CAST(user_id AS VARCHAR(20)) AS user_id,
               concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS session_id,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type <> 'error' AS success
        FROM {events}""",
    "event_writes": """
        SELECT concat(CAST(user_id AS VARCHAR(20)), '-', event_type) AS event_id, event_type, ts, CAST(user_id AS VARCHAR(20)) AS user_id,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_id AS write_no
        FROM {events}""",
    "retrieval_metrics": """
        SELECT concat('question ', CAST(event_id % 37 AS VARCHAR(10))) AS query, ts,
               CAST(1 + event_id % 10 AS INT) AS results_count,
               CAST(event_id % 80 AS DOUBLE) / CAST(100 AS DOUBLE) AS avg_score,
               CAST(event_id % 80 + 15 AS DOUBLE) / CAST(100 AS DOUBLE) AS max_score,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS user_feedback
        FROM {events} WHERE event_type = 'view'""",
    "user_feedback": """
        SELECT ts, CAST(event_id AS VARCHAR(20)) AS event_id, concat('question ', CAST(event_id % 37 AS VARCHAR(10))) AS query,
               CAST(1 + event_id % 5 AS INT) AS rating, props AS feedback_text
        FROM {events} WHERE event_type = 'click'""",
    "cache_entries": """
        SELECT concat('embedding:', md5(concat(event_type, '|', CAST(user_id AS VARCHAR(20))))) AS key,
               max(ts) AS created_at, max(ts) + INTERVAL '7' DAY AS expires_at, count(*) AS access_count
        FROM {events} GROUP BY event_type, user_id""",
    "cache_requests": """
        SELECT event_id AS request_id, ts, concat(event_type, '|', CAST(user_id + event_id % 3 AS VARCHAR(20))) AS text
        FROM {events}""",
    "md_docs": f"""
        SELECT doc_id, source, concat('Manual ', source) AS document_name,
               concat('# ', {_CLAUSE}, ' General', chr(10), substr(replace(text, '#', ''), 1, 300), chr(10),
                      '## ', {_CLAUSE}, '.1 Definition of terms', chr(10), 'Bearing is defined as ', substr(replace(text, '#', ''), 301, 300),
                      chr(10), chr(10), 'See Clause ', {_CLAUSE}, '.1.1 and Clause ', CAST(doc_id * 3 % 9 + 1 AS VARCHAR(5)), '.1. It shall apply.', chr(10),
                      '### ', {_CLAUSE}, '.1.1 Table of values Page ', CAST(doc_id % 50 + 1 AS VARCHAR(5)), chr(10),
                      substr(replace(text, '#', ''), 601, 300), ' should be used with clause ', {_CLAUSE}, '.2.1.', chr(10),
                      '### ', {_CLAUSE}, '.2.1 Design rule', chr(10), 'Refer to Clause ', {_CLAUSE}, '.1 first.', chr(10),
                      replace(substr(replace(text, '#', ''), 901), chr(10), concat(chr(10), chr(10)))) AS text
        FROM {{documents}}""",
    "paged_docs": """
        SELECT doc_id, source, concat('cover', chr(10), '[Page 1]', chr(10), substr(text, 1, 500), chr(10),
                                      '[Page 2]', chr(10), substr(text, 501), chr(10), '[Page 3]', chr(10), ' ') AS text
        FROM {documents}""",
    "answers": f"""
        SELECT doc_id AS answer_id, source,
               CASE doc_id % 6
                    WHEN 0 THEN concat('The limit is 3. [Source: Manual ', source, ', Section/Clause: ', {_CLAUSE}, '.1, Page: ', CAST(doc_id % 50 + 1 AS VARCHAR(5)), ']')
                    WHEN 1 THEN concat('[Source: Manual ', source, ', Clause: ', {_CLAUSE}, '.1.1] applies.')
                    WHEN 2 THEN concat('A value is given (Manual ', source, ', Clause ', {_CLAUSE}, '.2.1).')
                    WHEN 3 THEN concat('According to Clause ', {_CLAUSE}, '.1 of Manual ', source, ', see below.')
                    WHEN 4 THEN '[Source: Other Book, Section/Clause: 99.9, Page: 999] and Clause 98.7.6 too'
                    ELSE 'No source is named.' END AS answer
        FROM {{documents}}""",
    "reports": """
        SELECT p_partkey AS report_id,
               concat('# 1. Introduction', chr(10), 'Project name: Tower ', p_name, chr(10),
                      CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('## Ground Investigation', chr(10)) END, '## Analysis and Design', chr(10),
                      'Bearing capacity factor of safety = ', CAST(p_size % 5 + 1 AS VARCHAR(5)), '.5', chr(10),
                      'Sliding FoS = 1.', CAST(p_size % 10 AS VARCHAR(5)), chr(10), 'Overturning FoS = ', CAST(p_size % 3 + 1 AS VARCHAR(5)), '.0', chr(10),
                      CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('Slope stability FoS = 1.', CAST(p_size % 8 AS VARCHAR(5)), chr(10)) END,
                      CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('Cohesion = ', CAST(p_size * 15 AS VARCHAR(5)), ' kPa', chr(10)) END,
                      'Friction angle = ', CAST(p_size + 5 AS VARCHAR(5)), ' degrees', chr(10),
                      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Date: 01/02/20', CAST(10 + p_partkey % 15 AS VARCHAR(5)), chr(10)) END,
                      CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'Prepared by: Office' END) AS report_text
        FROM {part}""",
    "report_versions": """
        SELECT CAST(conv_id AS VARCHAR(20)) AS report_id, turn, role AS created_by,
               concat('## Scope', chr(10), replace(text, '#', ''), chr(10), '## Part ', CAST(turn % 3 AS VARCHAR(5)), chr(10), 'fixed body', chr(10),
                      '## Notes', chr(10), 'same') AS content
        FROM {conversations}""",
    "questions": """
        SELECT p_partkey AS question_id,
               concat(CASE p_partkey % 9 WHEN 0 THEN 'How to design a retaining wall with ' WHEN 1 THEN 'What is the bearing capacity of '
                           WHEN 2 THEN 'Table of friction coefficient for ' WHEN 3 THEN 'steps for pile foundation Settlement under '
                           WHEN 4 THEN 'Check slope stability beside ' WHEN 5 THEN '如何設計 擋土牆 ' WHEN 6 THEN 'Define shear for '
                           WHEN 7 THEN 'Verify shallow excavation near ' ELSE 'Summary of ' END, p_name) AS question
        FROM {part}""",
    "model_outputs": """
        SELECT p_partkey AS response_id,
               CASE p_partkey % 6
                    WHEN 0 THEN concat('{{"status": "pass", "score": ', CAST(p_size AS VARCHAR(10)), '}}')
                    WHEN 1 THEN concat('Result:', chr(10), '```json', chr(10), '{{"status": "fail", "score": ', CAST(p_size AS VARCHAR(10)), '}}', chr(10), '```')
                    WHEN 2 THEN concat('```', chr(10), '{{"status": "warning", "score": ', CAST(p_size AS VARCHAR(10)), '}}', chr(10), '```', chr(10), 'done')
                    WHEN 3 THEN concat('{{"status": "pass", "score": ', p_name)
                    WHEN 4 THEN ''
                    ELSE concat('  ', p_name) END AS response
        FROM {part}""",
    "vector_chunks": """
        SELECT vec_id AS chunk_id, embedding, label,
               CASE label % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'section' ELSE 'rule' END AS target_index,
               CASE label % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'section_overview' ELSE 'design_rule' END AS content_type,
               CASE WHEN label % 2 = 0 THEN 'code' ELSE 'manual' END AS document_type,
               concat(CAST(vec_id % 7 + 1 AS VARCHAR(5)), '.', CAST(vec_id % 4 + 1 AS VARCHAR(5))) AS clause_id
        FROM {embeddings}""",
    "text_chunks": """
        SELECT doc_id AS chunk_id, embedding, text FROM (SELECT d.doc_id, d.text, n FROM {documents} d JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true) d JOIN {embeddings} ON vec_id = doc_id % n""",
    "vector_edges": """
        SELECT vec_id AS src, (vec_id * 7 + 3) % n AS dst FROM {embeddings} JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true
        UNION ALL SELECT vec_id, (vec_id * 13 + 1) % n FROM {embeddings} JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true WHERE vec_id % 3 > 0""",
    "asked_items": """
        SELECT item_id AS query_id, text, item_id % 10 AS label, item_id % n AS vec_id FROM {benchmark} JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true""",
    "asked_questions": """
        SELECT question_id AS query_id, question AS text, question_id % 10 AS label,
               question_id % n AS vec_id FROM {questions} JOIN (SELECT count(*) AS n FROM {embeddings}) c ON true""",
    "lab_rows": """
        SELECT l_orderkey AS sample_id, CAST(l_linenumber AS DOUBLE) AS depth_m, l_linestatus AS test_type,
               CASE l_returnflag WHEN 'A' THEN 'cohesion_kpa' WHEN 'N' THEN 'friction_angle_deg' ELSE 'unit_weight_kn_m3' END AS parameter_name,
               l_quantity AS value, l_partkey AS ord
        FROM {lineitem}""",
    "borehole_rows": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS file, CAST(l_linenumber AS INT) AS line_no,
               CASE WHEN l_linenumber <= 2 THEN 'metadata' ELSE 'layer' END AS type,
               CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber * 2 AS DOUBLE) END AS depth_from,
               CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber * 2 + 2 AS DOUBLE) END AS depth_to,
               CASE WHEN l_linenumber > 2 THEN l_returnflag END AS description,
               CASE WHEN l_linenumber > 4 THEN l_quantity END AS spt_n,
               CASE l_linenumber WHEN 1 THEN 'borehole_id' WHEN 2 THEN 'ground_level_m' END AS key,
               CASE l_linenumber WHEN 1 THEN concat('BH-', CAST(l_orderkey AS VARCHAR(20))) WHEN 2 THEN '12.5' END AS value
        FROM {lineitem}""",
    "design_cases": """
        SELECT p_partkey AS case_id, p_brand AS site, CAST(p_size AS DOUBLE) AS cohesion_kpa, CAST(p_partkey % 36 AS DOUBLE) AS friction_angle_deg,
               CAST(16 + p_partkey % 6 AS DOUBLE) AS unit_weight_kn_m3, CAST(1 + p_partkey % 4 AS DOUBLE) AS width_m,
               CAST((1 + p_partkey % 4) * (1 + p_partkey % 3) AS DOUBLE) AS length_m, CAST(1 + p_partkey % 2 AS DOUBLE) AS depth_m,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 4 AS DOUBLE) END AS gwl_depth_m
        FROM {part}""",
    "design_projects": """
        SELECT p_partkey AS project_no,
               CASE p_partkey % 7 WHEN 0 THEN 'building' WHEN 1 THEN 'slope' WHEN 2 THEN 'retaining_wall' WHEN 3 THEN 'excavation'
                    WHEN 4 THEN 'pile' WHEN 5 THEN 'caisson' ELSE 'tunnel' END AS project_type,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(1 + p_partkey % 4 AS DOUBLE) END AS width_m,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(4 + p_partkey % 5 AS DOUBLE) END AS height_m,
               CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS cohesion_kpa,
               CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 36 AS DOUBLE) END AS friction_angle_deg,
               CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS DOUBLE) / CAST(10 AS DOUBLE) END AS pile_diameter_m
        FROM {part}""",
    "soil_layers": """
        SELECT case_id, layer_no, CAST((layer_no - 1) * 5 AS DOUBLE) AS depth_from_m, CAST(5 AS DOUBLE) AS thickness_m,
               CASE WHEN (case_id + layer_no) % 2 = 0 THEN 'cohesive' ELSE 'granular' END AS soil_type,
               CASE WHEN (case_id + layer_no) % 2 = 0 THEN cohesion_kpa + layer_no * 10 ELSE CAST(0 AS DOUBLE) END AS cohesion_kpa,
               CASE WHEN (case_id + layer_no) % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(25 + layer_no * 2 AS DOUBLE) END AS friction_angle_deg,
               unit_weight_kn_m3
        FROM (SELECT *, {spread_layers} AS layer_no FROM {design_cases}) l""",
    "piles": """
        SELECT case_id, CAST(0.5 + case_id % 3 * 0.25 AS DOUBLE) AS diameter_m, CAST(8 + case_id % 12 AS DOUBLE) AS embedment_length_m,
               CAST(2 + case_id % 5 AS DOUBLE) AS spacing_ratio, CAST(1 + case_id % 4 AS INT) AS piles_x, CAST(1 + case_id % 3 AS INT) AS piles_y
        FROM {design_cases}""",
    "walls": """
        SELECT case_id, site, CAST(3 + case_id % 5 AS DOUBLE) AS wall_height_m, CAST(2 + case_id % 4 AS DOUBLE) AS base_width_m,
               CAST(0.5 AS DOUBLE) AS toe_length_m, CAST(0.4 AS DOUBLE) AS stem_thickness_m, CAST(0.5 AS DOUBLE) AS base_thickness_m,
               unit_weight_kn_m3 AS backfill_unit_weight_kn_m3, friction_angle_deg AS backfill_friction_angle_deg,
               CAST(case_id % 3 * 5 AS DOUBLE) AS backfill_surcharge_kpa, cohesion_kpa AS foundation_cohesion_kpa,
               CAST(20 + case_id % 15 AS DOUBLE) AS foundation_friction_angle_deg, CAST(18 AS DOUBLE) AS foundation_unit_weight_kn_m3
        FROM {design_cases}""",
    "slopes": """
        SELECT case_id, site, CAST(case_id % 60 AS DOUBLE) AS slope_angle_deg, friction_angle_deg, cohesion_kpa, unit_weight_kn_m3,
               CAST(1 + case_id % 5 AS DOUBLE) AS depth_to_slip_m, CAST(case_id % 2 AS DOUBLE) AS gwl_above_slip_m,
               CAST(3 + case_id % 9 AS DOUBLE) AS height_m
        FROM {design_cases}""",
}

_SPREAD = {"spark": "explode(array(1, 2, 3))", "duckdb": "unnest([1, 2, 3])"}


def inputs_of(text: str) -> list[str]:
    """Names of the tables and views that a view text reads."""
    names = re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)
    return [n for n in dict.fromkeys(names) if n in VIEWS or n in TABLES]


# tables whose rows take much work each
_TEXT_TABLES = {"documents", "part"}


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its files give fewer tasks than that.

    A table of many files has more tasks than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the folder, with zone-less times read as UTC times."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = spread(df) if name in _TEXT_TABLES else df
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoneless}) if zoneless else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view or table by name."""
    if name in TABLES:
        return table(spark, folder, name)
    text = VIEWS[name].replace("{spread_layers}", _SPREAD["spark"])
    return spark.sql(text, **{n: view(spark, folder, n) for n in inputs_of(text)})


def view_ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views, and those they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in inputs_of(VIEWS[name]):
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    parts = []
    for name in ordered:
        text = VIEWS[name].replace("{spread_layers}", _SPREAD["duckdb"])
        parts.append(f"{name} AS ({text.format(**{n: n for n in inputs_of(text)})})")
    return "WITH RECURSIVE " + ",\n".join(parts)
