"""Queries of the design case and laboratory family."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.operators import design, labdata
from groundplan.plans.registry import Registry
from groundplan.sources.sessions import job_status

REGISTRY = Registry()
query = REGISTRY.add


def shown(df, keys, numbers, digits=6, others=()):
    return df.selectExpr(*keys, *[f"round({n}, {digits}) {n}" for n in numbers], *others)


# --- laboratory and boreholes -------------------------------------------


@query("lab_pivot", "lab_rows", """
SELECT sample_id, coalesce(max(CASE WHEN parameter_name = 'cohesion_kpa' THEN [ord, value] END)[2], -1) AS cohesion_kpa,
       coalesce(max(CASE WHEN parameter_name = 'friction_angle_deg' THEN [ord, value] END)[2], -1) AS friction_angle_deg,
       coalesce(max(CASE WHEN parameter_name = 'unit_weight_kn_m3' THEN [ord, value] END)[2], -1) AS unit_weight_kn_m3
FROM lab_rows GROUP BY 1""")
def lab_pivot(rows):
    names = ["cohesion_kpa", "friction_angle_deg", "unit_weight_kn_m3"]
    return labdata.lab_pivot(rows, names).selectExpr("sample_id", *[f"coalesce({n}, -1D) {n}" for n in names])


@query("lab_results", "lab_rows", """
SELECT sample_id, test_type, depth_m, params FROM
  (SELECT sample_id, min([CAST(ord AS DOUBLE), depth_m]) AS f, string_agg(concat(parameter_name, '=', v), ';' ORDER BY parameter_name) FILTER (v IS NOT NULL) AS params, any_value(t) AS t
   FROM (SELECT sample_id, parameter_name, min([ord, depth_m]) AS f0, min(ord) AS ord, min_by(depth_m, [ord, depth_m]) AS depth_m, NULL AS t, max([ord, value])[2] AS v FROM lab_rows GROUP BY 1, 2) GROUP BY 1) g
JOIN (SELECT sample_id, arg_min(depth_m, [CAST(ord AS VARCHAR).lpad(12, '0'), CAST(CAST(depth_m AS INT) AS VARCHAR), test_type]) AS depth_m,
             arg_min(test_type, [CAST(ord AS VARCHAR).lpad(12, '0'), CAST(CAST(depth_m AS INT) AS VARCHAR), test_type]) AS test_type FROM lab_rows GROUP BY 1) h USING (sample_id)""")
def lab_results(rows):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("parameters")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return labdata.lab_results(rows).select("sample_id", "test_type", "depth_m", text.alias("params"))


@query("borehole_layers", "borehole_rows", """
SELECT file, coalesce(max(CASE WHEN key = 'borehole_id' THEN value END), 'Unknown') AS borehole_id,
       coalesce(max(CASE WHEN key = 'ground_level_m' THEN CAST(value AS DOUBLE) END), 0) AS ground_level_m, count(*) FILTER (type = 'layer') AS layers,
       coalesce(max(depth_to), 0) AS deepest_m, coalesce(sum(spt_n), 0) AS spt_total
FROM borehole_rows GROUP BY 1""")
def borehole_layers(rows):
    logs = labdata.borehole_logs(rows)
    return logs.select(
        "file", "borehole_id", "ground_level_m", F.size("layers").cast("bigint").alias("layers"),
        F.coalesce(F.array_max(F.transform("layers", lambda x: x["depth_to_m"])), F.lit(0.0)).alias("deepest_m"),
        F.aggregate("layers", F.lit(0.0), lambda s, x: s + F.coalesce(x["spt_n"], F.lit(0.0))).alias("spt_total"),
    )


@query("ingest_jobs", "documents", """
SELECT source AS job_id, count(*) AS total_files, count(*) FILTER (n_chars >= 100) AS processed_files, count(*) FILTER (n_chars < 100) AS failed_files,
       CASE WHEN count(*) FILTER (n_chars < 100) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status,
       round(count(*) FILTER (n_chars >= 100) * 100.0 / count(*), 6) AS progress_percent,
       coalesce(array_to_string((list(concat('doc', doc_id, ': text too short') ORDER BY concat('doc', doc_id)) FILTER (n_chars < 100))[1:10], ';'), '') AS errors
FROM documents GROUP BY 1""")
def ingest_jobs(docs):
    from groundplan.functions.words import count_words

    short = F.length("text") < 100
    results = docs.select(
        F.col("source").alias("job_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_path"), (~short).alias("success"),
        F.when(short, 0).otherwise(F.ceil(count_words(F.col("text")) / 615)).alias("chunks_created"), F.when(short, "text too short").alias("error"),
    )
    return job_status(results).selectExpr(
        "job_id", "total_files", "processed_files", "failed_files", "status", "round(progress_percent, 6) progress_percent", "array_join(errors, ';') errors"
    )


# --- design cases -------------------------------------------------------

_TAN = "tan(radians(friction_angle_deg))"
_NQ = f"exp(pi() * {_TAN}) * pow(tan(radians(45 + friction_angle_deg / 2)), 2)"
FACTORS_SQL = f"""
base AS (SELECT *, CASE WHEN friction_angle_deg = 0 THEN 1.0 ELSE {_NQ} END AS nq, {_TAN} AS t,
                CASE WHEN gwl_depth_m <= depth_m THEN unit_weight_kn_m3 - 9.81 ELSE unit_weight_kn_m3 END AS g FROM design_cases),
factors AS (SELECT *, CASE WHEN friction_angle_deg = 0 THEN 5.14 ELSE (nq - 1) / t END AS nc FROM base)"""
TERZAGHI_SQL = FACTORS_SQL.strip() + """,
shaped AS (SELECT *, CASE WHEN friction_angle_deg = 0 THEN 0 ELSE 2 * (nq + 1) * t END AS ng,
                  CASE WHEN length_m / width_m > 10 THEN 1.0 WHEN abs(length_m - width_m) < 0.01 THEN 1.3 ELSE 1 + 0.3 * width_m / length_m END AS sc,
                  CASE WHEN length_m / width_m > 10 THEN 1.0 WHEN abs(length_m - width_m) < 0.01 THEN 0.8 ELSE 1 - 0.2 * width_m / length_m END AS sg FROM factors),
terzaghi AS (SELECT case_id, site, nc, nq, ng, sc, sg, cohesion_kpa * nc * sc + g * depth_m * nq + 0.5 * g * width_m * ng * sg AS q FROM shaped)"""


@query("terzaghi", "design_cases", """
SELECT case_id, round(nc, 6) nc, round(nq, 6) nq, round(ng, 6) ngamma, round(sc, 6) sc, round(sg, 6) sgamma, round(q, 4) q_ult_kpa, round(q / 3, 4) q_allowable_kpa FROM terzaghi""", TERZAGHI_SQL)
def terzaghi(cases):
    rows = design.terzaghi_cases(cases)
    return shown(rows, ["case_id"], ["nc", "nq", "ngamma", "sc", "sgamma"], others=["round(q_ult_kpa, 4) q_ult_kpa", "round(q_allowable_kpa, 4) q_allowable_kpa"])


HANSEN_SQL = FACTORS_SQL.strip() + """,
shaped AS (SELECT *, CASE WHEN friction_angle_deg = 0 THEN 0 ELSE 1.5 * (nq - 1) * t END AS ng,
                  CASE WHEN friction_angle_deg > 0 THEN 1 + nq / nc * width_m / length_m ELSE 1 + 0.2 * width_m / length_m END AS sc, 1 + width_m / length_m * t AS sq,
                  greatest(1 - 0.4 * width_m / length_m, 0.6) AS sg, CASE WHEN depth_m / width_m <= 1 THEN depth_m / width_m ELSE atan(depth_m / width_m) END AS k FROM factors),
deep AS (SELECT *, 1 + 0.4 * k AS dc, 1 + 2 * t * pow(1 - sin(radians(friction_angle_deg)), 2) * k AS dq FROM shaped),
hansen AS (SELECT *, cohesion_kpa * nc * sc * dc + g * depth_m * nq * sq * dq + 0.5 * g * width_m * ng * sg AS q FROM deep)"""


@query("hansen", "design_cases", """
SELECT case_id, round(sc, 6) sc, round(sq, 6) sq, round(sg, 6) sgamma, round(dc, 6) dc, round(dq, 6) dq, round(q, 4) q_ult_kpa FROM hansen""", HANSEN_SQL)
def hansen(cases):
    return shown(design.hansen_cases(cases), ["case_id"], ["sc", "sq", "sgamma", "dc", "dq"], others=["round(q_ult_kpa, 4) q_ult_kpa"])


EC7_SQL = """
loads AS (SELECT *, width_m * length_m * cohesion_kpa AS g_k, width_m * length_m * 20 AS q_k FROM design_cases),
combos AS (SELECT case_id, 'Combination_1' AS combination, cohesion_kpa, friction_angle_deg, unit_weight_kn_m3, width_m, length_m, depth_m, gwl_depth_m, g_k * 1.35 + q_k * 1.5 AS v FROM loads
           UNION ALL SELECT case_id, 'Combination_2', cohesion_kpa / 1.25, degrees(atan(tan(radians(friction_angle_deg)) / 1.25)), unit_weight_kn_m3, width_m, length_m, depth_m, gwl_depth_m, g_k * 1.0 + q_k * 1.3 FROM loads),
""" + HANSEN_SQL.strip().replace("FROM design_cases", "FROM combos") + """,
used AS (SELECT case_id, combination, v / (round(q, 1) * width_m * length_m) AS u FROM hansen)"""


@query("ec7_da1", "design_cases", """
SELECT case_id, bool_and(u <= 1) AS overall_pass, max(CASE WHEN combination = 'Combination_1' THEN round(u, 3) END) AS utilisation_1, max(CASE WHEN combination = 'Combination_2' THEN round(u, 3) END) AS utilisation_2,
       CASE WHEN max(CASE WHEN combination = 'Combination_1' THEN round(u, 3) END) > max(CASE WHEN combination = 'Combination_2' THEN round(u, 3) END) THEN 'Combination_1' ELSE 'Combination_2' END AS governing
FROM used GROUP BY 1""", EC7_SQL)
def ec7_da1(cases):
    area = F.col("width_m") * F.col("length_m")
    return design.ec7_check(cases.withColumns({"permanent_load_kn": area * F.col("cohesion_kpa"), "variable_load_kn": area * 20}))


SLOPE_SQL = """
stress AS (SELECT *, unit_weight_kn_m3 * depth_to_slip_m * pow(cos(radians(slope_angle_deg)), 2) AS n, 9.81 * gwl_above_slip_m * pow(cos(radians(slope_angle_deg)), 2) AS u,
                  unit_weight_kn_m3 * depth_to_slip_m * sin(radians(slope_angle_deg)) * cos(radians(slope_angle_deg)) AS d FROM slopes),
infinite AS (SELECT case_id, site, CASE WHEN d <= 0 THEN NULL ELSE (cohesion_kpa + (n - u) * tan(radians(friction_angle_deg))) / d END AS fos, CASE WHEN gwl_above_slip_m > 0 THEN u / n END AS ru FROM stress)"""


@query("infinite_slope", "slopes", """
SELECT case_id, coalesce(CAST(round(fos, 6) AS VARCHAR), 'inf') = 'inf' AS endless, round(coalesce(fos, 0), 6) AS fos, round(coalesce(ru, 0), 6) AS pore_ratio, coalesce(fos >= 1.4, true) AS pass_fail FROM infinite""", SLOPE_SQL)
def infinite_slope(cases):
    return design.slope_cases(cases).selectExpr(
        "case_id", "fos = double('inf') endless", "round(if(fos = double('inf'), 0D, fos), 6) fos", "round(coalesce(pore_ratio, 0D), 6) pore_ratio", "pass_fail"
    )


@query("taylor", "slopes", """
SELECT case_id, round(coalesce(fos, -1), 6) AS fos, coalesce(fos >= 1.4, false) AS pass_fail FROM (SELECT case_id, CASE WHEN friction_angle_deg = 0 THEN
         (CASE WHEN a >= 53 THEN 5.52 WHEN a >= 45 THEN 5.5 + (53 - a) * 0.5 / 8 WHEN a >= 30 THEN 6 + (45 - a) * 1.5 / 15 WHEN a >= 15 THEN 7.5 + (30 - a) * 3.5 / 15 ELSE 11 END) * cohesion_kpa / (unit_weight_kn_m3 * height_m)
         WHEN a = 0 THEN NULL
         ELSE cohesion_kpa / (unit_weight_kn_m3 * height_m) * 5.5 + tan(radians(friction_angle_deg)) / tan(radians(a)) END AS fos
       FROM (SELECT *, slope_angle_deg AS a FROM slopes))""")
def taylor(cases):
    return design.taylor_cases(cases).selectExpr("case_id", "round(coalesce(fos, -1D), 6) fos", "coalesce(pass_fail, false) pass_fail")


RANKINE_SQL = """
pressed AS (SELECT case_id, site, backfill_unit_weight_kn_m3 AS g, wall_height_m AS h, backfill_surcharge_kpa AS s, foundation_cohesion_kpa / 10 AS c,
                   pow(tan(radians(45 - backfill_friction_angle_deg / 2)), 2) AS ka, pow(tan(radians(45 + backfill_friction_angle_deg / 2)), 2) AS kp FROM walls),
summed AS (SELECT *, 0.5 * ka * g * h * h AS soil, ka * s * h AS load, greatest(0.5 * ka * g * h * h + ka * s * h - 2 * c * sqrt(ka) * h, 0) AS total FROM pressed)"""


@query("rankine", "walls", """
SELECT case_id, round(ka, 6) ka, round(kp, 6) kp, round(greatest(ka * g * h + ka * s - 2 * c * sqrt(ka), 0), 6) sigma_a_base_kpa, round(total, 6) total_active_force,
       round(CASE WHEN total > 0 THEN (soil * h / 3 + load * h / 2) / total ELSE h / 3 END, 4) point_of_application_m FROM summed""", RANKINE_SQL)
def rankine(walls):
    rows = design.rankine_cases(walls.withColumn("backfill_cohesion_kpa", F.col("foundation_cohesion_kpa") / 10))
    return shown(rows, ["case_id"], ["ka", "kp", "sigma_a_base_kpa", "total_active_force"], others=["round(point_of_application_m, 4) point_of_application_m"])


PILE_SQL = """
touch AS (SELECT p.*, l.layer_no, l.soil_type, l.cohesion_kpa AS c, l.friction_angle_deg AS phi, l.unit_weight_kn_m3 AS g, l.depth_from_m AS z0, l.thickness_m AS h,
                 greatest(least(l.depth_from_m + l.thickness_m, embedment_length_m) - l.depth_from_m, 0) AS overlap FROM piles p JOIN soil_layers l USING (case_id)),
stress AS (SELECT *, CASE WHEN soil_type = 'cohesive' THEN CASE WHEN c > 0 THEN least(CASE WHEN c < 50 THEN c ELSE c * 0.5 END, 100) ELSE 0 END
                          WHEN phi > 0 THEN least((1 + radians(phi)) * tan(radians(phi * 0.8)) * g * (z0 + h / 2), 100) ELSE 0 END AS qs,
                  least(CASE WHEN soil_type = 'granular' OR phi > 0 THEN g * embedment_length_m * exp(pi() * tan(radians(phi))) * pow(tan(radians(45 + phi / 2)), 2)
                             * CASE WHEN embedment_length_m / diameter_m > 1 THEN sqrt(least(embedment_length_m / diameter_m, 15)) ELSE 1 END ELSE c * 9 END, 10000) AS qb FROM touch),
capacity AS (SELECT case_id, any_value(diameter_m) AS d, any_value(spacing_ratio) AS ratio, any_value(piles_x) AS nx, any_value(piles_y) AS ny,
                    sum(qs * pi() * diameter_m * overlap) AS shaft, max_by(qb * pi() * diameter_m * diameter_m / 4, layer_no) AS toe FROM stress GROUP BY case_id)"""


@query("pile_capacity", "piles soil_layers", """
SELECT case_id, round(shaft, 4) ultimate_shaft_kn, round(toe, 4) ultimate_end_kn, round(shaft + toe, 4) ultimate_total_kn, round(shaft / 2.5, 4) allowable_shaft_kn,
       round(toe / 3, 4) allowable_end_kn, round((shaft + toe) / 2.5, 4) allowable_total_kn FROM capacity""", PILE_SQL)
def pile_capacity(piles, layers):
    names = ["ultimate_shaft_kn", "ultimate_end_kn", "ultimate_total_kn", "allowable_shaft_kn", "allowable_end_kn", "allowable_total_kn"]
    return shown(design.pile_capacity(piles, layers), ["case_id"], names, 4)


@query("pile_group", "piles soil_layers", """
SELECT case_id, nx * ny AS num_piles, round(e, 6) AS group_efficiency, round(round(shaft + toe, 1) * nx * ny * e, 3) AS group_ultimate_kn
FROM (SELECT *, greatest(1 - atan(ratio / (nx + ny)) * (nx * ny - 1) / (pi() * nx * ny), 0.5) AS e FROM capacity)""", PILE_SQL)
def pile_group(piles, layers):
    groups = design.pile_groups(design.pile_capacity(piles, layers))
    return groups.selectExpr("case_id", "num_piles", "round(group_efficiency, 6) group_efficiency", "round(group_ultimate_kn, 3) group_ultimate_kn")


WALL_SQL = """
w0 AS (SELECT *, base_width_m - toe_length_m - stem_thickness_m AS heel, pow(tan(radians(45 - backfill_friction_angle_deg / 2)), 2) AS ka, tan(radians(foundation_friction_angle_deg)) AS tf,
              pow(tan(radians(45 + foundation_friction_angle_deg / 2)), 2) AS kpf FROM walls),
w1 AS (SELECT *, 0.5 * backfill_unit_weight_kn_m3 * wall_height_m * wall_height_m * ka AS p1, backfill_surcharge_kpa * wall_height_m * ka AS p2,
              stem_thickness_m * wall_height_m * 24 AS ws, base_width_m * base_thickness_m * 24 AS wb, heel * wall_height_m * backfill_unit_weight_kn_m3 AS wh,
              0.5 * foundation_unit_weight_kn_m3 * base_thickness_m * base_thickness_m * kpf AS pp FROM w0),
w2 AS (SELECT *, p1 + p2 AS pa, p1 * wall_height_m / 3 + p2 * wall_height_m / 2 AS mo, ws + wb + wh AS w,
              ws * (toe_length_m + stem_thickness_m / 2) + wb * (toe_length_m + base_width_m / 2) + wh * (toe_length_m + stem_thickness_m + heel / 2) AS mr FROM w1),
w3 AS (SELECT *, base_width_m / 2 - (mr - mo) / w AS e, exp(pi() * tf) * kpf AS nq FROM w2),
w4 AS (SELECT *, CASE WHEN abs(e) <= base_width_m / 6 THEN w / base_width_m * (1 + 6 * e / base_width_m) ELSE 2 * w / (3 * (base_width_m / 2 - e)) END AS qmax,
              (nq - 1) / tf * foundation_cohesion_kpa + 0.5 * foundation_unit_weight_kn_m3 * base_width_m * 0.5 * (nq - 1) * tf AS qu FROM w3),
stable AS (SELECT *, (w * 0.5 * tan(radians(backfill_friction_angle_deg)) + pp) / pa AS sliding, mr / mo AS overturning, CASE WHEN qmax > 0 THEN qu / qmax END AS bearing FROM w4)"""


@query("wall_stability", "walls", """
SELECT case_id, round(pa, 4) total_active_force, round(sliding, 6) sliding_fos, round(overturning, 6) overturning_fos, round(coalesce(bearing, -1), 4) bearing_fos, round(qmax, 4) max_pressure_kpa,
       sliding >= 1.5 AS sliding_pass, overturning >= 2 AS overturning_pass, coalesce(bearing >= 3, true) AS bearing_pass FROM stable""", WALL_SQL)
def wall_stability(walls):
    return design.wall_cases(walls).selectExpr(
        "case_id", "round(total_active_force, 4) total_active_force", "round(sliding_fos, 6) sliding_fos", "round(overturning_fos, 6) overturning_fos",
        "round(if(bearing_fos = double('inf'), -1D, bearing_fos), 4) bearing_fos", "round(max_pressure_kpa, 4) max_pressure_kpa",
        "sliding_pass", "overturning_pass", "bearing_pass",
    )


@query("pressure_profile", "walls", """
SELECT case_id, CAST(i AS INT) AS point, round(wall_height_m * i / 99, 6) AS depth_m, round(pow(tan(radians(45 - backfill_friction_angle_deg / 2)), 2) * backfill_unit_weight_kn_m3 * wall_height_m * i / 99, 4) AS active_kpa,
       round(pow(tan(radians(45 + backfill_friction_angle_deg / 2)), 2) * backfill_unit_weight_kn_m3 * wall_height_m * i / 99, 4) AS passive_kpa
FROM (SELECT *, unnest(generate_series(0, 99)) AS i FROM walls)""")
def pressure_profile(walls):
    return design.pressure_profile(walls).selectExpr("case_id", "point", "round(depth_m, 6) depth_m", "round(active_kpa, 4) active_kpa", "round(passive_kpa, 4) passive_kpa")


@query("settlement_profile", "design_cases", """
SELECT case_id, CAST(i AS INT) AS point, round(-width_m + 2 * width_m * i / 99, 6) AS offset_m,
       round(cohesion_kpa * exp(-pow(-width_m + 2 * width_m * i / 99, 2) / (2 * pow(width_m / 3, 2))), 4) AS settlement_mm
FROM (SELECT *, unnest(generate_series(0, 99)) AS i FROM design_cases)""")
def settlement_profile(cases):
    rows = design.settlement_profile(cases.withColumn("max_settlement_mm", F.col("cohesion_kpa")))
    return rows.selectExpr("case_id", "point", "round(offset_m, 6) offset_m", "round(settlement_mm, 4) settlement_mm")


@query("design_sweep", "slopes", """
SELECT site, count(*) AS cases, round(avg(CASE WHEN fos >= 1.4 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, min_by(case_id, [round(fos, 9), case_id]) AS governing_case, round(min(fos), 6) AS smallest_fos
FROM (SELECT case_id, site, coalesce((cohesion_kpa + (n - u) * tan(radians(friction_angle_deg))) / nullif(d, 0), 1e9) AS fos FROM stress) GROUP BY 1""", """
spread AS (SELECT * REPLACE (unnest([0.0, 0.5, 1.0]) AS gwl_above_slip_m), unnest([1.0, 1.0, 1.0]) AS one FROM slopes),
deeper AS (SELECT * REPLACE (unnest([1.0, 2.0, 4.0]) AS depth_to_slip_m) FROM spread),
stress AS (SELECT *, unit_weight_kn_m3 * depth_to_slip_m * pow(cos(radians(slope_angle_deg)), 2) AS n, 9.81 * gwl_above_slip_m * pow(cos(radians(slope_angle_deg)), 2) AS u,
                  unit_weight_kn_m3 * depth_to_slip_m * sin(radians(slope_angle_deg)) * cos(radians(slope_angle_deg)) AS d FROM deeper)""")
def design_sweep(cases):
    swept = design.sweep(cases, {"gwl_above_slip_m": [0.0, 0.5, 1.0], "depth_to_slip_m": [1.0, 2.0, 4.0]})
    results = design.slope_cases(swept).withColumn("fos", F.round(F.least("fos", F.lit(1e9)), 9))
    return design.governing_cases(results, by="site", fos="fos", passes="pass_fail").selectExpr(
        "site", "cases", "round(pass_rate, 6) pass_rate", "governing_case", "round(smallest_fos, 6) smallest_fos"
    )


# --- catalogue ----------------------------------------------------------


def _projects(projects):
    pairs = lambda *names: F.map_filter(F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())
    return projects.select(
        "project_no", "project_type", pairs("pile_diameter_m").alias("parameters"), pairs("width_m", "height_m").alias("geometry"),
        pairs("cohesion_kpa", "friction_angle_deg").alias("soil"), F.lit(None).cast("double").alias("gwl_depth_m"),
    )


_SKILL_ROWS = ", ".join(
    f"('{kind}', {i}, '{skill}')" for kind, skills in {**V.PROJECT_SKILLS, "tunnel": V.DEFAULT_SKILLS}.items() for i, skill in enumerate(skills)
)
_INPUT_ROWS = ", ".join(f"('{s['skill_id']}', {i}, '{n}', '{u}', {r})" for s in V.SKILLS for i, (n, u, r) in enumerate(s["inputs"]))
SKILL_SQL = f"""
kinds(kind, k, skill_id) AS (VALUES {_SKILL_ROWS}),
needs(skill_id, i, name, unit, required) AS (VALUES {_INPUT_ROWS}),
wanted AS (SELECT p.*, k, skill_id FROM design_projects p JOIN kinds ON kind = project_type),
lacking AS (SELECT w.project_no, k, w.skill_id, i, name, unit FROM wanted w JOIN needs n ON n.skill_id = w.skill_id WHERE required AND NOT coalesce(CASE
    WHEN name IN ('foundation_width') THEN width_m IS NOT NULL WHEN name = 'wall_height_m' THEN height_m IS NOT NULL WHEN name = 'pile_diameter_m' THEN pile_diameter_m IS NOT NULL
    WHEN name IN ('soil_cohesion_kpa', 'cohesion_kpa') THEN cohesion_kpa IS NOT NULL
    WHEN name IN ('soil_friction_angle_deg', 'friction_angle_deg', 'backfill_friction_angle_deg') THEN friction_angle_deg IS NOT NULL ELSE false END, false))"""


@query("missing_inputs", "design_projects", """
SELECT w.project_no, w.skill_id, coalesce(string_agg(name, ',' ORDER BY i), '') AS missing FROM wanted w LEFT JOIN lacking l ON l.project_no = w.project_no AND l.skill_id = w.skill_id GROUP BY 1, 2""", SKILL_SQL)
def missing_inputs(projects):
    requests = design.missing_inputs(design.project_requests(_projects(projects)))
    return requests.selectExpr("project_no", "skill_id", "array_join(missing, ',') missing")


@query("pending_questions", "design_projects", """
SELECT project_no, array_to_string(list(q ORDER BY o)[1:8], ';') AS questions FROM (SELECT project_no, concat(name, ' (', unit, ')') AS q, min(k * 100 + i) AS o FROM lacking GROUP BY ALL) GROUP BY 1""", SKILL_SQL)
def pending_questions(projects):
    return design.pending_questions(design.project_requests(_projects(projects)), "project_no").selectExpr("project_no", "array_join(questions, ';') questions")


@query("skill_lookup", "design_projects", """
SELECT project_no, w.skill_id, (SELECT count(*) FROM needs n WHERE n.skill_id = w.skill_id AND required) AS inputs_required FROM wanted w""", SKILL_SQL)
def skill_lookup(projects):
    rows = projects.withColumn("skill_id", F.explode(design.project_skills(F.col("project_type"))))
    skills = design.list_skills(design.skill_table(projects.sparkSession))
    return rows.join(F.broadcast(skills), "skill_id").selectExpr("project_no", "skill_id", "cast(inputs_required as bigint) inputs_required")


@query("skill_store", "design_projects", """
SELECT project_no, w.skill_id, name, category, codes, acceptance, inputs_required FROM wanted w JOIN catalogue USING (skill_id)""", SKILL_SQL + """,
catalogue AS (SELECT * FROM (VALUES """ + ", ".join(
    "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in (s["skill_id"], s["name"], s["category"], ";".join(s["codes"]), ";".join(s["acceptance"]))) + f", {sum(n[2] for n in s['inputs'])})" for s in V.SKILLS
) + ") t(skill_id, name, category, codes, acceptance, inputs_required))")
def skill_store(projects):
    """The calculations that projects ask for, looked up in the stored catalogue."""
    from uuid import uuid4

    from groundplan.session import ensure_checkpoint_dir

    spark = projects.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sources/{uuid4().hex}"
    design.write_skills(design.skill_table(spark), folder)
    stored = design.read_skills(spark, folder)
    rows = projects.withColumn("skill_id", F.explode(design.project_skills(F.col("project_type"))))
    details = design.list_skills(stored).join(stored.select("skill_id", "acceptance"), "skill_id")
    joined = rows.select("project_no", "skill_id").join(F.broadcast(details), "skill_id")
    return joined.selectExpr(
        "project_no", "skill_id", "name", "category", "array_join(codes, ';') codes", "array_join(acceptance, ';') acceptance", "inputs_required"
    )


_CRITERIA = "CASE skill_id " + " ".join(f"WHEN '{s['skill_id']}' THEN '{';'.join(s['acceptance'])}'" for s in V.SKILLS) + " END"


@query("skill_execution", "design_cases slopes walls piles", f"""
SELECT case_id, skill_id, round(first, 4) AS first, round(second, 4) AS second, error = '' AS success, error, CASE WHEN error = '' THEN {_CRITERIA} ELSE '' END AS acceptance FROM (
  SELECT case_id, 'shallow_bearing_capacity' AS skill_id, CASE WHEN asked THEN q ELSE -1 END AS first, CASE WHEN asked THEN q / 3 ELSE -1 END AS second,
         CASE WHEN asked THEN '' ELSE 'Missing required inputs: [''foundation_length'']' END AS error FROM (SELECT *, case_id % 4 <> 1 OR length_m > 2 AS asked FROM hansen)
  UNION ALL SELECT case_id, 'slope_stability_infinite', coalesce(fos, 1e9), -1, '' FROM infinite
  UNION ALL SELECT case_id, 'earth_pressure_rankine', total, ka, '' FROM summed
  UNION ALL SELECT case_id, 'retaining_wall_stability', sliding, overturning, '' FROM stable
  UNION ALL SELECT case_id, 'pile_axial_capacity', shaft + toe, (shaft + toe) / 2.5, '' FROM single
  UNION ALL SELECT case_id, 'unheard_of', -1, -1, 'Skill not found: unheard_of' FROM design_cases)""", ",\n".join([HANSEN_SQL.strip(), SLOPE_SQL.strip().replace("stress AS", "slope_stress AS").replace("FROM stress", "FROM slope_stress"), RANKINE_SQL.strip(), WALL_SQL.strip()]) + """,
sunk AS (SELECT p.case_id, p.diameter_m AS d, p.embedment_length_m AS len, c.cohesion_kpa AS c, c.friction_angle_deg AS phi, c.unit_weight_kn_m3 AS g FROM piles p JOIN design_cases c USING (case_id)),
rubbed AS (SELECT *, CASE WHEN c > 5 THEN least(CASE WHEN c < 50 THEN c ELSE c * 0.5 END, 100)
                          WHEN phi > 0 THEN least((1 + radians(phi)) * tan(radians(phi * 0.8)) * g * len / 2, 100) ELSE 0 END AS qs,
                  least(CASE WHEN c <= 5 OR phi > 0 THEN g * len * exp(pi() * tan(radians(phi))) * pow(tan(radians(45 + phi / 2)), 2) * CASE WHEN len / d > 1 THEN sqrt(least(len / d, 15)) ELSE 1 END ELSE c * 9 END, 10000) AS qb FROM sunk),
single AS (SELECT case_id, qs * pi() * d * len AS shaft, qb * pi() * d * d / 4 AS toe FROM rubbed)""")
def skill_execution(cases, slopes, walls, piles):
    """Requests of all five calculations, some without a required input, and some for none that there is."""
    col = F.col
    asked = {
        "shallow_bearing_capacity": (cases, {
            "soil_cohesion_kpa": col("cohesion_kpa"), "soil_friction_angle_deg": col("friction_angle_deg"), "soil_unit_weight": col("unit_weight_kn_m3"),
            "foundation_width": col("width_m"), "foundation_length": F.when(F.expr("case_id % 4 <> 1 or length_m > 2"), col("length_m")),
            "foundation_depth": col("depth_m"), "gwl_depth": col("gwl_depth_m"),
        }),
        "slope_stability_infinite": (slopes, {
            "slope_angle_deg": col("slope_angle_deg"), "friction_angle_deg": col("friction_angle_deg"), "cohesion_kpa": col("cohesion_kpa"),
            "unit_weight": col("unit_weight_kn_m3"), "depth_to_slip_m": col("depth_to_slip_m"), "gwl_above_slip_m": col("gwl_above_slip_m"),
        }),
        "earth_pressure_rankine": (walls, {
            "wall_height_m": col("wall_height_m"), "backfill_friction_angle_deg": col("backfill_friction_angle_deg"), "backfill_cohesion_kpa": col("foundation_cohesion_kpa") / 10,
            "backfill_unit_weight": col("backfill_unit_weight_kn_m3"), "surcharge_kpa": col("backfill_surcharge_kpa"),
        }),
        "retaining_wall_stability": (walls, {n: col(n) for n in (
            "wall_height_m", "base_width_m", "toe_length_m", "stem_thickness_m", "base_thickness_m", "backfill_unit_weight_kn_m3", "backfill_friction_angle_deg",
            "backfill_surcharge_kpa", "foundation_cohesion_kpa", "foundation_friction_angle_deg")}),
        "pile_axial_capacity": (piles.join(cases, "case_id"), {
            "pile_diameter_m": col("diameter_m"), "pile_length_m": col("embedment_length_m"), "soil_cohesion_kpa": col("cohesion_kpa"),
            "soil_friction_angle_deg": col("friction_angle_deg"), "soil_unit_weight_kn_m3": col("unit_weight_kn_m3"),
        }),
        "unheard_of": (cases, {"cohesion_kpa": col("cohesion_kpa")}),
    }
    shown = {"shallow_bearing_capacity": ("q_ult_kpa", "q_allowable_kpa"), "slope_stability_infinite": ("fos", "none"), "earth_pressure_rankine": ("total_active_force", "ka"),
             "retaining_wall_stability": ("sliding_fos", "overturning_fos"), "pile_axial_capacity": ("ultimate_total_kn", "allowable_total_kn"), "unheard_of": ("none", "none")}
    requests = None
    for skill, (rows, inputs) in asked.items():
        own = F.map_filter(F.create_map(*[c for n, v in inputs.items() for c in (F.lit(n), v.cast("double"))]), lambda k, v: v.isNotNull())
        part = rows.select("case_id", F.lit(skill).alias("skill_id"), own.alias("inputs"), F.array(*map(F.lit, shown[skill])).alias("shown"))
        requests = part if requests is None else requests.unionByName(part)
    done = design.execute(requests)
    value = lambda i: F.round(F.least(F.coalesce(F.expr(f"results[shown[{i}]]"), F.lit(-1.0)), F.lit(1e9)), 4)
    return done.select(
        "case_id", "skill_id", value(0).alias("first"), value(1).alias("second"), "success", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.array_join("acceptance", ";"), F.lit("")).alias("acceptance"),
    )
