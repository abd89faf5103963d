"""Bulk evaluation of design cases, parameter studies and the calculation catalogue."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions import geotech as G

_FOUNDATION = ["cohesion_kpa", "friction_angle_deg", "unit_weight_kn_m3", "width_m", "length_m", "depth_m", "gwl_depth_m"]


def _columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def terzaghi_cases(cases: DataFrame, *, fos: float = 3.0) -> DataFrame:
    return cases.withColumns(G.terzaghi(*_columns(*_FOUNDATION), fos=fos))


def hansen_cases(cases: DataFrame, *, fos: float = 3.0) -> DataFrame:
    return cases.withColumns(G.hansen(*_columns(*_FOUNDATION), fos=fos))


def ec7_combinations(cases: DataFrame) -> DataFrame:
    """Both factor combinations of each case (with permanent and variable load).

    The two factor sets are unpacked inside the case's row.
    """
    names = ["combination", "gamma_c", "gamma_phi", "gamma_g", "gamma_q", "gamma_r"]
    sets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in V.EC7_COMBINATIONS])
    rows = cases.select("*", F.inline(sets))
    rows = rows.withColumns(
        {
            "design_c": F.col("cohesion_kpa") / F.col("gamma_c"),
            "design_phi": F.degrees(F.atan(F.tan(F.radians("friction_angle_deg")) / F.col("gamma_phi"))),
        }
    )
    pressure = G.hansen(F.col("design_c"), F.col("design_phi"), *_columns(*_FOUNDATION[2:]), fos=1.0)["q_ult_kpa"]
    # the capacity enters the check rounded to one decimal
    rows = rows.withColumn("q_ult_design_kpa", F.round(pressure, 1))
    area = F.col("width_m") * F.col("length_m")
    rows = rows.withColumns(
        {
            "r_d_kn": F.col("q_ult_design_kpa") * area / F.col("gamma_r"),
            "v_d_kn": F.coalesce("permanent_load_kn", F.lit(0.0)) * F.col("gamma_g") + F.coalesce("variable_load_kn", F.lit(0.0)) * F.col("gamma_q"),
        }
    )
    use = F.when(F.col("r_d_kn") > 0, F.col("v_d_kn") / F.col("r_d_kn")).otherwise(float("inf"))
    return rows.withColumns(
        {
            "q_design_kpa": F.when(F.col("v_d_kn") > 0, F.col("v_d_kn") / area).otherwise(0.0),
            "utilisation": use,
            "passes": use <= 1.0,
        }
    )


def ec7_check(cases: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Whether both combinations hold, and which governs (the second on a tie)."""
    rows = ec7_combinations(cases)
    of = lambda name: F.max(F.when(F.col("combination") == name, F.round("utilisation", 3)))
    sums = rows.groupBy(key).agg(
        F.bool_and("passes").alias("overall_pass"), of("Combination_1").alias("utilisation_1"), of("Combination_2").alias("utilisation_2")
    )
    first = F.col("utilisation_1") > F.col("utilisation_2")
    return sums.withColumn("governing", F.when(first, "Combination_1").otherwise("Combination_2"))


def slope_cases(cases: DataFrame, *, required: float = 1.4) -> DataFrame:
    names = ["slope_angle_deg", "friction_angle_deg", "cohesion_kpa", "unit_weight_kn_m3", "depth_to_slip_m", "gwl_above_slip_m"]
    return cases.withColumns(G.infinite_slope(*_columns(*names), required=required))


def taylor_cases(cases: DataFrame, *, required: float = 1.4) -> DataFrame:
    names = ["slope_angle_deg", "height_m", "cohesion_kpa", "unit_weight_kn_m3", "friction_angle_deg"]
    return cases.withColumns(G.taylor(*_columns(*names), required=required))


def rankine_cases(cases: DataFrame) -> DataFrame:
    names = ["wall_height_m", "backfill_friction_angle_deg", "backfill_cohesion_kpa", "backfill_unit_weight_kn_m3", "backfill_surcharge_kpa"]
    return cases.withColumns(G.rankine(*_columns(*names)))


def wall_cases(cases: DataFrame) -> DataFrame:
    names = [
        "wall_height_m", "base_width_m", "toe_length_m", "stem_thickness_m", "base_thickness_m", "backfill_unit_weight_kn_m3",
        "backfill_friction_angle_deg", "backfill_surcharge_kpa", "foundation_cohesion_kpa", "foundation_friction_angle_deg",
        "foundation_unit_weight_kn_m3",
    ]
    return cases.withColumns(G.wall_stability(*_columns(*names)))


def pile_capacity(piles: DataFrame, layers: DataFrame, *, fos: float = 2.5, key: str = "case_id") -> DataFrame:
    """Axial capacity of piles through their soil layers.

    Each layer adds its share of shaft friction; the last layer bears the toe.
    """
    soil = _columns("soil_type", "cohesion_kpa", "friction_angle_deg", "unit_weight_kn_m3")
    rows = piles.join(layers, key)
    top, bottom = F.col("depth_from_m"), F.col("depth_from_m") + F.col("thickness_m")
    touching = F.greatest(F.least(bottom, F.col("embedment_length_m")) - F.greatest(top, F.lit(0.0)), F.lit(0.0))
    stress = G.shaft_stress(*soil, top + F.col("thickness_m") / 2)
    shaft = F.when(F.col("embedment_length_m") > top, stress * math.pi * F.col("diameter_m") * touching).otherwise(0.0)
    toe = G.toe_stress(*soil, F.col("embedment_length_m"), F.col("diameter_m")) * math.pi * F.col("diameter_m") * F.col("diameter_m") / 4
    own = [c for c in piles.columns if c != key]
    sums = rows.groupBy(key, *own).agg(F.sum(shaft).alias("ultimate_shaft_kn"), F.max_by(toe, "layer_no").alias("ultimate_end_kn"))
    total = F.col("ultimate_shaft_kn") + F.col("ultimate_end_kn")
    return sums.withColumns(
        {
            "ultimate_total_kn": total,
            "allowable_shaft_kn": F.col("ultimate_shaft_kn") / fos,
            "allowable_end_kn": F.col("ultimate_end_kn") / (fos + 0.5),
            "allowable_total_kn": total / fos,
        }
    )


def single_layer_piles(cases: DataFrame, *, fos: float = 2.5) -> DataFrame:
    names = ["pile_diameter_m", "pile_length_m", "soil_cohesion_kpa", "soil_friction_angle_deg", "soil_unit_weight_kn_m3"]
    return cases.withColumns(G.single_pile(*_columns(*names), fos=fos))


def pile_groups(capacities: DataFrame, *, method: str = "Converse-Labarre") -> DataFrame:
    """Group capacity from single capacities, which enter rounded to one decimal."""
    piles = F.col("piles_x") * F.col("piles_y")
    efficiency = G.group_efficiency(F.col("spacing_ratio"), F.col("piles_x"), F.col("piles_y"), method)
    each = lambda c: F.round(c, 1)
    return capacities.withColumns(
        {
            "num_piles": piles, "group_efficiency": efficiency,
            "group_ultimate_kn": each("ultimate_total_kn") * piles * efficiency,
            "group_allowable_kn": each("allowable_total_kn") * piles * efficiency,
        }
    )


# --- studies ------------------------------------------------------------


def sweep(cases: DataFrame, ranges: dict[str, list[float]]) -> DataFrame:
    """Every case with every combination of the given parameter values.

    The values are unpacked inside the case's row, one parameter after the
    other.
    """
    for name, values in ranges.items():
        spread = F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)
        cases = cases.select(*[c for c in cases.columns if c != name], spread)
    return cases


def governing_cases(results: DataFrame, *, by: str, fos: str, passes: str, key: str = "case_id") -> DataFrame:
    """Pass rate and the case with the smallest safety, per site."""
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.when(F.col(passes), 1.0).otherwise(0.0)).alias("pass_rate"),
        F.min_by(F.col(key), F.struct(fos, key)).alias("governing_case"),
        F.min(fos).alias("smallest_fos"),
    )


def pressure_profile(walls: DataFrame, *, points: int = 100) -> DataFrame:
    """Active and passive pressure at evenly spaced depths of each wall."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    friction, weight = F.col("backfill_friction_angle_deg"), F.col("backfill_unit_weight_kn_m3")
    rows = walls.select("case_id", friction, weight, "wall_height_m", step)
    rows = rows.withColumn("depth_m", F.col("wall_height_m") * F.col("point") / (points - 1))
    return rows.select(
        "case_id", "point", "depth_m", (G.rankine_active(friction) * weight * F.col("depth_m")).alias("active_kpa"),
        (G.rankine_passive(friction) * weight * F.col("depth_m")).alias("passive_kpa"),
    )


def settlement_profile(cases: DataFrame, *, points: int = 100) -> DataFrame:
    """Bell-shaped settlement across each foundation (width_m, max_settlement_mm)."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    rows = cases.select("case_id", "width_m", "max_settlement_mm", step)
    rows = rows.withColumn("offset_m", -F.col("width_m") + 2 * F.col("width_m") * F.col("point") / (points - 1))
    spread = F.col("width_m") / 3
    drop = F.col("max_settlement_mm") * F.exp(-F.col("offset_m") * F.col("offset_m") / (2 * spread * spread))
    return rows.select("case_id", "point", "offset_m", drop.alias("settlement_mm"))


# --- calculation catalogue ----------------------------------------------


def skill_table(spark: SparkSession) -> DataFrame:
    """The calculation catalogue, one row per calculation."""
    schema = (
        "skill_id string, name string, category string, codes array<string>, report_sections array<string>, acceptance array<string>, "
        "inputs array<struct<name: string, unit: string, required: boolean>>"
    )
    keys = ["skill_id", "name", "category", "codes", "report_sections", "acceptance", "inputs"]
    return spark.createDataFrame([tuple(s[k] for k in keys) for s in V.SKILLS], schema)


def write_skills(skills: DataFrame, path: str) -> None:
    skills.write.mode("overwrite").json(path)


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(skill_table(spark).schema).json(path)


def find_skills(skills: DataFrame, *, category: str | None = None, code: str | None = None, section: str | None = None, skill_id: str | None = None) -> DataFrame:
    """Calculations of a category, code, report section or id."""
    if category is not None:
        skills = skills.filter(F.col("category") == category)
    if code is not None:
        skills = skills.filter(F.array_contains("codes", code))
    if section is not None:
        skills = skills.filter(F.array_contains("report_sections", section))
    if skill_id is not None:
        skills = skills.filter(F.col("skill_id") == skill_id)
    return skills


def list_skills(skills: DataFrame) -> DataFrame:
    required = F.size(F.filter("inputs", lambda i: i["required"]))
    return skills.select("skill_id", "name", "category", "codes", required.alias("inputs_required"))


def required_inputs(skill_id: Column) -> Column:
    """Names of the inputs a calculation must have."""
    chain = F
    for s in V.SKILLS:
        chain = chain.when(skill_id == s["skill_id"], F.array(*[F.lit(n) for n, _, needed in s["inputs"] if needed]))
    return chain


def input_unit(skill_id: Column, name: Column) -> Column:
    chain = F
    for s in V.SKILLS:
        for n, unit, _ in s["inputs"]:
            chain = chain.when((skill_id == s["skill_id"]) & (name == n), unit)
    return chain


def missing_inputs(requests: DataFrame) -> DataFrame:
    """Requests (skill_id, inputs map) with the required inputs they lack."""
    given = F.map_keys("inputs")
    needed = required_inputs(F.col("skill_id"))
    missing = F.filter(needed, lambda n: ~F.array_contains(given, n))
    return requests.withColumn("missing", F.coalesce(missing, F.expr("cast(array() as array<string>)")))


def project_skills(project_type: Column) -> Column:
    """Calculations a type of project asks for."""
    chain = F
    for kind, skills in V.PROJECT_SKILLS.items():
        chain = chain.when(project_type == kind, F.array(*map(F.lit, skills)))
    return chain.otherwise(F.array(*map(F.lit, V.DEFAULT_SKILLS)))


def resolved_parameter(name: str, parameters: Column, geometry: Column, soil: Column, water_depth: Column) -> Column:
    """Value of a parameter: as given, else by alias from geometry, soil or water."""
    given = parameters[name]
    if name in V.GEOMETRY_ALIASES:
        return F.coalesce(given, geometry[V.GEOMETRY_ALIASES[name]])
    if name in V.SOIL_ALIASES:
        return F.coalesce(given, soil[V.SOIL_ALIASES[name]])
    return F.coalesce(given, water_depth) if name == "gwl_depth" else given


def project_requests(projects: DataFrame) -> DataFrame:
    """One row per project and calculation with its resolved inputs.

    ``projects`` has project_type, parameters, geometry and soil (maps of
    numbers; soil is the first layer) and gwl_depth_m.
    """
    rows = projects.withColumn("skill_id", F.explode(project_skills(F.col("project_type"))))
    columns = _columns("parameters", "geometry", "soil", "gwl_depth_m")
    names = sorted({n for s in V.SKILLS for n, _, _ in s["inputs"]})
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), resolved_parameter(n, *columns).alias("value")) for n in names])
    return rows.withColumn("inputs", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def pending_questions(requests: DataFrame, key: str) -> DataFrame:
    """Up to eight distinct inputs to ask for, per project."""
    text = F.concat("name", F.lit(" ("), input_unit(F.col("skill_id"), F.col("name")), F.lit(")"))
    order = F.struct(F.array_position(project_skills(F.col("project_type")), F.col("skill_id")).alias("s"), F.col("n").alias("n"))
    rows = missing_inputs(requests).select(key, "project_type", "skill_id", F.posexplode("missing").alias("n", "name")).select(
        key, order.alias("o"), text.alias("question")
    )
    questions = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", "question"))), lambda q: q["question"]))
    return rows.groupBy(key).agg(F.slice(questions, 1, V.MAX_PENDING_QUESTIONS).alias("questions"))


Calculation = Callable[[Column], dict[str, Column]]


def _calculations() -> dict[str, Calculation]:
    or_value = lambda i, n, other: F.coalesce(i[n], F.lit(other))
    return {
        "shallow_bearing_capacity": lambda i: {
            n: c
            for n, c in G.hansen(
                i["soil_cohesion_kpa"], i["soil_friction_angle_deg"], i["soil_unit_weight"], i["foundation_width"],
                i["foundation_length"], i["foundation_depth"], i["gwl_depth"], or_value(i, "factor_of_safety", 3.0),
            ).items()
            if n in ("q_ult_kpa", "q_allowable_kpa")
        },
        "slope_stability_infinite": lambda i: {
            "fos": G.infinite_slope(
                i["slope_angle_deg"], i["friction_angle_deg"], i["cohesion_kpa"], i["unit_weight"], i["depth_to_slip_m"],
                or_value(i, "gwl_above_slip_m", 0.0),
            )["fos"]
        },
        "earth_pressure_rankine": lambda i: {
            n: c
            for n, c in G.rankine(
                i["wall_height_m"], i["backfill_friction_angle_deg"], or_value(i, "backfill_cohesion_kpa", 0.0),
                i["backfill_unit_weight"], or_value(i, "surcharge_kpa", 0.0),
            ).items()
            if n in ("ka", "kp", "total_active_force", "point_of_application_m")
        },
        "pile_axial_capacity": lambda i: G.single_pile(
            i["pile_diameter_m"], i["pile_length_m"], i["soil_cohesion_kpa"], i["soil_friction_angle_deg"],
            i["soil_unit_weight_kn_m3"], or_value(i, "factor_of_safety", 2.5),
        ),
        "retaining_wall_stability": lambda i: {
            n: c
            for n, c in G.wall_stability(
                i["wall_height_m"], i["base_width_m"], or_value(i, "toe_length_m", 1.0), or_value(i, "stem_thickness_m", 0.4),
                or_value(i, "base_thickness_m", 0.5), or_value(i, "backfill_unit_weight_kn_m3", 18.0), i["backfill_friction_angle_deg"],
                or_value(i, "backfill_surcharge_kpa", 0.0), or_value(i, "foundation_cohesion_kpa", 50.0),
                or_value(i, "foundation_friction_angle_deg", 25.0), F.lit(18.0),
            ).items()
            if n in ("sliding_fos", "overturning_fos", "bearing_fos")
        },
    }


CALCULATIONS: dict[str, Calculation] = _calculations()


def execute(requests: DataFrame, calculations: dict[str, Calculation] = CALCULATIONS) -> DataFrame:
    """Run each request's calculation: success, results map, error text, and the acceptance criteria of what succeeded.

    All registered calculations are branches of one expression, so requests of
    every kind are evaluated together in their own rows.
    """
    rows = missing_inputs(requests)
    inputs, skill = F.col("inputs"), F.col("skill_id")
    ready = F.size("missing") == 0
    chain = F
    for name, calculate in calculations.items():
        pairs = [c for n, v in calculate(inputs).items() for c in (F.lit(n), v.cast("double"))]
        chain = chain.when(ready & (skill == name), F.create_map(*pairs))
    listed = F.concat(F.lit("['"), F.array_join("missing", "', '"), F.lit("']"))
    known = skill.isin(*[s["skill_id"] for s in V.SKILLS])
    error = (
        F.when(~known, F.concat(F.lit("Skill not found: "), skill))
        .when(~ready, F.concat(F.lit("Missing required inputs: "), listed))
        .when(~skill.isin(*calculations), F.concat(F.lit("No executor registered for skill: "), skill))
    )
    criteria = F
    for s in V.SKILLS:
        criteria = criteria.when(skill == s["skill_id"], F.array(*map(F.lit, s["acceptance"])))
    done = rows.withColumns({"results": chain, "error": error}).withColumn("success", F.col("error").isNull())
    return done.withColumn("acceptance", F.when(F.col("success"), criteria))
