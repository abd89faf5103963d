import math

import pytest
from pyspark.sql import functions as F

from groundplan.operators import cache, design

CASE = "case_id int, cohesion_kpa double, friction_angle_deg double, unit_weight_kn_m3 double, width_m double, length_m double, depth_m double, gwl_depth_m double"


def test_terzaghi_by_hand(frame):
    rows = frame([(1, 5.0, 30.0, 19.0, 2.0, 2.0, 1.5, None), (2, 40.0, 0.0, 18.0, 1.0, 20.0, 1.0, 0.5)], CASE)
    got = {r.case_id: r for r in design.terzaghi_cases(rows).collect()}
    nq = math.exp(math.pi * math.tan(math.pi / 6)) * 3.0
    nc, ngamma = (nq - 1) / math.tan(math.pi / 6), 2 * (nq + 1) * math.tan(math.pi / 6)
    assert got[1].q_ult_kpa == pytest.approx(5 * nc * 1.3 + 19 * 1.5 * nq + 0.5 * 19 * 2 * ngamma * 0.8)
    # strip footing on clay with water at the base: buoyant weight, no shape factors
    assert got[2].q_ult_kpa == pytest.approx(40 * 5.14 + (18 - 9.81) * 1.0)
    assert got[2].q_allowable_kpa == pytest.approx(got[2].q_ult_kpa / 3)


def test_hansen_by_hand(frame):
    got = design.hansen_cases(frame([(1, 0.0, 28.0, 18.0, 1.5, 3.0, 1.2, 1.0)], CASE)).first()
    phi = math.radians(28)
    nq = math.exp(math.pi * math.tan(phi)) * math.tan(math.radians(59)) ** 2
    ngamma = 1.5 * (nq - 1) * math.tan(phi)
    weight = 18 - 9.81
    q = weight * 1.2 * nq * (1 + 0.5 * math.tan(phi)) * (1 + 2 * math.tan(phi) * (1 - math.sin(phi)) ** 2 * 0.8) + 0.5 * weight * 1.5 * ngamma * 0.8
    assert got.q_ult_kpa == pytest.approx(q)


def test_ec7_tie_goes_to_the_second(frame):
    rows = frame([(1, 10.0, 30.0, 19.0, 2.0, 2.0, 1.5, None)], CASE).withColumns({"permanent_load_kn": F.lit(0.0), "variable_load_kn": F.lit(0.0)})
    r = design.ec7_check(rows).first()
    assert r.overall_pass and r.governing == "Combination_2" and r.utilisation_1 == 0.0


def test_flat_slope_never_fails(frame):
    rows = frame([(1, 0.0, 30.0, 5.0, 18.0, 2.0, 0.0), (2, 30.0, 35.0, 5.0, 18.0, 2.0, 1.0)],
                 "case_id int, slope_angle_deg double, friction_angle_deg double, cohesion_kpa double, unit_weight_kn_m3 double, depth_to_slip_m double, gwl_above_slip_m double")
    got = {r.case_id: r for r in design.slope_cases(rows).collect()}
    assert got[1].fos == math.inf and got[1].pass_fail and got[1].pore_ratio is None
    b = math.radians(30)
    fos = (5 + (36 - 9.81) * math.cos(b) ** 2 * math.tan(math.radians(35))) / (36 * math.sin(b) * math.cos(b))
    assert got[2].fos == pytest.approx(fos) and got[2].pore_ratio == pytest.approx(9.81 / 36)


def test_single_pile_equals_layered_pile(frame):
    one = frame([(1, 1.0, 20.0, 20.0, 30.0, 18.0)], "case_id int, pile_diameter_m double, pile_length_m double, soil_cohesion_kpa double, soil_friction_angle_deg double, soil_unit_weight_kn_m3 double")
    a = design.single_layer_piles(one).first()
    piles = frame([(1, 1.0, 20.0)], "case_id int, diameter_m double, embedment_length_m double")
    layers = frame([(1, 1, 0.0, 20.0, "cohesive", 20.0, 30.0, 18.0)], "case_id int, layer_no int, depth_from_m double, thickness_m double, soil_type string, cohesion_kpa double, friction_angle_deg double, unit_weight_kn_m3 double")
    b = design.pile_capacity(piles, layers).first()
    assert a.ultimate_shaft_kn == pytest.approx(20 * math.pi * 20) and a.ultimate_shaft_kn == pytest.approx(b.ultimate_shaft_kn)
    assert a.ultimate_end_kn == pytest.approx(10000 * math.pi / 4) and a.allowable_end_kn == pytest.approx(a.ultimate_end_kn / 3)
    assert b.allowable_total_kn == pytest.approx(a.allowable_total_kn)


def test_execution_envelope(frame):
    rows = frame(
        [(1, "earth_pressure_rankine", {"wall_height_m": 4.0, "backfill_friction_angle_deg": 30.0, "backfill_unit_weight": 18.0}),
         (2, "earth_pressure_rankine", {"wall_height_m": 4.0}), (3, "unknown", {}),
         (4, "retaining_wall_stability", {"wall_height_m": 5.0, "base_width_m": 4.0, "backfill_friction_angle_deg": 30.0}),
         (5, "pile_axial_capacity", {"pile_diameter_m": 1.0, "pile_length_m": 20.0, "soil_cohesion_kpa": 20.0, "soil_friction_angle_deg": 30.0, "soil_unit_weight_kn_m3": 18.0})],
        "id int, skill_id string, inputs map<string,double>",
    )
    got = {r.id: r for r in design.execute(rows).collect()}
    assert got[1].success and got[1].results["ka"] == pytest.approx(1 / 3) and got[1].results["total_active_force"] == pytest.approx(48.0)
    assert got[2].error == "Missing required inputs: ['backfill_friction_angle_deg', 'backfill_unit_weight']" and not got[2].success
    assert got[3].error == "Skill not found: unknown"
    assert got[4].success and got[4].results["sliding_fos"] > 0
    assert got[5].results["ultimate_shaft_kn"] == pytest.approx(400 * math.pi)


def test_catalogue(spark, tmp_path):
    skills = design.skill_table(spark)
    design.write_skills(skills, str(tmp_path / "s"))
    back = design.read_skills(spark, str(tmp_path / "s"))
    assert back.count() == 5
    ids = lambda df: {r.skill_id for r in df.collect()}
    assert ids(design.find_skills(back, category="slopes")) == {"slope_stability_infinite"}
    assert ids(design.find_skills(back, code="bs_8002")) == {"earth_pressure_rankine", "retaining_wall_stability"}
    assert len(ids(design.find_skills(back, section="6_recommendations"))) == 4
    assert {r.skill_id: r.inputs_required for r in design.list_skills(back).collect()}["shallow_bearing_capacity"] == 6


def test_parameters_resolve_by_priority(frame):
    maps = "map<string,double>"
    rows = frame(
        [(1, "building", {"soil_unit_weight": 20.0}, {"width_m": 2.0, "length_m": 2.0, "depth_m": 1.0}, {"cohesion_kpa": 5.0, "friction_angle_deg": 30.0, "unit_weight_kn_m3": 19.0}, 3.5),
         (2, "tunnel", {}, {}, {}, None)],
        f"project_no int, project_type string, parameters {maps}, geometry {maps}, soil {maps}, gwl_depth_m double",
    )
    requests = design.project_requests(rows)
    got = {r.project_no: r for r in requests.collect()}
    assert got[1].inputs["soil_unit_weight"] == 20.0 and got[1].inputs["soil_cohesion_kpa"] == 5.0 and got[1].inputs["gwl_depth"] == 3.5
    assert design.execute(requests).filter("project_no = 1").first().success
    asked = design.pending_questions(requests, "project_no").collect()
    assert [r.project_no for r in asked] == [2] and asked[0].questions[0] == "soil_cohesion_kpa (kPa)" and len(asked[0].questions) == 6


def test_cache_keys(spark):
    import hashlib

    row = spark.range(1).select(
        cache.search_key(F.lit("q"), F.expr("map('b', '2', 'a', '1')")).alias("s"), cache.search_key(F.lit("q"), F.lit(None).cast("map<string,string>")).alias("e"),
        cache.answer_key(F.lit("p"), F.lit(None), F.lit("m")).alias("a"),
    ).first()
    assert row.s == "search:" + hashlib.md5(b'q|{"a": "1", "b": "2"}').hexdigest()
    assert row.e == "search:" + hashlib.md5(b"q|{}").hexdigest()
    assert row.a == "llm:" + hashlib.sha256(b"p||m").hexdigest()


def test_a_bad_case_does_not_stop_the_others(frame):
    rows = frame([(1, 5.0, 30.0, 19.0, 0.0, 0.0, 1.5, None), (2, 5.0, 30.0, 19.0, 2.0, 2.0, 1.5, None)], CASE)
    got = {r.case_id: r.q_ult_kpa for r in design.hansen_cases(rows).collect()}
    assert got[1] is None and got[2] > 0
    got = {r.case_id: r.q_ult_kpa for r in design.terzaghi_cases(rows).collect()}
    assert got[2] > 0
