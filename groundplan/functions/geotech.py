"""Design calculations as column expressions.

All results are unrounded; a case that divides by zero gives null, so that one
bad case does not stop a study. The formulas keep the simplifications of the
calculations they stand for: they serve to compare cases, not as advice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundplan import fixed_values as V


def _tan(degrees: Column) -> Column:
    return F.tan(F.radians(degrees))


def _square(c: Column) -> Column:
    return c * c


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rankine_active(friction: Column) -> Column:
    return _square(_tan(45 - friction / 2))


def rankine_passive(friction: Column) -> Column:
    return _square(_tan(45 + friction / 2))


def bearing_nq(friction: Column) -> Column:
    return F.exp(math.pi * _tan(friction)) * rankine_passive(friction)


def overburden(unit_weight: Column, depth: Column, water_depth: Column) -> tuple[Column, Column]:
    """Overburden pressure and the unit weight below the base; buoyant when the
    water stands no deeper than the base."""
    wet = water_depth.isNotNull() & (water_depth <= depth)
    effective = F.when(wet, unit_weight - V.WATER_UNIT_WEIGHT).otherwise(unit_weight)
    return effective * depth, effective


def terzaghi(cohesion, friction, unit_weight, width, length, depth, water_depth, fos=3.0) -> dict[str, Column]:
    """Bearing capacity of a shallow foundation with shape factors."""
    undrained = friction == 0
    tangent = _tan(friction)
    nq = F.when(undrained, 1.0).otherwise(bearing_nq(friction))
    nc = F.when(undrained, V.UNDRAINED_NC).otherwise((bearing_nq(friction) - 1) / tangent)
    ngamma = F.when(undrained, 0.0).otherwise(2 * (bearing_nq(friction) + 1) * tangent)
    strip, square = _ratio(length, width) > 10, F.abs(length - width) < 0.01
    sc = F.when(strip, 1.0).when(square, 1.3).otherwise(1.0 + 0.3 * _ratio(width, length))
    sgamma = F.when(strip, 1.0).when(square, 0.8).otherwise(1.0 - 0.2 * _ratio(width, length))
    q, below = overburden(unit_weight, depth, water_depth)
    ultimate = cohesion * nc * sc + q * nq + 0.5 * below * width * ngamma * sgamma
    return {"nc": nc, "nq": nq, "ngamma": ngamma, "sc": sc, "sgamma": sgamma, "q_ult_kpa": ultimate, "q_allowable_kpa": ultimate / fos}


def hansen(cohesion, friction, unit_weight, width, length, depth, water_depth, fos=3.0) -> dict[str, Column]:
    """Bearing capacity of a shallow foundation with shape and depth factors."""
    undrained = friction == 0
    tangent, ratio, deep = _tan(friction), _ratio(width, length), _ratio(depth, width)
    nq = F.when(undrained, 1.0).otherwise(bearing_nq(friction))
    nc = F.when(undrained, V.UNDRAINED_NC).otherwise((bearing_nq(friction) - 1) / tangent)
    ngamma = F.when(undrained, 0.0).otherwise(1.5 * (bearing_nq(friction) - 1) * tangent)
    sc = F.when(friction > 0, 1.0 + (nq / nc) * ratio).otherwise(1.0 + 0.2 * ratio)
    sq = 1.0 + ratio * tangent
    sgamma = F.greatest(1.0 - 0.4 * ratio, F.lit(0.6))
    k = F.when(deep <= 1, deep).otherwise(F.atan(deep))
    dc = 1.0 + 0.4 * k
    dq = 1.0 + 2 * tangent * _square(1 - F.sin(F.radians(friction))) * k
    q, below = overburden(unit_weight, depth, water_depth)
    ultimate = cohesion * nc * sc * dc + q * nq * sq * dq + 0.5 * below * width * ngamma * sgamma
    return {
        "nc": nc, "nq": nq, "ngamma": ngamma, "sc": sc, "sq": sq, "sgamma": sgamma, "dc": dc, "dq": dq,
        "q_ult_kpa": ultimate, "q_allowable_kpa": ultimate / fos,
    }


def infinite_slope(angle, friction, cohesion, unit_weight, depth, water_height, required=1.4) -> dict[str, Column]:
    """Safety of a long drained slope; a flat one has no driving stress and never fails."""
    beta = F.radians(angle)
    cosine2 = _square(F.cos(beta))
    normal, pore = unit_weight * depth * cosine2, V.WATER_UNIT_WEIGHT * water_height * cosine2
    strength = cohesion + (normal - pore) * _tan(friction)
    driving = unit_weight * depth * F.sin(beta) * F.cos(beta)
    fos = F.when(driving <= 0, float("inf")).otherwise(strength / driving)
    return {"fos": fos, "pore_ratio": F.when(water_height > 0, _ratio(pore, normal)), "pass_fail": fos >= required}


def taylor(angle, height, cohesion, unit_weight, friction, required=1.4) -> dict[str, Column]:
    """Safety of a slope by its stability number."""
    number = (
        F.when(angle >= 53, 5.52)
        .when(angle >= 45, 5.5 + (53 - angle) * 0.5 / 8)
        .when(angle >= 30, 6.0 + (45 - angle) * 1.5 / 15)
        .when(angle >= 15, 7.5 + (30 - angle) * 3.5 / 15)
        .otherwise(11.0)
    )
    share = _ratio(cohesion, unit_weight * height)
    fos = F.when(friction == 0, number * share).otherwise(share * 5.5 + _ratio(_tan(friction), _tan(angle)))
    return {"fos": fos, "stability_number": F.when(friction == 0, number), "pass_fail": fos >= required}


def rankine(height, friction, cohesion, unit_weight, surcharge) -> dict[str, Column]:
    """Active and passive earth pressure on a wall, with the resultant."""
    ka, zero = rankine_active(friction), F.lit(0.0)
    root = F.sqrt(ka)
    base = F.greatest(ka * unit_weight * height + ka * surcharge - 2 * cohesion * root, zero)
    soil, load = 0.5 * ka * unit_weight * height * height, ka * surcharge * height
    total = F.greatest(soil + load - 2 * cohesion * root * height, zero)
    arm = F.when(total > 0, (soil * height / 3 + load * height / 2) / total).otherwise(height / 3)
    return {
        "ka": ka, "kp": rankine_passive(friction), "sigma_a_base_kpa": base, "total_active_force": total,
        "soil_force": soil, "surcharge_force": load, "point_of_application_m": arm,
    }


def shaft_stress(soil_type, cohesion, friction, unit_weight, mid_depth) -> Column:
    """Unit shaft friction of a layer, at most 100 kPa."""
    clay = F.when(cohesion > 0, F.least(F.when(cohesion < 50, 1.0).otherwise(0.5) * cohesion, F.lit(100.0))).otherwise(0.0)
    beta = (1 + F.radians(friction)) * _tan(friction * 0.8)
    sand = F.when(friction > 0, F.least(beta * unit_weight * mid_depth, F.lit(100.0))).otherwise(0.0)
    return F.when(soil_type == "cohesive", clay).otherwise(sand)


def toe_stress(soil_type, cohesion, friction, unit_weight, toe_depth, diameter) -> Column:
    """Unit end bearing at the toe, at most 10 MPa."""
    slender = _ratio(toe_depth, diameter)
    nq = bearing_nq(friction) * F.when(slender > 1, F.sqrt(F.least(slender, F.lit(15.0)))).otherwise(1.0)
    sandy = (soil_type == "granular") | (friction > 0)
    return F.least(F.when(sandy, unit_weight * toe_depth * nq).otherwise(cohesion * 9.0), F.lit(10000.0))


def single_pile(diameter, length, cohesion, friction, unit_weight, fos=2.5) -> dict[str, Column]:
    """Capacity of a pile in one layer; more than 5 kPa of cohesion makes it clay."""
    soil = [F.when(cohesion > 5, "cohesive").otherwise("granular"), cohesion, friction, unit_weight]
    shaft = shaft_stress(*soil, length / 2) * math.pi * diameter * length
    end = toe_stress(*soil, length, diameter) * math.pi * diameter * diameter / 4
    return {
        "ultimate_shaft_kn": shaft, "ultimate_end_kn": end, "ultimate_total_kn": shaft + end, "allowable_shaft_kn": shaft / fos,
        "allowable_end_kn": end / (fos + 0.5), "allowable_total_kn": (shaft + end) / fos,
    }


def group_efficiency(spacing_ratio, piles_x, piles_y, method: str = "Converse-Labarre") -> Column:
    if method != "Converse-Labarre":
        return F.when(spacing_ratio < 3, 0.7).otherwise(0.85)
    piles = piles_x * piles_y
    angle = F.atan(_ratio(spacing_ratio, piles_x + piles_y))
    return F.greatest(1 - _ratio(angle * (piles - 1), math.pi * piles), F.lit(0.5))


def wall_stability(
    height, base, toe, stem, base_thickness, fill_weight, fill_friction, surcharge,
    ground_cohesion, ground_friction, ground_weight, material_weight=24.0,
) -> dict[str, Column]:
    """Sliding, overturning and bearing of a cantilever wall."""
    heel = base - toe - stem
    ka = rankine_active(fill_friction)
    soil, load = 0.5 * fill_weight * height * height * ka, surcharge * height * ka
    active, moment = soil + load, soil * height / 3 + load * height / 2
    stem_weight, base_weight, heel_weight = stem * height * material_weight, base * base_thickness * material_weight, heel * height * fill_weight
    weight = stem_weight + base_weight + heel_weight
    resisting = stem_weight * (toe + stem / 2) + base_weight * (toe + base / 2) + heel_weight * (toe + stem + heel / 2)
    passive = 0.5 * ground_weight * base_thickness * base_thickness * rankine_passive(ground_friction)
    endless = float("inf")
    sliding = F.when(active > 0, (weight * 0.5 * _tan(fill_friction) + passive) / active).otherwise(endless)
    overturning = F.when(moment > 0, resisting / moment).otherwise(endless)
    eccentricity = F.when(weight > 0, base / 2 - (resisting - moment) / weight).otherwise(0.0)
    inside = F.abs(eccentricity) <= base / 6
    tilt, mean = 6 * _ratio(eccentricity, base), _ratio(weight, base)
    largest = F.when(inside, mean * (1 + tilt)).otherwise(_ratio(2 * weight, 3 * (base / 2 - eccentricity)))
    smallest = F.when(inside, mean * (1 - tilt)).otherwise(0.0)
    nq = bearing_nq(ground_friction)
    nc = F.when(ground_friction > 0, (nq - 1) / _tan(ground_friction)).otherwise(V.UNDRAINED_NC)
    ngamma = 0.5 * (nq - 1) * _tan(ground_friction)
    capacity = nc * ground_cohesion + 0.5 * ground_weight * base * ngamma
    bearing = F.when(largest > 0, capacity / largest).otherwise(endless)
    return {
        "ka": ka, "kp": rankine_passive(fill_friction), "total_active_force": active, "overturning_moment": moment,
        "passive_resistance": passive, "sliding_fos": sliding, "overturning_fos": overturning, "bearing_fos": bearing,
        "max_pressure_kpa": largest, "min_pressure_kpa": F.greatest(smallest, F.lit(0.0)), "total_weight": weight,
        "resisting_moment": resisting, "sliding_pass": sliding >= 1.5, "overturning_pass": overturning >= 2.0, "bearing_pass": bearing >= 3.0,
    }
