"""All named queries."""

from __future__ import annotations

from groundplan.plans import design_queries, document_queries, programme_queries, quality_queries, search_queries, source_queries, usage_queries
from groundplan.plans.registry import Plan

_FAMILIES = [programme_queries, usage_queries, document_queries, search_queries, quality_queries, design_queries, source_queries]


def all_plans() -> dict[str, Plan]:
    return {name: plan for family in _FAMILIES for name, plan in family.REGISTRY.plans.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.REGISTRY.sql.items()}
