"""Query routing and expansion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.words import contains_any, listed

# fixed values: query types and their retrieval strategies
STRATEGY_OF_TYPE = {
    "comprehensive_design": "hierarchical_graph",
    "data_lookup": "table_first",
    "definition": "atomic_lookup",
    "general": "semantic_search",
}


def query_type(query: Column) -> Column:
    lowered = F.lower(query)
    return (
        F.when(contains_any(lowered, V.DESIGN_TERMS), "comprehensive_design")
        .when(contains_any(lowered, V.DATA_TERMS), "data_lookup")
        .when(contains_any(lowered, V.DEFINITION_TERMS), "definition")
        .otherwise("general")
    )


def strategy(kind: Column) -> Column:
    chain = F
    for name, way in STRATEGY_OF_TYPE.items():
        chain = chain.when(kind == name, way)
    return chain


def _named(query: Column, table: dict[str, list[str]]) -> Column:
    lowered = F.lower(query)
    return listed(*[(contains_any(lowered, words), name) for name, words in table.items()])


def target_elements(query: Column) -> Column:
    return _named(query, V.ELEMENT_TERMS)


def target_actions(query: Column) -> Column:
    return _named(query, V.ACTION_TERMS)


def expansions(query: Column, limit: int = V.MAX_EXPANSIONS) -> Column:
    """The query followed by up to ``limit`` variants with a synonym put in."""
    lowered = F.lower(query)
    variants = [
        F.when(lowered.contains(term), F.replace(lowered, F.lit(term), F.lit(other)))
        for term, others in V.SYNONYMS.items()
        for other in others[: V.SYNONYMS_PER_TERM]
    ]
    changed = F.filter(F.array_compact(F.array(*variants)), lambda v: v != lowered)
    return F.slice(F.array_distinct(F.concat(F.array(query), changed)), 1, limit + 1)


def equation_query(query: Column) -> Column:
    return F.concat(query, F.lit(V.EQUATION_SUFFIX))
