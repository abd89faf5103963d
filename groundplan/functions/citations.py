"""Citation extraction, matching and notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundplan import fixed_values as V
from groundplan.functions.text import CLAUSE_START
from groundplan.functions.words import SPACES, let, strip

_SPAN = "struct<raw: string, start: int, end: int>"
_CITATION = "struct<form: string, document: string, clause_id: string, page: int, raw: string, start: int, end: int>"


def _fields(form: str, span: Column) -> Column:
    """A citation of one form from the span it matched."""
    raw = span["raw"]
    group = lambda i: strip(F.regexp_extract(raw, V.CITATION_FORMS[form], i))
    none = F.lit(None).cast("int")
    if form == "full":
        document, clause, page = group(1), group(2), group(3).try_cast("int")
    elif form in ("short", "parenthetical"):
        document, clause, page = group(1), group(2), none
    elif form == "according_to":
        document, clause, page = group(2), group(1), none
    else:
        document, clause, page = F.lit(V.UNKNOWN_DOCUMENT), group(1), none
    return F.struct(
        F.lit(form).alias("form"), document.alias("document"), clause.alias("clause_id"), page.alias("page"),
        raw.alias("raw"), span["start"].alias("start"), span["end"].alias("end"),
    ).cast(_CITATION)


def _spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern and where they lie: what stands between them and their own lengths, added up."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["raw"])
        span = F.struct(part["raw"].alias("raw"), start.alias("start"), end.alias("end")).cast(_SPAN)
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("found"))
    return F.aggregate(F.filter(parts, lambda p: p["raw"].isNotNull()), empty, add, lambda s: s["found"])


def citations_with_offsets(text: Column) -> Column:
    """Citations of a text with start and end offsets, the most specific form first.

    A match that shares characters with a citation of a more specific form is dropped.
    """
    found = F.expr(f"cast(array() as array<{_CITATION}>)")
    for form in V.CITATION_FORMS:
        found = let(found, _more(F.coalesce(text, F.lit("")), form))
    return found


def _more(text: Column, form: str):
    def step(found: Column) -> Column:
        apart = lambda span: ~F.exists(found, lambda c: (span["start"] < c["end"]) & (span["end"] > c["start"]))
        return F.concat(found, F.transform(F.filter(_spans(text, V.CITATION_FORMS[form]), apart), lambda span: _fields(form, span)))

    return step


def extract(text: Column) -> Column:
    """Citations of a text without their places."""
    return F.transform(citations_with_offsets(text), lambda c: c.dropFields("start", "end"))


def normal_clause(clause: Column) -> Column:
    """Clause number without a leading word; the text itself when it has none."""
    bare = strip(F.regexp_replace(clause, r"(?iU)^(Clause|Section|Clauses?|Sections?)\s*", ""))
    number = F.nullif(F.regexp_extract(bare, CLAUSE_START, 1), F.lit(""))
    return F.when(F.coalesce(clause, F.lit("")) != "", F.coalesce(number, bare))


def clauses_match(a: Column, b: Column) -> Column:
    """Equal clauses, or one the parent of the other."""
    dot = F.lit(".")
    same = (a == b) | b.startswith(F.concat(a, dot)) | a.startswith(F.concat(b, dot))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def documents_match(a: Column, b: Column) -> Column:
    """Names that are equal, abbreviate, or contain each other, whatever their case."""
    given = (a != "") & (b != "")
    left, right = strip(F.lower(a)), strip(F.lower(b))
    tests = (left == right) | right.contains(left) | left.contains(right)
    for short, full in V.DOCUMENT_ABBREVIATIONS.items():
        tests = tests | (left.contains(short) & right.contains(full)) | (left.contains(full) & right.contains(short))
    narrow = lambda c: F.regexp_replace(c, SPACES, " ")
    tests = tests | narrow(right).contains(narrow(left)) | narrow(left).contains(narrow(right))
    return F.coalesce(given & tests, F.lit(False))


def sections_match(a: Column, b: Column) -> Column:
    left, right = strip(F.lower(a)), strip(F.lower(b))
    return F.coalesce((a != "") & (b != "") & (right.contains(left) | left.contains(right)), F.lit(False))


def confidence(document: Column, clause: Column, section: Column) -> Column:
    """Confidence of one citation and chunk from what agrees."""
    return (
        F.when(document & clause, V.CONFIDENCE_DOCUMENT_AND_CLAUSE)
        .when(document & section, V.CONFIDENCE_DOCUMENT_AND_SECTION)
        .when(document, V.CONFIDENCE_DOCUMENT)
        .when(clause, V.CONFIDENCE_CLAUSE)
        .otherwise(0.0)
    )


def note(value: Column) -> Column:
    percent = F.concat(F.round(value * 100, 0).cast("int").cast("string"), F.lit("%"))
    return (
        F.when(value >= V.VERIFIED_FROM, F.concat(F.lit("Citation verified with "), percent, F.lit(" confidence")))
        .when(
            value > 0.5,
            F.concat(F.lit("Partial match found ("), percent, F.lit(" confidence) - clause may be referenced indirectly")),
        )
        .when(
            value > V.HALLUCINATED_TO,
            F.concat(F.lit("Weak match ("), percent, F.lit(" confidence) - document match but clause not found")),
        )
        .otherwise("No matching chunk found - possible hallucination")
    )
