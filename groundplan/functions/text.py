"""Text annotation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan import fixed_values as V
from groundplan.functions.words import contains_any, count_words, strip

# fixed values: patterns of clauses, references and pages
CLAUSE_START = r"^(\d+(?:\.\d+)*)"
CROSS_REFERENCE = r"(?i)Clause\s+(\d+(?:\.\d+)+)"
PAGE_IN_TITLE = r"(?i)Page\s+(\d+)"
PAGE_IN_TEXT = r"(?i)\[?Page\s+(\d+)\]?"
PLAIN_WORD = r"(?<![\p{L}\p{N}_])[a-z]{2,}(?![\p{L}\p{N}_])"
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """Lower-case words of at least two plain letters that are no stop words, with repeats.

    A word ends where no letter, digit or underscore of any alphabet follows.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*V.STOP_WORDS))


def regulatory_strength(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(contains_any(lowered, ["shall", "must"]), "mandatory")
        .when(lowered.contains("should"), "advisory")
        .otherwise("informative")
    )


def clause_of(title: Column) -> Column:
    """Leading clause number of a heading, 'unknown' without one."""
    bare = strip(F.regexp_replace(strip(F.coalesce(title, F.lit(""))), "^#+", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, CLAUSE_START, 1), F.lit("")), F.lit("unknown"))


def cross_references(text: Column) -> Column:
    """Clause numbers named in the text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CROSS_REFERENCE), F.lit(1)))


def _page(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")).try_cast("int")


def page_of_title(title: Column) -> Column:
    return _page(title, PAGE_IN_TITLE)


def page_of_title_or_text(title: Column, text: Column) -> Column:
    in_title, in_text = _page(title, PAGE_IN_TEXT), _page(text, PAGE_IN_TEXT)
    return F.coalesce(F.nullif(in_title, F.lit(0)), in_text)


def content_type(title: Column, text: Column, level: Column) -> Column:
    """Kind of a section, from its title, text and heading level. ``text`` is stripped."""
    title, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    few_lines = F.size(F.split(text, LINE_BREAKS)) < V.TABLE_TEXT_MAX_LINES
    return (
        F.when(title.contains("table") | (body.contains("table") & few_lines), "table")
        .when(contains_any(title, ["equation", "formula"]), "equation")
        .when(title.contains("definition") | body.contains("defined as"), "definition")
        .when(level <= 2, "section_overview")
        .otherwise("design_rule")
    )


def index_of_type(kind: Column) -> Column:
    return F.when(kind == "section_overview", "section").otherwise("rule")


def routed_index(kind: Column, level: Column) -> Column:
    """Index of a chunk when a document is split over the two indexes."""
    return (
        F.when(F.coalesce(kind, F.lit("clause_text")).isin("table", "equation", "definition"), "rule")
        .when(F.coalesce(level, F.lit(2)) <= 2, "section")
        .otherwise("rule")
    )


def token_estimate(text: Column) -> Column:
    return count_words(text) * F.lit(V.TOKENS_PER_WORD)


def document_key(file_name: Column) -> Column:
    """Document id of a file: its lower-case stem with underscores for spaces."""
    return F.replace(F.lower(F.regexp_replace(file_name, r"\.[^.]*$", "")), F.lit(" "), F.lit("_"))


def safe_file_name(name: Column) -> Column:
    """Name fit for a file: other characters and spaces become underscores."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} \-_]", "_")
    return F.replace(strip(kept), F.lit(" "), F.lit("_"))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def plain_citation(clause: Column, title: Column, page: Column) -> Column:
    shown = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"))).otherwise("")
    return F.concat(F.lit("["), clause, F.lit("] "), title, shown)


def markdown_citation(clause: Column, title: Column, page: Column) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("**"), clause, F.lit("**")),
        F.nullif(title, F.lit("")),
        F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("(p. "), page.cast("string"), F.lit(")"))),
    )


# --- model output -------------------------------------------------------


def json_block(response: Column) -> Column:
    """The JSON text of a model response: the first fenced object, else the
    first fenced array, else the response without its fence lines."""
    clean = strip(F.coalesce(response, F.lit("")))
    fenced = lambda body: F.nullif(F.regexp_extract(clean, r"(?s)```(?:json)?\s*(" + body + r")\s*```", 1), F.lit(""))
    lines = F.split(clean, "\n")
    inner = F.when(strip(F.element_at(lines, -1)) == "```", F.slice(lines, 2, F.size(lines) - 2)).otherwise(
        F.slice(lines, 2, F.size(lines))
    )
    bare = F.when(clean.startswith("```") & (F.size(lines) > 2), F.array_join(inner, "\n")).otherwise(clean)
    return strip(F.coalesce(fenced(r"\{.*?\}"), fenced(r"\[.*?\]"), bare))


def parsed_or_default(response: Column, schema: str | T.StructType, default: dict[str, object]) -> Column:
    """Fields of the JSON of a response; the default row when it does not parse.

    A value of the wrong type counts as not parsed, like a missing field.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    with_corrupt = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])

    def read(text: Column) -> Column:
        row = F.from_json(text, with_corrupt, strict)
        complete = reduce(lambda a, b: a & b, [row[f.name].isNotNull() for f in fields.fields])
        return F.when((text != "") & row["_corrupt"].isNull() & complete, row)

    row = F.coalesce(read(json_block(response)), read(F.coalesce(response, F.lit(""))))
    values = [F.coalesce(row[f.name], F.lit(default[f.name]).cast(f.dataType)).alias(f.name) for f in fields.fields]
    return F.struct(*values, row.isNotNull().alias("parsed"))


# --- equations ----------------------------------------------------------

_MATHS_MARKS = ["\\frac", "\\sum", "\\min", "_", "^", "="]
_STEP = r"^\s*(###\s*Step|\d+\)\s*Step)"
_NOT_FOUND = "Equation not found in retrieved context"


def normalised_equations(text: Column) -> Column:
    """Equation text with uniform maths marks.

    The lines of one text are folded in order; the state holds the lines so
    far, whether the step has no equation, and whether its variable list is
    being left out.
    """
    lines = F.split(F.replace(text, F.lit("<br>"), F.lit("\n")), LINE_BREAKS)

    def shown(line: Column, bare: Column) -> Column:
        inner = strip(F.regexp_extract(bare, r"^\s*\[(.+)\]\s*$", 1))
        bullet = r"^(\s*[-*]\s*)\(([^)]+)\)\s*[-:]\s*(.*)$"
        variable = F.concat(
            F.regexp_extract(line, bullet, 1), F.lit("$"), strip(F.regexp_extract(line, bullet, 2)), F.lit("$: "),
            strip(F.regexp_extract(line, bullet, 3)),
        )
        maths = bare.rlike(r"^\s*\[(.+)\]\s*$") & contains_any(inner, _MATHS_MARKS)
        return (
            F.when(bare.startswith("[Source:") | bare.contains(_NOT_FOUND), line)
            .when(maths, F.concat(F.lit("$$"), inner, F.lit("$$")))
            .when(line.rlike(bullet), variable)
            .otherwise(line)
        )

    def step(state: Column, line: Column) -> Column:
        bare = strip(line)
        lowered = F.lower(bare)
        is_step = bare.rlike(_STEP)
        resumes = lowered.startswith("**acceptance") | lowered.startswith("**citation")
        hidden = ~is_step & state["hiding"] & ~resumes
        variables = ~hidden & ~is_step & state["missing"] & lowered.startswith("**variable definitions")
        missing = ~is_step & (state["missing"] | (~hidden & bare.contains(_NOT_FOUND) & ~bare.startswith("[Source:")))
        added = (
            F.when(hidden, F.array().cast("array<string>"))
            .when(variables, F.array(line, F.lit("N/A (no equation in retrieved context).")))
            .when(is_step, F.array(line))
            .otherwise(F.array(shown(line, bare)))
        )
        return F.struct(
            F.concat(state["lines"], added).alias("lines"), missing.alias("missing"), (hidden | variables).alias("hiding")
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("missing"), F.lit(False).alias("hiding"))
    joined = F.array_join(F.aggregate(lines, start, step)["lines"], "\n")
    closed = F.replace(F.replace(joined, F.lit("\\["), F.lit("$$")), F.lit("\\]"), F.lit("$$"))
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(closed)
