"""Queries of the corpus preparation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundplan.functions import text as X
from groundplan.operators import chunking
from groundplan.plans.registry import Registry
from groundplan.session import stored

REGISTRY = Registry()
query = REGISTRY.add

# headings found line by line; sections numbered by a running count of headings
SECTIONS_SQL = r"""
lines AS (SELECT doc_id, document_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM md_docs),
marked AS (SELECT *, regexp_full_match(line, '#{1,4}\s+.+') AS headed FROM lines),
numbered AS (SELECT *, sum(CAST(headed AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM marked),
bodies AS (SELECT doc_id, document_name, part, max(CASE WHEN headed THEN line END) AS head,
                  trim(coalesce(string_agg(CASE WHEN NOT headed THEN line END, chr(10) ORDER BY pos), ''), chr(10) || ' ' || chr(9) || chr(13)) AS text
           FROM numbered GROUP BY ALL),
sections AS (SELECT doc_id, document_name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS section_no,
                    coalesce(trim(regexp_replace(head, '^#+', '')), 'Preamble') AS title,
                    CAST(coalesce(length(regexp_extract(head, '^#+')), 0) AS INT) AS level, text
             FROM bodies WHERE text <> ''),
counted AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words FROM sections)"""

# paragraphs of large sections are packed one after the other by recursion
CHUNKS_SQL = SECTIONS_SQL + r""",
paras AS (SELECT doc_id, section_no, unnest(string_split(text, chr(10) || chr(10))) AS para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i
          FROM counted WHERE CAST(words AS DOUBLE) * CAST(1.3 AS DOUBLE) > 800),
sized AS (SELECT *, CAST(len(list_filter(string_split_regex(para, '\s+'), lambda w: w <> '')) AS DOUBLE) * CAST(1.3 AS DOUBLE) AS tokens FROM paras),
packed AS (
  SELECT doc_id, section_no, i, 0 AS chunk, false AS opens, tokens AS total, tokens FROM sized WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.section_no, s.i, CASE WHEN p.total + s.tokens > 800 THEN p.chunk + 1 ELSE p.chunk END, p.total + s.tokens > 800,
         CASE WHEN p.total + s.tokens > 800 THEN p.tokens + s.tokens ELSE p.total + s.tokens END, s.tokens
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.section_no = p.section_no AND s.i = p.i + 1),
placed AS (SELECT doc_id, section_no, i, chunk FROM packed UNION ALL SELECT doc_id, section_no, i - 1, chunk FROM packed WHERE opens),
large AS (SELECT p.doc_id, p.section_no, p.chunk AS part_no, string_agg(para, chr(10) || chr(10) ORDER BY p.i) AS text
          FROM placed p JOIN sized s ON s.doc_id = p.doc_id AND s.section_no = p.section_no AND s.i = p.i GROUP BY ALL),
parts AS (SELECT doc_id, document_name, section_no, 0 AS part_no, title, level, false AS large, text FROM counted WHERE CAST(words AS DOUBLE) * CAST(1.3 AS DOUBLE) <= 800
          UNION ALL
          SELECT c.doc_id, document_name, c.section_no, l.part_no, title, level, true, l.text FROM counted c JOIN large l ON l.doc_id = c.doc_id AND l.section_no = c.section_no),
chunks AS (SELECT *, coalesce(nullif(regexp_extract(title, '^(\d+(?:\.\d+)*)', 1), ''), 'unknown') AS clause_id,
                  CASE WHEN large THEN 'design_rule'
                       WHEN contains(lower(title), 'table') OR (contains(lower(text), 'table') AND len(string_split(text, chr(10))) < 20) THEN 'table'
                       WHEN contains(lower(title), 'equation') OR contains(lower(title), 'formula') THEN 'equation'
                       WHEN contains(lower(title), 'definition') OR contains(lower(text), 'defined as') THEN 'definition'
                       WHEN level <= 2 THEN 'section_overview' ELSE 'design_rule' END AS content_type,
                  CASE WHEN contains(lower(text), 'shall') OR contains(lower(text), 'must') THEN 'mandatory'
                       WHEN contains(lower(text), 'should') THEN 'advisory' ELSE 'informative' END AS regulatory_strength,
                  nullif(regexp_extract(title, '(?i)Page\s+(\d+)', 1), '') AS page,
                  regexp_extract_all(text, '(?i)Clause\s+(\d+(?:\.\d+)+)', 1) AS refs,
                  length(text) AS char_count FROM parts)"""


def manual_docs(docs):
    """The marked-up documents in the shape the chunker reads."""
    return docs.select(
        F.col("doc_id").alias("document_id"), "document_name", F.lit("code").alias("document_type"), "text"
    )


def manual_chunks(docs):
    return chunking.section_chunks(manual_docs(docs))


@query("section_split", "md_docs", "SELECT doc_id, section_no, title, level, md5(text) AS text_md5 FROM sections", SECTIONS_SQL)
def section_split(docs):
    return chunking.section_table(docs, ["doc_id"]).selectExpr("doc_id", "section_no", "title", "level", "md5(text) text_md5")


@query("section_chunks", "md_docs", """
SELECT doc_id, section_no, part_no, clause_id, content_type, CASE WHEN large THEN part_no ELSE -1 END AS sub_chunk_index, char_count, md5(text) AS text_md5 FROM chunks""", CHUNKS_SQL)
def section_chunks(docs):
    return manual_chunks(docs).selectExpr(
        "document_id doc_id", "section_no", "part_no", "clause_id", "content_type", "coalesce(sub_chunk_index, -1) sub_chunk_index",
        "cast(char_count as bigint) char_count", "md5(text) text_md5",
    )


@query("chunk_metadata", "md_docs", """
SELECT doc_id, section_no, part_no, clause_id, title AS clause_title, level AS section_level, content_type, coalesce(page, 'none') AS page_no, regulatory_strength,
       array_to_string(list_filter(refs, lambda r, i: list_position(refs, r) = i), ',') AS cross_references,
       CASE WHEN content_type = 'section_overview' THEN 'section' ELSE 'rule' END AS target_index
FROM chunks""", CHUNKS_SQL)
def chunk_metadata(docs):
    return manual_chunks(docs).selectExpr(
        "document_id doc_id", "section_no", "part_no", "clause_id", "clause_title", "section_level", "content_type",
        "coalesce(cast(page_no as string), 'none') page_no", "regulatory_strength", "array_join(cross_references, ',') cross_references", "target_index",
    )


@query("index_routing", "md_docs", """
SELECT doc_id, count(*) FILTER (target = 'section') AS section_count, count(*) FILTER (target = 'rule') AS rule_count
FROM (SELECT doc_id, CASE WHEN content_type IN ('table', 'equation', 'definition') THEN 'rule' WHEN level <= 2 THEN 'section' ELSE 'rule' END AS target FROM chunks)
GROUP BY doc_id""", CHUNKS_SQL)
def index_routing(docs):
    return chunking.index_counts(chunking.section_chunks(manual_docs(docs), route=True)).withColumnRenamed("document_id", "doc_id")


@query("fixed_window_chunks", "documents", r"""
SELECT doc_id, concat('Chunk ', CAST(i // 615 + 1 AS INT)) AS title, array_to_string(list_slice(w, i + 1, i + 615), ' ') AS text
FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 615)) AS i
      FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""")
def fixed_window_chunks(docs):
    rows = docs.select("doc_id", F.explode(chunking.window_sections(F.col("text"))).alias("s"))
    return rows.selectExpr("doc_id", "s.title", "s.text")


@query("page_split", "paged_docs", r"""
SELECT doc_id, page_number, trim(text, chr(10) || ' ' || chr(9) || chr(13)) AS text
FROM (SELECT doc_id, CAST(unnest(n) AS INT) AS page_number, unnest(b[2:]) AS text
      FROM (SELECT doc_id, regexp_extract_all(text, '\[Page (\d+)\]', 1) AS n, string_split_regex(text, '\[Page \d+\]') AS b FROM paged_docs))
WHERE trim(text, chr(10) || ' ' || chr(9) || chr(13)) <> ''""")
def page_split(docs):
    return chunking.pages_of(docs, ["doc_id"])


# items as a reader of laid-out pages gives them: a head, then one item per line
ITEMS_SQL = r"""
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
items AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 1 THEN 'SECTION_HEADER' WHEN pos % 9 = 5 THEN 'TABLE' WHEN pos % 9 = 7 THEN 'FORMULA' ELSE 'PARAGRAPH' END AS item_type,
                 CASE WHEN pos % 9 = 1 THEN concat('3.', pos, ' ', line) ELSE line END AS text FROM cut)"""


def laid_out_items(docs):
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.selectExpr(
        "document_id", "at + 1 pos",
        "case (at + 1) % 9 when 1 then 'SECTION_HEADER' when 5 then 'TABLE' when 7 then 'FORMULA' else 'PARAGRAPH' end item_type",
        "2 level", "case (at + 1) % 9 when 1 then concat('3.', at + 1, ' ', line) else line end text", "cast(at div 20 + 1 as int) page_no",
    )


@query("item_blocks", "documents", r"""
SELECT document_id, count(*) AS chunks, count(*) FILTER (kind = 'table') AS tables, count(DISTINCT clause) AS clauses
FROM (SELECT doc_id AS document_id, 'table' AS kind, CAST(max(CASE WHEN item_type = 'SECTION_HEADER' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS clause,
             item_type, text FROM items
      QUALIFY item_type = 'TABLE'
      UNION ALL
      SELECT doc_id, 'text', CAST(max(head) AS VARCHAR), '', '' FROM
        (SELECT doc_id, text, item_type, sum(CASE WHEN item_type IN ('SECTION_HEADER', 'TABLE') THEN 1 ELSE 0 END) OVER w AS run,
                max(CASE WHEN item_type = 'SECTION_HEADER' THEN pos END) OVER w AS head
         FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE item_type <> 'TABLE' AND trim(text) <> '' GROUP BY doc_id, run)
GROUP BY document_id""", ITEMS_SQL)
def item_blocks(docs):
    # the size limit lies above every run here, so each run of lines is one block
    chunks = chunking.item_chunks(laid_out_items(docs), max_chars=10_000_000)
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("content_type") == "table").alias("tables"), F.count_distinct("clause_id").alias("clauses")
    )


# lines added one after the other; a block closes with the line that reaches the limit, and what is longer is packed by paragraphs
ITEM_CHUNKS_SQL = ITEMS_SQL + r""",
typed AS (SELECT doc_id, pos, item_type, trim(text, chr(10) || ' ' || chr(9) || chr(13)) AS text, (pos - 1) // 20 + 1 AS page_no FROM items),
placed AS (SELECT *, sum(CASE WHEN item_type IN ('SECTION_HEADER', 'TABLE') THEN 1 ELSE 0 END) OVER w AS run, max(CASE WHEN item_type = 'SECTION_HEADER' THEN pos END) OVER w AS head,
                  max(CASE WHEN item_type = 'FORMULA' AND text <> '' THEN pos END) OVER w AS formula
           FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
kept AS (SELECT *, CASE item_type WHEN 'SECTION_HEADER' THEN concat('# ', text) ELSE text END AS line, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS i
         FROM placed WHERE item_type <> 'TABLE' AND text <> ''),
folded AS (
  SELECT doc_id, run, i, 0 AS block, CASE WHEN item_type <> 'SECTION_HEADER' AND length(line) >= 1500 THEN -1 ELSE length(line) END AS chars FROM kept WHERE i = 1
  UNION ALL
  SELECT k.doc_id, k.run, k.i, CASE WHEN f.chars < 0 THEN f.block + 1 ELSE f.block END,
         CASE WHEN (CASE WHEN f.chars < 0 THEN 0 ELSE f.chars + 1 END) + length(k.line) >= 1500 THEN -1 ELSE (CASE WHEN f.chars < 0 THEN 0 ELSE f.chars + 1 END) + length(k.line) END
  FROM folded f JOIN kept k ON k.doc_id = f.doc_id AND k.run = f.run AND k.i = f.i + 1),
blocks AS (SELECT k.doc_id, k.run, f.block, string_agg(k.line, chr(10) ORDER BY k.i) AS text, max(k.head) AS head, max(k.formula) AS formula, arg_max(k.page_no, k.i) AS page_no
           FROM folded f JOIN kept k ON k.doc_id = f.doc_id AND k.run = f.run AND k.i = f.i GROUP BY ALL
           UNION ALL SELECT doc_id, run, -1, text, head, formula, page_no FROM placed WHERE item_type = 'TABLE'),
named AS (SELECT b.doc_id, b.run, b.block, b.text, b.page_no, h.text AS title, CASE WHEN b.formula > coalesce(b.head, 0) THEN q.text END AS formula
          FROM blocks b LEFT JOIN typed h ON h.doc_id = b.doc_id AND h.pos = b.head LEFT JOIN typed q ON q.doc_id = b.doc_id AND q.pos = b.formula)"""


@query("item_chunks", "documents", r"""
SELECT doc_id AS document_id, run, block, CASE WHEN title IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_extract(title, '^(\d+(?:\.\d+)*)', 1), ''), 'unknown') END AS clause_id,
       CASE block WHEN -1 THEN 'table' ELSE 'clause_text' END AS content_type, page_no, CASE block WHEN -1 THEN 'Untitled Table' END AS table_caption, md5(formula) AS formula_md5,
       length(text) AS char_count, md5(text) AS text_md5 FROM named""", ITEM_CHUNKS_SQL)
def item_chunks(docs):
    # no line of the documents holds a blank line, so a block is one part
    return chunking.item_chunks(laid_out_items(docs)).selectExpr(
        "document_id", "run", "block", "clause_id", "content_type", "page_no", "table_caption", "md5(formula_latex) formula_md5",
        "cast(char_count as bigint) char_count", "md5(text) text_md5",
    )


@query("character_chunks", "md_docs", r"""
SELECT doc_id, chunk AS part_no, md5(trim(string_agg(para, chr(10) || chr(10) ORDER BY i), chr(10) || ' ' || chr(9) || chr(13))) AS text_md5, count(*) AS paragraphs
FROM filled_blocks GROUP BY doc_id, chunk""", r"""
paragraphs AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, chr(10) || ' ' || chr(9) || chr(13)) <> '')) AS para,
                      generate_subscripts(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, chr(10) || ' ' || chr(9) || chr(13)) <> ''), 1) AS i FROM md_docs),
filled_blocks AS (
  SELECT doc_id, i, para, 0 AS chunk, length(para) + 2 AS chars FROM paragraphs WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, p.para, CASE WHEN f.chars + length(p.para) + 2 > 1500 THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN f.chars + length(p.para) + 2 > 1500 THEN length(p.para) ELSE f.chars + length(p.para) + 2 END
  FROM filled_blocks f JOIN paragraphs p ON p.doc_id = f.doc_id AND p.i = f.i + 1)""")
def character_chunks(docs):
    parts = docs.select("doc_id", F.posexplode(chunking.pack_by_characters(F.col("text"))).alias("part_no", "text"))
    inner = F.filter(F.split("text", "\n\n"), lambda p: F.btrim(p, F.lit("\n \t\r")) != "")
    return parts.select("doc_id", "part_no", F.md5("text").alias("text_md5"), F.size(inner).cast("bigint").alias("paragraphs"))


@query("document_catalogue", "md_docs", """
SELECT CAST(doc_id AS VARCHAR) AS document_id, min(document_name) AS document_name, 'code' AS document_type, count(*) AS chunk_count FROM chunks GROUP BY 1""", CHUNKS_SQL)
def document_catalogue(docs):
    from groundplan.sources.chunk_store import list_documents

    return list_documents(manual_chunks(docs))


@query("document_sample", "md_docs", """
SELECT doc_id AS document_id, target_index, section_no, part_no FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY target_index, section_no, part_no) n FROM
    (SELECT *, CASE WHEN content_type = 'section_overview' THEN 'section' ELSE 'rule' END AS target_index,
            row_number() OVER (PARTITION BY doc_id, content_type = 'section_overview' ORDER BY section_no, part_no) k FROM chunks) WHERE k <= 2) WHERE n <= 5""", CHUNKS_SQL)
def document_sample(docs):
    from groundplan.sources.chunk_store import document_samples

    return document_samples(manual_chunks(docs), limit=5, collections=2, order=["section_no", "part_no"]).select(
        "document_id", "target_index", "section_no", "part_no"
    )


@query("chunk_filter", "md_docs", """
SELECT doc_id AS document_id, section_no, part_no FROM chunks WHERE content_type = 'design_rule' AND regulatory_strength = 'informative'""", CHUNKS_SQL)
def chunk_filter(docs):
    from groundplan.sources.chunk_store import matching

    rows = matching(manual_chunks(docs), content_type="design_rule", regulatory_strength="informative", document_type="code")
    return rows.select("document_id", "section_no", "part_no")


@query("document_delete", "md_docs", """
SELECT doc_id AS document_id, section_no, part_no FROM chunks WHERE doc_id <> 7""", CHUNKS_SQL)
def document_delete(docs):
    from groundplan.sources.chunk_store import without_document

    return without_document(manual_chunks(docs), 7).select("document_id", "section_no", "part_no")


@query("chunk_lookup", "md_docs", """
SELECT doc_id AS document_id, section_no, part_no, clause_id FROM chunks WHERE doc_id = 7 AND section_no = 1 AND part_no = 0""", CHUNKS_SQL)
def chunk_lookup(docs):
    from hashlib import sha256

    from groundplan.sources.chunk_store import by_chunk_id

    return by_chunk_id(manual_chunks(docs), sha256(b"7|1|0").hexdigest()).select("document_id", "section_no", "part_no", "clause_id")


# piece -1 is the whole text of a document
_DUMP_BLOCK = r"""concat(repeat('─', 80), chr(10), 'CHUNK ', n, chr(10), repeat('─', 80), chr(10),
                         'Index: ', CASE WHEN content_type = 'section_overview' THEN 'section' ELSE 'rule' END, ' | Page: ', coalesce(page, 'N/A'), ' | Clause: ', clause_id, ' | Type: ', content_type, chr(10),
                         'Title: ', title, chr(10), repeat('─', 80), chr(10), chr(10), trim(text, chr(10) || ' '), chr(10), chr(10))"""
_DUMP_HEAD = "concat('Document: ', min(document_name), chr(10), 'Total Chunks: ', count(*), chr(10), repeat('=', 80), chr(10), chr(10))"


@query("chunk_dump", "md_docs", f"""
SELECT doc_id AS document_id, 0 AS piece, md5({_DUMP_HEAD}) AS block_md5 FROM chunks GROUP BY 1
UNION ALL
SELECT doc_id, n, md5({_DUMP_BLOCK}) FROM dumped
UNION ALL
SELECT doc_id, -1, md5(concat({_DUMP_HEAD}, string_agg({_DUMP_BLOCK}, '' ORDER BY n))) FROM dumped GROUP BY doc_id""", CHUNKS_SQL.strip() + """,
dumped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part_no) n FROM chunks)""")
def chunk_dump(docs):
    from groundplan.sources.chunk_store import dump_blocks, dump_texts

    blocks = stored(dump_blocks(manual_chunks(docs), order=["section_no", "part_no"], bucket=F.floor(F.col("section_no") / 256)))
    whole = dump_texts(blocks).selectExpr("document_id", "-1L piece", "md5(text) block_md5")
    return blocks.selectExpr("document_id", "piece", "md5(block) block_md5").unionByName(whole)


@query("citation_strings", "md_docs", """
SELECT doc_id AS document_id, section_no, part_no, concat('[', clause_id, '] ', title, CASE WHEN page IS NULL THEN '' ELSE ', p. ' || page END) AS plain,
       concat('**', clause_id, '** ', title, CASE WHEN page IS NULL THEN '' ELSE ' (p. ' || page || ')' END) AS markdown
FROM chunks""", CHUNKS_SQL)
def citation_strings(docs):
    args = [F.col("clause_id"), F.col("clause_title"), F.col("page_no")]
    return manual_chunks(docs).select(
        "document_id", "section_no", "part_no", X.plain_citation(*args).alias("plain"), X.markdown_citation(*args).alias("markdown")
    )


@query("typed_chunks", "md_docs", """
SELECT doc_id AS document_id, section_no, part_no, clause_id, coalesce(CAST(page AS INT), 0) AS page_number, content_type FROM chunks""", CHUNKS_SQL)
def typed_chunks(docs):
    rows = chunking.typed_chunks(manual_chunks(docs))
    return rows.selectExpr(
        "document_id", "section_no", "part_no", "canonical_source.clause_id", "canonical_source.page_number", "content_type"
    )


@query("document_keys", "pages", r"""
SELECT page_id, replace(lower(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '')), ' ', '_') AS document_id,
       replace(trim(regexp_replace(url, '[^\p{L}\p{N} \-_]', '_', 'g')), ' ', '_') AS file_name
FROM pages""")
def document_keys(pages):
    name = F.substring_index("url", "/", -1)
    return pages.select("page_id", X.document_key(name).alias("document_id"), X.safe_file_name(F.col("url")).alias("file_name"))


@query("json_extract", "model_outputs", r"""
SELECT response_id, CASE WHEN ok THEN block ->> 'status' ELSE 'unknown' END AS status, CASE WHEN ok THEN CAST(block ->> 'score' AS INT) ELSE 0 END AS score, ok AS parsed
FROM (SELECT response_id, block, CASE WHEN json_valid(block) THEN coalesce(json_type(block) = 'OBJECT' AND json_exists(block, '$.status') AND TRY_CAST(block ->> 'score' AS INT) IS NOT NULL, false) ELSE false END AS ok FROM
  (SELECT response_id, CASE WHEN regexp_matches(response, '```') THEN regexp_extract(response, '```(?:json)?\s*(\{[^`]*\})\s*```', 1) ELSE trim(response) END AS block FROM model_outputs))""")
def json_extract(outputs):
    parsed = X.parsed_or_default(F.col("response"), "status string, score int", {"status": "unknown", "score": 0})
    return outputs.select("response_id", parsed.alias("p")).select("response_id", "p.status", "p.score", "p.parsed")


EQUATION_SQL = r"""
marked AS (SELECT answer_id, concat(answer, '<br>### Step 1', chr(10), '[x = a_b]', chr(10), '- (k) - ', source, chr(10), '2) Step 2', chr(10), 'Equation not found in retrieved context', chr(10),
                  '**Variable definitions**', chr(10), '- (m): hidden', chr(10), '**Citation**', chr(10), '\[ y \]') AS text FROM answers),
lined AS (SELECT answer_id, unnest(string_split(replace(text, '<br>', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '<br>', chr(10)), chr(10)), 1) AS i FROM marked),
stepped AS (SELECT *, trim(line) AS bare, regexp_matches(line, '^\s*(###\s*Step|\d+\)\s*Step)') AS is_step, sum(CASE WHEN regexp_matches(line, '^\s*(###\s*Step|\d+\)\s*Step)') THEN 1 ELSE 0 END) OVER (PARTITION BY answer_id ORDER BY i) AS seg FROM lined),
lost AS (SELECT *, min(CASE WHEN contains(bare, 'Equation not found in retrieved context') AND NOT starts_with(bare, '[Source:') THEN i END) OVER (PARTITION BY answer_id, seg) AS lost_at FROM stepped),
listed AS (SELECT *, min(CASE WHEN starts_with(lower(bare), '**variable definitions') AND i > lost_at THEN i END) OVER (PARTITION BY answer_id, seg) AS list_at FROM lost),
resumed AS (SELECT *, min(CASE WHEN i > list_at AND (starts_with(lower(bare), '**acceptance') OR starts_with(lower(bare), '**citation')) THEN i END) OVER (PARTITION BY answer_id, seg) AS resume_at FROM listed),
written AS (SELECT answer_id, i, CASE WHEN is_step THEN line WHEN i = list_at THEN concat(line, chr(10), 'N/A (no equation in retrieved context).')
                   WHEN starts_with(bare, '[Source:') OR contains(bare, 'Equation not found in retrieved context') THEN line
                   WHEN regexp_matches(bare, '^\[(.+)\]$') AND regexp_matches(bare, '\\frac|\\sum|\\min|_|\^|=') THEN concat('$$', trim(regexp_extract(bare, '^\[(.+)\]$', 1)), '$$')
                   WHEN regexp_matches(line, '^\s*[-*]\s*\([^)]+\)\s*[-:]\s*.*$') THEN concat(regexp_extract(line, '^(\s*[-*]\s*)\(', 1), '$', trim(regexp_extract(line, '^\s*[-*]\s*\(([^)]+)\)', 1)), '$: ', trim(regexp_extract(line, '^\s*[-*]\s*\([^)]+\)\s*[-:]\s*(.*)$', 1)))
                   ELSE line END AS line
            FROM resumed WHERE NOT coalesce(i > list_at AND i < coalesce(resume_at, 1000000), false))"""


@query("equation_text", "answers", r"""
SELECT answer_id, replace(replace(string_agg(line, chr(10) ORDER BY i), '\[', '$$'), '\]', '$$') AS text FROM written GROUP BY 1""", EQUATION_SQL)
def equation_text(answers):
    marked = F.concat(
        F.col("answer"), F.lit("<br>### Step 1\n[x = a_b]\n- (k) - "), F.col("source"),
        F.lit("\n2) Step 2\nEquation not found in retrieved context\n**Variable definitions**\n- (m): hidden\n**Citation**\n\\[ y \\]"),
    )
    return answers.select("answer_id", X.normalised_equations(marked).alias("text"))
