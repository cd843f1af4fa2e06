"""Queries over tag files and fragments (S-3, J-1, J-2, J-7, A-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators.blocks import blocks, classify_lines
from ..operators.tags import find_fragments, find_substrings, fragment_lines, kind_members, read_fragments, read_tags, tags_by_kind
from ..sources.derived import code_lines, scope_lines, tag_lines, with_tables
from ..sources.lines import with_offsets

# Tag-line parsing and the kind table, in SQL.
TAGS_SQL = r"""
WITH kinds(kind_code, kind) AS (VALUES ('I', 'ImportedInternal'), ('Y', 'ImportedExternal'), ('C', 'Const'),
       ('c', 'Class'), ('f', 'Function'), ('i', 'Module'), ('m', 'Member'), ('v', 'Variable'), ('t', 'Type')),
raw AS (SELECT regexp_replace(value, '\n$', '') AS v FROM tag_lines WHERE NOT starts_with(value, '!')),
parsed AS (
  SELECT regexp_extract(v, '^([^\t]*)\t([^\t]*)\t(.*?;")\t([^\t\n]*)(\t(.*))?$', 1) AS symbol,
         regexp_extract(v, '^([^\t]*)\t([^\t]*)\t(.*?;")\t([^\t\n]*)(\t(.*))?$', 2) AS path,
         regexp_extract(v, '^([^\t]*)\t([^\t]*)\t(.*?;")\t([^\t\n]*)(\t(.*))?$', 3) AS pattern,
         regexp_extract(v, '^([^\t]*)\t([^\t]*)\t(.*?;")\t([^\t\n]*)(\t(.*))?$', 4) AS kind_code
  FROM raw),
tags AS (SELECT parsed.*, kinds.kind FROM parsed LEFT JOIN kinds USING (kind_code))
"""

TAGS_BY_KIND_SQL = with_tables(TAGS_SQL + """
SELECT kind, CAST(count(*) AS BIGINT) AS n_tags, CAST(count(DISTINCT symbol) AS BIGINT) AS n_symbols,
       min(symbol) AS first_symbol, max(symbol) AS last_symbol
FROM tags GROUP BY kind
""", "scope_lines", "tag_lines")


@register("tags_by_kind", TAGS_BY_KIND_SQL)
def q_tags_by_kind(spark, sf):
    return tags_by_kind(read_tags(tag_lines(scope_lines(table(spark, sf, "events")))))


FRAGMENTS_EXACT_SQL = with_tables(TAGS_SQL + r""",
ln AS (SELECT path, number, text, regexp_replace(text, '\n+$', '') AS body,
              COALESCE(SUM(length(text)) OVER (PARTITION BY path ORDER BY number
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
       FROM scope_lines),
t AS (SELECT *, replace(replace(pattern, '\/', '/'), '\\', '\') AS p FROM tags),
t2 AS (SELECT *, substr(p, 3, length(p) - 6) AS pat FROM t)
SELECT t2.symbol, t2.kind, t2.path, t2.pattern, CAST(ln.off AS BIGINT) AS "offset",
       CAST(length(t2.pat) AS BIGINT) AS length, CAST(ln.number AS BIGINT) AS line, CAST(0 AS BIGINT) AS "column",
       t2.pat AS text
FROM t2 LEFT JOIN ln ON ln.path = t2.path AND ln.body = t2.pat
""", "scope_lines", "tag_lines")


@register("fragments_exact", FRAGMENTS_EXACT_SQL)
def q_fragments_exact(spark, sf):
    scope = scope_lines(table(spark, sf, "events"))
    tags = read_tags(tag_lines(scope))
    return find_fragments(with_offsets(scope), tags)


FRAGMENTS_SUBSTRING_SQL = """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents),
pat AS (SELECT DISTINCT item_id AS pattern_id, text AS p FROM benchmark WHERE length(text) > 0),
h AS (SELECT path, pattern_id, p, text[:strpos(text, p) - 1] AS head FROM d JOIN pat ON contains(text, p))
SELECT path, pattern_id, CAST(len(string_split(head, chr(10))) - 1 AS BIGINT) AS line,
       CAST(length(string_split(head, chr(10))[-1]) AS BIGINT) AS "column",
       CAST(length(head) AS BIGINT) AS "offset", CAST(length(p) AS BIGINT) AS length
FROM h
"""


@register("fragments_substring", FRAGMENTS_SUBSTRING_SQL)
def q_fragments_substring(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    pats = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return find_substrings(docs, pats)


READ_FRAGMENTS_SQL = with_tables(r"""
WITH l AS (
  SELECT path, number, text,
         regexp_matches(text, '^[ \t]*#') AS c,
         regexp_extract(text, '^([ \t]*)', 1) AS s,
         regexp_matches(text, '^[ \t]*#[ \t]?--') AS m
  FROM code_lines),
st(path, number, s, run, block_no) AS (
  SELECT path, number, s, m, CAST(0 AS BIGINT) FROM l WHERE number = 0
  UNION ALL
  SELECT l.path, l.number, l.s,
         CASE WHEN st.run THEN l.c AND l.s = st.s ELSE l.m END,
         st.block_no + CASE WHEN (CASE WHEN st.run THEN l.c AND l.s = st.s ELSE l.m END) <> st.run
                            THEN 1 ELSE 0 END
  FROM st JOIN l ON l.path = st.path AND l.number = st.number + 1),
j AS (
  SELECT l.path, l.number, l.text, st.run, st.block_no
  FROM l JOIN st ON l.path = st.path AND l.number = st.number)
SELECT path, block_no, CASE WHEN bool_or(run) THEN 'doc' ELSE 'text' END AS kind,
       string_agg(text, '' ORDER BY number) AS fragment_text
FROM j GROUP BY path, block_no
""", "code_lines", recursive=True)


@register("read_fragments", READ_FRAGMENTS_SQL)
def q_read_fragments(spark, sf):
    lines = with_offsets(code_lines(table(spark, sf, "events")))
    bl = blocks(classify_lines(lines))
    out = read_fragments(bl.select("path", "block_no", "kind", "offset", "length", "line", "n_lines"), lines)
    return out.select("path", "block_no", "kind", "fragment_text")


@register("kind_members", with_tables("""
SELECT CASE string_split(value, chr(9))[4] WHEN 'c' THEN 'Class' WHEN 'f' THEN 'Function' END AS kind,
       row_number() OVER (PARTITION BY string_split(value, chr(9))[4] ORDER BY string_split(value, chr(9))[1], string_split(value, chr(9))[2],
                          string_split(value, chr(9))[3]) - 1 AS place,
       string_split(value, chr(9))[1] AS symbol, string_split(value, chr(9))[2] AS path, string_split(value, chr(9))[3] AS pattern
FROM tag_lines
""", "scope_lines", "tag_lines"))
def q_kind_members(spark, sf):
    """A-1: the tags of each kind, one row a tag."""
    return kind_members(read_tags(tag_lines(scope_lines(table(spark, sf, "events")))))


@register("fragment_lines", READ_FRAGMENTS_SQL[:READ_FRAGMENTS_SQL.rindex("SELECT path, block_no, CASE")] + "SELECT path, block_no, number, text AS piece FROM j")
def q_fragment_lines(spark, sf):
    """J-2 as rows: the lines of every block."""
    lines = with_offsets(code_lines(table(spark, sf, "events")))
    bl = blocks(classify_lines(lines)).select("path", "block_no", "offset", "length", "line", "n_lines")
    return fragment_lines(bl, lines).select("path", "block_no", "number", "piece")
