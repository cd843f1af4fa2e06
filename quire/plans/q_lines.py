"""Queries over line tables: line index, blocks and their variants."""

from __future__ import annotations

from ..catalog import register, table
from ..functions.text import list_item, todo_item
from ..operators.blocks import (blocks, classify_lines, prose_blocks, prose_lines, strict_blocks, trim_blank_lines,
                                typed_blocks)
from ..sources.derived import code_lines, nota_lines, with_tables
from ..sources.lines import line_index, line_of, position_of, scan_lines

from pyspark.sql import functions as F


# ---------------------------------------------------------------- line_index (S-2, W-11)
LINE_INDEX_SQL = r"""
WITH pieces AS (
  SELECT CAST(doc_id AS VARCHAR) AS path,
         string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS p
  FROM documents),
raw AS (
  SELECT path, len(p) AS n, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM pieces),
l AS (
  SELECT path, CAST(i - 1 AS BIGINT) AS number,
         CASE WHEN i = n THEN piece ELSE piece || chr(10) END AS text
  FROM raw WHERE NOT (i = n AND piece = ''))
SELECT path, number,
       CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY path ORDER BY number
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY path ORDER BY number
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS "end",
       CAST(length(text) AS BIGINT) AS length
FROM l
"""


@register("line_index", LINE_INDEX_SQL)
def q_line_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"),
                                                 F.col("text").alias("content"))
    return line_index(scan_lines(docs))


POSITIONS_SQL = "WITH x AS (" + LINE_INDEX_SQL + """)
SELECT path, number AS line, CAST(3 AS BIGINT) AS "column", "offset" + 3 AS "offset", number AS found_line, CAST(3 AS BIGINT) AS found_column
FROM x WHERE length > 3
"""


@register("positions", POSITIONS_SQL)
def q_positions(spark, sf):
    """W-11 both ways: the fourth character of each line as an offset, and back."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    lines = scan_lines(docs)
    points = lines.where(F.length("text") > 3).select("path", F.col("number").alias("line"), F.lit(3).cast("bigint").alias("column"))
    there = position_of(lines, points).withColumnsRenamed({"line": "asked_line", "column": "asked_column"})
    return line_of(lines, there).select("path", F.col("asked_line").alias("line"), F.col("asked_column").alias("column"), "offset",
                                        F.col("line").alias("found_line"), F.col("column").alias("found_column"))


# ---------------------------------------------------------------- blocks (W-1, W-2)
# The oracle is the literal line-by-line state machine as a recursive CTE.
BLOCKS_SQL = with_tables(r"""
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
  SELECT l.path, l.number, l.text, st.run, st.block_no,
         COALESCE(SUM(length(l.text)) OVER (PARTITION BY l.path ORDER BY l.number
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         LAG(st.run) OVER (PARTITION BY l.path ORDER BY l.number) AS prev_run
  FROM l JOIN st ON l.path = st.path AND l.number = st.number)
SELECT path, block_no,
       CASE WHEN bool_or(run) THEN 'doc' ELSE 'text' END AS kind,
       max(CASE WHEN run AND NOT COALESCE(prev_run, false)
                THEN regexp_extract(text, '^[ \t]*#[ \t]?-{2,}[ \t]*([^\n]*)', 1) END) AS meta,
       CAST(min(off) AS BIGINT) AS "offset", CAST(sum(length(text)) AS BIGINT) AS length,
       CAST(min(number) AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n_lines
FROM j GROUP BY path, block_no
""", "code_lines", recursive=True)


@register("blocks", BLOCKS_SQL)
def q_blocks(spark, sf):
    return blocks(classify_lines(code_lines(table(spark, sf, "events"))))


# ---------------------------------------------------------------- strict_blocks (W-4)
STRICT_BLOCKS_SQL = with_tables(r"""
WITH l AS (
  SELECT path, number, text,
         regexp_matches(text, '^[ \t]*#') AS c,
         regexp_extract(text, '^([ \t]*)', 1) AS s,
         regexp_matches(text, '^[ \t]*#[ \t]?--\n?$') AS m
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
  SELECT l.path, l.number, l.text, st.run, st.block_no,
         COALESCE(SUM(length(l.text)) OVER (PARTITION BY l.path ORDER BY l.number
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM l JOIN st ON l.path = st.path AND l.number = st.number)
SELECT path, block_no,
       CASE WHEN bool_or(run) THEN 'doc' ELSE 'text' END AS kind,
       CASE WHEN bool_or(run) THEN '' END AS meta,
       CAST(min(off) AS BIGINT) AS "offset", CAST(sum(length(text)) AS BIGINT) AS length,
       CAST(min(number) AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n_lines
FROM j GROUP BY path, block_no
""", "code_lines", recursive=True)


@register("strict_blocks", STRICT_BLOCKS_SQL)
def q_strict_blocks(spark, sf):
    return strict_blocks(code_lines(table(spark, sf, "events")))


# ---------------------------------------------------------------- typed_blocks (W-3)
TYPED_BLOCKS_SQL = with_tables(r"""
WITH l AS (
  SELECT path, number, text,
         regexp_matches(text, '^[ \t]*#\s*--') AS m,
         regexp_matches(text, '^[ \t]*#') AS c
  FROM code_lines),
st(path, number, kind, block_no) AS (
  SELECT path, number, CASE WHEN m THEN 'text' WHEN c THEN 'comment' ELSE 'code' END, CAST(0 AS BIGINT)
  FROM l WHERE number = 0
  UNION ALL
  SELECT l.path, l.number,
         CASE WHEN l.m THEN 'text'
              WHEN l.c THEN CASE WHEN st.kind IN ('text', 'comment') THEN st.kind ELSE 'comment' END
              ELSE 'code' END,
         st.block_no + CASE WHEN l.m THEN 1
                            WHEN l.c THEN CASE WHEN st.kind IN ('text', 'comment') THEN 0 ELSE 1 END
                            ELSE CASE WHEN st.kind = 'code' THEN 0 ELSE 1 END END
  FROM st JOIN l ON l.path = st.path AND l.number = st.number + 1),
j AS (
  SELECT l.path, l.number, l.text, l.m, st.kind, st.block_no,
         COALESCE(SUM(length(l.text)) OVER (PARTITION BY l.path ORDER BY l.number
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM l JOIN st ON l.path = st.path AND l.number = st.number)
SELECT path, block_no, min(kind) AS kind,
       max(CASE WHEN m THEN regexp_replace(regexp_extract(text, '^[ \t]*#\s*-{2,}([^\n]*)', 1),
                                           '^\s+|\s+$', '', 'g') END) AS meta,
       CAST(min(off) AS BIGINT) AS start, CAST(min(off) + sum(length(text)) AS BIGINT) AS "end",
       CAST(min(number) AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n_lines
FROM j GROUP BY path, block_no
""", "code_lines", recursive=True)


@register("typed_blocks", TYPED_BLOCKS_SQL)
def q_typed_blocks(spark, sf):
    return typed_blocks(code_lines(table(spark, sf, "events")))


# ---------------------------------------------------------------- prose_blocks (W-5), E-10, F-6, E-11
# Line-by-line note parser as a recursive CTE: `open` = a code block is open
# after this line.
PROSE_STATE = r"""
WITH l AS (
  SELECT path, number, text,
         regexp_matches(text, '^```(\s.+)*$') AS f,
         CASE WHEN regexp_matches(text, '^==+') THEN 'Title'
              WHEN regexp_matches(text, '^#+') THEN 'Heading'
              WHEN regexp_matches(text, '^--') THEN 'Meta'
              WHEN regexp_matches(text, '^# --') THEN 'Comment'
              WHEN regexp_matches(text, '^[ \t]*-[ ]*\[[ xX]\][ ]*') THEN 'TodoList'
              WHEN regexp_matches(text, '^[ \t]*[0-9a-zA-Z][).][ ]*') THEN 'OrderedList'
              WHEN regexp_matches(text, '^[ \t]*[-*][ ]*') THEN 'UnorderedList' END AS r
  FROM nota_lines),
st(path, number, open, kind, block_no) AS (
  SELECT path, number, f, CASE WHEN f THEN 'Code' ELSE COALESCE(r, 'Text') END, CAST(0 AS BIGINT)
  FROM l WHERE number = 0
  UNION ALL
  SELECT l.path, l.number,
         CASE WHEN st.open THEN NOT l.f ELSE l.f END,
         CASE WHEN st.open OR l.f THEN 'Code' ELSE COALESCE(l.r, 'Text') END,
         st.block_no + CASE WHEN st.open THEN 0
                            WHEN l.f OR l.r IS NOT NULL THEN 1
                            WHEN st.kind = 'Text' THEN 0 ELSE 1 END
  FROM st JOIN l ON l.path = st.path AND l.number = st.number + 1),
p AS (SELECT l.path, l.number, l.text, st.kind, st.block_no
      FROM l JOIN st ON l.path = st.path AND l.number = st.number)
"""

PROSE_BLOCKS_SQL = with_tables(PROSE_STATE + """
SELECT path, block_no, min(kind) AS kind, CAST(min(number) AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS n_lines
FROM p GROUP BY path, block_no
""", "nota_lines", recursive=True)


@register("prose_blocks", PROSE_BLOCKS_SQL)
def q_prose_blocks(spark, sf):
    return prose_blocks(nota_lines(table(spark, sf, "events")))


TODO_PROGRESS_SQL = with_tables(PROSE_STATE + r"""
SELECT path,
       CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE lower(regexp_extract(text, '^[ \t]*-[ ]*\[([ xX])\]', 1)) = 'x') AS BIGINT) AS done
FROM p WHERE kind = 'TodoList' GROUP BY path
""", "nota_lines", recursive=True)


@register("todo_progress", TODO_PROGRESS_SQL)
def q_todo_progress(spark, sf):
    items = prose_lines(nota_lines(table(spark, sf, "events"))).where(F.col("kind") == "TodoList")
    return items.groupBy("path").agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if(todo_item("text").getField("done")).alias("done"))


LIST_ITEMS_SQL = with_tables(PROSE_STATE + r"""
SELECT path, CAST(number AS BIGINT) AS number, kind,
       CASE WHEN regexp_matches(text, '^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$') THEN 'todo'
            WHEN regexp_matches(text, '^[ \t]*-[ ]*(([^:]|:[^:])+)::[ ]*$') THEN 'definition'
            WHEN regexp_matches(text, '^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$') THEN 'ordered'
            WHEN regexp_matches(text, '^[ \t]*([-*])[ ]*(.*)$') THEN 'bullet' END AS item_type,
       CASE WHEN regexp_matches(text, '^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$')
                 THEN regexp_extract(text, '^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$', 1)
            WHEN regexp_matches(text, '^[ \t]*-[ ]*(([^:]|:[^:])+)::[ ]*$')
                 THEN regexp_extract(text, '^[ \t]*-[ ]*(([^:]|:[^:])+)::[ ]*$', 1)
            WHEN regexp_matches(text, '^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$')
                 THEN regexp_extract(text, '^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$', 1)
            ELSE regexp_extract(text, '^[ \t]*([-*])[ ]*(.*)$', 1) END AS label,
       CASE WHEN regexp_matches(text, '^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$')
                 THEN regexp_extract(text, '^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$', 2)
            WHEN regexp_matches(text, '^[ \t]*-[ ]*(([^:]|:[^:])+)::[ ]*$') THEN ''
            WHEN regexp_matches(text, '^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$')
                 THEN regexp_extract(text, '^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$', 2)
            ELSE regexp_extract(text, '^[ \t]*([-*])[ ]*(.*)$', 2) END AS item_text
FROM p WHERE kind IN ('TodoList', 'OrderedList', 'UnorderedList')
""", "nota_lines", recursive=True)


@register("list_items", LIST_ITEMS_SQL)
def q_list_items(spark, sf):
    items = prose_lines(nota_lines(table(spark, sf, "events"))).where(
        F.col("kind").isin("TodoList", "OrderedList", "UnorderedList"))
    it = list_item("text")
    return items.select("path", "number", "kind", it.getField("type").alias("item_type"),
                        it.getField("label").alias("label"), it.getField("text").alias("item_text"))


TRIM_BLANK_SQL = with_tables(r"""
WITH b AS (
  SELECT path, number, text,
         min(CASE WHEN NOT regexp_matches(text, '^[ \t]*$') THEN number END) OVER (PARTITION BY path) AS lo,
         max(CASE WHEN NOT regexp_matches(text, '^[ \t]*$') THEN number END) OVER (PARTITION BY path) AS hi
  FROM nota_lines)
SELECT path, number, text FROM b WHERE number BETWEEN lo AND hi
""", "nota_lines")


@register("trim_blank", TRIM_BLANK_SQL)
def q_trim_blank(spark, sf):
    return trim_blank_lines(nota_lines(table(spark, sf, "events"))).select("path", "number", "text")
