"""Queries over web pages: HTML marks (W-6) and tag nesting (W-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators.marks import combined, marks, pair_marks
from ..operators.spans import containing

# Mark rules for HTML, in priority order (names with STA_/END_ are events).
HTML_RULES = [
    ("comment", r"<!--.*?-->"),
    ("doctype", r"<![A-Za-z][^>]*>"),
    ("END_tag", r"</[A-Za-z][A-Za-z0-9]*[^>]*>"),
    ("STA_tag", r"<[A-Za-z][A-Za-z0-9]*[^>]*>"),
]

def _marks_sql(rules, with_cols: str = "") -> str:
    rx, groups = combined(rules)
    names = [n for n, _ in rules]
    g_cols = ", ".join(f"regexp_extract_all(html, '{rx}', {g}) AS g{i}" for i, g in enumerate(groups))
    g_un = ", ".join(f"unnest(g{i}) AS g{i}" for i in range(len(groups)))
    case = " ".join(f"WHEN COALESCE(g{i}, '') <> '' THEN '{n}'" for i, n in enumerate(names))
    ev = " ".join(f"WHEN type = '{n}' THEN '{'+' if n.startswith('STA_') else '-' if n.startswith('END_') else '='}'"
                  for n in names)
    return f"""
WITH b AS (
  SELECT page_id, regexp_split_to_array(html, '{rx}') AS gaps,
         regexp_extract_all(html, '{rx}', 0) AS toks, {g_cols}
  FROM pages),
gp AS (SELECT page_id, len(gaps) AS ng, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS text FROM b),
tk AS (SELECT page_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS text, {g_un} FROM b),
pc AS (
  SELECT page_id, CAST(2 * (i - 1) AS BIGINT) AS piece,
         CASE WHEN i = ng THEN '#eos' ELSE '#text' END AS type, text FROM gp
  UNION ALL
  SELECT page_id, CAST(2 * (i - 1) + 1 AS BIGINT) AS piece, CASE {case} END AS type, text FROM tk),
st AS (
  SELECT *, CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY page_id ORDER BY piece
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM pc),
mk AS (
  SELECT page_id, piece, type,
         CASE WHEN type = '#eos' THEN '.' WHEN type = '#text' THEN '=' {ev} END AS event,
         text, start, CAST(start + length(text) AS BIGINT) AS "end"
  FROM st WHERE type <> '#text' OR text <> ''){with_cols}
"""


HTML_MARKS_SQL = _marks_sql(HTML_RULES) + "SELECT page_id, piece, type, event, text, start, \"end\" FROM mk"


@register("html_marks", HTML_MARKS_SQL)
def q_html_marks(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return marks(pages, HTML_RULES, key="page_id", text="html")


HTML_DEPTH_SQL = _marks_sql(HTML_RULES, """,
d AS (
  SELECT *, lower(regexp_extract(text, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM mk WHERE event IN ('+', '-')),
lv AS (
  SELECT *, SUM(CASE WHEN event = '+' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, name ORDER BY piece
            ROWS UNBOUNDED PRECEDING) + CASE WHEN event = '+' THEN 0 ELSE 1 END AS level
  FROM d),
nx AS (
  SELECT *, LEAD(event) OVER w AS ne, LEAD(piece) OVER w AS np, LEAD("end") OVER w AS nend
  FROM lv WINDOW w AS (PARTITION BY page_id, name, level ORDER BY piece))
""") + """
SELECT page_id, name, piece, type, text, start, CAST(level AS BIGINT) AS level,
       CASE WHEN ne = '-' THEN np END AS end_piece, CASE WHEN ne = '-' THEN nend END AS span_end
FROM nx WHERE event = '+'
"""


@register("html_depth", HTML_DEPTH_SQL)
def q_html_depth(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    tags = marks(pages, HTML_RULES, key="page_id", text="html").withColumn(
        "name", F.lower(F.regexp_extract("text", "^</?([A-Za-z][A-Za-z0-9]*)", 1)))
    return pair_marks(tags, key="page_id", name="name").withColumn("level", F.col("level").cast("bigint"))


@register("span_nesting", "WITH el AS (" + HTML_DEPTH_SQL + """),
e AS (SELECT page_id, piece, start AS lo, span_end AS hi FROM el WHERE span_end IS NOT NULL)
SELECT i.page_id, i.piece, o.piece AS enclosing,
       row_number() OVER (PARTITION BY i.page_id, i.piece ORDER BY o.hi - o.lo, o.lo DESC, o.piece) AS distance
FROM e i JOIN e o ON o.page_id = i.page_id AND o.lo <= i.lo AND i.hi <= o.hi AND o.hi - o.lo > i.hi - i.lo
""")
def q_span_nesting(spark, sf):
    """J-4: elements in elements, by character offsets, to any depth."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    tags = marks(pages, HTML_RULES, key="page_id", text="html").withColumn(
        "name", F.lower(F.regexp_extract("text", "^</?([A-Za-z][A-Za-z0-9]*)", 1)))
    spans = pair_marks(tags, key="page_id", name="name").where("span_end is not null").select(
        "page_id", "piece", F.col("start").alias("lo"), F.col("span_end").alias("hi"))
    return containing(spans, spans, ["page_id"], "piece")
