"""Queries over declarations of the scoped code files (Y-*, J-3 .. J-6, A-2 .. A-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators.blocks import blocks, classify_lines
from ..operators.spans import innermost
from ..operators.symbols import (attach_docs, check_unique, defined_in, docstring_lines, docstrings, enclosing, fields, imports, mentions,
                                 mentions_by_symbol, references, register_symbols, slots, submodules, symbols)
from ..operators.tags import SYMBOL_KINDS, kind_lookup
from ..sources.derived import code_lines, module_files, scope_lines, with_tables
from ..sources.lines import with_offsets
from .q_lines import BLOCKS_SQL
from .q_trees import NODES_SQL, url_nodes

DECL_RX = r"^([ \t]*)(async[ \t]+)?(class|def)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
MODULE_SQL = r"replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/py/', ''), '\.py$', ''), '/__init__$', ''), '/', '.')"

#: Lexical state by walking every file character by character: ``lx(path, number, text, off, start, open, said, code)``.
LEX_SQL = rf"""
WITH lx_ln AS (SELECT path, number, text, COALESCE(SUM(length(text)) OVER (PARTITION BY path ORDER BY number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {{src}}),
lx_fs AS (SELECT path, string_agg(text, '' ORDER BY number) AS s, sum(length(text)) AS size FROM lx_ln GROUP BY path),
lx_wk AS (
  SELECT path, s, size, 1::BIGINT AS i, 0::BIGINT AS number, 'code' AS mode, 0 AS depth, TRUE AS bol, 0::BIGINT AS n, '' AS c, FALSE AS quote FROM lx_fs
  UNION ALL
  SELECT path, s, size, i + n2, number + CASE WHEN right(taken, 1) = chr(10) THEN 1 ELSE 0 END, mode2,
         CASE WHEN mode2 = 'code' AND bol2 AND regexp_matches(substr(s, i + n2, 100), '{DECL_RX}') THEN 0 ELSE depth2 END, bol2, n2, taken, quote2
  FROM (
    SELECT *, substr(s, i, n2) AS taken,
      CASE WHEN mode = 'code' AND substr(s, i, 3) IN (repeat(chr(39), 3), repeat(chr(34), 3)) THEN substr(s, i, 3)
           WHEN mode = 'code' AND x IN (chr(39), chr(34)) THEN x WHEN mode = 'code' AND x = '#' THEN '#'
           WHEN mode = '#' AND x = chr(10) THEN 'code' WHEN mode = '#' THEN '#'
           WHEN mode <> 'code' AND substr(s, i, length(mode)) = mode THEN 'code'
           WHEN length(mode) = 1 AND x = chr(10) THEN 'code' ELSE mode END AS mode2,
      CASE WHEN mode <> 'code' THEN depth WHEN x IN ('(', '[', chr(123)) THEN depth + 1
           WHEN x IN (')', ']', chr(125)) THEN greatest(depth - 1, 0) ELSE depth END AS depth2,
      x = chr(10) AS bol2,
      (mode = 'code' AND x IN (chr(39), chr(34))) OR (mode NOT IN ('code', '#') AND substr(s, i, length(mode)) = mode) AS quote2
    FROM (SELECT path, s, size, i, number, mode, depth, bol, substr(s, i, 1) AS x,
                 CASE WHEN mode = '#' THEN 1 WHEN substr(s, i, 1) = chr(92) THEN 2
                      WHEN mode = 'code' AND substr(s, i, 3) IN (repeat(chr(39), 3), repeat(chr(34), 3)) THEN 3
                      WHEN length(mode) = 3 AND substr(s, i, 3) = mode THEN 3 ELSE 1 END AS n2
          FROM lx_wk WHERE i <= size))),
lx_st AS (SELECT path, i - n AS i, c, lag(number) OVER w AS number, lag(mode) OVER w AS mode, lag(depth) OVER w AS depth, lag(bol) OVER w AS bol,
              mode AS mode2, quote FROM lx_wk WINDOW w AS (PARTITION BY path ORDER BY i)),
lx_pc AS (SELECT path, number, min_by(mode = 'code' AND depth = 0 AND bol, i) AS start, max_by(mode2 NOT IN ('code', '#'), i) AS open,
         string_agg(CASE WHEN mode = '#' OR mode2 = '#' THEN regexp_replace(c, '[^\n]', ' ', 'g')
                         WHEN mode <> 'code' OR quote THEN regexp_replace(c, '[^\n]', '"', 'g') ELSE c END, '' ORDER BY i) AS code0,
         string_agg(CASE WHEN mode NOT IN ('code', '#') AND NOT quote AND NOT (length(mode) = 1 AND c = chr(10)) THEN c ELSE '' END, '' ORDER BY i) AS said
       FROM lx_st WHERE c <> '' GROUP BY path, number),
lx AS (SELECT lx_ln.*, start, open, said,
         regexp_replace(regexp_replace(code0, '(^|[^A-Za-z0-9_"])[rRuUbBfF][rRuUbBfF]"', '\1' || repeat(chr(34), 3), 'g'), '(^|[^A-Za-z0-9_"])[rRuUbBfF]"', '\1' || repeat(chr(34), 2), 'g') AS code
       FROM lx_ln JOIN lx_pc USING (path, number))
"""

SYMBOLS_CTE = LEX_SQL.format(src="scope_lines") + rf""",
l AS (
  SELECT path, number, text, code, start, said, open, start AND regexp_matches(code, '{DECL_RX}') AS isdecl,
         start AND NOT regexp_matches(code, '^[ \t]*\n?$') AS nb,
         CAST(length(regexp_extract(code, '^([ \t]*)', 1)) AS BIGINT) AS ind,
         regexp_extract(code, '{DECL_RX}', 4) AS name, regexp_extract(code, '{DECL_RX}', 3) AS k
  FROM lx),
d AS (SELECT * FROM l WHERE isdecl),
e AS (SELECT d.path, d.number, min(l.number) AS nxt FROM d JOIN l
        ON l.path = d.path AND l.number > d.number AND l.nb AND l.ind <= d.ind GROUP BY d.path, d.number),
n AS (SELECT path, max(number) + 1 AS n FROM scope_lines GROUP BY path),
sp AS (SELECT d.*, COALESCE(e.nxt, n.n) AS end_line FROM d LEFT JOIN e USING (path, number) JOIN n USING (path)),
anc AS (SELECT c.path, c.number, string_agg(a.name, '.' ORDER BY a.ind) AS chain FROM sp c JOIN sp a
          ON a.path = c.path AND a.number < c.number AND c.number < a.end_line AND a.ind < c.ind
        GROUP BY c.path, c.number),
syms AS (
  SELECT sp.path, CASE WHEN k = 'class' THEN 'class' ELSE 'function' END AS kind, name,
         {MODULE_SQL} || COALESCE('.' || anc.chain, '') || '.' || name AS qualname,
         {MODULE_SQL} || COALESCE('.' || anc.chain, '') AS parent,
         CAST(sp.number AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, ind AS indent
  FROM sp LEFT JOIN anc USING (path, number)
  UNION ALL
  SELECT path, 'module' AS kind, string_split({MODULE_SQL}, '.')[-1] AS name, {MODULE_SQL} AS qualname,
         NULL AS parent, CAST(0 AS BIGINT) AS line, CAST(n AS BIGINT) AS end_line, CAST(0 AS BIGINT) AS indent
  FROM n)
"""


@register("symbols", with_tables(SYMBOLS_CTE + "SELECT * FROM syms", "scope_lines", recursive=True))
def q_symbols(spark, sf):
    return symbols(scope_lines(table(spark, sf, "events")))


@register("contains", with_tables(SYMBOLS_CTE + '''
SELECT s.path, s.qualname, s.line, e.qualname AS enclosing, e.line AS enclosing_line,
       CAST(row_number() OVER (PARTITION BY s.path, s.line ORDER BY e.kind = 'module', e.line DESC) AS BIGINT) AS distance
FROM syms s JOIN syms e ON e.path = s.path AND s.kind <> 'module'
 AND (e.kind = 'module' OR (e.line < s.line AND s.end_line <= e.end_line))
''', "scope_lines", recursive=True))
def q_contains(spark, sf):
    return enclosing(scope_lines(table(spark, sf, "events")))


@register("slots", with_tables(SYMBOLS_CTE + '''
SELECT parent, name AS slot, arg_max(qualname, line) AS qualname, max(line) AS line
FROM syms WHERE parent IS NOT NULL GROUP BY parent, name
''', "scope_lines", recursive=True))
def q_slots(spark, sf):
    return slots(symbols(scope_lines(table(spark, sf, "events"))))


@register("symbol_kinds", with_tables(SYMBOLS_CTE + ''',
c AS (SELECT path, qualname, line, CASE kind WHEN 'class' THEN 'Cls' WHEN 'function' THEN 'Fun' ELSE 'Mdl' END AS kind_code FROM syms)
SELECT path, qualname, line, kind_code, CASE kind_code WHEN 'Cls' THEN 'Class' WHEN 'Fun' THEN 'Function' ELSE 'Module' END AS kind FROM c
''', "scope_lines", recursive=True))
def q_symbol_kinds(spark, sf):
    kind = F.col("kind")
    code = F.when(kind == "class", F.lit("Cls")).when(kind == "function", F.lit("Fun")).otherwise(F.lit("Mdl"))
    coded = symbols(scope_lines(table(spark, sf, "events"))).select("path", "qualname", "line", code.alias("kind_code"))
    return kind_lookup(coded, kinds=SYMBOL_KINDS).select("path", "qualname", "line", "kind_code", "kind")


@register("fields", with_tables(SYMBOLS_CTE + r''',
f AS (SELECT l.path, l.number, regexp_extract(l.code, '^[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*[^ \t\n=]', 1) AS fname
      FROM l WHERE start AND regexp_matches(l.code, '^[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*[^ \t\n=]')),
o AS (SELECT f.path, f.number, f.fname, arg_max(syms.qualname, syms.line) AS owner, max(syms.line) AS owner_line
      FROM f JOIN syms ON syms.path = f.path AND syms.kind <> 'module' AND syms.line < f.number AND f.number < syms.end_line
      GROUP BY f.path, f.number, f.fname)
SELECT o.path, o.fname AS name, o.owner || '.' || o.fname AS qualname, CAST(o.number AS BIGINT) AS line
FROM o JOIN l ON l.path = o.path AND l.number = o.owner_line
WHERE regexp_matches(l.text, '^[ \t]*class[ \t]+[A-Za-z0-9_]+\(NamedTuple\):')
''', "scope_lines", recursive=True))
def q_fields(spark, sf):
    return fields(scope_lines(table(spark, sf, "events")))


DOCS_CTE = SYMBOLS_CTE + r''',
b AS (SELECT s.path, s.qualname, s.line, s.indent,
        (SELECT min(l.number) FROM l WHERE l.path = s.path AND l.number > s.line AND l.nb) AS doc_line
      FROM syms s WHERE s.kind <> 'module'),
o AS (SELECT b.*, length(regexp_extract(l.text, '^[ \t]*', 0)) AS margin,
        COALESCE((SELECT min(m.number) FROM l m WHERE m.path = b.path AND m.number > b.doc_line AND m.start), 1000000000) AS after
      FROM b JOIN l ON l.path = b.path AND l.number = b.doc_line AND l.ind > b.indent AND regexp_matches(l.text, '^[ \t(]*[rRuU]?["\x27]')),
dl AS (SELECT o.*, l.number, l.code, l.open, CASE WHEN l.number = doc_line THEN said
              ELSE substr(said, least(length(regexp_extract(said, '^[ \t]*', 0)), margin) + 1) END AS part
       FROM o JOIN l ON l.path = o.path AND l.number >= o.doc_line AND l.number < o.after),
ok AS (SELECT path, line FROM dl GROUP BY path, line HAVING bool_and(regexp_matches(code, '^[\s()";\\]*$')) AND NOT max_by(open, number))
'''


@register("docstrings", with_tables(DOCS_CTE + r'''
SELECT path, qualname, line, CAST(doc_line AS BIGINT) AS doc_line,
       regexp_replace(string_agg(part, '' ORDER BY number), '^\s+|\s+$', '', 'g') AS documentation
FROM dl JOIN ok USING (path, line) GROUP BY path, qualname, line, doc_line
''', "scope_lines", recursive=True))
def q_docstrings(spark, sf):
    return docstrings(scope_lines(table(spark, sf, "events")))


@register("docstring_lines", with_tables(DOCS_CTE + "SELECT path, qualname, line, CAST(doc_line AS BIGINT) AS doc_line, number, part AS said "
                                         "FROM dl JOIN ok USING (path, line)", "scope_lines", recursive=True))
def q_docstring_lines(spark, sf):
    return docstring_lines(scope_lines(table(spark, sf, "events")))


@register("submodules", with_tables(r'''
WITH m AS (SELECT path, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', ''), '/', '.') AS module,
                  string_split(path, '/') AS p FROM module_files),
k AS (SELECT path, module, p FROM m WHERE module = 'src' OR starts_with(module, 'src.')),
need AS (SELECT path, p, unnest(range(1, len(p))) AS n FROM k),
bad AS (SELECT path FROM need WHERE array_to_string(p[1:n], '/') || '/__init__.py' NOT IN (SELECT path FROM module_files))
SELECT path, module FROM k
WHERE (p[-1] = '__init__.py' OR NOT starts_with(p[-1], '__')) AND path NOT IN (SELECT path FROM bad)
''', "module_files"))
def q_submodules(spark, sf):
    return submodules(module_files(table(spark, sf, "events")), "src")


@register("register_symbols", with_tables(SYMBOLS_CTE + """
SELECT qualname, arg_max(path, line) AS path, arg_max(kind, line) AS kind, arg_max(name, line) AS name,
       arg_max(parent, line) AS parent, max(line) AS line, arg_max(end_line, line) AS end_line,
       arg_max(indent, line) AS indent, CAST(count(*) AS BIGINT) AS registrations
FROM syms GROUP BY qualname
""", "scope_lines", recursive=True))
def q_register_symbols(spark, sf):
    return register_symbols(symbols(scope_lines(table(spark, sf, "events"))))


@register("check_unique", NODES_SQL + """
SELECT name, CAST(count(*) AS BIGINT) AS count FROM nodes GROUP BY name HAVING count(*) > 1
""")
def q_check_unique(spark, sf):
    return check_unique(url_nodes(spark, sf), "name")


_FROM = r"^from[ \t]+([.]*[A-Za-z_][A-Za-z0-9_.]*|[.]+)[ \t]+import[ \t]*(.+?)[ \t]*$"
_NAME = r"^([A-Za-z_][A-Za-z0-9_.]*|[*])([ \t]+as[ \t]+([A-Za-z_][A-Za-z0-9_]*))?$"
_IMPORT_ROWS = rf'''
WITH t AS (SELECT path, number, regexp_replace(regexp_replace(text, '[ \t]*(#.*)?\n?$', ''), '^[ \t]+', '') AS s FROM scope_lines),
f AS (SELECT *, regexp_matches(s, '{_FROM}') AS is_from, regexp_extract(s, '{_FROM}', 1) AS pkg, regexp_extract(s, '{_FROM}', 2) AS lst FROM t),
o AS (SELECT *, COALESCE(last_value(CASE WHEN is_from AND contains(lst, '(') AND NOT contains(lst, ')') THEN pkg
                                         WHEN contains(s, ')') THEN '' END IGNORE NULLS)
        OVER (PARTITION BY path ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS open FROM f),
h AS (SELECT path, number,
        CASE WHEN open <> '' THEN open WHEN is_from THEN pkg WHEN regexp_matches(s, '^import[ \t]+(.+?)[ \t]*$') THEN '' END AS head,
        CASE WHEN open <> '' THEN split_part(s, ')', 1) WHEN is_from THEN lst ELSE regexp_extract(s, '^import[ \t]+(.+?)[ \t]*$', 1) END AS body
      FROM o),
i AS (SELECT path, number, head, trim(unnest(string_split(regexp_replace(body, '[()]', '', 'g'), ',')), ' ') AS m FROM h WHERE head IS NOT NULL)
SELECT path, number, head || CASE WHEN head = '' OR head LIKE '%.' THEN '' ELSE '.' END || regexp_extract(m, '{_NAME}', 1) AS module,
       NULLIF(regexp_extract(m, '{_NAME}', 3), '') AS alias, head <> '' AS listed
FROM i WHERE regexp_extract(m, '{_NAME}', 1) <> ''
'''
IMPORTS_SQL = with_tables(f"SELECT path, number, module, alias FROM ({_IMPORT_ROWS})", "scope_lines")


@register("imports", IMPORTS_SQL)
def q_imports(spark, sf):
    return imports(scope_lines(table(spark, sf, "events")))


MENTIONS_CTE = r""",
t AS (SELECT path, number, code AS text, start, off, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*') AS w,
             regexp_split_to_array(code, '[A-Za-z_][A-Za-z0-9_]*') AS g FROM lx),
u AS (SELECT path, number, text, start, off, w, g, generate_subscripts(w, 1) AS i, unnest(w) AS name FROM t),
c AS (SELECT *, CAST(COALESCE(list_sum(list_transform(list_slice(g, 1, i - 1), lambda x: length(x))), 0)
                   + COALESCE(list_sum(list_transform(list_slice(w, 1, i - 1), lambda x: length(x))), 0)
                   + length(g[i]) AS BIGINT) AS col FROM u),
m AS (
  SELECT name,
         CASE WHEN start AND regexp_matches(text, '^([ \t]*)(async[ \t]+)?(class|def)[ \t]+([A-Za-z_][A-Za-z0-9_]*)')
                   AND col = length(regexp_extract(text, '^([ \t]*(async[ \t]+)?(class|def)[ \t]+)', 1)) THEN 'def'
              WHEN start AND regexp_matches(text, '^[ \t]*[A-Za-z_][A-Za-z0-9_]*[ \t]*=[^=]')
                   AND col = length(regexp_extract(text, '^([ \t]*)[A-Za-z_][A-Za-z0-9_]*[ \t]*=[^=]', 1)) THEN 'asn'
              ELSE 'ref' END AS type,
         path, CAST(number AS BIGINT) AS line, col AS "column", CAST(off + col AS BIGINT) AS "offset",
         CAST(length(name) AS BIGINT) AS length
  FROM c WHERE name NOT IN ('False', 'None', 'True', 'and', 'as', 'assert', 'async', 'await', 'break', 'class',
    'continue', 'def', 'del', 'elif', 'else', 'except', 'finally', 'for', 'from', 'global', 'if', 'import', 'in',
    'is', 'lambda', 'nonlocal', 'not', 'or', 'pass', 'raise', 'return', 'try', 'while', 'with', 'yield'))
"""


@register("mentions", with_tables(LEX_SQL.format(src="scope_lines") + MENTIONS_CTE + """
SELECT name, CAST(count(*) FILTER (WHERE type = 'def') AS BIGINT) AS n_def,
       CAST(count(*) FILTER (WHERE type = 'ref') AS BIGINT) AS n_ref,
       CAST(count(*) FILTER (WHERE type = 'asn') AS BIGINT) AS n_asn,
       CAST(count(DISTINCT path) AS BIGINT) AS n_paths
FROM m GROUP BY name
""", "scope_lines", recursive=True))
def q_mentions(spark, sf):
    return mentions_by_symbol(mentions(scope_lines(table(spark, sf, "events"))))


@register("mention_rows", with_tables(LEX_SQL.format(src="scope_lines") + MENTIONS_CTE + "SELECT * FROM m", "scope_lines", recursive=True))
def q_mention_rows(spark, sf):
    return mentions(scope_lines(table(spark, sf, "events")))


@register("references", with_tables(SYMBOLS_CTE + MENTIONS_CTE + """,
s2 AS (SELECT s.*, COALESCE((SELECT max(p.line) FROM syms p WHERE p.path = s.path AND p.kind <> 'module'
              AND p.line < s.line AND s.line < p.end_line), -1) AS scope FROM syms s WHERE s.kind <> 'module'),
r AS (SELECT name, path, line, "column" FROM m WHERE type = 'ref'),
cand AS (SELECT r.name, r.path, r.line, r."column", s2.qualname, s2.scope, s2.line AS s_line
         FROM r JOIN s2 ON s2.path = r.path AND s2.name = r.name
         LEFT JOIN syms p ON p.path = r.path AND p.kind <> 'module' AND p.line = s2.scope
         WHERE s2.scope = -1 OR (p.line < r.line AND r.line < p.end_line)),
near AS (SELECT name, path, line, "column", arg_max(qualname, (scope, s_line)) AS q FROM cand GROUP BY name, path, line, "column"),
fl AS (SELECT path, name, arg_max(qualname, line) AS q FROM s2 GROUP BY path, name),
gl AS (SELECT name, max(qualname) AS q FROM s2 GROUP BY name HAVING count(*) = 1),
im AS ({imports}),
ib AS (SELECT path, number, COALESCE(alias, CASE WHEN listed THEN string_split(module, '.')[-1] ELSE string_split(module, '.')[1] END) AS name,
              CASE WHEN alias IS NULL AND NOT listed THEN string_split(module, '.')[1] WHEN dots = 0 THEN module
                   ELSE array_to_string(list_append(string_split(own, '.')[1:len(string_split(own, '.')) - dots], rest), '.') END AS qualname
       FROM (SELECT im.*, {module} AS own, length(regexp_extract(module, '^[.]*', 0)) AS dots, regexp_replace(module, '^[.]+', '') AS rest FROM im)),
fi AS (SELECT path, name, arg_max(qualname, (number, qualname)) AS q FROM ib GROUP BY path, name)
SELECT r.name, r.path, r.line, r."column", COALESCE(near.q, fl.q, fi.q, gl.q) AS qualname,
       CASE WHEN near.q IS NOT NULL THEN 'scope' WHEN fl.q IS NOT NULL THEN 'file' WHEN fi.q IS NOT NULL THEN 'import' WHEN gl.q IS NOT NULL THEN 'global' END AS found
FROM r LEFT JOIN near ON near.name = r.name AND near.path = r.path AND near.line = r.line AND near."column" = r."column"
LEFT JOIN fl ON fl.path = r.path AND fl.name = r.name LEFT JOIN fi ON fi.path = r.path AND fi.name = r.name LEFT JOIN gl ON gl.name = r.name
""".replace("{imports}", _IMPORT_ROWS).replace("{module}", MODULE_SQL), "scope_lines", recursive=True))
def q_references(spark, sf):
    return references(scope_lines(table(spark, sf, "events")))


@register("mentions_in_symbols", with_tables(SYMBOLS_CTE + MENTIONS_CTE + """,
fz AS (SELECT path, max(number) + 1 AS number, max_by(off + length(text), number) AS off FROM lx GROUP BY path),
oo AS (SELECT path, number, off FROM lx UNION ALL SELECT path, number, off FROM fz),
sy AS (SELECT s.path, s.qualname, s.line, a.off AS lo, z.off AS hi FROM syms s JOIN oo a ON a.path = s.path AND a.number = s.line
       JOIN oo z ON z.path = s.path AND z.number = s.end_line)
SELECT m.name, m.path, m."offset", arg_max(sy.qualname, (sy.lo - sy.hi, sy.lo, sy.qualname)) AS within
FROM m LEFT JOIN sy ON sy.path = m.path AND sy.lo <= m."offset" AND m."offset" < sy.hi GROUP BY m.name, m.path, m."offset"
""", "scope_lines", recursive=True))
def q_mentions_in_symbols(spark, sf):
    """J-3 by offsets: the innermost symbol whose characters hold a mention."""
    lines = with_offsets(scope_lines(table(spark, sf, "events")))
    offsets = lines.select("path", "number", "offset").unionByName(lines.groupBy("path").agg(
        (F.max("number") + 1).alias("number"), F.max(F.col("offset") + F.length("text")).alias("offset")))
    ends = [offsets.select("path", F.col("number").alias(n), F.col("offset").alias(o)) for n, o in (("line", "lo"), ("end_line", "hi"))]
    spans = symbols(lines).select("path", "qualname", "line", "end_line").join(ends[0], ["path", "line"]).join(ends[1], ["path", "end_line"])
    return innermost(mentions(lines).select("name", "path", "offset"), spans.select("path", "qualname", "lo", "hi"), ["path"], "offset", "qualname")


def _block_state_sql() -> str:
    """The W-1 recursive state CTEs of BLOCKS_SQL, without its final SELECT."""
    body = BLOCKS_SQL
    return body[:body.rindex("SELECT path, block_no,")]


DEFINED_IN_SQL = _block_state_sql().replace("WITH RECURSIVE code_lines AS", "WITH RECURSIVE code_lines AS", 1) + \
    LEX_SQL.format(src="code_lines").replace("WITH lx_ln AS", ", lx_ln AS", 1) + MENTIONS_CTE + """
SELECT m.name, m.path, m.line, j.block_no, CASE WHEN j.run THEN 'doc' ELSE 'text' END AS block_kind
FROM m LEFT JOIN j ON j.path = m.path AND j.number = m.line WHERE m.type = 'asn'
"""


@register("defined_in", DEFINED_IN_SQL)
def q_defined_in(spark, sf):
    lines = code_lines(table(spark, sf, "events"))
    asn = mentions(lines).where(F.col("type") == "asn").select("name", "path", "line")
    return defined_in(asn, classify_lines(lines)).select("name", "path", "line", "block_no", "block_kind")


ATTACH_DOCS_SQL = BLOCKS_SQL.replace("SELECT path, block_no,\n", ", b AS (SELECT path, block_no,\n", 1).rstrip() + \
    """)
SELECT d.path, d.block_no AS doc_block, d.meta AS doc_meta, d.line AS doc_line, c.block_no AS code_block,
       c.line AS code_line, c.n_lines AS code_lines
FROM b d JOIN b c ON c.path = d.path AND c.block_no = d.block_no + 1
WHERE d.kind = 'doc' AND c.kind = 'text'
"""


@register("attach_docs", ATTACH_DOCS_SQL)
def q_attach_docs(spark, sf):
    bl = blocks(classify_lines(code_lines(table(spark, sf, "events"))))
    return attach_docs(bl)
