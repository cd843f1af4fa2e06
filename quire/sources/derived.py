"""Source-like tables derived from the driver tables (see FIXTURES.md §3).

The test data holds no source code, so code, scoped and note files are made
from ``events``: one user = one file, one event = one line, in ``(ts,
event_id)`` order.  The Spark builders number the lines with
:func:`quire.plans.scan.number_rows` (range slices, no per-user window); the
SQL texts are the portable definitions used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import CHUNK, key_name, number_rows


def _s(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _numbered(events: DataFrame, path: Column, text: Column) -> DataFrame:
    base = events.select(path.alias("path"), "ts", "event_id", text.alias("text"))
    out = number_rows(base, ["path"], ["ts", "event_id"])
    return out.select("path", "number", "text", CHUNK, key_name(["path"]))


def _module_path() -> Column:
    return F.concat(F.lit("src/pkg"), _s(F.col("user_id") % 7), F.lit("/mod"), _s("user_id"), F.lit(".py"))


def code_lines(events: DataFrame) -> DataFrame:
    t, i = F.col("event_type"), _s("event_id")
    text = (F.when(t == "signup", F.lit("# -- doc"))
            .when((t == "error") & (F.col("event_id") % 5 == 0), F.lit("  # --"))
            .when(t == "error", F.lit("# --"))
            .when(t == "click", F.concat(F.lit("# note "), i))
            .when(t == "view", F.concat(F.lit("  # note "), i))
            .when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), i, F.lit(" = a < b & 'c' + \"d\"")))
            .otherwise(F.concat(F.lit("x"), i, F.lit(" = 1"))))
    return _numbered(events, _module_path(), F.concat(text, F.lit("\n")))


def scope_lines(events: DataFrame) -> DataFrame:
    t, i, e = F.col("event_type"), _s("event_id"), F.col("event_id")
    f = _s(e % 20)
    text = (F.when((t == "signup") & (e % 3 == 0), F.concat(F.lit("class C"), i, F.lit("(NamedTuple):")))
            .when(t == "signup", F.concat(F.lit("class C"), i, F.lit(":")))
            .when(t == "view", F.concat(F.lit("    def f"), f, F.lit("(self):")))
            .when((t == "click") & (e % 4 == 0), F.concat(F.lit('        """Doc of '), i, F.lit('."""')))
            .when((t == "click") & (e % 4 == 1), F.concat(F.lit("    g"), i, F.lit(": int")))
            .when((t == "click") & (e % 4 == 2), F.concat(F.lit("        x = f"), f, F.lit("(y)")))
            .when((t == "click") & (e % 12 == 3), F.concat(F.lit("    def h"), i, F.lit("(self,  # more")))
            .when((t == "click") & (e % 12 == 7), F.concat(F.lit("        'Note "), i, F.lit(".'")))
            .when(t == "click", F.concat(F.lit("        x = "), i))
            .when((t == "error") & (e % 10 == 0), F.concat(F.lit('        """Open '), i))
            .when((t == "error") & (e % 10 == 1), F.concat(F.lit("        q="), i, F.lit("):")))
            .when((t == "error") & (e % 10 == 2), F.concat(F.lit("    s = 'part "), i, F.lit(" \\")))
            .when((t == "error") & (e % 10 == 3), F.concat(F.lit("        r'''class R"), i, F.lit(": \\d'''")))
            .when((t == "error") & (e % 10 == 4), F.lit('        """'))
            .when(t == "error", F.concat(F.lit("    y = "), i))
            .when(e % 4 == 0, F.concat(F.lit("import m"), i, F.lit("  # why")))
            .when(e % 4 == 1, F.concat(F.lit("from p import (a"), i, F.lit(", b as c"), i, F.lit(")")))
            .when(e % 4 == 2, F.concat(F.lit("from . import z"), i))
            .otherwise(F.concat(F.lit("from .q import (k"), i, F.lit(","))))
    return _numbered(events, _module_path(), F.concat(text, F.lit("\n")))


def nota_lines(events: DataFrame) -> DataFrame:
    t, i, e = F.col("event_type"), _s("event_id"), F.col("event_id")
    text = (F.when(t == "signup", F.concat(F.lit("== Title "), i))
            .when((t == "view") & (e % 2 == 0), F.concat(F.lit("- [x] item "), i))
            .when(t == "view", F.concat(F.lit("- [ ] item "), i))
            .when((t == "click") & (e % 3 == 0), F.concat(F.lit("_t"), i, F.lit(" *e`c`* x_ <<q>>")))
            .when((t == "click") & (e % 6 == 1), F.concat(F.lit("**s"), i, F.lit(" *e _t `c <<q [a]>>` t_ e* s** [l *m*)[u]")))
            .when((t == "click") & (e % 3 == 1), F.concat(F.lit("**s"), i, F.lit("** [a] [l)[t]")))
            .when(t == "click", F.concat(F.lit("- *b"), i, F.lit("* and `c`")))
            .when((t == "error") & (e % 4 == 0), F.lit("```"))
            .when(t == "error", F.lit(""))
            .when(e % 5 == 0, F.concat(F.lit("1) step "), i))
            .when(e % 5 == 1, F.concat(F.lit("- term "), i, F.lit("::")))
            .otherwise(F.concat(F.lit("plain text "), i)))
    return _numbered(events, F.concat(F.lit("note"), _s("user_id")), text)


def tag_lines(scope: DataFrame) -> DataFrame:
    """ctags-style lines, one per class or method declaration of ``scope_lines``."""
    text = F.col("text")
    return scope.where(text.startswith("class ") | text.startswith("    def ")).select(F.concat(
        F.regexp_extract(text, "(class|def) ([A-Za-z_0-9]+)", 2), F.lit("\t"), F.col("path"), F.lit("\t"),
        F.lit("/^"), F.regexp_replace(text, "\n", ""), F.lit('$/;"'), F.lit("\t"),
        F.when(text.startswith("class"), F.lit("c")).otherwise(F.lit("f"))).alias("value"))


def module_files(events: DataFrame) -> DataFrame:
    """Paths of the modules, with package markers for even folders and a private file in each."""
    user = F.col("user_id")
    folder = F.concat(F.lit("src/pkg"), _s(user % 7))
    some = events.select(F.explode(F.array(
        _module_path(), F.concat(folder, F.lit("/__main__.py")), F.lit("src/__init__.py"), F.lit("other/mod.py"),
        F.when(user % 7 % 2 == 0, F.concat(folder, F.lit("/__init__.py"))))).alias("path"))
    return some.where("path is not null").distinct()


# Portable definitions (FIXTURES.md §3), used by the DuckDB oracle.
CODE_LINES_SQL = """
SELECT 'src/pkg' || CAST(user_id % 7 AS STRING) || '/mod' || CAST(user_id AS STRING) || '.py' AS path,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS number,
       CASE WHEN event_type = 'signup' THEN '# -- doc'
            WHEN event_type = 'error' AND event_id % 5 = 0 THEN '  # --'
            WHEN event_type = 'error' THEN '# --'
            WHEN event_type = 'click' THEN '# note ' || CAST(event_id AS STRING)
            WHEN event_type = 'view' THEN '  # note ' || CAST(event_id AS STRING)
            WHEN event_id % 3 = 0 THEN 'x' || CAST(event_id AS STRING) || ' = a < b & ' || chr(39) || 'c' || chr(39) || ' + "d"'
            ELSE 'x' || CAST(event_id AS STRING) || ' = 1' END || chr(10) AS text
FROM events
"""

SCOPE_LINES_SQL = '''
SELECT 'src/pkg' || CAST(user_id % 7 AS STRING) || '/mod' || CAST(user_id AS STRING) || '.py' AS path,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS number,
       CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'class C' || CAST(event_id AS STRING) || '(NamedTuple):'
            WHEN event_type = 'signup' THEN 'class C' || CAST(event_id AS STRING) || ':'
            WHEN event_type = 'view' THEN '    def f' || CAST(event_id % 20 AS STRING) || '(self):'
            WHEN event_type = 'click' AND event_id % 4 = 0 THEN '        """Doc of ' || CAST(event_id AS STRING) || '."""'
            WHEN event_type = 'click' AND event_id % 4 = 1 THEN '    g' || CAST(event_id AS STRING) || ': int'
            WHEN event_type = 'click' AND event_id % 4 = 2 THEN '        x = f' || CAST(event_id % 20 AS STRING) || '(y)'
            WHEN event_type = 'click' AND event_id % 12 = 3 THEN '    def h' || CAST(event_id AS STRING) || '(self,  # more'
            WHEN event_type = 'click' AND event_id % 12 = 7 THEN '        ' || chr(39) || 'Note ' || CAST(event_id AS STRING) || '.' || chr(39)
            WHEN event_type = 'click' THEN '        x = ' || CAST(event_id AS STRING)
            WHEN event_type = 'error' AND event_id % 10 = 0 THEN '        """Open ' || CAST(event_id AS STRING)
            WHEN event_type = 'error' AND event_id % 10 = 1 THEN '        q=' || CAST(event_id AS STRING) || '):'
            WHEN event_type = 'error' AND event_id % 10 = 2 THEN '    s = ' || chr(39) || 'part ' || CAST(event_id AS STRING) || ' ' || chr(92)
            WHEN event_type = 'error' AND event_id % 10 = 3
              THEN '        r' || repeat(chr(39), 3) || 'class R' || CAST(event_id AS STRING) || ': ' || chr(92) || 'd' || repeat(chr(39), 3)
            WHEN event_type = 'error' AND event_id % 10 = 4 THEN '        """'
            WHEN event_type = 'error' THEN '    y = ' || CAST(event_id AS STRING)
            WHEN event_id % 4 = 0 THEN 'import m' || CAST(event_id AS STRING) || '  # why'
            WHEN event_id % 4 = 1 THEN 'from p import (a' || CAST(event_id AS STRING) || ', b as c' || CAST(event_id AS STRING) || ')'
            WHEN event_id % 4 = 2 THEN 'from . import z' || CAST(event_id AS STRING)
            ELSE 'from .q import (k' || CAST(event_id AS STRING) || ',' END || chr(10) AS text
FROM events
'''

NOTA_LINES_SQL = """
SELECT 'note' || CAST(user_id AS STRING) AS path,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS number,
       CASE WHEN event_type = 'signup' THEN '== Title ' || CAST(event_id AS STRING)
            WHEN event_type = 'view' AND event_id % 2 = 0 THEN '- [x] item ' || CAST(event_id AS STRING)
            WHEN event_type = 'view' THEN '- [ ] item ' || CAST(event_id AS STRING)
            WHEN event_type = 'click' AND event_id % 3 = 0 THEN '_t' || CAST(event_id AS STRING) || ' *e`c`* x_ <<q>>'
            WHEN event_type = 'click' AND event_id % 6 = 1
              THEN '**s' || CAST(event_id AS STRING) || ' *e _t `c <<q [a]>>` t_ e* s** [l *m*)[u]'
            WHEN event_type = 'click' AND event_id % 3 = 1 THEN '**s' || CAST(event_id AS STRING) || '** [a] [l)[t]'
            WHEN event_type = 'click' THEN '- *b' || CAST(event_id AS STRING) || '* and `c`'
            WHEN event_type = 'error' AND event_id % 4 = 0 THEN repeat('`', 3)
            WHEN event_type = 'error' THEN ''
            WHEN event_id % 5 = 0 THEN '1) step ' || CAST(event_id AS STRING)
            WHEN event_id % 5 = 1 THEN '- term ' || CAST(event_id AS STRING) || '::'
            ELSE 'plain text ' || CAST(event_id AS STRING) END AS text
FROM events
"""

MODULE_FILES_SQL = """
SELECT DISTINCT path FROM (
  SELECT 'src/pkg' || CAST(user_id % 7 AS STRING) || '/mod' || CAST(user_id AS STRING) || '.py' AS path FROM events
  UNION ALL SELECT 'src/pkg' || CAST(user_id % 7 AS STRING) || '/__main__.py' FROM events
  UNION ALL SELECT 'src/__init__.py' UNION ALL SELECT 'other/mod.py'
  UNION ALL SELECT 'src/pkg' || CAST(user_id % 7 AS STRING) || '/__init__.py' FROM events WHERE user_id % 7 % 2 = 0)
"""

TAG_LINES_SQL = """
SELECT regexp_extract(text, '(class|def) ([A-Za-z_0-9]+)', 2) || chr(9) || path || chr(9)
       || '/^' || replace(text, chr(10), '') || '$/;"' || chr(9)
       || CASE WHEN text LIKE 'class%' THEN 'c' ELSE 'f' END AS value
FROM scope_lines WHERE text LIKE 'class %' OR text LIKE '    def %'
"""


def with_tables(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the derived tables it names, as CTEs."""
    defs = {"code_lines": CODE_LINES_SQL, "scope_lines": SCOPE_LINES_SQL, "nota_lines": NOTA_LINES_SQL,
            "tag_lines": TAG_LINES_SQL, "module_files": MODULE_FILES_SQL}
    need = list(names)
    if "tag_lines" in need and "scope_lines" not in need:
        need.insert(0, "scope_lines")
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in need)
    head = "WITH RECURSIVE" if recursive else "WITH"
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"{head} {ctes},\n{body[5:]}"
    return f"{head} {ctes}\n{body}"
