"""Queries for the scalar functions and sinks (E-*, K-1, K-2, K-6, F-1, F-3, A-7, A-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions.export import filter_glob, merge_attributes, to_json_rows, weave
from ..functions.text import (apply_template, attr_quote, block_meta, clamp, expand_tokens, get_json, inline_spans,
                              lerp, microformats, parse_groups, prel, split_list, steps, time_tuple, unescape_pattern)
from ..operators.symbols import module_name
from ..operators.tags import read_tags
from ..sources.derived import code_lines, nota_lines, scope_lines, tag_lines, with_tables
from .q_lines import TYPED_BLOCKS_SQL

URL_GROUPS = r"(?P<scheme>[A-Za-z]+)://(?P<host_name>[^/?#:]+)(?P<path>[^?#]*)(\?(?P<query>[^#]*))?"


_PG = r"'^(?:([A-Za-z]+)://([^/?#:]+)([^?#]*)(\?([^#]*))?)'"


@register("parse_groups", f"""
WITH u AS (SELECT page_id, url, regexp_matches(url, {_PG}) AS ok FROM pages)
SELECT page_id,
       CASE WHEN ok THEN regexp_extract(url, {_PG}, 1) END AS scheme,
       CASE WHEN ok THEN regexp_extract(url, {_PG}, 2) END AS host_name,
       CASE WHEN ok THEN regexp_extract(url, {_PG}, 3) END AS path,
       CASE WHEN ok AND regexp_extract(url, {_PG}, 4) <> '' THEN regexp_extract(url, {_PG}, 5) END AS query,
       CASE WHEN ok AND regexp_extract(url, {_PG}, 4) <> ''
            THEN array_to_string(string_split(regexp_extract(url, {_PG}, 5), '&'), '|') END AS params
FROM u
""")
def q_parse_groups(spark, sf):
    g = parse_groups("url", URL_GROUPS)
    return table(spark, sf, "pages").select(
        "page_id", g["scheme"].alias("scheme"), g["host"]["name"].alias("host_name"), g["path"].alias("path"),
        g["query"].alias("query"), F.array_join(split_list(g["query"], "&"), "|").alias("params"))


MICRO_SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents),
x AS (
  SELECT doc_id, 'tag' AS kind, unnest(regexp_extract_all(text, '#([A-Za-z0-9_\-]+)', 1)) AS value FROM d
  UNION ALL SELECT doc_id, 'ref', unnest(regexp_extract_all(text, '#\{([^}]+)\}', 1)) FROM d
  UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '([A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+)', 1)) FROM d
  UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '([A-Za-z]+://[^\s>]+)', 1)) FROM d)
SELECT doc_id, kind, value, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY doc_id, kind, value
"""


@register("microformats", MICRO_SQL)
def q_microformats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(microformats("text", bracketed=False)).alias("m"))
    return d.groupBy("doc_id", F.col("m.kind").alias("kind"), F.col("m.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


@register("expand_tokens", """
SELECT p_partkey, 'Part ' || p_brand || ' of size ' || CAST(p_size AS VARCHAR) || ' (' || p_type || ')' AS label,
       '<li>' || p_brand || ':' || CAST(p_size AS VARCHAR) || '</li><li>' || p_type || ':' || p_name || '</li>' AS items,
       'a=' || p_brand || ',b=' || p_type AS entries, '0 ' || p_brand || '; 1 ' || p_type AS words, '[' || p_name || ']' AS name
FROM part
""")
def q_expand_tokens(spark, sf):
    p = table(spark, sf, "part")
    ctx = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"),
                       F.lit("part.type"), F.col("p_type"))
    items = F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("value")),
                    F.struct(F.col("p_type").alias("name"), F.col("p_name").alias("value")))
    return p.select("p_partkey",
                    expand_tokens(F.lit("Part ${brand} of size ${size} (${part.type})"), ctx).alias("label"),
                    apply_template(items, "<li>{name}:{value}</li>").alias("items"),
                    apply_template(F.create_map(F.lit("b"), F.col("p_type"), F.lit("a"), F.col("p_brand")), "{key}={value}", ",", "map").alias("entries"),
                    apply_template(F.array("p_brand", "p_type"), "{index} {}", "; ", "values").alias("words"),
                    apply_template("p_name", "[{value}]", shape="one").alias("name"))


@register("minmax_scale", """
WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, round((p_retailprice - lo) / NULLIF(hi - lo, 0), 6) AS scaled,
       round(least(greatest(0.25, 0.75), greatest((p_retailprice - lo) / NULLIF(hi - lo, 0), least(0.25, 0.75))), 6) AS clamped,
       round(10 + (20 - 10) * ((p_retailprice - lo) / NULLIF(hi - lo, 0)), 6) AS lerped
FROM part, b
""")
def q_minmax_scale(spark, sf):
    p = table(spark, sf, "part")
    b = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    j = p.crossJoin(F.broadcast(b))  # one-row aggregate
    k = prel(F.col("p_retailprice"), F.col("lo"), F.col("hi"))
    return j.select("p_partkey", F.round(k, 6).alias("scaled"), F.round(clamp(k, 0.75, 0.25), 6).alias("clamped"),
                    F.round(lerp(10.0, 20.0, k), 6).alias("lerped"))


@register("json_values", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       concat_ws(',', year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts), isodow(ts) - 1,
                 dayofyear(ts), -1) AS time_tuple
FROM events
""")
def q_json_values(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", get_json("props", "$.k").cast("bigint").alias("k"),
                    F.array_join(time_tuple("ts"), ",").alias("time_tuple"))


@register("merge_attributes", """
WITH e AS (SELECT user_id, ts, event_id, 'k' AS attr, json_extract_string(props, '$.k') AS value FROM events
           WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT user_id, attr, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
       CAST(count(*) AS BIGINT) AS n_values
FROM e GROUP BY user_id, attr
""")
def q_merge_attributes(spark, sf):
    e = table(spark, sf, "events")
    attrs = F.from_json("props", "map<string,string>")
    return merge_attributes(e, "user_id", ["ts", "event_id"], attrs)


GLOB_SQL = with_tables(r"""
WITH f AS (SELECT DISTINCT path FROM code_lines)
SELECT path, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', ''), '/', '.') AS module
FROM f WHERE regexp_matches(string_split(path, '/')[-1], '^mod1.*\.py$')
         AND NOT regexp_matches(string_split(path, '/')[-1], '^.*5\.py$')
""", "code_lines")


@register("glob_filter", GLOB_SQL)
def q_glob_filter(spark, sf):
    files = code_lines(table(spark, sf, "events")).select("path").distinct()
    kept = filter_glob(files, includes=["mod1*.py"], excludes=["*5.py"])
    return kept.select("path", module_name("path").alias("module"))


WEAVE_SQL = TYPED_BLOCKS_SQL[:TYPED_BLOCKS_SQL.rindex("SELECT path, block_no, min(kind)")] + r""",
w AS (SELECT *, lag(block_no) OVER x AS pb, lead(block_no) OVER x AS nb FROM j
      WINDOW x AS (PARTITION BY path ORDER BY number)),
w2 AS (SELECT *, pb IS NULL OR pb <> block_no AS first, nb IS NULL OR nb <> block_no AS last FROM w),
w3 AS (SELECT *, lag(first) OVER (PARTITION BY path ORDER BY number) AS pf FROM w2)
SELECT path, number, block_no, kind,
  CASE WHEN first THEN CASE kind WHEN 'comment' THEN '<pre class=comment style=''color:green;''>'
                                 WHEN 'code' THEN '<pre class=code style=''color:grey;''>'
                                 ELSE '<em class=text style=''color:blue;''>' END ELSE '' END
  || CASE WHEN kind <> 'text' THEN replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
          WHEN first THEN ''
          ELSE CASE WHEN COALESCE(pf, false) THEN '' ELSE chr(10) END
               || replace(replace(replace(replace(replace(
                    regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^[# ]+', ''),
                    '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') END
  || CASE WHEN last THEN CASE kind WHEN 'text' THEN '</em>' ELSE '</pre>' END ELSE '' END AS html
FROM w3
"""


@register("weave", WEAVE_SQL)
def q_weave(spark, sf):
    return weave(code_lines(table(spark, sf, "events")))


@register("json_enums", """
SELECT event_id, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'error' THEN 'E' ELSE event_type END AS event_type,
       'user.' || user_id AS qualname FROM events
""")
def q_json_enums(spark, sf):
    """K-1: an enumeration by value, and qualified names; read back by their fields."""
    members = [("view", "1"), ("click", "2"), ("error", "E")]
    rows = to_json_rows(table(spark, sf, "events"), ["event_id", "event_type"], {"event_type": members}, "value",
                        F.concat(F.lit("user."), F.col("user_id").cast("string")))
    return rows.select(F.from_json("json", "event_id bigint, event_type string, qualname string").alias("j")).select("j.*")


@register("json_rows", """
SELECT event_id, user_id, event_type, value, props FROM events
""")
def q_json_rows(spark, sf):
    """K-1: events as JSON objects, read back by their fields."""
    cols = ["event_id", "user_id", "event_type", "value", "props"]
    rows = to_json_rows(table(spark, sf, "events"), cols)
    return rows.select(F.from_json("json", "event_id bigint, user_id bigint, event_type string, value double, props string").alias("j")).select("j.*")


#: To any depth; the fixed delimiters are written out here, so that the operator's are checked.
INLINE_SQL = r"""
SELECT path, number, level, kind, CAST(start AS INTEGER) AS start, CAST(start + length(hit) AS INTEGER) AS "end", text FROM sp WHERE level > 0
"""
INLINE_CTE = r"""WITH RECURSIVE sp AS (
  SELECT path, number, 0 AS level, '' AS kind, 0::BIGINT AS start, '' AS hit, 0::BIGINT AS inside, text FROM nota_lines
  UNION ALL
  SELECT path, number, level + 1,
         CASE WHEN starts_with(hit, '**') AND length(hit) > 4 THEN 'strong' WHEN starts_with(hit, '*') THEN 'emphasis' WHEN starts_with(hit, '_') THEN 'term'
              WHEN starts_with(hit, '`') THEN 'code' WHEN starts_with(hit, '<<') THEN 'quote' WHEN contains(hit, ')[') THEN 'link' ELSE 'anchor' END,
         start, hit, start + CASE WHEN starts_with(hit, '<<') OR (starts_with(hit, '**') AND length(hit) > 4) THEN 2 ELSE 1 END,
         CASE WHEN starts_with(hit, '<<') OR (starts_with(hit, '**') AND length(hit) > 4) THEN substr(hit, 3, length(hit) - 4)
              WHEN starts_with(hit, '[') AND contains(hit, ')[') THEN split_part(substr(hit, 2), ')[', 1) ELSE substr(hit, 2, length(hit) - 2) END
  FROM (SELECT path, number, level, hit, inside + COALESCE(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                                            + COALESCE(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT *, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i
              FROM (SELECT path, number, level, inside,
                      regexp_extract_all(text, '[*][*].+?[*][*]|[*].+?[*]|_.+?_|`.+?`|<<.+?>>|\[[^\]]*?\)\[[^\]]*\]|\[[^\]]+\]') AS hits,
                      regexp_split_to_array(text, '[*][*].+?[*][*]|[*].+?[*]|_.+?_|`.+?`|<<.+?>>|\[[^\]]*?\)\[[^\]]*\]|\[[^\]]+\]') AS gaps
                    FROM sp)))) """


@register("inline_spans", with_tables(INLINE_CTE.replace("WITH RECURSIVE", "WITH") + INLINE_SQL, "nota_lines", recursive=True))
def q_inline_spans(spark, sf):
    return nota_lines(table(spark, sf, "events")).select("path", "number", F.explode(inline_spans("text")).alias("x")).select(
        "path", "number", "x.*")


@register("microformats_marked", """
WITH d AS (SELECT c_custkey, 'see <c' || c_custkey || '@shop.org> or <http://shop/' || c_custkey || '> #n' || c_nationkey || ' #{ref '
                  || c_custkey || '} c@bare.org' AS t FROM customer)
SELECT c_custkey, 'email' AS kind, 'c' || c_custkey || '@shop.org' AS value FROM d
UNION ALL SELECT c_custkey, 'url', 'http://shop/' || c_custkey FROM d
UNION ALL SELECT c_custkey, 'tag', regexp_extract(t, '#(n[0-9]+)', 1) FROM d
UNION ALL SELECT c_custkey, 'ref', 'ref ' || c_custkey FROM d
""")
def q_microformats_marked(spark, sf):
    key, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.concat(F.lit("see <c"), s, F.lit("@shop.org> or <http://shop/"), s, F.lit("> #n"), F.col("c_nationkey").cast("string"),
                    F.lit(" #{ref "), s, F.lit("} c@bare.org"))
    return table(spark, sf, "customer").select(key, F.explode(microformats(text)).alias("m")).select("c_custkey", "m.kind", "m.value")


@register("attributes", """
SELECT p_partkey, replace(replace(p_name || ' & "' || p_brand || '"', '&', '&amp;'), '"', '&quot;') AS quoted,
       array_to_string(list_transform(range(0, p_size % 5 + 2), lambda i: printf('%.4f', i / (p_size % 5 + 1))), ',') AS steps
FROM part
""")
def q_attributes(spark, sf):
    text = F.concat("p_name", F.lit(' & "'), "p_brand", F.lit('"'))
    stops = F.transform(steps(F.col("p_size") % 5 + 1), lambda x: F.format_string("%.4f", x))
    return table(spark, sf, "part").select("p_partkey", attr_quote(text).alias("quoted"), F.array_join(stops, ",").alias("steps"))


@register("block_metas", with_tables(r"""
SELECT path, number, CASE WHEN regexp_matches(text, '^[ \t]*#[ \t]?--') THEN trim(regexp_replace(text, '^[ \t]*#[ \t]?-+', ''), ' ' || chr(9) || chr(10)) ELSE '' END AS meta
FROM code_lines
""", "code_lines"))
def q_block_metas(spark, sf):
    return code_lines(table(spark, sf, "events")).select("path", "number", block_meta("text", strip=True).alias("meta"))


@register("tag_texts", with_tables(r"""
SELECT string_split(value, chr(9))[1] AS symbol, string_split(value, chr(9))[2] AS path,
       regexp_extract(value, '/\^(.*)\$/;"', 1) AS text
FROM tag_lines
""", "scope_lines", "tag_lines"))
def q_tag_texts(spark, sf):
    tags = read_tags(tag_lines(scope_lines(table(spark, sf, "events"))))
    return tags.select("symbol", "path", unescape_pattern("pattern").alias("text"))
