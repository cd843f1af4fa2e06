"""Queries that write a tree of files below the shared folder and read it back (S-1, S-2, K-3, K-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions.export import weave
from ..operators.trees import nest_tree
from ..session import ensure_checkpoint_dir
from ..sources.derived import code_lines, scope_lines, with_tables
from ..sources.documents import scan_folder, write_documents
from ..sources.files import json_nodes
from ..sources.lines import read_lines
from .q_text import WEAVE_SQL
from .q_trees import DIRECT_SQL, direct_nodes


def fresh_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("file_lines", with_tables("""
SELECT path, number, CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY path ORDER BY number
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", text FROM scope_lines
""", "scope_lines"))
def q_file_lines(spark, sf):
    """S-2: source files written as files, then read in byte ranges."""
    folder = fresh_folder(spark)
    write_documents(scope_lines(table(spark, sf, "events")), folder)
    return read_lines(spark, folder).select("path", "number", "offset", "text")


@register("folder_files", with_tables("""
SELECT path || CASE WHEN hash_ % 2 = 0 THEN '/__init__.py' ELSE '/.hidden' END AS path, sum(octet_length(encode(text)))::BIGINT AS size,
       string_agg(text, '' ORDER BY number) AS content
FROM (SELECT *, length(path) AS hash_ FROM scope_lines) GROUP BY path, hash_
""", "scope_lines"))
def q_folder_files(spark, sf):
    """S-1: a tree with private and hidden names, written, then listed and read by tasks."""
    folder = fresh_folder(spark)
    lines = scope_lines(table(spark, sf, "events"))
    name = F.when(F.length("path") % 2 == 0, F.lit("/__init__.py")).otherwise(F.lit("/.hidden"))
    write_documents(lines.withColumn("path", F.concat("path", name)), folder)
    return scan_folder(spark, folder).select("path", "size", "content")


@register("woven_documents", f"SELECT path || '.html' AS path, string_agg(html, '' ORDER BY number) AS content FROM ({WEAVE_SQL}) GROUP BY path")
def q_woven_documents(spark, sf):
    """K-6: one HTML file for each source file."""
    folder = fresh_folder(spark)
    write_documents(weave(code_lines(table(spark, sf, "events"))), folder, text="html", suffix=".html")
    return scan_folder(spark, folder).select("path", "content")


@register("tree_documents", f"SELECT root || '.json' AS path, string_agg(json, '' ORDER BY preorder) AS content FROM (" + DIRECT_SQL + """,
n AS (SELECT *, lag(depth) OVER x AS pd, COALESCE(lead(depth) OVER x, 0) AS nd FROM w WINDOW x AS (PARTITION BY root ORDER BY preorder))
SELECT root, preorder, CASE WHEN pd >= depth THEN ',' ELSE '' END || '{"id":' || CAST(to_json(id) AS VARCHAR) || ',"value":{"name":'
  || CAST(to_json(name) AS VARCHAR) || '},"children":' || CASE WHEN nd > depth THEN '[' ELSE 'null}' || repeat(']}', CAST(depth - nd AS INTEGER)) END AS json
FROM n) GROUP BY root
""")
def q_tree_documents(spark, sf):
    """K-3: one JSON file for each root."""
    folder = fresh_folder(spark)
    write_documents(nest_tree(direct_nodes(spark, sf), F.struct("name")), folder, path="root", order="preorder", text="json", suffix=".json")
    return scan_folder(spark, folder).select("path", "content")


@register("json_tree", DIRECT_SQL + """
SELECT root || '.json' AS path, id, parent,
       CASE WHEN parent IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY root, parent ORDER BY preorder) - 1 END AS ord, depth,
       '{"is_file":' || CAST(is_file AS VARCHAR) || ',"name":' || CAST(to_json(name) AS VARCHAR) || '}' AS value
FROM w
""")
def q_json_tree(spark, sf):
    """S-4: the trees written as JSON files, parsed back to nodes of any depth without a schema."""
    folder = fresh_folder(spark)
    write_documents(nest_tree(direct_nodes(spark, sf), F.struct("name", "is_file")), folder, path="root", order="preorder", text="json", suffix=".json")
    return json_nodes(scan_folder(spark, folder), "path", "content")
