"""Queries over the URL path tree of ``pages`` (T-*, W-10, A-6, K-3..K-5, F-2, F-7, J-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators.symbols import module_name
from ..operators.trees import (ancestors, catalogue, children, detach, detached, edges_dot, filtered, leaf_flags, name_tree, nest_tree,
                               outline_numbered, path_parts, roots, siblings, siblings_of, subtree, subtree_of, tour, tree_filter, walk,
                               walk_by_parent)
from ..sources.derived import module_files, with_tables

URL_PATH_SQL = r"""regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1),
    '/+', '/', 'g'), '/$', '')"""


def url_paths(pages):
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)
    rest = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return pages.select(F.regexp_replace(F.regexp_replace(F.concat(host, rest), "/+", "/"), "/$", "").alias("path"))


def url_nodes(spark, sf):
    return catalogue(url_paths(table(spark, sf, "pages").select("url")))


NODES_SQL = f"""
WITH files AS (SELECT DISTINCT {URL_PATH_SQL} AS id FROM pages WHERE {URL_PATH_SQL} <> ''),
pre AS (SELECT id, string_split(id, '/') AS s FROM files),
ks AS (SELECT s, unnest(range(1, len(s))) AS k FROM pre),
dirs AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS id FROM ks),
all_nodes AS (
  SELECT id, true AS is_file FROM files
  UNION ALL SELECT id, false AS is_file FROM dirs WHERE id NOT IN (SELECT id FROM files)),
nodes AS (
  SELECT id, NULLIF(regexp_extract(id, '^(.*)/[^/]*$', 1), '') AS parent,
         string_split(id, '/')[-1] AS name, CAST(len(string_split(id, '/')) - 1 AS BIGINT) AS depth, is_file
  FROM all_nodes)
"""

URL_CATALOGUE_SQL = NODES_SQL + r"""
SELECT id, parent, name, depth, is_file,
       CASE WHEN regexp_extract(name, '^.+(\.[^.]+)$', 1) = '' THEN name
            ELSE regexp_extract(name, '^(.+)\.[^.]+$', 1) END AS stem,
       regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix
FROM nodes
"""


@register("url_catalogue", URL_CATALOGUE_SQL)
def q_url_catalogue(spark, sf):
    n = url_nodes(spark, sf)
    parts = path_parts("id")
    return n.select("id", "parent", "name", "depth", "is_file", parts["stem"].alias("stem"),
                    parts["suffix"].alias("suffix"))


TREE_WALK_SQL = NODES_SQL + """
SELECT id, parent, name, depth, string_split(id, '/')[1] AS root,
       CAST(row_number() OVER (PARTITION BY string_split(id, '/')[1] ORDER BY replace(id, '/', chr(1))) - 1 AS BIGINT)
         AS preorder,
       repeat('  ', CAST(depth AS INTEGER)) || name AS outline
FROM nodes
"""


@register("tree_walk", TREE_WALK_SQL)
def q_tree_walk(spark, sf):
    return walk(url_nodes(spark, sf))


TREE_SIBLINGS_SQL = NODES_SQL + """,
kids AS (SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT nodes.id, parent, name,
       CAST(row_number() OVER w - 1 AS BIGINT) AS "index",
       lag(nodes.id) OVER w AS prev_sibling, lead(nodes.id) OVER w AS next_sibling,
       lag(nodes.id) OVER w IS NULL AS is_first, lead(nodes.id) OVER w IS NULL AS is_last,
       CAST(COALESCE(kids.n, 0) AS BIGINT) AS n_children, COALESCE(kids.n, 0) = 0 AS is_leaf
FROM nodes LEFT JOIN kids ON kids.id = nodes.id
WINDOW w AS (PARTITION BY parent ORDER BY name, nodes.id)
"""


@register("tree_siblings", TREE_SIBLINGS_SQL)
def q_tree_siblings(spark, sf):
    return siblings(url_nodes(spark, sf))


CHILDREN_SQL = NODES_SQL + """
SELECT parent, CAST(count(*) AS BIGINT) AS n_children, min(name) AS first_child, max(name) AS last_child
FROM nodes WHERE parent IS NOT NULL GROUP BY parent
"""


@register("tree_children", CHILDREN_SQL)
def q_tree_children(spark, sf):
    return children(url_nodes(spark, sf))


SUBTREE_SQL = NODES_SQL + """,
tops AS (SELECT id, depth FROM nodes WHERE depth = 1 AND name = 'fr')
SELECT nodes.id, nodes.parent, nodes.name, nodes.depth, nodes.is_file, tops.id AS top,
       CAST(nodes.depth - tops.depth AS BIGINT) AS distance
FROM nodes JOIN tops ON nodes.id = tops.id OR starts_with(nodes.id, tops.id || '/')
WHERE nodes.depth - tops.depth <= 1
"""


@register("subtree", SUBTREE_SQL)
def q_subtree(spark, sf):
    n = url_nodes(spark, sf)
    tops = n.where((F.col("depth") == 1) & (F.col("name") == "fr"))
    return subtree(n, tops, depth=1)


DETACH_SQL = NODES_SQL + """,
tops AS (SELECT id FROM nodes WHERE depth = 1 AND name = 'en')
SELECT * FROM nodes WHERE NOT EXISTS (
  SELECT 1 FROM tops WHERE nodes.id = tops.id OR starts_with(nodes.id, tops.id || '/'))
"""


@register("detach", DETACH_SQL)
def q_detach(spark, sf):
    n = url_nodes(spark, sf)
    return detach(n, n.where((F.col("depth") == 1) & (F.col("name") == "en")))


DOT_EDGES_SQL = NODES_SQL + """
SELECT id, 0 AS kind, id || '[label=' || name || '];' AS line FROM nodes
UNION ALL
SELECT id, 1 AS kind, parent || '->' || id || ';' AS line FROM nodes WHERE parent IS NOT NULL
"""


@register("dot_edges", DOT_EDGES_SQL)
def q_dot_edges(spark, sf):
    return edges_dot(url_nodes(spark, sf))


@register("nest_tree", NODES_SQL + """,
w AS (SELECT *, string_split(id, '/')[1] AS root FROM nodes),
n AS (SELECT *, row_number() OVER x - 1 AS preorder, lag(depth) OVER x AS pd, COALESCE(lead(depth) OVER x, 0) AS nd
      FROM w WINDOW x AS (PARTITION BY root ORDER BY replace(id, '/', chr(1))))
SELECT root, CAST(preorder AS BIGINT) AS preorder,
  CASE WHEN pd >= depth THEN ',' ELSE '' END || '{"id":' || CAST(to_json(id) AS VARCHAR) || ',"value":{"name":'
  || CAST(to_json(name) AS VARCHAR) || ',"is_file":' || CAST(is_file AS VARCHAR) || '},"children":'
  || CASE WHEN nd > depth THEN '[' ELSE 'null}' || repeat(']}', CAST(depth - nd AS INTEGER)) END AS json
FROM n
""")
def q_nest_tree(spark, sf):
    return nest_tree(url_nodes(spark, sf), F.struct("name", "is_file"))


@register("tree_roots", NODES_SQL + "SELECT id, name, is_file FROM nodes WHERE parent IS NULL")
def q_tree_roots(spark, sf):
    return roots(url_nodes(spark, sf)).select("id", "name", "is_file")


@register("tree_ancestors", NODES_SQL + """
SELECT n.id, a.id AS ancestor, CAST(n.depth - a.depth AS BIGINT) AS distance
FROM nodes n JOIN nodes a ON starts_with(n.id, a.id || '/')
""")
def q_tree_ancestors(spark, sf):
    return ancestors(url_nodes(spark, sf))


@register("tree_filter", NODES_SQL + """
SELECT id, name FROM nodes n WHERE is_file AND NOT EXISTS (
  SELECT 1 FROM nodes p WHERE p.name = 'fr' AND (n.id = p.id OR starts_with(n.id, p.id || '/')))
""")
def q_tree_filter(spark, sf):
    return tree_filter(url_nodes(spark, sf), F.col("is_file"), F.col("name") != "fr").select("id", "name")


@register("tree_flags", NODES_SQL + """,
k AS (SELECT parent AS id, arg_min(id, (name, id)) AS first_child, arg_max(id, (name, id)) AS last_child
      FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.id, first_child IS NULL AS is_leaf, first_child IS NOT NULL AS is_node, first_child IS NULL AND NOT is_file AS is_empty,
       parent IS NULL AS is_tree, parent IS NOT NULL AS is_subtree, first_child, last_child
FROM nodes n LEFT JOIN k ON k.id = n.id
""")
def q_tree_flags(spark, sf):
    return leaf_flags(url_nodes(spark, sf), F.col("is_file"))


@register("sibling_lists", NODES_SQL + """,
r AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY name, id) AS i, depth FROM nodes WHERE parent IS NOT NULL)
SELECT a.id, b.id AS sibling, CASE WHEN b.i < a.i THEN 'previous' ELSE 'next' END AS side, CAST(abs(b.i - a.i) AS BIGINT) AS distance
FROM r a JOIN r b ON a.parent = b.parent AND a.i <> b.i WHERE a.depth = 1
""")
def q_sibling_lists(spark, sf):
    nodes = url_nodes(spark, sf)
    return siblings_of(siblings(nodes), nodes.where("depth = 1"))


@register("outline_numbers", NODES_SQL + """,
z AS (SELECT id, row_number() OVER (PARTITION BY string_split(id, '/')[1] ORDER BY replace(id, '/', chr(1))) - 1 AS n,
             repeat('  ', CAST(depth AS INTEGER)) || name AS o FROM nodes)
SELECT id, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ' ' || o AS outline FROM z
""")
def q_outline_numbers(spark, sf):
    walked = walk(url_nodes(spark, sf))
    return walked.select("id", outline_numbered(walked).alias("outline"))


@register("tree_walk_by_parent", NODES_SQL.replace("WITH files", "WITH RECURSIVE files", 1) + """,
o AS (SELECT md5(id) AS id, md5(parent) AS parent, CAST(-length(name) AS BIGINT) AS ord FROM nodes),
t AS (SELECT id, id AS root, 0 AS depth, [printf('%06d', ord + 100000) || id] AS k FROM o WHERE parent IS NULL
      UNION ALL SELECT o.id, t.root, t.depth + 1, list_append(t.k, printf('%06d', o.ord + 100000) || o.id) FROM t JOIN o ON o.parent = t.id)
SELECT id, root, CAST(depth AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY root ORDER BY k) - 1 AS BIGINT) AS preorder FROM t
""")
def q_tree_walk_by_parent(spark, sf):
    """T-3, T-4 on ids that say nothing about their place (hashes of the paths), longest names first."""
    nodes = url_nodes(spark, sf).select(F.md5("id").alias("id"), F.md5("parent").alias("parent"), (-F.length("name")).cast("bigint").alias("ord"))
    return walk_by_parent(nodes)


@register("name_tree", with_tables("""
WITH n AS (SELECT DISTINCT replace(replace(replace(path, '/__init__.py', ''), '.py', ''), '/', '.') AS name FROM module_files)
SELECT name, CASE WHEN contains(name, '.') THEN array_to_string(string_split(name, '.')[:-2], '.') END AS parent,
       CAST(len(string_split(name, '.')) AS BIGINT) AS depth FROM n
""", "module_files"))
def q_name_tree(spark, sf):
    names = module_files(table(spark, sf, "events")).select(module_name("path", "").alias("name")).distinct()
    tree = name_tree("name")
    return names.select("name", tree["parent"].alias("parent"), tree["depth"].alias("depth"))


# Only direct parents are nodes, so roots stand at any depth of their paths.
DIRECT_SQL = f"""
WITH RECURSIVE files AS (SELECT DISTINCT {URL_PATH_SQL} AS id FROM pages WHERE {URL_PATH_SQL} <> ''),
dirs AS (SELECT DISTINCT regexp_extract(id, '^(.*)/[^/]*$', 1) AS id FROM files WHERE contains(id, '/')),
all_nodes AS (SELECT id, true AS is_file FROM files UNION ALL SELECT id, false FROM dirs WHERE id NOT IN (SELECT id FROM files)),
nodes AS (SELECT a.id, p.id AS parent, string_split(a.id, '/')[-1] AS name, a.is_file
          FROM all_nodes a LEFT JOIN all_nodes p ON p.id = regexp_extract(a.id, '^(.*)/[^/]*$', 1)),
t AS (SELECT id, parent, name, is_file, id AS root, 0::BIGINT AS depth FROM nodes WHERE parent IS NULL
      UNION ALL SELECT n.id, n.parent, n.name, n.is_file, t.root, t.depth + 1 FROM t JOIN nodes n ON n.parent = t.id),
w AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY replace(id, '/', chr(1))) - 1 AS preorder FROM t)
"""


def direct_nodes(spark, sf):
    return catalogue(url_paths(table(spark, sf, "pages").select("url")), full=False)


@register("tree_walk_direct", DIRECT_SQL + """
SELECT id, parent, name, depth, root, preorder, repeat('  ', CAST(depth AS INTEGER)) || name AS outline FROM w
""")
def q_tree_walk_direct(spark, sf):
    """T-4, K-5 where roots are not first segments of their paths."""
    return walk(direct_nodes(spark, sf))


@register("nest_tree_direct", DIRECT_SQL + """,
n AS (SELECT *, lag(depth) OVER x AS pd, COALESCE(lead(depth) OVER x, 0) AS nd FROM w WINDOW x AS (PARTITION BY root ORDER BY preorder))
SELECT root, preorder, CASE WHEN pd >= depth THEN ',' ELSE '' END || '{"id":' || CAST(to_json(id) AS VARCHAR) || ',"value":{"name":'
  || CAST(to_json(name) AS VARCHAR) || ',"is_file":' || CAST(is_file AS VARCHAR) || '},"children":'
  || CASE WHEN nd > depth THEN '[' ELSE 'null}' || repeat(']}', CAST(depth - nd AS INTEGER)) END AS json
FROM n
""")
def q_nest_tree_direct(spark, sf):
    """K-3 where roots are not first segments of their paths."""
    return nest_tree(direct_nodes(spark, sf), F.struct("name", "is_file"))


# Ids that say nothing about their place: hashes of the paths, longest names first.
HASHED_SQL = NODES_SQL.replace("WITH files", "WITH RECURSIVE files", 1) + """,
o AS (SELECT md5(id) AS id, md5(parent) AS parent, CAST(-length(name) AS BIGINT) AS ord, name, is_file FROM nodes),
t AS (SELECT id, id AS root, 0::BIGINT AS depth, [printf('%06d', ord + 100000) || id] AS k FROM o WHERE parent IS NULL
      UNION ALL SELECT o.id, t.root, t.depth + 1, list_append(t.k, printf('%06d', o.ord + 100000) || o.id) FROM t JOIN o ON o.parent = t.id),
up AS (SELECT id, id AS top, 0::BIGINT AS distance, parent AS at FROM o
       UNION ALL SELECT up.id, o.id, up.distance + 1, o.parent FROM up JOIN o ON o.id = up.at)
"""


def hashed_nodes(spark, sf):
    return url_nodes(spark, sf).select(F.md5("id").alias("id"), F.md5("parent").alias("parent"), (-F.length("name")).cast("bigint").alias("ord"),
                                       "name", "is_file")


@register("tree_tour", HASHED_SQL + """
SELECT t.id, root, depth, row_number() OVER (PARTITION BY root ORDER BY k) - 1 AS preorder,
       (SELECT count(*) FROM up WHERE up.top = t.id) AS size
FROM t
""")
def q_tree_tour(spark, sf):
    """Pre-order, depth and subtree size from ids and parents alone."""
    return tour(hashed_nodes(spark, sf))


@register("subtree_any_ids", HASHED_SQL + """
SELECT up.id, top, distance FROM up JOIN o ON o.id = up.top WHERE o.name IN ('fr', 'en', 'a') OR o.parent IS NULL
""")
def q_subtree_any_ids(spark, sf):
    """T-6: nested tops, one row for each top above a node."""
    nodes = hashed_nodes(spark, sf)
    return subtree_of(tour(nodes), nodes.where(F.col("name").isin("fr", "en", "a") | F.col("parent").isNull()))


@register("detach_any_ids", HASHED_SQL + """
SELECT id, name FROM o WHERE NOT EXISTS (SELECT 1 FROM up JOIN o p ON p.id = up.top WHERE up.id = o.id AND p.name = 'en')
""")
def q_detach_any_ids(spark, sf):
    """T-7 on any ids."""
    nodes = hashed_nodes(spark, sf)
    return detached(nodes, tour(nodes), nodes.where("name = 'en'")).select("id", "name")


@register("tree_filter_any_ids", HASHED_SQL + """
SELECT id, name FROM o WHERE is_file AND NOT EXISTS (SELECT 1 FROM up JOIN o p ON p.id = up.top WHERE up.id = o.id AND p.name = 'fr')
""")
def q_tree_filter_any_ids(spark, sf):
    """F-7 on any ids."""
    nodes = hashed_nodes(spark, sf)
    return filtered(nodes, tour(nodes), F.col("is_file"), F.col("name") != "fr").select("id", "name")
