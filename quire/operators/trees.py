"""Trees as tables (T-1 .. T-8, W-10, A-6, K-3 .. K-5, F-2, F-7, J-8).

Nodes are rows ``(id, parent, name, depth)``.  For path-like ids (file paths,
URL paths, dotted names) every ancestor is a prefix of the id, so ancestors,
roots, depth, pre-order and subtrees come from exploding prefixes and equi
joins -- no iteration, no recursion.  Ordered work among siblings or within
a root goes through :func:`quire.plans.scan.number_rows`, so a parent with
millions of children is still cut into range slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import number_rows, scan
from ..session import ensure_checkpoint_dir
from .spans import inside

SEP = "/"
# Sort key separator below every printable character: pre-order = key order.
KEY_SEP = "\u0001"


def path_parts(col: Column | str, sep: str = SEP) -> Column:
    """F-2: struct(name, stem, suffix, parent) of a path; a top-level parent is '.'."""
    p = F.col(col) if isinstance(col, str) else col
    name = F.element_at(F.split(p, sep), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.when(suffix == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))
    parent = F.regexp_extract(p, rf"^(.*){sep}[^{sep}]*$", 1)
    return F.struct(name.alias("name"), stem.alias("stem"), suffix.alias("suffix"),
                    F.when(parent == "", F.lit(".")).otherwise(parent).alias("parent"))


def catalogue(paths: DataFrame, path: str = "path", full: bool = True, sep: str = SEP) -> DataFrame:
    """T-1 / J-8 / U-1: file rows plus directory rows.

    ``full=True`` adds every ancestor directory (explode path prefixes);
    ``full=False`` adds only direct parents, as the reference does, and a
    directory whose own parent is absent becomes a root.  Directories are
    the parents that are not entries themselves (``left_anti``).
    """
    files = paths.select(F.col(path).alias("id")).where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()
    segs = F.split("id", sep)
    if full:
        dirs = files.where(F.size(segs) > 1).select(F.explode(F.sequence(F.lit(1), F.size(segs) - 1)).alias("_k"), segs.alias("_s")).select(
            F.array_join(F.slice("_s", 1, F.col("_k")), sep).alias("id"))
    else:
        dirs = files.select(F.regexp_extract("id", rf"^(.*){sep}[^{sep}]*$", 1).alias("id")).where(F.col("id") != "")
    dirs = dirs.distinct().join(files, "id", "left_anti")
    nodes = files.withColumn("is_file", F.lit(True)).unionByName(dirs.withColumn("is_file", F.lit(False)))
    parent = F.regexp_extract("id", rf"^(.*){sep}[^{sep}]*$", 1)
    nodes = nodes.select("id", F.when(parent == "", None).otherwise(parent).alias("parent"),
                         F.element_at(F.split("id", sep), -1).alias("name"),
                         (F.size(F.split("id", sep)) - 1).cast("bigint").alias("depth"), "is_file")
    if not full:  # a parent that is not a node makes this node a root
        known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
        nodes = nodes.join(known, "parent", "left").withColumn(
            "parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")
    return nodes


def roots(nodes: DataFrame) -> DataFrame:
    """T-2: nodes without a parent."""
    return nodes.where(F.col("parent").isNull())


def ancestors(nodes: DataFrame, sep: str = SEP) -> DataFrame:
    """T-3: one row per (node, ancestor) with the distance; ``root_of`` is the farthest."""
    segs = F.split("id", sep)
    inner = nodes.where(F.size(segs) > 1)       # a root has no ancestor (and sequence(1, 0) counts down)
    return inner.select("id", segs.alias("_s"), F.explode(F.sequence(F.lit(1), F.size(segs) - 1)).alias("_k")).select(
        "id", F.array_join(F.slice("_s", 1, F.col("_k")), sep).alias("ancestor"),
        (F.size("_s") - F.col("_k")).cast("bigint").alias("distance"))


def rooted(nodes: DataFrame, sep: str = SEP) -> DataFrame:
    """Nodes with ``root``, the nearest of the node's own prefixes that is a node without a parent, and ``depth`` below it.

    A root may stand at any depth of its path (``catalogue(full=False)``) and above another one.
    """
    segs = F.split("id", sep)
    tops = roots(nodes).select(F.col("id").alias("root"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.array_join(F.slice(segs, F.lit(1), k), sep))
    near = nodes.select("id", F.explode(prefixes).alias("root")).join(tops, "root").groupBy("id").agg(
        F.max_by("root", F.length("root")).alias("root"))
    out = nodes.join(near, "id", "left").withColumn("root", F.coalesce("root", F.element_at(segs, 1)))
    return out.withColumn("depth", (F.size(segs) - F.size(F.split("root", sep))).cast("bigint"))


def walk(nodes: DataFrame, sep: str = SEP) -> DataFrame:
    """T-4 / K-5: pre-order position of every node within its root, and the line
    of the outline, indented from the root on.  Siblings are ordered by name."""
    w = rooted(nodes, sep).withColumn("_key", F.array_join(F.split("id", sep), KEY_SEP))
    ranked = number_rows(w, ["root"], ["_key"], out="preorder")
    return ranked.select("id", "parent", "name", "depth", "root", "preorder",
                         F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("name")).alias("outline"))


def outline_numbered(walked: DataFrame) -> Column:
    """K-5 numbering: pre-order position, padded to 3 digits, before the outline text."""
    number = F.col("preorder").cast("string")
    return F.concat(F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), F.lit(" "), F.col("outline"))


def siblings(nodes: DataFrame) -> DataFrame:
    """W-10 / A-6 / T-5: index among siblings (by name), previous and next
    sibling, first/last flags, child count, leaf and empty flags."""
    keyed = nodes.withColumn("_pk", F.coalesce(F.col("parent"), F.lit(KEY_SEP)))
    ranked = number_rows(keyed, ["_pk"], ["name", "id"], out="index")
    nb = scan(ranked, ["_pk"], ["index"], prev={"prev_sibling": F.col("id")}, next={"next_sibling": F.col("id")})
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    out = nb.join(kids, "id", "left").withColumn("n_children", F.coalesce(F.col("n_children"), F.lit(0)))
    return out.select("id", "parent", "name", "index", "prev_sibling", "next_sibling",
                      F.col("prev_sibling").isNull().alias("is_first"), F.col("next_sibling").isNull().alias("is_last"),
                      "n_children", (F.col("n_children") == 0).alias("is_leaf"))


def children(nodes: DataFrame) -> DataFrame:
    """A-6: per parent, the child count and the first and last child by name.
    (Children stay rows: a parent may have an unbounded number of them.)"""
    return nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("name").alias("first_child"), F.max("name").alias("last_child"))


def subtree(nodes: DataFrame, tops: DataFrame, depth: int = -1, sep: str = SEP) -> DataFrame:
    """T-6: the nodes at or below each id of ``tops`` (column ``id``), down to
    ``depth`` levels (-1 = all); attributes are kept.  Equi join of each
    node's ancestor list against ``tops``."""
    anc = ancestors(nodes, sep).select("id", F.col("ancestor").alias("top"), "distance").unionByName(
        nodes.select("id", F.col("id").alias("top"), F.lit(0).cast("bigint").alias("distance")))
    hit = anc.join(tops.select(F.col("id").alias("top")), "top", "left_semi")
    if depth >= 0:
        hit = hit.where(F.col("distance") <= depth)
    return nodes.join(hit.select("id", "top", "distance"), "id")


def detach(nodes: DataFrame, tops: DataFrame, sep: str = SEP) -> DataFrame:
    """T-7: the nodes outside every subtree rooted at ``tops``."""
    return nodes.join(subtree(nodes, tops, -1, sep).select("id"), "id", "left_anti")


def tree_filter(nodes: DataFrame, keep: Column, prune: Column, sep: str = SEP) -> DataFrame:
    """F-7: ``prune`` false drops a node and its whole subtree, ``keep`` false
    drops the node only."""
    pruned = nodes.where(~prune).select("id")
    return detach(nodes, pruned, sep).where(keep)


def edges_dot(nodes: DataFrame) -> DataFrame:
    """K-4: one ``id[label=name];`` line per node and one ``a->b;`` per edge."""
    labels = nodes.select("id", F.lit(0).alias("kind"), F.concat("id", F.lit("[label="), "name", F.lit("];")).alias("line"))
    edges = nodes.where(F.col("parent").isNotNull()).select(
        "id", F.lit(1).alias("kind"), F.concat("parent", F.lit("->"), "id", F.lit(";")).alias("line"))
    return labels.unionByName(edges)


def nest_tree(nodes: DataFrame, value: Column, sep: str = SEP) -> DataFrame:
    """K-3: nested ``{id, value, children|null}`` JSON as lines ``(root, preorder, json)``.

    A node's line opens it and closes every node that ends there, which only
    takes the depths of its neighbours in pre-order, so nothing is gathered: the
    lines of a root in order of ``preorder`` are its document.
    """
    w = rooted(nodes.withColumn("_v", F.to_json(value)), sep).withColumn("_key", F.array_join(F.split("id", sep), KEY_SEP))
    ranked = number_rows(w, ["root"], ["_key"], out="preorder")
    nb = scan(ranked, ["root"], ["preorder"], prev={"_pd": F.col("depth")}, next={"_nd": F.col("depth")})
    below = F.coalesce("_nd", F.lit(0))
    opened = F.concat(F.when(F.col("_pd") >= F.col("depth"), F.lit(",")).otherwise(F.lit("")), F.lit('{"id":'),
                      F.regexp_replace(F.to_json(F.array("id")), r"^\[|\]$", ""), F.lit(',"value":'), F.coalesce("_v", F.lit("null")),
                      F.lit(',"children":'))
    closed = F.concat(F.lit("null}"), F.repeat(F.lit("]}"), (F.col("depth") - below).cast("int")))
    return nb.select("root", "preorder", F.concat(opened, F.when(below > F.col("depth"), F.lit("[")).otherwise(closed)).alias("json"))


def leaf_flags(nodes: DataFrame, has_attributes: Column | None = None) -> DataFrame:
    """T-5: ``id`` with ``is_leaf, is_node, is_empty, is_tree, is_subtree``, ``first_child`` and
    ``last_child`` (by name); empty is a leaf without attributes."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
        F.min_by("id", F.struct("name", "id")).alias("first_child"), F.max_by("id", F.struct("name", "id")).alias("last_child"))
    has = F.lit(False) if has_attributes is None else has_attributes
    out = nodes.withColumn("_has", has).join(kids, "id", "left")
    leaf = F.col("first_child").isNull()
    return out.select("id", leaf.alias("is_leaf"), (~leaf).alias("is_node"), (leaf & ~F.col("_has")).alias("is_empty"),
                      F.col("parent").isNull().alias("is_tree"), F.col("parent").isNotNull().alias("is_subtree"), "first_child", "last_child")


def siblings_of(ranked: DataFrame, asked: DataFrame) -> DataFrame:
    """W-10: all previous and all next siblings of the asked ids: ``(id, sibling, side, distance)``.

    ``ranked`` comes from :func:`siblings`; previous ones count backwards from
    the node.  Rows appear only for asked nodes, an equi join on the parent.
    """
    one = ranked.join(asked.select("id"), "id", "left_semi").select("id", "parent", F.col("index").alias("_i"))
    both = one.where("parent is not null").join(ranked.select("parent", F.col("id").alias("sibling"), "index"), "parent")
    gap = F.col("index") - F.col("_i")
    return both.where(gap != 0).select("id", "sibling", F.when(gap < 0, F.lit("previous")).otherwise(F.lit("next")).alias("side"),
                                       F.abs(gap).alias("distance"))


def ancestors_by_parent(nodes: DataFrame) -> DataFrame:
    """T-3 for any ids: one row per (id, ancestor) with the distance, from ``id`` and ``parent`` alone.

    Doubling: with all ancestors up to distance d known, one equi join gives
    those up to 2d, so a tree of depth D takes log2(D) joins.  Rounds are
    checkpointed.  A parent that is not a node counts as an ancestor and ends
    the chain; a cycle raises.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    known = nodes.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance"))
    known, reach = known.distinct().checkpoint(eager=True), 1
    while True:
        if not known.where("id = ancestor").isEmpty():
            raise ValueError("the parents of these nodes form a cycle")
        far = known.where(F.col("distance") == reach).select("id", F.col("ancestor").alias("_at"))
        more = far.join(known.select(F.col("id").alias("_at"), "ancestor", "distance"), "_at").select(
            "id", "ancestor", (F.col("distance") + reach).alias("distance"))
        more = more.checkpoint(eager=True)
        if more.isEmpty():
            return known
        known, reach = known.unionByName(more).checkpoint(eager=True), reach * 2


def walk_by_parent(nodes: DataFrame, ord: str = "ord") -> DataFrame:
    """T-4 for any ids: ``(id, root, depth, preorder)`` with siblings in the order of ``ord``, then id.

    A node's sort key is the list of ``(ord, id)`` from its root down, as long
    as the node is deep; positions come from the range-sliced numbering.
    """
    step = nodes.select(F.col("id").alias("ancestor"), F.struct(F.col(ord).alias("o"), F.col("id").alias("i")).alias("_step"))
    chain = ancestors_by_parent(nodes).unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("distance")))
    keys = chain.join(step, "ancestor").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_step"))), lambda x: x["_step"]).alias("_key"))
    keyed = keys.select("id", F.get("_key", F.lit(0))["i"].alias("root"), (F.size("_key") - 1).cast("bigint").alias("depth"), "_key")
    return number_rows(keyed, ["root"], ["_key"], out="preorder").select("id", "root", "depth", "preorder")


def tour(nodes: DataFrame, ord: str = "ord") -> DataFrame:
    """T-4 .. T-6 for any ids: ``(id, root, depth, preorder, size)``; siblings in the order of ``ord``, then id.

    Every node is entered and left once; what comes next follows from its first child, next sibling and
    parent.  This list is ranked by doubling: each round halves the steps that are left, so a tree of n
    nodes takes log2(2 n) joins of 2 n rows, whatever its depth.  The subtree of a node is
    the interval ``[preorder, preorder + size)`` of its root.  A parent that is not a node makes a root; a
    cycle raises; rounds are checkpointed.  Ids must be unique and not null.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    base = nodes.select("id", "parent", F.col(ord).alias("o"))
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("k"))
    base = base.join(known, "parent", "left").select("id", F.when(F.col("k"), F.col("parent")).alias("parent"), "o")
    base = base.withColumn("_pk", F.coalesce(F.concat(F.lit("="), F.col("parent").cast("string")), F.lit(""))).checkpoint(eager=True)
    ranked = number_rows(base, ["_pk"], ["o", "id"], out="_at")
    ranked = scan(ranked, ["_pk"], ["_at"], next={"after": F.col("id")})
    first = base.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min_by("id", F.struct("o", "id")).alias("child"))
    links = ranked.join(first, "id", "left")
    inner, up = F.col("parent").isNotNull(), F.lit(True)
    entering = F.struct(F.lit(False).alias("left"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_left"), F.lit(1).alias("w"))
    leaving = F.struct(up.alias("left"), F.when(inner, F.coalesce("after", "parent")).alias("to"), (inner & F.col("after").isNull()).alias("to_left"),
                       F.lit(0).alias("w"))
    steps = links.select("id", F.explode(F.array(entering, leaving)).alias("e")).select("id", "e.*")
    now = steps.select("id", "left", "to", "to_left", F.col("w").cast("bigint").alias("entered"), (2 * F.col("w") - 1).cast("bigint").alias("net"),
                       F.when(F.col("to").isNull(), F.col("id")).alias("root")).checkpoint(eager=True)
    rounds = max(1, now.count()).bit_length() + 1
    while not (open_ := now.where("to is not null")).isEmpty():
        if not rounds:
            raise ValueError("the parents of these nodes form a cycle")
        ahead = now.select(F.col("id").alias("to"), F.col("left").alias("to_left"), F.col("to").alias("_to"), F.col("to_left").alias("_left"),
                           F.col("entered").alias("_entered"), F.col("net").alias("_net"), F.col("root").alias("_root"))
        moved = open_.join(ahead, ["to", "to_left"]).select("id", "left", F.col("_to").alias("to"), F.col("_left").alias("to_left"), (
            F.col("entered") + F.col("_entered")).alias("entered"), (F.col("net") + F.col("_net")).alias("net"), F.col("_root").alias("root"))
        now, rounds = now.where("to is null").unionByName(moved).checkpoint(eager=True), rounds - 1
    at = lambda c, left: F.max(F.when(F.col("left") == left, F.col(c)))
    sums = now.groupBy("id").agg(F.max("root").alias("root"), (-at("net", False)).alias("depth"), at("entered", False).alias("_from"),
                                 (at("entered", False) - at("entered", True)).alias("size"))
    whole = sums.where("id = root").select("root", F.col("_from").alias("_all"))
    return sums.join(whole, "root").select("id", "root", "depth", (F.col("_all") - F.col("_from")).alias("preorder"), "size")


def subtree_of(toured: DataFrame, tops: DataFrame, depth: int = -1) -> DataFrame:
    """T-6 for any ids: ``(id, top, distance)`` of the nodes at or below each id of ``tops``, down to ``depth`` levels (-1: all)."""
    spans = toured.join(tops.select("id").distinct(), "id").select(
        "root", F.col("id").alias("top"), F.col("depth").alias("_top_depth"), F.col("preorder").alias("lo"), (F.col("preorder") + F.col("size")).alias("hi"))
    held = inside(toured.select("root", "id", "depth", "preorder"), spans, ["root"], "preorder")
    out = held.select("id", "top", (F.col("depth") - F.col("_top_depth")).alias("distance"))
    return out if depth < 0 else out.where(F.col("distance") <= depth)


def detached(nodes: DataFrame, toured: DataFrame, tops: DataFrame) -> DataFrame:
    """T-7 for any ids: the nodes outside every subtree rooted at ``tops``."""
    return nodes.join(subtree_of(toured, tops).select("id").distinct(), "id", "left_anti")


def filtered(nodes: DataFrame, toured: DataFrame, keep: Column, prune: Column) -> DataFrame:
    """F-7 for any ids: ``prune`` false drops a node and its whole subtree, ``keep`` false drops the node only."""
    return detached(nodes, toured, nodes.where(~prune)).where(keep)


def name_tree(col: Column | str) -> Column:
    """T-8: struct(parent, depth) of a dotted name (``a.b.c`` -> ``a.b``, 3)."""
    q = F.col(col) if isinstance(col, str) else col
    parent = F.regexp_extract(q, r"^(.*)\.[^.]+$", 1)
    return F.struct(F.when(parent == "", None).otherwise(parent).alias("parent"),
                    F.size(F.split(q, r"\.")).cast("bigint").alias("depth"))
