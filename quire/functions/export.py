"""Sinks and rendering (K-1, K-6) and file-name predicates (F-1, A-8).

``weave`` renders typed blocks as HTML one *line* at a time: the opening tag
rides on a block's first line and the closing tag on its last, so no block
or file is ever gathered into one value; writing the rows of a path in
``number`` order (``write.partitionBy('path').text``) yields the document.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import typed_lines
from ..plans.scan import scan
from .text import html_escape, strip_comment

# Opening and closing tags per typed-block kind (fixed rendering).
BLOCK_TAGS = {
    "comment": ("<pre class=comment style='color:green;'>", "</pre>"),
    "code": ("<pre class=code style='color:grey;'>", "</pre>"),
    "text": ("<em class=text style='color:blue;'>", "</em>"),
}


def to_json_rows(df: DataFrame, cols: Sequence[str] | None = None, enums: Mapping[str, Sequence[tuple[str, str]]] | None = None,
                 enum: str = "name", qualname: Column | None = None) -> DataFrame:
    """K-1: one JSON object per row, nulls kept (structs nest, arrays stay arrays).

    ``enums`` gives the ``(name, value)`` members of the enumeration that a column's codes belong to; a code is a name or a
    value, and comes out as its ``name`` or its ``value``, whichever ``enum`` says (of several members with one value the first).
    What is no member stays as it is.  ``qualname`` is added to each object under that name.
    """
    if enum not in ("name", "value"):
        raise ValueError(f"enum is 'name' or 'value', not {enum!r}")
    fields = []
    for c in list(cols or df.columns):
        out = F.col(c)
        if c in (enums or {}):
            members, known = {}, {}
            for name, value in enums[c]:
                members.setdefault(value, name)
            for name, value in enums[c]:
                shown = (members[value] if enum == "name" else value)
                known.setdefault(value, shown)
                known[name] = name if enum == "name" else value
            table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
            out = out if table is None else F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.col(c).cast("string"))
        fields.append(out.alias(c))
    if qualname is not None:
        fields.append(qualname.alias("qualname"))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def weave(lines: DataFrame) -> DataFrame:
    """K-6: ``(path, number, html)`` -- typed blocks as HTML, line by line.

    Code and comment lines are escaped inside ``<pre>``; text blocks drop
    their marker line and show each later line with ``#`` and blanks
    stripped (escaped too), joined by newlines, inside ``<em>``.
    """
    tl = typed_lines(lines)
    tl = scan(tl, ["path"], ["number"], prev={"_pf": F.col("starts")}, next={"_ns": F.col("starts")})
    first, last = F.col("starts"), F.coalesce("_ns", F.lit(True))
    kind = F.col("kind")

    def tag(i: int) -> Column:
        out = None
        for k, t in BLOCK_TAGS.items():
            out = F.when(kind == k, F.lit(t[i])) if out is None else out.when(kind == k, F.lit(t[i]))
        return out

    # in a text block the line after the marker is shown without a leading newline
    body = (F.when(kind != "text", html_escape("text"))
            .when(first, F.lit(""))
            .otherwise(F.concat(F.when(F.coalesce(F.col("_pf"), F.lit(False)), F.lit("")).otherwise(F.lit("\n")),
                                html_escape(strip_comment("text")))))
    html = F.concat(F.when(first, tag(0)).otherwise(F.lit("")), body, F.when(last, tag(1)).otherwise(F.lit("")))
    return tl.select("path", "number", "block_no", "kind", html.alias("html"))


def glob_regex(patterns: Sequence[str]) -> str:
    """Shell globs (``* ? [seq] [!seq]``) to one anchored regex, on the driver."""
    return "^(?:" + "|".join(f"(?:{fnmatch.translate(p)})" for p in patterns) + ")"


def filter_glob(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = (),
                name: Column | None = None) -> DataFrame:
    """F-1: keep a file if its name matches an include (none = all) and no exclude."""
    n = name if name is not None else F.element_at(F.split("path", "/"), -1)
    cond = F.lit(True)
    if includes:
        cond = cond & n.rlike(glob_regex(includes))
    if excludes:
        cond = cond & ~n.rlike(glob_regex(excludes))
    return files.where(cond)


def merge_attributes(rows: DataFrame, key: str, order: Sequence[str], attrs: Column) -> DataFrame:
    """A-8: merge the attribute maps of a key's rows in order: the first value
    of an attribute wins, or the last with ``replace``.  Both are returned;
    ``min_by``/``max_by`` per (key, attribute) -- partial aggregates."""
    ordkey = F.struct(*[F.col(c) for c in order])
    ex = rows.select(key, ordkey.alias("_o"), F.explode(attrs).alias("attr", "value"))
    return ex.groupBy(key, "attr").agg(F.min_by("value", "_o").alias("first_value"),
                                       F.max_by("value", "_o").alias("last_value"),
                                       F.count(F.lit(1)).alias("n_values"))
