"""Column functions (E-1 .. E-15, K-2): string, regex, JSON, array and math.

All of them build Spark expressions; none is a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import MARKER_META

_NAMED = re.compile(r"\(\?P?<([A-Za-z][A-Za-z0-9_]*)>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- E-1, E-2
def parse_groups(col: Column | str, pattern: str) -> Column:
    """E-1: match ``pattern`` at the start of the string (multi-line mode) and
    nest its named groups into a struct; ``_`` in a group name is a path
    separator (``args_0`` -> ``args.0``).  A group that did not take part in
    the match is null, an empty one is empty.  The whole struct is null when
    the pattern does not match.

    Java group names may not hold ``_``, so groups are renamed on the driver
    and addressed by number.
    """
    groups = _capturing_groups(pattern)
    plain = _NAMED.sub("(", pattern)
    rx = f"(?m)^(?:{plain})"
    s = _c(col)
    tree: dict = {}
    for idx, name in groups:
        if name is None:
            continue
        node = tree
        parts = name.split("_")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise ValueError(f"group {name} nests under a value")
        # an empty group took part if a back reference to it matches; a group that did not fails there
        took_part = F.regexp_extract(s, rx, 0).rlike(f"(?m)\\A(?>{plain})\\{idx}")
        value = F.regexp_extract(s, rx, idx)
        node[parts[-1]] = F.when((value != "") | took_part, value)

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return F.when(s.rlike(rx), build(tree))


def _capturing_groups(pattern: str) -> list[tuple[int, str | None]]:
    """``(number, name or None)`` of every capturing group, in order of its '('."""
    out, n, i, cls = [], 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if cls:
            cls = ch != "]"
        elif ch == "[":
            cls = True
        elif ch == "(":
            m = _NAMED.match(pattern, i)
            if m:
                n += 1
                out.append((n, m.group(1)))
            elif pattern[i + 1:i + 2] != "?":
                n += 1
                out.append((n, None))
        i += 1
    return out


def _group_numbers(pattern: str) -> list[int]:
    """1-based numbers of the capturing groups, in order of their '('."""
    out, n, i, cls = [], 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if cls:
            cls = ch != "]"
        elif ch == "[":
            cls = True
        elif ch == "(":
            if pattern[i + 1:i + 2] != "?":
                n += 1
                out.append(n)
        i += 1
    return out


def split_list(col: Column | str, sep: str = ",", max_items: int | None = None) -> Column:
    """E-2: separated items, all of them unless ``max_items`` says otherwise."""
    items = F.split(_c(col), re.escape(sep), -1)
    return items if max_items is None else F.slice(items, 1, max_items)


# ---------------------------------------------------------------- E-3 .. E-7
def block_meta(col: Column | str, strip: bool = False) -> Column:
    """E-3: text after a block marker, '' when the line is a marker without it."""
    meta = F.regexp_extract(_c(col), MARKER_META, 1)
    return F.regexp_replace(meta, r"^\s+|\s+$", "") if strip else meta


def unescape_pattern(col: Column | str) -> Column:
    """E-4: a tag address ``/^text$/;"`` to its text: strip the delimiters,
    then ``\\/`` -> ``/`` and ``\\\\`` -> ``\\``."""
    s = _c(col)
    return unescape(F.regexp_replace(F.regexp_replace(s, r'^/\^?', ""), r'\$?/;"$', ""))


def unescape(col: Column) -> Column:
    """Tag addresses escape slashes and backslashes by a backslash."""
    return F.replace(F.replace(col, F.lit("\\/"), F.lit("/")), F.lit("\\\\"), F.lit("\\"))


def extract(text: Column | str, offset: Column | str, length: Column | str) -> Column:
    """E-5: characters ``[offset, offset+length)`` (0-based, code points)."""
    return F.substr(_c(text), _c(offset) + 1, _c(length))


# Fixed entity table of the HTML escaper: & < > " ' (ampersand first).
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
ATTR_ENTITIES = [("&", "&amp;"), ('"', "&quot;")]


def html_escape(col: Column | str) -> Column:
    """E-6: ``& < > " '`` to entities."""
    out = _c(col)
    for a, b in HTML_ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def attr_quote(col: Column | str) -> Column:
    """E-6: attribute form, only ``&`` and ``"``; null becomes ''."""
    out = _c(col)
    for a, b in ATTR_ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit(""))


def strip_comment(col: Column | str) -> Column:
    """E-7: strip surrounding whitespace, then leading '#' and blanks."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"^\s+|\s+$", ""), r"^[# ]+", "")


# ---------------------------------------------------------------- E-8 .. E-11
# Fixed microformat patterns: #tag, #{ref}, <mail@host>, <scheme://...>.
MICROFORMATS = [
    ("tag", r"#([A-Za-z0-9_\-]+)"),
    ("ref", r"#\{([^}]+)\}"),
    ("email", r"<([A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+)>"),
    ("url", r"<([A-Za-z]+://[^>]+)>"),
]
BARE = {"email": r"([A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+)", "url": r"([A-Za-z]+://[^\s>]+)"}


def _tagger(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def microformats(col: Column | str, bracketed: bool = True) -> Column:
    """E-8: array of ``struct(kind, value)`` for every microformat in the text."""
    s = _c(col)
    parts = []
    for kind, rx in MICROFORMATS:
        if not bracketed and kind in BARE:
            rx = BARE[kind]
        parts.append(F.transform(F.regexp_extract_all(s, F.lit(rx), 1), _tagger(kind)))
    return F.concat(*parts)


# Fixed patterns of the note syntax: list items.
TODO_ITEM = r"^[ \t]*-[ ]*\[([ xX])\][ ]*(.*)$"
ORDERED_ITEM = r"^[ \t]*([0-9a-zA-Z])[).][ ]*(.*)$"
BULLET_ITEM = r"^[ \t]*([-*])[ ]*(.*)$"
DEFINITION_ITEM = r"^[ \t]*-[ ]*(([^:]|:[^:])+)::[ ]*$"


def todo_item(col: Column | str) -> Column:
    """E-10: ``struct(done, text)`` of a ``- [x] ...`` line, null otherwise."""
    s = _c(col)
    return F.when(s.rlike(TODO_ITEM), F.struct(
        F.lower(F.regexp_extract(s, TODO_ITEM, 1)).eqNullSafe("x").alias("done"),
        F.regexp_extract(s, TODO_ITEM, 2).alias("text")))


def list_item(col: Column | str) -> Column:
    """E-11: ``struct(type, label, text)`` for todo, definition, ordered and bullet items."""
    s = _c(col)
    return (F.when(s.rlike(TODO_ITEM), F.struct(F.lit("todo").alias("type"), F.regexp_extract(s, TODO_ITEM, 1).alias("label"),
                                                F.regexp_extract(s, TODO_ITEM, 2).alias("text")))
            .when(s.rlike(DEFINITION_ITEM), F.struct(F.lit("definition").alias("type"),
                                                     F.regexp_extract(s, DEFINITION_ITEM, 1).alias("label"),
                                                     F.lit("").alias("text")))
            .when(s.rlike(ORDERED_ITEM), F.struct(F.lit("ordered").alias("type"), F.regexp_extract(s, ORDERED_ITEM, 1).alias("label"),
                                                  F.regexp_extract(s, ORDERED_ITEM, 2).alias("text")))
            .when(s.rlike(BULLET_ITEM), F.struct(F.lit("bullet").alias("type"), F.regexp_extract(s, BULLET_ITEM, 1).alias("label"),
                                                 F.regexp_extract(s, BULLET_ITEM, 2).alias("text"))))


# ---------------------------------------------------------------- E-9
# Fixed delimiters of inline spans, in order: at one place the first wins.
INLINE = [
    ("strong", r"\*\*(.+?)\*\*"),
    ("emphasis", r"\*(.+?)\*"),
    ("term", r"_(.+?)_"),
    ("code", r"`(.+?)`"),
    ("quote", r"<<(.+?)>>"),
    ("link", r"\[([^\]]*?)\)\[[^\]]*\]"),
    ("anchor", r"\[([^\]]+)\]"),
]
INLINE_ANY = "|".join(rx for _, rx in INLINE)


def inline_spans(col: Column | str, levels: int | None = None) -> Column:
    """E-9: array of ``struct(level, kind, start, end, text)`` for the inline spans of a line.

    The earliest start wins; ``text`` is what stands between the delimiters and
    is searched again, to any depth, or ``levels`` deep if that is given.  ``start`` and ``end`` count characters
    of the whole line, delimiters included; a span stands before those within it.  Null text: null.

    Any depth takes a stack, which built-in expressions do not have: texts go to Python in Arrow
    batches.  With ``levels`` the expression is built-in and as large as it is deep.
    """
    return _all_spans(_c(col)) if levels is None else _spans(_c(col), F.lit(0), 1, levels)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("level", T.IntegerType()), ("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()))])))
def _all_spans(texts: pd.Series) -> pd.Series:
    any_, each = re.compile(INLINE_ANY), [(name, re.compile(rx)) for name, rx in INLINE]

    def spans(text):
        if text is None:
            return None
        out, todo = [], [(text, 0, 1)]
        while todo:
            body, base, level = todo.pop()
            below = []
            for m in any_.finditer(body):
                name, own = next((n, w) for n, rx in each if (w := rx.fullmatch(m[0])))
                begin = base + m.start()
                found = {"level": level, "kind": name, "start": begin, "end": begin + len(m[0]), "text": own[1]}
                below.append((found, (own[1], begin + (2 if m[0].startswith(("**", "<<")) else 1), level + 1)))
            out += [f for f, _ in below]
            todo += [b for _, b in below]
        # a span stands before those within it
        return sorted(out, key=lambda f: (f["start"], f["level"]))

    return texts.map(spans)


def _spans(s: Column, base: Column, level: int, levels: int) -> Column:
    hits, gaps = F.regexp_extract_all(s, F.lit(INLINE_ANY), 0), F.split(s, INLINE_ANY, -1)

    def kind_of(hit: Column) -> Column:
        out = F.when(hit.rlike(f"^(?:{INLINE[0][1]})$"), F.lit(INLINE[0][0]))
        for name, rx in INLINE[1:]:
            out = out.when(hit.rlike(f"^(?:{rx})$"), F.lit(name))
        return out

    def inner(hit: Column) -> Column:
        out = F.when(hit.rlike(f"^(?:{INLINE[0][1]})$"), F.regexp_extract(hit, INLINE[0][1], 1))
        for _, rx in INLINE[1:]:
            out = out.when(hit.rlike(f"^(?:{rx})$"), F.regexp_extract(hit, rx, 1))
        return out

    kind = "array<struct<level:int,kind:string,start:int,end:int,text:string,inside:int>>"
    start = F.struct(base.cast("int").alias("at"), F.array().cast(kind).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        begin, text = acc["at"] + F.length(x["gap"]), inner(x["hit"])
        span = F.struct(F.lit(level).alias("level"), kind_of(x["hit"]).alias("kind"), begin.alias("start"),
                        (begin + F.length(x["hit"])).alias("end"), text.alias("text"),
                        (begin + F.when(x["hit"].rlike(r"^(\*\*|<<)"), 2).otherwise(1)).alias("inside"))
        return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(acc["all"], F.array(span)).alias("all"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    own = F.aggregate(pairs, start, step, lambda acc: acc["all"])
    plain = lambda x: F.struct(x["level"].alias("level"), x["kind"].alias("kind"), x["start"].alias("start"),
                               x["end"].alias("end"), x["text"].alias("text"))
    if level == levels:
        return F.transform(own, plain)
    return F.flatten(F.transform(own, lambda x: F.concat(F.array(plain(x)), _spans(x["text"], x["inside"], level + 1, levels))))


# ---------------------------------------------------------------- E-12, E-13
TOKEN_EXPR = r"\$\{([^}]+)\}"
# Fixed patterns of the token syntax.
# A token is dot-separated chunks: key+factor (``gap2``), value+unit (``1.5em``) or a name.
TOKEN_CHUNK = r"([A-Za-z_]+[0-9]+|[0-9]+(\.[0-9]+)?[A-Za-z]+|[A-Za-z_]+)"
TOKEN_WHOLE = rf"^{TOKEN_CHUNK}(\.{TOKEN_CHUNK})*$"


def expand_tokens(col: Column | str, context: Column, on_missing: str = "error") -> Column:
    """E-12: replace each ``${a.b}`` by ``context['a.b']`` (a MAP column or a
    ``create_map`` literal).  A malformed or unknown token raises (strict, as
    in the reference) unless ``on_missing='keep'``, which leaves it as it is.
    """
    s = _c(col)
    gaps = F.split(s, TOKEN_EXPR, -1)
    names = F.regexp_extract_all(s, F.lit(TOKEN_EXPR), 1)

    def value(name: Column) -> Column:
        found = F.try_element_at(context, name)
        ok = name.rlike(TOKEN_WHOLE) & found.isNotNull()
        if on_missing == "keep":
            return F.when(ok, found).otherwise(F.concat(F.lit("${"), name, F.lit("}")))
        return F.when(ok, found).otherwise(F.raise_error(F.concat(F.lit("Undefined or malformed token: "), name)))

    expanded = F.aggregate(F.sequence(F.lit(1), F.size(names)), F.element_at(gaps, 1),
                           lambda acc, i: F.concat(acc, value(F.element_at(names, i)), F.element_at(gaps, i + 1)))
    return F.when(F.size(names) > 0, expanded).otherwise(s)


_FIELD = re.compile(r"\{((?:[A-Za-z_][A-Za-z0-9_.]*)?)\}")


def apply_template(items: Column | str, template: str, sep: str = "", shape: str = "array") -> Column:
    """E-13: render ``template`` once per value, joined by ``sep``; null renders nothing.

    ``shape`` says what ``items`` is: an ``array`` of structs, ``values`` (an array of plain values), a ``map``, or ``one``
    struct or plain value.  ``{field.path}`` is a field of the value, ``{key}`` the key of a map's entry and ``{key.a}`` a field of
    it, ``{value}`` its value; ``{}`` is the value itself, with ``{index}`` its place from 0.  A map is rendered in the
    order of its keys.
    """
    pieces = _FIELD.split(template)

    def render(fields):
        def one(x: Column, i: Column) -> Column:
            parts = []
            for n, p in enumerate(pieces):
                if n % 2 == 0:
                    if p:
                        parts.append(F.lit(p))
                else:
                    parts.append(F.coalesce(fields(x, i, p.split(".") if p else []).cast("string"), F.lit("")))
            return F.concat(*parts) if parts else F.lit("")
        return one

    def path(v: Column, names: list[str]) -> Column:
        for k in names:
            v = v.getField(k)
        return v

    def plain(x: Column, i: Column, names: list[str]) -> Column:
        return i if names == ["index"] else path(x, names)

    def bare(x: Column, i: Column, names: list[str]) -> Column:
        return i if names == ["index"] else path(x, names[1:] if names[:1] == ["value"] else names)

    def entry(x: Column, i: Column, names: list[str]) -> Column:
        if names == ["index"]:
            return i
        at = {"key": "key", "value": "value"}.get(names[0] if names else "value")
        return path(x["value"], names) if at is None else path(x[at], names[1:])

    c = _c(items)
    if shape == "one":
        c = F.when(c.isNotNull(), F.array(c))
    if shape == "map":
        c = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    how = {"array": plain, "values": bare, "map": entry, "one": bare}[shape]
    return F.coalesce(F.array_join(F.transform(c, render(how)), sep), F.lit(""))


# ---------------------------------------------------------------- E-14, A-7
def clamp(v: Column, a: Column | float = 0.0, b: Column | float = 1.0) -> Column:
    """E-14: bound ``v`` to [a, b] whatever the order of a and b."""
    a, b = F.lit(a) if not isinstance(a, Column) else a, F.lit(b) if not isinstance(b, Column) else b
    return F.least(F.greatest(a, b), F.greatest(v, F.least(a, b)))


def lerp(a: Column | float, b: Column | float, k: Column | float) -> Column:
    a, b, k = [x if isinstance(x, Column) else F.lit(x) for x in (a, b, k)]
    return a + (b - a) * k


def prel(v: Column, a: Column | float, b: Column | float) -> Column:
    """Position of ``v`` between ``a`` and ``b``; null when ``a == b``."""
    a, b = [x if isinstance(x, Column) else F.lit(x) for x in (a, b)]
    return (v - a) / F.nullif(b - a, F.lit(0))


def steps(n: Column | int) -> Column:
    """E-14: ``[0/n, 1/n, ..., n/n]``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("double") / n.cast("double"))


# ---------------------------------------------------------------- E-15, K-2
def get_json(col: Column | str, path: str) -> Column:
    """E-15: a value out of JSON text by a ``$.a.b`` path."""
    return F.get_json_object(_c(col), path)


def time_tuple(ts: Column | str) -> Column:
    """K-2: year, month, day, hour, minute, second, weekday (Mon=0), day of year, -1."""
    t = _c(ts)
    return F.array(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t),
                   F.weekday(t), F.dayofyear(t), F.lit(-1))


def join_lines(parts: Sequence[Column], sep: str = "\n") -> Column:
    return F.concat_ws(sep, *parts)


def map_literal(d: Mapping[str, str]) -> Column:
    """A small fixed context as a MAP literal (for E-12)."""
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)
