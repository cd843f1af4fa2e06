"""Declarations, documentation and mentions from lexed source lines (Y-1 .. Y-6, J-3 .. J-6, A-2 .. A-5).

:func:`quire.operators.lexical.lexed_lines` gives every line its code, the declarations open at it and
those that end before it.  What is here are projections, aggregations and equi joins of those rows;
functions that take ``lines`` also take lines that were read already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import starts
from ..plans.scan import CHUNK, CHUNK_ROWS, chunk_by_position, scan
from ..session import ensure_checkpoint_dir
from .lexical import DECL, KEY, lexed_lines

IMPORT = r"^import[ \t]+(.+?)[ \t]*$"
FROM_IMPORT = r"^from[ \t]+([.]*[A-Za-z_][A-Za-z0-9_.]*|[.]+)[ \t]+import[ \t]*(.+?)[ \t]*$"
IMPORTED = r"^([A-Za-z_][A-Za-z0-9_.]*|[*])([ \t]+as[ \t]+([A-Za-z_][A-Za-z0-9_]*))?$"
FIELD = r"^[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*[^ \t\n=]"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
#: Code of a statement that is a string and nothing else, and how one begins that is text.
ONLY_STRING, STRING_BEGIN = r"^[\s()\";\\]*$", r"^[ \t(]*[rRuU]?['\"]"

# Python keywords are not mentions (fixed word list).
KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
    "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]


def module_name(path: Column | str, prefix: str = "src/py/") -> Column:
    """F-3: path -> dotted module name (anchored: strip ``prefix`` and ``.py``,
    ``/`` -> ``.``, a package's ``__init__`` names the package)."""
    p = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(p, "^" + prefix.replace(".", r"\."), "")
    p = F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), r"/__init__$", "")
    return F.regexp_replace(p, "/", ".")


def _chain() -> Column:
    """Module and open scopes of a line, as names."""
    return F.concat(F.array(module_name("path")), F.transform("scopes", lambda x: x["name"]))


def declarations(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-1 / Y-2: class and def symbols with span, parent and qualname.

    ``(path, kind, name, qualname, parent, line, end_line, indent, scopes)``; ``end_line``
    is exclusive: the next statement outside, or the number of lines of the file.  Each line tells what it
    declares and what it ends, so both come from one read and meet by ``(file, line)``.
    """
    df = lexed_lines(lines, chunk_rows)
    own = F.struct("path", "scopes", "code")
    none = F.when(F.lit(False), own)
    begins = F.array(F.struct(F.col("number").alias("line"), F.lit(None).cast("bigint").alias("end"), own.alias("own")))
    ends = F.transform("closes", lambda x: F.struct(x.alias("line"), F.col("number").alias("end"), none.alias("own")))
    told = F.when(F.col("decl"), F.concat(begins, ends)).otherwise(ends)
    rows = df.select(KEY, F.explode(told).alias("t")).select(KEY, "t.*")
    met = rows.groupBy(KEY, "line").agg(F.any_value("own", F.lit(True)).alias("own"), F.max("end").alias("end"))
    n_lines = lines.groupBy("path").agg((F.max("number") + 1).alias("_n"))
    out = met.select("own.path", "own.scopes", "own.code", "line", "end")
    out = out.join(n_lines.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path")))
    name, chain = F.regexp_extract("code", DECL, 4), _chain()
    return out.select(
        "path", F.when(F.regexp_extract("code", DECL, 3) == "class", F.lit("class")).otherwise(F.lit("function")).alias("kind"),
        name.alias("name"), F.array_join(F.concat(chain, F.array(name)), ".").alias("qualname"), F.array_join(chain, ".").alias("parent"),
        "line", F.coalesce("end", "_n").alias("end_line"), F.length(F.regexp_extract("code", DECL, 1)).cast("bigint").alias("indent"), "scopes")


def symbols(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-1: declarations plus one module row per file."""
    decl = declarations(lines, chunk_rows)
    mods = lines.groupBy("path").agg((F.max("number") + 1).alias("end_line")).select(
        "path", F.lit("module").alias("kind"), F.element_at(F.split(module_name("path"), r"\."), -1).alias("name"),
        module_name("path").alias("qualname"), F.lit(None).cast("string").alias("parent"),
        F.lit(0).cast("bigint").alias("line"), "end_line", F.lit(0).cast("bigint").alias("indent"))
    return decl.drop("scopes").unionByName(mods)


def imports(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-3: ``(path, number, module, alias)``, one row per imported name.

    ``import a, b`` names modules; ``from x import y, z`` gives ``x.y`` and
    ``x.z``, ``from . import z`` gives ``.z``.  Comments are left out, and a
    parenthesised list may run over several lines: the line that opens it
    carries its package forward until the one that closes it.
    """
    return _imports(lines, chunk_rows).drop("listed")


def _imports(lines: DataFrame, chunk_rows: int) -> DataFrame:
    """:func:`imports` with ``listed``: the name is one of a ``from``."""
    df = lines if CHUNK in lines.columns else chunk_by_position(lines, "number", chunk_rows)
    code = F.regexp_replace(F.regexp_replace("text", r"[ \t]*(#.*)?\n?$", ""), r"^[ \t]+", "")
    df = df.withColumn("_t", code)
    package, listed = F.regexp_extract("_t", FROM_IMPORT, 1), F.regexp_extract("_t", FROM_IMPORT, 2)
    opens = F.col("_t").rlike(FROM_IMPORT) & listed.contains("(") & ~listed.contains(")")
    df = scan(df, ["path"], ["number"], lasts={"_open": (F.when(opens, package).when(F.col("_t").contains(")"), F.lit("")), False)})
    inside = F.coalesce("_open", F.lit("")) != ""
    head = F.when(inside, F.col("_open")).when(F.col("_t").rlike(FROM_IMPORT), package).when(F.col("_t").rlike(IMPORT), F.lit(""))
    body = F.when(inside, F.substring_index("_t", ")", 1)).when(F.col("_t").rlike(FROM_IMPORT), listed).otherwise(F.regexp_extract("_t", IMPORT, 1))
    rows = df.select("path", "number", head.alias("_pkg"), body.alias("_b")).where("_pkg is not null")
    rows = rows.select("path", "number", "_pkg", (F.col("_pkg") != "").alias("listed"), F.explode(F.split(F.regexp_replace("_b", "[()]", ""), ",")).alias("_m"))
    name, alias = F.regexp_extract(F.trim("_m"), IMPORTED, 1), F.regexp_extract(F.trim("_m"), IMPORTED, 3)
    joint = F.when((F.col("_pkg") == "") | F.col("_pkg").endswith("."), F.lit("")).otherwise(F.lit("."))
    return rows.where(name != "").select("path", "number", F.concat("_pkg", joint, name).alias("module"),
                                         F.when(alias != "", alias).alias("alias"), "listed")


def fields(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-4: ``(path, name, qualname, line)`` of annotated names directly in the body of a class
    with the base ``NamedTuple`` or ``dataclass``."""
    owner = F.try_element_at("scopes", F.lit(-1))
    df = lexed_lines(lines, chunk_rows).where(F.col("start") & F.col("code").rlike(FIELD) & (F.size("scopes") > 0))
    df = df.where(owner["record"] & (owner["kind"] == "class"))
    name = F.regexp_extract("code", FIELD, 1)
    return df.select("path", name.alias("name"), F.array_join(F.concat(_chain(), F.array(name)), ".").alias("qualname"), F.col("number").alias("line"))


def docstring_lines(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-5: ``(path, qualname, line, doc_line, number, said)``, one row per line of a declaration's documentation.

    The first statement of a body is documentation if it is strings and nothing else, of any quotes, with no prefix of
    bytes or formatting.  ``said`` is what they say on the line, without quotes and, after the first line, without
    the statement's own indent; escapes stay as they are written.  A string that never closes is none.
    """
    df = lexed_lines(lines, chunk_rows).where(F.col("first").isNotNull() & ((F.col("number") == F.col("first")) | ~F.col("start")))
    head = F.col("number") == F.col("first")
    whole = df.groupBy(KEY, "first").agg(
        (F.bool_and(F.col("code").rlike(ONLY_STRING)) & F.bool_or(head & F.col("text").rlike(STRING_BEGIN)) & ~F.max_by("open", "number")).alias("_ok"),
        F.max(F.when(head, F.length(F.regexp_extract("text", r"^[ \t]*", 0)))).alias("_margin")).where("_ok")
    lead = F.least(F.length(F.regexp_extract("said", r"^[ \t]*", 0)), F.col("_margin"))
    said = F.when(head, F.col("said")).otherwise(F.substring("said", lead + 1, F.length("said")))
    return df.join(whole, [KEY, "first"]).select(
        "path", F.array_join(_chain(), ".").alias("qualname"), F.element_at("scopes", -1)["line"].alias("line"),
        F.col("first").alias("doc_line"), "number", said.alias("said"))


def docstrings(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Y-5: ``(path, qualname, line, doc_line, documentation)``, the lines of :func:`docstring_lines` as one
    value without white space at its ends; a value is as large as its documentation."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "said"))), lambda x: x["said"]), "")
    rows = docstring_lines(lines, chunk_rows).groupBy("path", "qualname", "line", "doc_line").agg(whole.alias("_d"))
    return rows.withColumn("documentation", F.regexp_replace("_d", r"^\s+|\s+$", "")).drop("_d")


def submodules(files: DataFrame, root: str, path: str = "path", prefix: str = "") -> DataFrame:
    """F-4: ``(path, module)`` of the modules below the package ``root``, itself included.

    Files whose name begins with ``__`` are not modules of their own, and a
    folder counts only if it and every folder between it and the root hold an
    ``__init__.py``: a semi join of each file's folders with the packages.
    """
    rows = files.select(F.col(path).alias("path")).where(F.col("path").endswith(".py")).distinct()
    rows = rows.withColumn("module", module_name("path", prefix))
    rows = rows.where((F.col("module") == root) | F.col("module").startswith(root + "."))
    stem = F.regexp_extract("path", r"([^/]*)\.py$", 1)
    package = rows.where(stem == "__init__").select(F.col("module").alias("package"))
    kept = rows.where((stem == "__init__") | ~stem.startswith("__"))
    parts, depth = F.split("module", r"\."), len(root.split("."))
    # packages that must exist: from the root down to the folder the file lies in
    last = F.size(parts) - F.when(stem == "__init__", 0).otherwise(1)
    need = kept.select("path", F.explode(F.when(last >= depth, F.sequence(F.lit(depth), last)).otherwise(F.array())).alias("_n"),
                       parts.alias("_p")).select("path", F.array_join(F.slice("_p", 1, F.col("_n")), ".").alias("package"))
    missing = need.join(package, "package", "left_anti").select("path").distinct()
    return kept.join(missing, "path", "left_anti")


def mentions(lines: DataFrame, chunk_rows: int = CHUNK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Y-6: identifier occurrences in code, outside strings and comments, with type ``def`` (after class/def),
    ``asn`` (left of a single ``=`` where a statement begins) or ``ref``; keywords excluded.

    ``(name, type, path, line, column, offset, length)`` and the columns named in ``carry``.  A line is tokenised once and its columns are one running sum, so long lines stay linear.
    """
    df = lexed_lines(lines, chunk_rows)
    t = F.col("code")
    words, gaps = F.regexp_extract_all(t, F.lit(IDENT), 0), F.split(t, IDENT, -1)
    rows = df.select("path", "number", "offset", "code", "start", "decl", *carry, words.alias("_w"), gaps.alias("_g")).where(F.size("_w") > 0)
    # gap and word as one step: a word stands after the steps before it and its own gap
    steps = F.zip_with(F.slice("_g", 1, F.size("_w")), "_w", lambda g, w: F.length(g) + F.length(w))
    rows = rows.withColumn("_s", starts(steps)).withColumns({
        "_def": F.when(F.col("decl"), F.length(F.regexp_extract(t, r"^([ \t]*(async[ \t]+)?(class|def)[ \t]+)", 1))),
        "_asn": F.when(F.col("start") & t.rlike(r"^[ \t]*[A-Za-z_][A-Za-z0-9_]*[ \t]*=[^=]"),
                       F.length(F.regexp_extract(t, r"^([ \t]*)[A-Za-z_][A-Za-z0-9_]*[ \t]*=[^=]", 1)))})
    rows = rows.withColumn("_z", F.arrays_zip("_w", "_s", F.slice("_g", 1, F.size("_w")).alias("_h")))
    # outer: from a plain explode Spark infers a filter on the array, below which the running sum is worked out a second time;
    # no array is empty here
    toks = rows.select("path", "number", "offset", "_def", "_asn", *carry, F.explode_outer("_z").alias("_x"))
    col = (F.col("_x._s") + F.length("_x._h")).cast("bigint")
    kind = F.when(col == F.col("_def"), F.lit("def")).when(col == F.col("_asn"), F.lit("asn")).otherwise(F.lit("ref"))
    return toks.where(~F.col("_x._w").isin(*KEYWORDS)).select(
        F.col("_x._w").alias("name"), kind.alias("type"), "path", F.col("number").alias("line"), col.alias("column"),
        (F.col("offset") + col).alias("offset"), F.length("_x._w").cast("bigint").alias("length"), *carry)


def mentions_by_symbol(m: DataFrame) -> DataFrame:
    """A-5: per name, counts of def / ref / asn mentions and the files they are in."""
    return m.groupBy("name").agg(F.count_if(F.col("type") == "def").alias("n_def"),
                                 F.count_if(F.col("type") == "ref").alias("n_ref"),
                                 F.count_if(F.col("type") == "asn").alias("n_asn"),
                                 F.count_distinct("path").alias("n_paths"))


def bindings(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(path, number, name, qualname)``: the name each import binds and what it stands for.

    ``import a.b`` binds ``a``; a relative module counts from the package the file lies in; ``*`` binds nothing.
    """
    rows = _imports(lines, chunk_rows)
    dots, rest = F.length(F.regexp_extract("module", r"^(\.*)", 1)), F.regexp_replace("module", r"^\.+", "")
    parts = F.split(module_name("path"), r"\.")
    up = F.size(parts) - dots + F.when(F.col("path").endswith("/__init__.py"), 1).otherwise(0)
    package = F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(0))), ".")
    whole = F.when(dots == 0, F.col("module")).when(package == "", rest).otherwise(F.concat(package, F.lit("."), rest))
    plain = F.col("alias").isNull() & ~F.col("listed")
    name = F.coalesce("alias", F.when(plain, F.substring_index("module", ".", 1)).otherwise(F.substring_index("module", ".", -1)))
    return rows.where(~F.col("module").endswith("*")).select(
        "path", "number", name.alias("name"), F.when(plain, F.substring_index("module", ".", 1)).otherwise(whole).alias("qualname"))


def references(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """J-5: each ``ref`` mention with the one symbol it means: ``(name, path, line, column, qualname, found)``.

    ``found`` is ``scope`` for a symbol declared in the nearest scope open at
    the mention (module level last), ``file`` for another one of the file, ``import`` for a name that an import
    of the file binds, ``global`` for a name that exactly one symbol of all files has; else null.
    Each step is an equi join against one row per key (the last declaration
    wins), so a name that very many places use never meets all its namesakes.  The lexed lines are
    written once, to the checkpoint folder, and read for declarations, imports and mentions.
    """
    df = lexed_lines(lines, chunk_rows)
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select("path", "number", "offset", "text", "code", "start", "decl", "scopes").checkpoint(eager=True)
    name = F.regexp_extract("code", DECL, 4)
    outer = F.coalesce(F.get("scopes", F.size("scopes") - 1)["line"], F.lit(-1).cast("bigint"))
    syms = df.where("decl").select("path", name.alias("name"), F.array_join(F.concat(_chain(), F.array(name)), ".").alias("qualname"),
                                   F.col("number").alias("line"), outer.alias("scope"))
    # one aggregation of the declarations, from which the wider ones follow
    base = syms.groupBy("path", "scope", "name").agg(F.max_by("qualname", "line").alias("qualname"), F.max("line").alias("_line"),
                                                     F.max("qualname").alias("_most"), F.count(F.lit(1)).alias("_n"))
    in_scope = base.select("path", "scope", "name", "qualname")
    in_file = base.groupBy("path", "name").agg(F.max_by("qualname", "_line").alias("_file"))
    bound = bindings(df, chunk_rows).groupBy("path", "name").agg(F.max_by("qualname", F.struct("number", "qualname")).alias("_import"))
    named = in_file.join(bound, ["path", "name"], "full")
    anywhere = base.groupBy("name").agg(F.max("_most").alias("_global"), F.sum("_n").alias("_n")).where("_n = 1").drop("_n")
    around = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform("scopes", lambda x: x["line"]))
    refs = mentions(df.withColumn("_open", around), chunk_rows, carry=("_open",)).where(F.col("type") == "ref")
    tries = refs.select("name", "path", "line", "column", F.posexplode("_open").alias("_depth", "scope"))
    near = tries.join(in_scope, ["path", "scope", "name"], "left").groupBy("path", "name", "line", "column").agg(
        F.max_by("qualname", F.when(F.col("qualname").isNotNull(), F.col("_depth"))).alias("_scope"))
    out = near.join(named, ["path", "name"], "left").join(anywhere, "name", "left")
    found = F.when(F.col("_scope").isNotNull(), F.lit("scope")).when(F.col("_file").isNotNull(), F.lit("file")).when(
        F.col("_import").isNotNull(), F.lit("import")).when(F.col("_global").isNotNull(), F.lit("global"))
    return out.select("name", "path", "line", "column", F.coalesce("_scope", "_file", "_import", "_global").alias("qualname"), found.alias("found"))


def defined_in(points: DataFrame, classified: DataFrame) -> DataFrame:
    """J-3: the block holding each point ``(path, line, ...)``.  W-2 blocks
    partition a file by lines, so the innermost block is the block of the
    point's line: an equi join on ``(path, number)``."""
    blk = classified.select("path", F.col("number").alias("line"), "block_no", F.col("kind").alias("block_kind"))
    return points.join(blk, ["path", "line"], "left")


def enclosing(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """J-4: ``(path, qualname, line, enclosing, enclosing_line, distance)``: the symbols whose span
    strictly contains each declaration, the nearest at distance 1, the module farthest."""
    decl = declarations(lines, chunk_rows)
    outer = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("line"), module_name("path").alias("name"))),
                     F.transform("scopes", lambda x: F.struct(x["line"].alias("line"), x["name"].alias("name"))))
    rows = decl.select("path", "qualname", "line", outer.alias("_o"), F.posexplode(outer).alias("_i", "_x"))
    name = F.array_join(F.transform(F.slice("_o", 1, F.col("_i") + 1), lambda x: x["name"]), ".")
    return rows.select("path", "qualname", "line", name.alias("enclosing"), F.col("_x.line").alias("enclosing_line"),
                       (F.size("_o") - F.col("_i")).cast("bigint").alias("distance"))


def block_scopes(blocks_df: DataFrame, lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """J-4 for blocks: each block with the innermost symbol open at its first line."""
    open_at = lexed_lines(lines, chunk_rows).select("path", F.col("number").alias("line"), F.array_join(_chain(), ".").alias("enclosing"))
    return blocks_df.join(open_at, ["path", "line"], "left")


def attach_docs(blocks_df: DataFrame, doc_kind: str = "doc", code_kind: str = "text") -> DataFrame:
    """J-6: each doc block with the block that follows it in the same file
    (``block_no + 1``, an equi join), when that block is code."""
    doc = blocks_df.where(F.col("kind") == doc_kind).select(
        "path", F.col("block_no").alias("doc_block"), F.col("meta").alias("doc_meta"),
        F.col("line").alias("doc_line"), (F.col("block_no") + 1).alias("block_no"))
    code = blocks_df.where(F.col("kind") == code_kind).select(
        "path", "block_no", F.col("line").alias("code_line"), F.col("n_lines").alias("code_lines"))
    return doc.join(code, ["path", "block_no"]).withColumnRenamed("block_no", "code_block")


def slots(syms: DataFrame) -> DataFrame:
    """A-2: ``(parent, slot, qualname, line)``, one row per name a scope holds; of several
    declarations of one name the last counts.  Module rows have no parent."""
    kids = syms.where(F.col("parent").isNotNull())
    return kids.groupBy("parent", F.col("name").alias("slot")).agg(
        F.max_by("qualname", F.struct("line", "path")).alias("qualname"), F.max("line").alias("line"))


def register_symbols(syms: DataFrame, seq: str = "line") -> DataFrame:
    """A-3: one row per qualname; a later registration (larger ``seq``) wins."""
    cols = [c for c in syms.columns if c != "qualname"]
    best = syms.groupBy("qualname").agg(F.max_by(F.struct(*cols), F.struct(F.col(seq), F.col("path"))).alias("_s"),
                                        F.count(F.lit(1)).alias("registrations"))
    return best.select("qualname", "_s.*", "registrations")


def order_by_position(rows: DataFrame, line: str = "line", column: str = "column") -> DataFrame:
    """O-1: rows in order of file, line and column (the pair, not its sum)."""
    return rows.orderBy("path", line, column)


def check_unique(nodes: DataFrame, key: str = "id") -> DataFrame:
    """A-4: ids registered more than once, with their count."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
