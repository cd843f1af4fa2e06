"""Line classification and blocks (W-1 .. W-5, F-6).

Every operator takes a ``lines`` table ``(path, number, text[, offset, _chunk])``
with one row per line, ``number`` dense from 0 within ``path``, and works
through :func:`quire.plans.scan.scan`, so a single huge file is still cut
into bounded slices.

W-1 is a two-state machine run line by line (in a block run or not).  Each
line maps the state through one of four boolean functions: constant false,
constant true, identity or negation.  The state after line ``i`` is therefore
the value set by the last constant line, flipped once per negating line
after it.  Functions compose, so a slice is summed up by the one function its
lines make, plus what its first and last line say to their neighbours: all
steps run inside the slices, one small row per slice settles the states, and
one join hands each slice the state it begins in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import CHUNK, CHUNK_ROWS, chunk_by_position, key_name, scan, slice_windows, with_key

# Fixed patterns of the block syntax (values that must equal the reference's).
# A block marker opens with '#', one optional blank and two or more dashes;
# a comment line is any line whose first non-blank character is '#'.
MARKER = r"^[ \t]*#[ \t]?--"
MARKER_META = r"^[ \t]*#[ \t]?-{2,}[ \t]*([^\n]*)"
COMMENT = r"^[ \t]*#"
INDENT = r"^([ \t]*)"

# W-4: the strict marker, exactly two dashes and nothing after them.
STRICT_MARKER = r"^[ \t]*#[ \t]?--\n?$"
# W-3: a typed-block marker allows any blanks between '#' and the dashes.
TYPED_MARKER = r"^[ \t]*#\s*--"
TYPED_META = r"^[ \t]*#\s*-{2,}([^\n]*)"

#: Kind of a documentation block.
DOC = "doc"

KEYS = ["path"]
ORDER = ["number"]


def _chunked(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return lines if CHUNK in lines.columns else chunk_by_position(lines, "number", chunk_rows)


def _with_offset(lines: DataFrame) -> DataFrame:
    if "offset" in lines.columns:
        return lines
    return scan(lines, KEYS, ORDER, sums={"offset": (F.length("text").cast("bigint"), False)})


def classify_lines(lines: DataFrame, chunk_rows: int = CHUNK_ROWS, *, marker: str = MARKER,
                   marker_meta: str = MARKER_META) -> DataFrame:
    """W-1: adds ``kind`` ('doc' | 'text'), ``meta`` and ``block_no``.

    A marker opens a run; following comment lines with the same indent
    continue it; the first line that breaks the run is text even if it is a
    marker itself.  ``meta`` is the text after the marker on the line that
    opened the run, ``block_no`` the 0-based block of W-2.
    """
    part, rows, slices = slice_windows(KEYS, ORDER)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, c, m = F.col("text"), F.col("_c"), F.col("_m")
    df = with_key(_chunked(lines, chunk_rows), KEYS).withColumns({
        "_c": text.rlike(COMMENT), "_s": F.regexp_extract(text, INDENT, 1), "_m": text.rlike(marker)})

    # Inside a slice, after its first row: the state is `_val`, flipped if the first row left
    # `true` and no constant line has come since (`_fixed`).
    df = df.withColumns({"_i": F.row_number().over(rows), "_pc": F.lag("_c").over(rows), "_ps": F.lag("_s").over(rows)})
    later = F.col("_i") > 1
    neg, const, value = _line_function(c, m, c & F.col("_pc") & (F.col("_s") == F.col("_ps")))
    df = df.withColumns({"_neg": later & neg, "_const": later & const, "_cv": value})
    df = df.withColumn("_odd", F.sum(F.col("_neg").cast("int")).over(upto) % 2 == 1)
    df = df.withColumn("_lc", F.last(F.when(F.col("_const"), F.col("_cv") != F.col("_odd")), ignorenulls=True).over(upto))
    df = df.withColumns({"_fixed": F.col("_lc").isNotNull(), "_val": F.coalesce("_lc", F.lit(False)) != F.col("_odd")})
    before = F.lag(F.struct("_fixed", "_val")).over(rows)
    df = df.withColumn("_before", before)
    df = df.withColumns({f"_st{h}": later & (_state(F.col("_fixed"), F.col("_val"), h)
                                             != _state(F.col("_before._fixed"), F.col("_before._val"), h)) for h in (0, 1)})
    df = df.withColumns({f"_b{h}": F.sum(F.col(f"_st{h}").cast("bigint")).over(upto) for h in (0, 1)}
                        | {"_off": F.sum(F.length("text").cast("bigint")).over(upto)})

    # One row per slice: its function is that of its first row followed by that of the rest.
    ends = df.groupBy(*part).agg(F.min_by(F.struct("_c", "_s", "_m"), "number").alias("f"),
                                 F.max_by(F.struct("_c", "_s", "_fixed", "_val", "_b0", "_b1", "_off"), "number").alias("l"))
    ends = ends.withColumn("p", F.lag("l").over(slices))
    adjacent = F.col("f._c") & F.coalesce(F.col("p._c") & (F.col("f._s") == F.col("p._s")), F.lit(False))
    neg, const, value = _line_function(F.col("f._c"), F.col("f._m"), adjacent)
    ends = ends.withColumns({"neg": neg, "const": const, "value": value})
    ends = ends.withColumns({
        "all_const": F.col("l._fixed") | F.col("const"),
        "all_value": F.when(F.col("l._fixed"), F.col("l._val")).otherwise(F.col("value") != F.col("l._val"))})
    ends = ends.withColumn("all_neg", ~F.col("all_const") & (F.col("neg") != F.col("l._val")))
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("odd", F.sum(F.col("all_neg").cast("int")).over(whole) % 2 == 1)
    ends = ends.withColumn("lc", F.last(F.when(F.col("all_const"), F.col("all_value") != F.col("odd")), ignorenulls=True).over(whole))
    ends = ends.withColumn("entry", F.coalesce(F.lag(F.coalesce("lc", F.lit(False)) != F.col("odd")).over(slices), F.lit(False)))
    ends = ends.withColumn("_h", F.when(F.col("const"), F.col("value")).otherwise(F.col("entry") != F.col("neg")))
    ends = ends.withColumn("_hs", F.col("p").isNull() | (F.col("_h") != F.col("entry")))
    starts = F.col("_hs").cast("bigint") + F.when(F.col("_h"), F.col("l._b1")).otherwise(F.col("l._b0"))
    ends = ends.select(*part, "_h", "_hs", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("_eb"),
                       F.coalesce(F.sum("l._off").over(earlier), F.lit(0)).alias("_eo"))

    df = df.join(ends, part, "left")
    h = F.col("_h")
    run = F.when(later, F.col("_val") != (h & ~F.col("_fixed"))).otherwise(h)
    start = F.when(later, F.when(h, F.col("_st1")).otherwise(F.col("_st0"))).otherwise(F.col("_hs"))
    block = F.col("_eb") + F.col("_hs").cast("bigint") + F.when(h, F.col("_b1")).otherwise(F.col("_b0")) - 1
    offset = [] if "offset" in lines.columns else [(F.col("_eo") + F.col("_off") - F.length("text")).alias("offset")]
    return df.select(*_kept(df, lines), *offset, F.when(run, F.lit(DOC)).otherwise(F.lit("text")).alias("kind"),
                     F.when(run & start, F.regexp_extract(text, marker_meta, 1)).alias("meta"), block.alias("block_no"))


def _line_function(c: Column, m: Column, adjacent: Column) -> tuple[Column, Column, Column]:
    """``(negates, constant, its value)`` of a line; neither: the state stays."""
    return c & ~adjacent & m, ~c | (~adjacent & ~m) | (adjacent & m), adjacent & m


def _state(fixed: Column, value: Column, h: int) -> Column:
    return value != ~fixed if h else value


def _kept(df: DataFrame, lines: DataFrame) -> list[str]:
    """Input columns with the helpers (chunk, key) that later passes reuse."""
    return [n for n in df.columns if n in lines.columns or n in (CHUNK, key_name(KEYS))]


def _carried(df: DataFrame, lines: DataFrame, first: list[str], last: list[str], settle) -> DataFrame:
    """Join each slice's carry to its rows.

    The summary holds the columns ``first`` of a slice's first row (``f``) and
    ``last`` of its last row (``l``); ``settle(summary, slices)`` turns it into
    the carry columns.
    """
    part, _, slices = slice_windows(KEYS, ORDER)
    ends = df.groupBy(*part).agg(F.min_by(F.struct(*first), "number").alias("f"), F.max_by(F.struct(*last), "number").alias("l"))
    ends = ends.withColumn("p", F.lag("l").over(slices))
    return df.join(settle(ends, slices, slices.rowsBetween(Window.unboundedPreceding, -1)), part, "left")


def runs(lines: DataFrame, kind: Column | str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Gaps and islands: ``block_no`` = 0-based run of equal ``kind`` within the file."""
    part, rows, _ = slice_windows(KEYS, ORDER)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = with_key(_chunked(lines, chunk_rows), KEYS).withColumn("kind", F.col(kind) if isinstance(kind, str) else kind)
    df = df.withColumns({"_i": F.row_number().over(rows), "_pk": F.lag("kind").over(rows)})
    df = df.withColumn("_b", F.sum(((F.col("_i") > 1) & ~F.col("kind").eqNullSafe(F.col("_pk"))).cast("bigint")).over(upto))

    def settle(ends, slices, earlier):
        ends = ends.withColumn("_hs", (F.col("p").isNull() | ~F.col("f.kind").eqNullSafe(F.col("p.kind"))).cast("bigint"))
        return ends.select(*part, (F.coalesce(F.sum(F.col("_hs") + F.col("l._b")).over(earlier), F.lit(0)) + F.col("_hs")).alias("_eb"))

    df = _carried(df, lines, ["kind"], ["kind", "_b"], settle)
    names = [n for n in _kept(df, lines) if n != "kind"]
    return df.select(*names, "kind", (F.col("_eb") + F.col("_b") - 1).alias("block_no"))


def blocks(classified: DataFrame) -> DataFrame:
    """W-2: one row per block -- first offset, total length, first line, kind, meta.

    ``groupBy(path, block_no)`` with a map-side partial aggregate; a block
    spanning slices is merged by the final aggregate, never collected.
    """
    df = _with_offset(classified)
    return df.groupBy("path", "block_no").agg(
        F.min("kind").alias("kind"),
        F.max("meta").alias("meta"),
        F.min("offset").alias("offset"),
        F.sum(F.length("text")).cast("bigint").alias("length"),
        F.min("number").alias("line"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def strict_blocks(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-4: W-1 with the strict marker; the breaking line and the text after
    it share one block (W-2 merges them).  Meta is always empty."""
    return blocks(classify_lines(lines, chunk_rows, marker=STRICT_MARKER, marker_meta="^()"))


def typed_lines(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-3: ``kind`` in text / comment / code, ``meta``, ``block_no`` and ``starts`` (opens a block) per line.

    A marker always opens a text block; a comment line continues a text or
    comment block, else opens a comment block; any other line is code.  So a
    comment line is text iff the last marker-or-code line at or before it is
    a marker -- one "last non-null" -- and blocks start at markers and where
    the comment/code class changes.
    """
    part, rows, _ = slice_windows(KEYS, ORDER)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, c, m = F.col("text"), F.col("_c"), F.col("_m")
    df = with_key(_chunked(lines, chunk_rows), KEYS).withColumns({"_m": text.rlike(TYPED_MARKER), "_c": text.rlike(COMMENT)})
    df = df.withColumns({"_i": F.row_number().over(rows), "_pc": F.lag("_c").over(rows),
                         "_lm": F.last(F.when(m | ~c, m), ignorenulls=True).over(upto)})
    df = df.withColumn("_st", (F.col("_i") > 1) & (m | (c != F.col("_pc"))))
    df = df.withColumns({"_b": F.sum(F.col("_st").cast("bigint")).over(upto), "_off": F.sum(F.length("text").cast("bigint")).over(upto)})

    def settle(ends, slices, earlier):
        ends = ends.withColumn("_hs", F.col("p").isNull() | F.col("f._m") | (F.col("f._c") != F.col("p._c")))
        return ends.select(*part, "_hs", F.last("l._lm", ignorenulls=True).over(earlier).alias("_em"),
                           F.coalesce(F.sum(F.col("_hs").cast("bigint") + F.col("l._b")).over(earlier), F.lit(0)).alias("_eb"),
                           F.coalesce(F.sum("l._off").over(earlier), F.lit(0)).alias("_eo"))

    df = _carried(df, lines, ["_c", "_m"], ["_c", "_lm", "_b", "_off"], settle)
    kind = (F.when(~c, F.lit("code")).when(F.coalesce("_lm", "_em", F.lit(False)), F.lit("text")).otherwise(F.lit("comment")))
    offset = [] if "offset" in lines.columns else [(F.col("_eo") + F.col("_off") - F.length("text")).alias("offset")]
    meta = F.when(m, F.regexp_replace(F.regexp_extract(text, TYPED_META, 1), r"^\s+|\s+$", ""))
    return df.select(*_kept(df, lines), *offset, kind.alias("kind"), meta.alias("meta"),
                     (F.col("_eb") + F.col("_hs").cast("bigint") + F.col("_b") - 1).alias("block_no"),
                     F.when(F.col("_i") > 1, F.col("_st")).otherwise(F.col("_hs")).alias("starts"))


def typed_blocks(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-3 blocks: kind, meta, start and end offsets, first line, line count."""
    return typed_lines(lines, chunk_rows).groupBy("path", "block_no").agg(
        F.min("kind").alias("kind"),
        F.max("meta").alias("meta"),
        F.min("offset").alias("start"),
        (F.min("offset") + F.sum(F.length("text"))).cast("bigint").alias("end"),
        F.min("number").alias("line"),
        F.count(F.lit(1)).alias("n_lines"),
    )


# W-5 prose rules, first match wins, in this order (fixed values of the note
# syntax).  Line rules make a one-line block; list rules make a block of one
# item; a fence opens a code block that runs to the next fence line.
PROSE_LINE_RULES = [
    ("Title", r"^==+"),
    ("Heading", r"^#+"),
    ("Meta", r"^--"),
    ("Comment", r"^# --"),
]
PROSE_FENCE = r"^```(\s.+)*$"
PROSE_LIST_RULES = [
    ("TodoList", r"^[ \t]*-[ ]*\[[ xX]\][ ]*"),
    ("OrderedList", r"^[ \t]*[0-9a-zA-Z][).][ ]*"),
    ("UnorderedList", r"^[ \t]*[-*][ ]*"),
]
BLANK = r"^[ \t]*$"


def prose_rule(text: Column) -> Column:
    """Name of the first line or list rule that matches, null for plain text."""
    rule = None
    for name, rx in PROSE_LINE_RULES + PROSE_LIST_RULES:
        rule = F.when(text.rlike(rx), F.lit(name)) if rule is None else rule.when(text.rlike(rx), F.lit(name))
    return rule


def prose_lines(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-5: ``kind`` and ``block_no`` per line of a note.

    Code state is the parity of the running count of fence lines (a fence
    opens when the count becomes odd and the next one closes); outside code,
    the first rule in order wins and makes a block of its own; remaining
    lines merge into text blocks.  Blank lines do not split text.
    """
    part, rows, _ = slice_windows(KEYS, ORDER)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.col("text")
    df = with_key(_chunked(lines, chunk_rows), KEYS).withColumns({"_f": text.rlike(PROSE_FENCE), "_r": prose_rule(text)})
    df = df.withColumns({"_i": F.row_number().over(rows), "_k": F.sum(F.col("_f").cast("bigint")).over(upto),
                         "_pf": F.lag("_f").over(rows), "_pr": F.lag("_r").over(rows)})

    def starts(f, r, k, pf, pr, odd: int | Column):
        """Whether a line opens a block when ``odd`` fences stand before the slice."""
        open_now, open_before = (k + odd) % 2 == 1, (k - f.cast("bigint") + odd) % 2 == 1
        in_code = open_now | f
        prev_text = ~(open_before | pf) & pr.isNull()
        return (f & open_now) | (~in_code & (r.isNotNull() | ~prev_text))

    f, r, k = F.col("_f"), F.col("_r"), F.col("_k")
    for odd in (0, 1):
        opens = (F.col("_i") > 1) & starts(f, r, k, F.coalesce("_pf", F.lit(False)), F.col("_pr"), odd)
        df = df.withColumn(f"_b{odd}", F.sum(opens.cast("bigint")).over(upto))
    df = df.withColumn("_off", F.sum(F.length("text").cast("bigint")).over(upto))

    def settle(ends, slices, earlier):
        ends = ends.withColumn("_odd", F.coalesce(F.sum("l._k").over(earlier), F.lit(0)) % 2)
        fresh = starts(F.col("f._f"), F.col("f._r"), F.col("f._f").cast("bigint"), F.coalesce("p._f", F.lit(False)), F.col("p._r"), F.col("_odd"))
        ends = ends.withColumn("_hs", (F.col("p").isNull() | fresh).cast("bigint"))
        inside = F.when(F.col("_odd") == 1, F.col("l._b1")).otherwise(F.col("l._b0"))
        return ends.select(*part, "_odd", (F.coalesce(F.sum(F.col("_hs") + inside).over(earlier), F.lit(0)) + F.col("_hs")).alias("_eb"),
                           F.coalesce(F.sum("l._off").over(earlier), F.lit(0)).alias("_eo"))

    df = _carried(df, lines, ["_f", "_r"], ["_f", "_r", "_k", "_b0", "_b1", "_off"], settle)
    in_code = ((k + F.col("_odd")) % 2 == 1) | f
    kind = F.when(in_code, F.lit("Code")).when(r.isNotNull(), r).otherwise(F.lit("Text"))
    offset = [] if "offset" in lines.columns else [(F.col("_eo") + F.col("_off") - F.length("text")).alias("offset")]
    block = F.col("_eb") + F.when(F.col("_odd") == 1, F.col("_b1")).otherwise(F.col("_b0")) - 1
    return df.select(*_kept(df, lines), *offset, kind.alias("kind"), block.alias("block_no"))


def prose_blocks(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return prose_lines(lines, chunk_rows).groupBy("path", "block_no").agg(
        F.min("kind").alias("kind"),
        F.min("number").alias("line"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def trim_blank_lines(lines: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """F-6: drop leading and trailing blank lines of each file (or block).

    First and last non-blank line per key come from a partial aggregate (one
    row per key) joined back on the key; AQE splits a hot key on the big side.
    """
    nonblank = ~F.col("text").rlike(BLANK)
    bounds = lines.where(nonblank).groupBy(*by).agg(F.min("number").alias("_lo"), F.max("number").alias("_hi"))
    return lines.join(bounds, list(by), "inner").where(F.col("number").between(F.col("_lo"), F.col("_hi"))).drop(
        "_lo", "_hi")
