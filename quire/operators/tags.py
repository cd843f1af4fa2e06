"""Tag files, fragments and kinds (S-3, J-1, J-2, J-7, A-1).

A tag line is ``symbol TAB path TAB address TAB kind [TAB extras]``; the
address is ``/^line text$/;"`` (a whole line) or a plain search text.
Locating tags is a join against the ``lines`` table -- each file is read
once, never once per tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract, unescape
from ..plans.scan import number_rows

# Tag kind codes and names (fixed values of the tag format).
TAG_KINDS = [
    ("I", "ImportedInternal"),
    ("Y", "ImportedExternal"),
    ("C", "Const"),
    ("c", "Class"),
    ("f", "Function"),
    ("i", "Module"),
    ("m", "Member"),
    ("v", "Variable"),
    ("t", "Type"),
]

# Symbol kind codes and names (fixed values, those of docset indexes).
SYMBOL_KINDS = [
    ("Ann", "Annotation"),
    ("Atr", "Attribute"),
    ("Bnd", "Binding"),
    ("Blt", "Builtin"),
    ("Cal", "Callback"),
    ("Cat", "Category"),
    ("Cls", "Class"),
    ("Cmd", "Command"),
    ("Cmp", "Component"),
    ("Cst", "Constant"),
    ("Ctor", "Constructor"),
    ("Del", "Delegate"),
    ("Dir", "Directive"),
    ("Ele", "Element"),
    ("Enm", "Enum"),
    ("Env", "Environment"),
    ("Err", "Error"),
    ("Evt", "Event"),
    ("Exc", "Exception"),
    ("Ext", "Extension"),
    ("Fld", "Field"),
    ("File", "File"),
    ("Flt", "Filter"),
    ("Frm", "Framework"),
    ("Fun", "Function"),
    ("Glb", "Global"),
    ("Hck", "Hook"),
    ("Ins", "Instance"),
    ("Int", "Interface"),
    ("Kwd", "Keyword"),
    ("Lib", "Library"),
    ("Ltl", "Literal"),
    ("Mcr", "Macro"),
    ("Mtd", "Method"),
    ("Mxn", "Mixin"),
    ("Mod", "Modifier"),
    ("Mdl", "Module"),
    ("Nsp", "Namespace"),
    ("Obj", "Object"),
    ("Opr", "Operator"),
    ("Opt", "Option"),
    ("Pkg", "Package"),
    ("Prm", "Parameter"),
    ("Pgn", "Plugin"),
    ("Prc", "Procedure"),
    ("Prp", "Property"),
    ("Ptl", "Protocol"),
    ("Prv", "Provider"),
    ("Qry", "Query"),
    ("Rcd", "Record"),
    ("Rsc", "Resource"),
    ("Sec", "Section"),
    ("Svc", "Service"),
    ("Stg", "Setting"),
    ("Sct", "Shortcut"),
    ("Stm", "Statement"),
    ("Str", "Struct"),
    ("Sty", "Style"),
    ("Sub", "Subroutine"),
    ("Tag", "Tag"),
    ("Tst", "Test"),
    ("Trt", "Trait"),
    ("Typ", "Type"),
    ("Unn", "Union"),
    ("Val", "Value"),
    ("Var", "Variable"),
]

_LINE = r'^([^\t]*)\t([^\t]*)\t(.*?;")\t([^\t\n]*)(\t(.*))?$'
_PLAIN = r"^([^\t]*)\t([^\t]*)\t(.*)\t([^\t\n]*)$"

# Longest gram a pattern is looked up by.
LONGEST_GRAM = 32
#: Words of the filter that texts test their grams with, counters of the sketch of how common grams are.
FILTER_WORDS, SKETCH = 1 << 11, 1 << 14


def kind_lookup(df: DataFrame, code: str = "kind_code", kinds: list[tuple[str, str]] = TAG_KINDS) -> DataFrame:
    """J-7: code -> kind name, null when unknown (broadcast of a fixed table, 9 or 66 rows)."""
    names = df.sparkSession.createDataFrame(kinds, f"`{code}` string, kind string")
    return df.join(F.broadcast(names), code, "left")


def read_tags(raw: DataFrame, value: str = "value") -> DataFrame:
    """S-3 / F-5: tag lines to ``(symbol, path, pattern, kind_code, extras, kind)``.

    Header lines (``!``) are dropped.  The address runs to its ``;"``; the
    field after it is the kind code and later ``k:v`` fields go to ``extras``
    (of a repeated key the last counts).  Lines without ``;"`` split the address
    at their last tab; lines of neither form are not tags and are dropped.
    """
    v = F.regexp_replace(F.col(value), r"\n$", "")
    rows = raw.select(v.alias("_v")).where(~F.col("_v").startswith("!"))
    rows = rows.where(F.col("_v").rlike(_LINE) | F.col("_v").rlike(_PLAIN))
    full = F.col("_v").rlike(_LINE)

    def field(i: int):
        return F.when(full, F.regexp_extract("_v", _LINE, i)).otherwise(F.regexp_extract("_v", _PLAIN, i))

    pairs = F.transform(F.split(F.regexp_extract("_v", _LINE, 6), "\t"), lambda kv: F.struct(
        F.regexp_extract(kv, "^([^:]*)", 1).alias("k"), F.regexp_extract(kv, "^[^:]*:?(.*)$", 1).alias("v")))
    last_of_key = F.filter(pairs, lambda kv, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == kv["k"]))
    extras = F.when(full & (F.regexp_extract("_v", _LINE, 6) != ""), F.map_from_entries(last_of_key))
    out = rows.select(field(1).alias("symbol"), field(2).alias("path"), field(3).alias("pattern"),
                      field(4).alias("kind_code"), extras.alias("extras"))
    return kind_lookup(out)


def find_fragments(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """J-1: one row per (tag, hit); tags without a hit keep one row with nulls.

    ``/^text$/;"`` addresses hit lines equal to ``text`` (column 0): an equi
    join on ``(path, text)``.  Other addresses hit the first occurrence of the
    literal in each line of the tag's file, looked up by grams within the file
    (:func:`find_substrings`).  ``lines`` needs ``offset`` (see ``scan_lines``).
    """
    # a tag is identified by its own fields (duplicate tag lines keep their count)
    t = tags.groupBy("symbol", "kind", "kind_code", "path", "pattern").agg(F.count(F.lit(1)).alias("_copies"))
    t = t.withColumn("_p", unescape(F.col("pattern")))
    exact = F.col("_p").startswith("/^") & F.col("_p").endswith('$/;"')
    t = t.withColumn("_exact", exact).withColumn(
        "_pat", F.when(exact, F.expr("substring(_p, 3, length(_p) - 6)")).otherwise(F.col("_p")))
    ln = lines.select("path", "number", "offset", F.regexp_replace("text", "\n+$", "").alias("_body"), "text")
    tk = ["path", "pattern"]

    pt = t.select("path", "pattern", "_pat", "_exact").distinct().alias("t")
    ln = ln.alias("l")
    ex = pt.where("t._exact").join(ln, (F.col("t.path") == F.col("l.path")) & (F.col("t._pat") == F.col("l._body")))
    ex = ex.select(F.col("t.path").alias("path"), F.col("t.pattern").alias("pattern"),
                   F.col("l.offset").alias("offset"), F.length("t._pat").cast("bigint").alias("length"),
                   F.col("l.number").alias("line"), F.lit(0).cast("bigint").alias("column"))
    plain = pt.where(~F.col("t._exact")).select("path", "pattern", "_pat")
    texts = lines.select(F.struct("path", "number", "offset").alias("at"), "text", "path")
    sub = find_substrings(texts, plain, path="at", content="text", pattern="_pat", pid="pattern", within="path")
    sub = sub.select(F.col("path.path").alias("path"), F.col("pattern_id").alias("pattern"),
                     (F.col("path.offset") + F.col("offset")).alias("offset"), "length", F.col("path.number").alias("line"),
                     F.col("offset").alias("column"))
    hits = ex.unionByName(sub)
    out = t.join(hits, tk, "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("symbol", "kind", "path", "pattern", "offset", "length", "line", "column",
                      F.col("_pat").alias("text"))


def fragments_by_tag(frags: DataFrame) -> DataFrame:
    """J-1 grouped form: one row per tag with its sorted fragment list."""
    frag = F.struct("offset", "length", "line", "column")
    return frags.groupBy("symbol", "kind", "path", "pattern").agg(
        F.array_sort(F.collect_list(F.when(F.col("offset").isNotNull(), frag))).alias("fragments"))


def _bit(*parts: Column) -> tuple[Column, Column]:
    """Word and mask of a hash in a filter of ``FILTER_WORDS`` words of 64 bits."""
    h = F.xxhash64(*parts)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))


def _grams(text: Column, size: Column) -> Column:
    """The whole grams of ``size`` characters at its multiples."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{"), size.cast("string"), F.lit("}")), F.lit(0))


def find_substrings(files: DataFrame, patterns: DataFrame, *, path: str = "path", content: str = "content",
                    pattern: str = "pattern", pid: str = "pattern_id", within: str | None = None, sample: float | None = None, prefilter: bool = False) -> DataFrame:
    """J-1 without paths: ``(path, pattern_id, line, column, offset, length)``, the first place of
    each pattern in each text, also where it spans lines.

    A pattern of length L is looked up by grams of ``g`` characters, the largest
    power of two with ``2g - 1 <= L`` (at most 32).  Texts list their grams at
    multiples of ``g`` only; wherever a pattern lies, for some ``r < g`` all its grams at ``r``, ``r + g``, ... fall on
    such places.  For each ``r`` the pattern is listed under one of them: the first, or with ``sample`` the one that is
    rarest in a sketch of ``SKETCH`` counters over that share of the texts, which pays where patterns of few
    characters begin alike (any choice gives the same rows).  The grams meet in an equi join, and the
    whole pattern is compared there.  With ``prefilter`` texts first drop the grams that are not in a filter of what
    patterns are listed under: one row of ``FILTER_WORDS`` words of 64 bits, 16 KB, broadcast.  That pays where the
    patterns are too many to broadcast, so that the texts' grams would be shuffled.

    Patterns of one or two characters are looked up whole; a text lists its different characters or pairs only.

    Empty patterns and null texts match nothing; repeated patterns count once.  Rows with one path and one text are one
    text, and rows that share a path only are texts of their own, each with its places.
    ``within`` names a column of both inputs that must be equal, too.
    """
    same = F.lit(0) if within is None else F.col(within)
    pats = patterns.select(F.col(pid).alias("pattern_id"), F.col(pattern).alias("_pat"), same.alias("_w")).where(F.length("_pat") > 0).distinct()
    gram = F.pow(F.lit(2), F.floor(F.log2((F.length("_pat") + 1) / 2))).cast("int")
    # negative: a short pattern, looked up whole among the different pieces of its length
    pats = pats.withColumn("_g", F.when(F.length("_pat") <= 2, -F.length("_pat")).otherwise(F.least(F.lit(LONGEST_GRAM), gram)))
    texts = files.select(F.col(path).alias("path"), F.col(content).alias("_text"), same.alias("_w")).where("_text is not null")
    texts = texts.withColumn("_t", F.xxhash64("_text"))
    sizes = pats.agg(F.collect_set("_g").alias("_sizes"))       # one row, at most eight numbers
    places = F.when(F.col("_g") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("_pat") - F.col("_g")))
    listed = pats.withColumn("_at", F.explode(places)).withColumn("_gram", F.expr("substring(_pat, _at + 1, abs(_g))"))
    if sample is None:
        listed = listed.withColumn("_n", F.lit(0))
    else:
        bucket = F.pmod(F.xxhash64("_g", "_gram"), F.lit(SKETCH))
        some = texts.sample(sample, seed=1).crossJoin(F.broadcast(sizes)).select("_text", F.explode("_sizes").alias("_g")).where("_g > 0")
        seen = some.select("_g", F.explode(_grams(F.col("_text"), F.col("_g"))).alias("_gram")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        seen = seen.agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("_seen"))
        listed = listed.crossJoin(F.broadcast(seen)).withColumn("_n", F.coalesce(F.try_element_at("_seen", bucket), F.lit(0)))
    asked = listed.groupBy("pattern_id", "_pat", "_w", "_g", F.when(F.col("_g") > 0, F.expr("_at % _g")).otherwise(0).alias("_r")).agg(
        F.min_by(F.struct("_at", "_gram"), F.struct("_n", "_at")).alias("_x")).select("pattern_id", "_pat", "_w", "_g", "_x.*")
    spread = texts.crossJoin(F.broadcast(sizes)).withColumn("_g", F.explode("_sizes"))
    letters = F.filter(F.array_distinct(F.split("_text", "")), lambda x: x != "")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - 1, F.lit(1))), lambda i: F.substring("_text", i, F.lit(2))))
    pieces = F.when(F.col("_g") > 0, _grams(F.col("_text"), F.abs("_g"))).when(F.col("_g") == -1, letters).otherwise(pairs)
    if prefilter:
        word, mask = _bit(F.col("_g"), F.col("_gram"))
        bits = asked.groupBy(word.alias("w")).agg(F.bit_or(mask).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("_b"))
        bits = bits.select(F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda w: F.coalesce(
            F.try_element_at("_b", w), F.lit(0).cast("bigint"))).alias("_bits"))

        def wanted(p: Column) -> Column:
            word, mask = _bit(F.col("_g"), p["x"])
            return F.get("_bits", word).bitwiseAND(mask) != 0

        numbered = F.transform(pieces, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        spread = spread.crossJoin(F.broadcast(bits)).select("path", "_t", "_w", "_g", F.explode(F.filter(numbered, wanted)).alias("_p"))
        grams = spread.select("path", "_t", "_w", "_g", F.col("_p.i").alias("_i"), F.col("_p.x").alias("_gram"))
    else:
        grams = spread.select("path", "_t", "_w", "_g", F.posexplode(pieces).alias("_i", "_gram"))
    place = F.when(F.col("_g") > 0, F.col("_i") * F.col("_g") - F.col("_at")).otherwise(F.lit(0))
    near = grams.join(asked, ["_w", "_g", "_gram"]).select("path", "_t", "pattern_id", "_pat", "_g", place.alias("_from"))
    near = near.where("_from >= 0").distinct()
    same_text = F.col("n.path").eqNullSafe(F.col("o.path")) & (F.col("n._t") == F.col("o._t"))
    found = near.alias("n").join(texts.select("path", "_t", "_text").alias("o"), same_text).select("n.*", "o._text")
    at = F.when(F.col("_g") < 0, F.expr("locate(_pat, _text) - 1")).when(F.expr("substring(_text, _from + 1, length(_pat)) = _pat"), F.col("_from"))
    head = F.expr("left(_text, _at)")
    place = F.struct(F.col("_at").cast("bigint").alias("offset"),
                     (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("bigint").alias("line"),
                     F.length(F.substring_index(head, "\n", -1)).cast("bigint").alias("column"))
    first = found.withColumn("_at", at).where("_at >= 0").groupBy("path", "_t", "pattern_id", "_pat").agg(F.min(place).alias("x"))
    return first.select("path", "pattern_id", "x.line", "x.column", "x.offset", F.length("_pat").cast("bigint").alias("length"))


def fragment_lines(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """J-2 as rows: each fragment ``(path, line, n_lines, offset, length, ...)`` once per line it covers, with ``number`` and
    ``piece``, what of the line lies in it (null if the file has no such line); in order of ``number`` the pieces are its text.

    An equi join on ``(path, number)`` with the ``lines`` table: no file is read whole and no text gathered.
    """
    cover = fragments.withColumn("number", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n_lines") - 1)))
    ln = lines.select("path", "number", F.col("offset").alias("_lo"), F.col("text").alias("_t"))
    lo = F.greatest(F.col("offset") - F.col("_lo"), F.lit(0))
    hi = F.least(F.col("offset") + F.col("length") - F.col("_lo"), F.length("_t"))
    return cover.join(ln, ["path", "number"], "left").select(*[F.col(c) for c in fragments.columns], "number", extract(F.col("_t"), lo, hi - lo).alias("piece"))


def read_fragments(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """J-2: the text of each fragment ``(path, line, n_lines, offset, length)``.

    The pieces of :func:`fragment_lines` joined in line order, so a value is as large as its fragment.  Fragments are grouped by
    all their columns, which must be comparable; equal ones come out as often as they went in.  A fragment whose file
    is missing keeps its own ``text`` (when given).
    """
    own = fragments.columns
    piece = F.when(F.col("piece").isNotNull(), F.struct("number", "piece"))
    texts = fragment_lines(fragments, lines).groupBy(*own).agg(
        F.collect_set(piece).alias("_p"), (F.count(F.lit(1)) / F.count_distinct("number")).cast("int").alias("_copies"))
    read = F.when(F.size("_p") > 0, F.array_join(F.transform(F.array_sort("_p"), lambda x: x["piece"]), ""))
    keep = read if "text" not in own else F.coalesce(read, F.col("text"))
    return texts.withColumn("_c", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*own, keep.alias("fragment_text"))


def tags_by_kind(tags: DataFrame) -> DataFrame:
    """A-1: tags grouped by kind -- count, distinct symbols, first and last
    symbol.  The groups are labels; their members stay rows (a kind holds an
    unbounded number of tags, so it is not collected into one value)."""
    return tags.groupBy("kind").agg(F.count(F.lit(1)).alias("n_tags"),
                                    F.count_distinct("symbol").alias("n_symbols"),
                                    F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol"))


def kind_members(tags: DataFrame, order: tuple[str, ...] = ("symbol", "path", "pattern")) -> DataFrame:
    """A-1: every tag with its place (from 0) within its kind, by ``order``; tags of no known kind are one group.

    Numbered in range slices, so a kind that holds most of the tags is cut like any other sequence.
    """
    own = ["symbol", "path", "pattern", "kind"]
    return number_rows(tags.select(*own), ["kind"], list(order), out="place").select("kind", "place", "symbol", "path", "pattern")
