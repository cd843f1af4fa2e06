from pyspark.sql import functions as F

from quire.functions.export import filter_glob, to_json_rows
from quire.functions.text import (attr_quote, block_meta, clamp, expand_tokens, html_escape, inline_spans, lerp, map_literal,
                                  parse_groups, split_list, steps, strip_comment, time_tuple, unescape_pattern)
from quire.operators.marks import marks


def _one(spark, col, value="x", schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_parse_groups_call_text(spark):
    # f(A,B,C,D) -> {name: f, args: {0: A, 1: B, 2: C, 3: D}}
    items = "".join(f"(,(?P<args_{i}>[A-Z]+))?" if i else "(?P<args_0>[A-Z]+)" for i in range(4))
    r = _one(spark, parse_groups(F.col("s"), rf"(?P<name>[a-z]+)\({items}\)"), "f(A,B,C,D)")
    assert r["name"] == "f" and [r["args"][str(i)] for i in range(4)] == ["A", "B", "C", "D"]


def test_parse_groups_tells_empty_from_absent(spark):
    groups = parse_groups("s", r"(?P<key>[a-z]+)(=(?P<value>[a-z]*))?(;(?P<rest>.*))?")
    df = spark.createDataFrame([("a=b;c",), ("a=",), ("a",), ("a;",), ("1",), (None,)], "s string")
    assert [None if r[0] is None else tuple(r[0]) for r in df.select(groups).collect()] == [
        ("a", "b", "c"), ("a", "", None), ("a", None, None), ("a", None, ""), None, None]


def test_split_list_keeps_all_items(spark):
    text = ",".join(str(i) for i in range(20))
    assert len(_one(spark, split_list(F.col("s")), text)) == 20
    assert _one(spark, split_list(F.col("s"), max_items=3), text) == ["0", "1", "2"]


def test_tokens_over_rows_with_and_without(spark):
    ctx = F.create_map(F.lit("a.b"), F.lit("X"))
    df = spark.createDataFrame([("plain",), ("${a.b}!",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(expand_tokens("s", ctx)).collect()] == ["plain", "X!", "", None]


def test_globs_are_anchored(spark):
    files = spark.createDataFrame([("p/mod1.py",), ("p/xmod1.py",), ("p/my_file.py",), ("p/_my.py",), ("p/mod1.pyc",)], "path string")
    assert {r.path for r in filter_glob(files, includes=["mod1*.py"]).collect()} == {"p/mod1.py"}
    assert {r.path for r in filter_glob(files, excludes=["_*", "*.pyc"]).collect()} == {"p/mod1.py", "p/xmod1.py", "p/my_file.py"}


def test_inline_spans_nested(spark):
    # The nested example text and its reading.
    got = _one(spark, inline_spans(F.col("s")), "_term*emphasis`code`*_")
    assert [(r.level, r.kind, r.start, r.end, r.text) for r in got] == [
        (1, "term", 0, 22, "term*emphasis`code`*"), (2, "emphasis", 5, 21, "emphasis`code`"), (3, "code", 14, 20, "code")]
    got = _one(spark, inline_spans(F.col("s")), "é **s** <<q _t_>> [l)[to] [a] *open")
    assert [(r.level, r.kind, r.start, r.end, r.text) for r in got] == [
        (1, "strong", 2, 7, "s"), (1, "quote", 8, 17, "q _t_"), (2, "term", 12, 15, "t"), (1, "link", 18, 25, "l"), (1, "anchor", 26, 29, "a")]
    assert _one(spark, inline_spans(F.col("s")), "none") == []
    deep = "**a *b _c `d <<e [f]>>` c_ b* a**"
    got = _one(spark, inline_spans(F.col("s")), deep)
    assert [(x.level, x.kind) for x in got] == [(1, "strong"), (2, "emphasis"), (3, "term"), (4, "code"), (5, "quote"), (6, "anchor")]
    assert [deep[x.start:x.end] for x in got][-1] == "[f]" and got[3].text == "d <<e [f]>>"
    for text in (deep, "é **s** <<q _t_>> [l)[to] [a] *open", "_a *b* `c`_ *d _e_*", ""):
        assert _one(spark, inline_spans(F.col("s"), 6), text) == _one(spark, inline_spans(F.col("s")), text)


def test_escape_and_quote(spark):
    assert _one(spark, html_escape(F.col("s")), "<a href=\"x\">'&'</a>") == \
        "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert _one(spark, attr_quote(F.col("s")), None) == ""


def test_meta_strip_unescape(spark):
    assert _one(spark, block_meta(F.col("s")), "  # -- meta here\n") == "meta here"
    assert _one(spark, block_meta(F.col("s")), "# --\n") == ""
    assert _one(spark, strip_comment(F.col("s")), "  # # hello \n") == "hello"
    assert _one(spark, unescape_pattern(F.col("s")), r'/^a\/b \\ c$/;"') == "a/b \\ c"


def test_expand_tokens(spark):
    ctx = map_literal({"color.primary": "blue", "gap2": "8px"})
    assert _one(spark, expand_tokens(F.col("s"), ctx), "c=${color.primary};g=${gap2}") == "c=blue;g=8px"
    assert _one(spark, expand_tokens(F.col("s"), ctx, on_missing="keep"), "x ${nope} y") == "x ${nope} y"


def test_math_and_time(spark):
    assert _one(spark, clamp(F.lit(5.0), 3.0, 1.0)) == 3.0
    assert _one(spark, lerp(2.0, 4.0, 0.5)) == 3.0
    assert _one(spark, steps(4)) == [0.0, 0.25, 0.5, 0.75, 1.0]
    # 2024-01-01 is a Monday: weekday 0, day of year 1
    assert _one(spark, time_tuple(F.to_timestamp(F.lit("2024-01-01 10:20:30")))) == [2024, 1, 1, 10, 20, 30, 0, 1, -1]


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert to_json_rows(df).first()["json"] == '{"a":1,"b":null}'


def test_glob_filter(spark):
    df = spark.createDataFrame([("a/x.py",), ("a/y.txt",), ("b/_z.py",)], "path string")
    got = sorted(r.path for r in filter_glob(df, ["*.py"], ["_*"]).collect())
    assert got == ["a/x.py"]


def test_marks_reference_text(spark):
    text = "\n# --\n# Block 1\nLine 1\n\n# --\n# Block 2.1\n# Block 2.2\nLine 2\nLine 3\n"
    rules = [("block", r"^([ \t]*)#[ ]+--[ ]*\n"), ("comment", r"^([ \t]*)#.*$")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.type, r.start, r.end) for r in marks(docs, rules).orderBy("piece").collect()]
    types = [t for t, _, _ in got]
    assert types[:4] == ["#text", "block", "comment", "#text"]
    assert types[-1] == "#eos"
    # pieces tile the text exactly
    assert got[0][1] == 0 and got[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_templates_of_all_shapes(spark):
    from quire.functions.text import apply_template

    row = spark.sql("SELECT array(named_struct('a', 1, 'b', named_struct('c', 'x')), NULL) AS s, array('p', NULL, 'q') AS v, map('k2', 2, 'k1', 1) AS m, "
                    "map('z', named_struct('c', 'y')) AS ms, named_struct('a', 7) AS o, 'text' AS t, CAST(NULL AS STRING) AS n, map() AS e")
    got = row.select(apply_template("s", "{a}-{b.c}{index};").alias("s"), apply_template("v", "<{}>", ",", "values").alias("v"),
                     apply_template("m", "{index}:{key}={value}", " ", "map").alias("m"), apply_template("ms", "{key}{c}{value.c}", shape="map").alias("ms"),
                     apply_template("o", "{a}!", shape="one").alias("o"), apply_template("t", "{}{value}", shape="one").alias("t"),
                     apply_template("n", "{}", shape="one").alias("n"), apply_template("e", "{key}", shape="map").alias("e")).first()
    assert tuple(got) == ("1-x0;-1;", "<p>,<>,<q>", "0:k1=1 1:k2=2", "zyy", "7!", "texttext", "", "")
