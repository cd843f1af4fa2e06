import json

from pyspark.sql import functions as F

from quire.functions.export import to_json_rows
from quire.operators.marks import marks, pair_marks
from quire.operators.symbols import (block_scopes, docstrings, enclosing, fields, imports, mentions, order_by_position, references, slots,
                                     submodules, symbols)
from quire.operators.tags import find_fragments, find_substrings, kind_lookup, read_tags, SYMBOL_KINDS
from quire.operators.trees import (ancestors, ancestors_by_parent, catalogue, detach, leaf_flags, nest_tree, outline_numbered, siblings, siblings_of, subtree,
                                   tree_filter, walk, walk_by_parent)
from quire.sources.lines import scan_lines, with_offsets

PATHS = ["garden/tools/rake.md", "garden/tools/spade.md", "garden/beds/north/roses.md", "garden/plan.md", "alone.md"]


def nodes_of(spark, paths=PATHS):
    return catalogue(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_catalogue_walk_and_subtree(spark):
    nodes = nodes_of(spark)
    ids = {r.id: r for r in nodes.collect()}
    assert set(ids) == {*PATHS, "garden", "garden/tools", "garden/beds", "garden/beds/north"}
    assert ids["garden"].parent is None and ids["garden/beds/north"].parent == "garden/beds"
    order = [r.id for r in walk(nodes).where("root = 'garden'").orderBy("preorder").collect()]
    assert order == ["garden", "garden/beds", "garden/beds/north", "garden/beds/north/roses.md", "garden/plan.md", "garden/tools",
                     "garden/tools/rake.md", "garden/tools/spade.md"]
    tops = nodes.where("id = 'garden/beds'")
    assert {r.id for r in subtree(nodes, tops).collect()} == {"garden/beds", "garden/beds/north", "garden/beds/north/roses.md"}
    assert "garden/beds" not in {r.id for r in detach(nodes, tops).collect()}
    assert {r.id for r in tree_filter(nodes, F.col("is_file"), F.col("name") != "tools").collect()} == {
        "garden/beds/north/roses.md", "garden/plan.md", "alone.md"}
    assert {(r.id, r.ancestor) for r in ancestors(nodes).where("id in ('alone.md', 'garden/plan.md')").collect()} == {("garden/plan.md", "garden")}


def test_trees_without_paths(spark):
    import pytest

    rows = [("r", None, 0)] + [(f"n{i}", "r" if i == 0 else f"n{i - 1}", 0) for i in range(20)] + [("z", "r", -1), ("y", "r", 5), ("s", None, 0)]
    nodes = spark.createDataFrame(rows, "id string, parent string, ord long")
    got = {(r.id, r.ancestor): r.distance for r in ancestors_by_parent(nodes).collect()}
    assert got["n19", "r"] == 20 and got["n19", "n0"] == 19 and len(got) == sum(range(1, 21)) + 2
    order = [(r.id, r.depth) for r in walk_by_parent(nodes).where("root = 'r'").orderBy("preorder").collect()]
    assert order == [("r", 0), ("z", 1)] + [(f"n{i}", i + 1) for i in range(20)] + [("y", 1)]
    with pytest.raises(ValueError):
        ancestors_by_parent(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"))


def test_order_by_position(spark):
    rows = spark.createDataFrame([("b", 0, 0), ("a", 2, 1), ("a", 1, 9)], "path string, line long, column long")
    assert [(r.path, r.line) for r in order_by_position(rows).collect()] == [("a", 1), ("a", 2), ("b", 0)]


def test_siblings_and_flags(spark):
    nodes = nodes_of(spark)
    ranked = siblings(nodes)
    by = {r.id: r for r in ranked.collect()}
    assert by["garden/plan.md"].prev_sibling == "garden/beds" and by["garden/plan.md"].next_sibling == "garden/tools"
    assert by["garden"].n_children == 3 and by["alone.md"].is_leaf
    lists = siblings_of(ranked, nodes.where("id = 'garden/tools'")).collect()
    assert {(r.sibling, r.side, r.distance) for r in lists} == {("garden/plan.md", "previous", 1), ("garden/beds", "previous", 2)}
    flags = {r.id: r for r in leaf_flags(nodes).collect()}
    assert flags["garden"].is_tree and flags["garden"].is_node and flags["garden"].first_child == "garden/beds"
    assert flags["garden/plan.md"].is_subtree and flags["garden/plan.md"].is_empty and flags["garden/plan.md"].last_child is None


def test_numbers_are_never_cut(spark):
    walked = walk(nodes_of(spark, [f"top/{i:05d}" for i in range(1200)]))
    assert {r[0].split(" ")[0] for r in walked.select(outline_numbered(walked)).collect()} == {f"{i:03d}" for i in range(1201)}


def test_nested_json_lines_make_the_document(spark):
    rows = nest_tree(nodes_of(spark, PATHS + ["alone.md/x\"y"]), F.struct("name")).orderBy("root", "preorder").collect()
    docs = {}
    for r in rows:
        docs[r.root] = docs.get(r.root, "") + r.json
    tree = json.loads(docs["garden"])
    assert [c["id"] for c in tree["children"]] == ["garden/beds", "garden/plan.md", "garden/tools"]
    assert tree["children"][0]["children"][0]["children"][0] == {"id": "garden/beds/north/roses.md", "value": {"name": "roses.md"}, "children": None}
    assert json.loads(docs["alone.md"])["children"][0]["value"] == {"name": 'x\"y'}


SOURCE = '''class A(NamedTuple):
    """One
      line."""
    size: int

    def m(self):
        "plain"
        x = A

    def n(self):
        \'\'\'Short.\'\'\'
        def g():
            return m(g)
        pass

def g():
    return A
'''
PATH = "src/py/pkg/mod.py"


def lines_of(spark, text=SOURCE, path=PATH):
    return scan_lines(spark.createDataFrame([(path, text)], "path string, content string"))


def test_symbols_scopes_and_slots(spark):
    got = {(r.qualname, r.line): (r.kind, r.end_line) for r in symbols(lines_of(spark)).collect()}
    assert got == {("pkg.mod", 0): ("module", 17), ("pkg.mod.A", 0): ("class", 15), ("pkg.mod.A.m", 5): ("function", 9),
                   ("pkg.mod.A.n", 9): ("function", 15), ("pkg.mod.A.n.g", 11): ("function", 13), ("pkg.mod.g", 15): ("function", 17)}
    inside = {(r.qualname, r.enclosing, r.enclosing_line, r.distance) for r in enclosing(lines_of(spark)).collect()}
    assert {x for x in inside if x[0] == "pkg.mod.A.n.g"} == {("pkg.mod.A.n.g", "pkg.mod.A.n", 9, 1), ("pkg.mod.A.n.g", "pkg.mod.A", 0, 2),
                                                             ("pkg.mod.A.n.g", "pkg.mod", 0, 3)}
    assert len(inside) == 3 + 2 + 2 + 1 + 1
    held = {(r.parent, r.slot): r.qualname for r in slots(symbols(lines_of(spark))).collect()}
    assert held["pkg.mod.A", "n"] == "pkg.mod.A.n" and len(held) == 5
    blocks = spark.createDataFrame([(PATH, 0, 6), (PATH, 1, 16)], "path string, block_no long, line long")
    assert {r.block_no: r.enclosing for r in block_scopes(blocks, lines_of(spark)).collect()} == {0: "pkg.mod.A.m", 1: "pkg.mod.g"}


def test_fields_docstrings_and_references(spark):
    lines = lines_of(spark)
    assert [(r.qualname, r.line) for r in fields(lines).collect()] == [("pkg.mod.A.size", 3)]
    docs = {r.qualname: (r.doc_line, r.documentation) for r in docstrings(lines).collect()}
    assert docs == {"pkg.mod.A": (1, "One\n  line."), "pkg.mod.A.m": (6, "plain"), "pkg.mod.A.n": (10, "Short.")}
    found = {(r.name, r.line): (r.qualname, r.found) for r in references(lines).collect()}
    assert found["A", 7] == ("pkg.mod.A", "scope") and found["g", 12] == ("pkg.mod.A.n.g", "scope") and found["m", 12] == ("pkg.mod.A.m", "scope")
    assert found["A", 16] == ("pkg.mod.A", "scope") and found["self", 5] == (None, None)


ODD = """from a.b import f as g, h
import os.path, x.y as z
from . import near
from ..up import far
def m(
    self,
):
    (r'Odd \\d'
     "one")
    f = g(h, os.path, z, near, far, q='g')

def n():
    b"no"

def o():
    f'no'

def p():
    \"\"\"never closed
class Q: pass
"""


def test_odd_documentation_and_references_through_imports(spark):
    lines = lines_of(spark, ODD, "src/py/top/in/mod.py")
    assert [(r.qualname, r.line, r.doc_line, r.documentation) for r in docstrings(lines).collect()] == [("top.in.mod.m", 4, 7, "Odd \\done")]
    assert {r.name for r in symbols(lines).collect()} == {"mod", "m", "n", "o", "p"}
    found = {r.name: (r.qualname, r.found) for r in references(lines).where("line = 9").collect()}
    assert found == {"g": ("a.b.f", "import"), "h": ("a.b.h", "import"), "os": ("os", "import"), "path": (None, None), "z": ("x.y", "import"),
                     "near": ("top.in.near", "import"), "far": ("top.up.far", "import"), "q": (None, None)}
    kinds = {(r.name, r.type) for r in mentions(lines).collect()}
    assert ("m", "def") in kinds and ("f", "asn") in kinds and not {n for n, _ in kinds} & {"Odd", "no", "Q", "r", "never"}


def test_imports_in_all_forms(spark):
    text = ("import os  # c\nimport a.b as ab, sys\nfrom x import (y, z as w)\nfrom . import v\nfrom .q import u\n"
            "from p import (  # many\n    one,\n    two as t,  # second\n)\nfrom s import *\nx = 1\n")
    got = sorted((r.number, r.module, r.alias) for r in imports(lines_of(spark, text)).collect())
    assert got == [(0, "os", None), (1, "a.b", "ab"), (1, "sys", None), (2, "x.y", None), (2, "x.z", "w"), (3, ".v", None), (4, ".q.u", None),
                   (6, "p.one", None), (7, "p.two", "t"), (9, "s.*", None)]


def test_mentions_on_a_long_line(spark):
    text = "x = " + " ".join(f"n{i}" for i in range(200_000)) + "\n"
    got = mentions(with_offsets(lines_of(spark, text)))
    assert got.count() == 200_001
    last = got.orderBy(F.desc("column")).first()
    assert last.name == "n199999" and last.column == text.rindex("n199999")


def test_submodules(spark):
    files = ["top/__init__.py", "top/a.py", "top/__main__.py", "top/in/__init__.py", "top/in/b.py", "top/bare/c.py", "topper/d.py"]
    got = submodules(spark.createDataFrame([(f,) for f in files], "path string"), "top").collect()
    assert {r.module for r in got} == {"top", "top.a", "top.in", "top.in.b"}


def test_tags_locate_lines(spark):
    lines = lines_of(spark, "class B:\n    def go(self):\n        return 1\n", "m.py")
    raw = spark.createDataFrame([("!_TAG_FILE_FORMAT\t2\t/extended/",), ('B\tm.py\t/^class B:$/;"\tc',), ("no tag at all",), ("",),
                                 ('go\tm.py\t/^    def go(self):$/;"\tf\tclass:Z\tline:2\tclass:B',), ("ret\tm.py\treturn\tq",)], "value string")
    tags = read_tags(raw)
    rows = {r.symbol: r for r in tags.collect()}
    assert set(rows) == {"B", "go", "ret"}
    assert rows["B"].kind == "Class" and rows["go"].extras == {"class": "B", "line": "2"} and rows["ret"].kind is None
    frags = {r.symbol: (r.offset, r.length, r.line, r.column) for r in find_fragments(lines, tags).collect()}
    assert frags == {"B": (0, 8, 0, 0), "go": (9, 17, 1, 0), "ret": (35, 6, 2, 8)}
    codes = kind_lookup(spark.createDataFrame([("Mtd",), ("none",)], "kind_code string"), kinds=SYMBOL_KINDS)
    assert {r.kind_code: r.kind for r in codes.collect()} == {"Mtd": "Method", "none": None} and len(SYMBOL_KINDS) == 66


def test_substrings_in_one_way_for_all_sizes(spark):
    import random

    rng = random.Random(3)
    texts = {f"t{i}": "".join(rng.choice("ab\né ") for _ in range(rng.randint(0, 300))) for i in range(40)} | {"none": None}
    pool = [t for t in texts.values() if t]
    pats = [(i, t[a:a + n]) for i, n in enumerate([1, 1, 2, 3, 5, 7, 14, 15, 30, 31, 63, 64, 100, 200] * 4)
            for t in [rng.choice(pool)] for a in [rng.randrange(max(1, len(t) - n))]] + [(900, "a"), (900, "a"), (901, ""), (902, "absent")]
    got = find_substrings(spark.createDataFrame(list(texts.items()), "path string, content string"),
                          spark.createDataFrame(pats, "pattern_id long, pattern string")).collect()
    want = {(p, i, t.count("\n", 0, t.index(x)), t.index(x) - (t.rfind("\n", 0, t.index(x)) + 1), t.index(x), len(x))
            for p, t in texts.items() if t for i, x in pats if x and x in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_by_name(spark):
    docs = spark.createDataFrame([(0, "<a><b></a></b><a><a></a>")], "doc_id long, text string")
    tags = marks(docs, [("END_t", "</[a-z]>"), ("STA_t", "<[a-z]>")]).withColumn("name", F.regexp_extract("text", "[a-z]", 0))
    got = {r.start: (r.name, r.span_end) for r in pair_marks(tags, name="name", chunk_rows=3).collect()}
    assert got == {0: ("a", 10), 3: ("b", 14), 14: ("a", None), 17: ("a", 24)}
    assert json.loads(to_json_rows(docs.select("doc_id")).first()["json"]) == {"doc_id": 0}


def test_substrings_of_texts_that_share_a_path(spark):
    files = spark.createDataFrame([("a", "xx hello"), ("a", "hello yy"), ("a", "hello yy"), (None, "say hello"), ("b", "é" * 500 + "z")], "path string, content string")
    pats = spark.createDataFrame([(0, "hello"), (1, "l"), (2, "yy"), (3, "z"), (4, "éz"), (5, "no"), (6, "o")], "pattern_id long, pattern string")
    rows = sorted(((r.path or "", r.pattern_id, r.offset) for r in find_substrings(files, pats).collect()))
    assert rows == sorted(((r.path or "", r.pattern_id, r.offset) for r in find_substrings(files, pats, sample=0.9, prefilter=True).collect()))
    texts = {("a", "xx hello"), ("a", "hello yy"), ("", "say hello"), ("b", "é" * 500 + "z")}
    want = sorted((p, i, t.index(x)) for p, t in texts for i, x in ((0, "hello"), (1, "l"), (2, "yy"), (3, "z"), (4, "éz"), (5, "no"), (6, "o")) if x in t)
    assert rows == want


def test_one_letter_does_not_explode_the_texts(spark):
    files = spark.range(20).selectExpr("concat('f', id) AS path", "repeat('abcdefgh ', 20000) AS content")
    found = find_substrings(files, spark.createDataFrame([(0, "e")], "pattern_id long, pattern string"))
    plan = found._jdf.queryExecution()
    assert found.count() == 20
    assert {r.offset for r in found.collect()} == {4}
    many = spark.range(3000).selectExpr("id AS pattern_id", "concat('pattern ', id, IF(id = 7, '', ' !')) AS pattern")
    text = spark.createDataFrame([("t", "x pattern 7 y")], "path string, content string")
    assert [r.pattern_id for r in find_substrings(text, many, prefilter=True).collect()] == [7] == [r.pattern_id for r in find_substrings(text, many).collect()]
    assert "array_distinct" in plan.toString()
