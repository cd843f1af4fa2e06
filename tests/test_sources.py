import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringStartsWith

from quire.sources.documents import FolderReader, scan_folder, write_documents
from quire.sources.files import json_nodes, read_json_tree, read_manifest, scan_files
from quire.sources.lines import line_of, position_of, read_lines, scan_lines


def test_scan_files_and_manifest(spark, tmp_path):
    root = tmp_path / "so.rce (1)"
    for name, body in {"one/a.py": "x = 1\n", "one/__init__.py": "# init\n", "b.txt": "hé\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    listed = {r.path: r.content for r in scan_files(spark, str(root)).collect()}
    assert listed == {"one/a.py": "x = 1\n", "one/__init__.py": "# init\n", "b.txt": "hé\n"}
    names = spark.createDataFrame([("one/__init__.py",), ("one/a.py",), ("gone.py",)], "path string")
    for base in (str(root), f"file://{tmp_path}/so.rce%20(1)"):
        got = {r.path: r.content for r in read_manifest(names, base).collect()}
        assert got == {"one/__init__.py": "# init\n", "one/a.py": "x = 1\n", "gone.py": None}
    with pytest.raises(Exception):
        read_manifest(spark.createDataFrame([("one",)], "path string"), str(root)).collect()     # a folder is no file


def test_read_json_tree_of_any_depth(spark, tmp_path):
    deep = {"id": "n34"}
    for i in range(33, -1, -1):
        deep = {"id": f"n{i}", "value": {"size": i}, "children": [deep] if i % 2 else [deep, {"id": f"side{i}"}]}
    (tmp_path / "tree.json").write_text(json.dumps([deep, {"id": "alone"}]))
    rows = {r.id: (r.parent, r.ord, r.depth) for r in read_json_tree(spark, f"{tmp_path}/tree.json").collect()}
    assert rows["n34"] == ("n33", 0, 34) and rows["side32"] == ("n32", 1, 33) and rows["alone"] == (None, 0, 0)
    assert len(rows) == 35 + 17 + 1


def test_lines_and_positions(spark):
    files = spark.createDataFrame([("a", "é\r\nxy\n\nlast"), ("b", ""), ("c", "\n"), ("d", None)], "path string, content string")
    got = sorted((r.path, r.number, r.offset, r.text) for r in scan_lines(files).collect())
    assert got == [("a", 0, 0, "é\n"), ("a", 1, 2, "xy\n"), ("a", 2, 5, "\n"), ("a", 3, 6, "last"), ("c", 0, 0, "\n")]
    pieces = sorted((r.path, r.number, r.offset, r.text) for r in scan_lines(files, eol=False).collect())
    assert pieces == [("a", 0, 0, "é\n"), ("a", 1, 2, "xy\n"), ("a", 2, 5, "\n"), ("a", 3, 6, "last\n"), ("b", 0, 0, "\n"),
                      ("c", 0, 0, "\n"), ("c", 1, 1, "\n")]
    assert "Exchange" not in scan_lines(files)._jdf.queryExecution().executedPlan().toString()
    lines = scan_lines(files)
    asked = spark.createDataFrame([("a", n) for n in range(12)] + [("c", 0), ("z", 0)], "path string, offset long")
    where = {(r.path, r.offset): (r.line, r.column) for r in line_of(lines, asked).collect()}
    assert [where["a", n] for n in range(10)] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3)]
    assert where["a", 10] == where["z", 0] == (None, None)
    points = spark.createDataFrame([("a", 1, 1), ("a", 9, 0)], "path string, line long, column long")
    assert {(r.line, r.offset) for r in position_of(lines, points).collect()} == {(1, 3), (9, None)}
    long = spark.createDataFrame([("x", "y" * 10000 + "\nz")], "path string, content string")
    back = line_of(scan_lines(long), spark.createDataFrame([("x", 9999), ("x", 10001)], "path string, offset long")).orderBy("offset").collect()
    assert [(r.line, r.column) for r in back] == [(0, 9999), (1, 0)]
    assert scan_lines(files).agg(F.sum(F.length("text"))).first()[0] == 11


def test_folders_are_listed_whole_and_pruned(spark, tmp_path):
    want = {}
    for i in range(40):
        for name in (f"d{i % 7}/_x/.hidden{i}", f"d{i % 7}/e{i}/f.py", f"__init__{i}.py", f"d{i % 7}/.git/{i}"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(f"é{i}\r\n", encoding="utf-8", newline="")
            want[name] = f"é{i}\r\n"
    (tmp_path / "bad").write_bytes(b"\xff!")
    want["bad"] = "\ufffd!"
    for partitions in (None, 3, 1000):
        rows = scan_folder(spark, str(tmp_path), partitions=partitions).collect()
        assert {r.path: r.content for r in rows} == want and len(rows) == len(want)
        assert {r.path: r.size for r in rows}["bad"] == 2
    frame = scan_folder(spark, str(tmp_path))
    assert {r.path for r in frame.where("path like 'd3/%'").collect()} == {p for p in want if p.startswith("d3/")}
    assert {r.path for r in frame.where("path in ('d1/e1/f.py', '__init__2.py', 'no')").collect()} == {"d1/e1/f.py", "__init__2.py"}
    named = scan_folder(spark, str(tmp_path), includes=["*.py"], excludes=["f.*"], content=False).collect()
    assert {r.path for r in named} == {f"__init__{i}.py" for i in range(40)} and {r.content for r in named} == {None}
    reader = FolderReader({"path": str(tmp_path)})
    list(reader.pushFilters([StringStartsWith(("path",), "d3/_x/")]))
    assert {f for p in reader.partitions() for f, _ in p.folders} == {"", "d3", "d3/_x"}


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(5000).selectExpr("concat('a/d', id % 5, '/_doc') AS path", "id AS number", "IF(id = 7, NULL, concat('é', id, '\n')) AS text")
    one = spark.range(4000).selectExpr("'big' AS path", "id AS number", "concat('line ', id, '\n') AS text")
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # documents lie in several tasks
    try:
        write_documents(rows.unionByName(one), out, suffix=".html")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.path: r.content for r in scan_folder(spark, out).collect()}
    assert got == {f"a/d{k}/_doc.html": "".join("" if i == 7 else f"é{i}\n" for i in range(k, 5000, 5)) for k in range(5)} | {
        "big.html": "".join(f"line {i}\n" for i in range(4000))}
    bad = rows.withColumn("text", F.expr("IF(number = 4321, raise_error('no'), text)")).withColumn("path", F.concat(F.lit("new/"), "path"))
    for frame in (bad, rows.withColumn("path", F.lit("../up")), rows.withColumn("path", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            write_documents(frame, out)
    assert {r.path for r in scan_folder(spark, out, content=False).collect()} == set(got)
    write_documents(rows.where("false"), str(tmp_path / "none"))


def test_files_read_in_ranges_give_the_same_lines(spark, tmp_path):
    import random

    rng = random.Random(8)
    piece = lambda: rng.choice(["é", "漢字", "x" * rng.randint(0, 90), "", "\x0b", "🎈"])
    files = {f"f{i}": "".join(piece() + rng.choice(["\n", "\r\n", "\n", "\r", "", "\n\n"]) for _ in range(rng.choice([0, 1, 5, 400]))) for i in range(12)}
    files |= {"ends": "a\n", "open": "a\nb", "cr": "a\r", "crlf": "a\r\n", "only": "\n", "mixed": "a\r\rb\r\n\rc"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    frame = spark.createDataFrame(list(files.items()), "path string, content string")
    names = ["path", "number", "offset", "text"]
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, universal, eol in ((37, True, True), (101, True, False), (1000, False, True), (10 ** 8, True, True)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = read_lines(spark, str(tmp_path), universal_newlines=universal, eol=eol)
            want = scan_lines(frame, universal_newlines=universal, eol=eol)
            rows = sorted(tuple(r) for r in got.select(*names).collect())
            if eol:
                assert rows == sorted(tuple(r) for r in want.select(*names).collect())
            else:  # an empty file has no row to read
                assert rows == sorted(tuple(r) for r in want.select(*names).collect() if files[r.path])
            if size == 37:
                raw = spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start")
                assert raw.distinct().count() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_columns_of_any_depth_and_types(spark):
    deep = {"id": "n34", "value": None}
    for i in range(33, -1, -1):
        deep = {"id": f"n{i}", "value": [i, {"a": "x"}][i % 2], "children": [deep] if i % 2 else [deep, {"id": f"side{i}", "children": []}]}
    rows = [(1, json.dumps([deep, {"id": 7, "value": "t"}])), (2, json.dumps({"id": "one"})), (3, None), (4, ""), (5, "{bad"), (6, "[]"), (7, "3")]
    got = json_nodes(spark.createDataFrame(rows, "doc long, content string"), "doc", "content").collect()
    by = {(r.doc, r.id): (r.parent, r.ord, r.depth, r.value) for r in got}
    assert len(got) == len(by) == 35 + 17 + 1 + 1
    assert by[1, "n34"] == ("n33", 0, 34, None) and by[1, "side32"] == ("n32", 1, 33, None) and by[1, "7"] == (None, 1, 0, '"t"')
    assert by[2, "one"] == (None, 0, 0, None) and by[1, "n0"][3] == "0" and by[1, "n1"][3] == '{"a":"x"}'
    raw = spark.createDataFrame([(1, bytearray(json.dumps({"id": "é"}).encode()))], "doc long, content binary")
    assert [r.id for r in json_nodes(raw, "doc", "content").collect()] == ["é"]


def test_enumerations_by_name_or_value(spark):
    from quire.functions.export import to_json_rows

    rows = spark.createDataFrame([("red",), ("1",), ("2",), ("rouge",), ("other",), (None,)], "c string")
    members = {"c": [("red", "1"), ("rouge", "1"), ("blue", "2")]}
    shown = lambda how: [json.loads(r.json)["c"] for r in to_json_rows(rows, enums=members, enum=how).collect()]
    assert shown("name") == ["red", "red", "blue", "rouge", "other", None]
    assert shown("value") == ["1", "1", "2", "1", "other", None]
    with pytest.raises(ValueError):
        to_json_rows(rows, enum="both")
