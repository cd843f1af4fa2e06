import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.spans import bins_of_span, containing, innermost, inside
from quire.operators.trees import catalogue, detached, nest_tree, subtree_of, tour, walk


def test_bins_cover_exactly(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 2, 3, 7, 100, 5000])) for a in [0, 1, 2, 3, 63, 64, 65, 1000, 4095, 4096] for _ in range(3)] + [
        (5, 2), (-1, 4), (0, 1 << 40), (3, (1 << 50) + 5)]
    rows = spark.createDataFrame(spans, "lo long, hi long").withColumn("b", bins_of_span(F.col("lo"), F.col("hi"))).collect()
    for r in rows:
        parts = sorted((x.bin << x.level, (x.bin + 1) << x.level) for x in r.b)
        if r.lo < 0 or r.hi <= r.lo:
            assert parts == []
            continue
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * max(1, (r.hi - r.lo).bit_length())


def test_points_and_spans_equal_plain_search(spark):
    rng = random.Random(2)
    spans = [(f, i, a, a + rng.randint(0, 60)) for f in "xy" for i, a in enumerate(rng.choices(range(100), k=40))] + [("x", 99, 0, 100), ("x", 98, 0, 100)]
    points = [(f, i, rng.randint(-2, 120)) for f in "xyz" for i in range(50)] + [("x", 77, None)]
    sp = spark.createDataFrame(spans, "f string, k long, lo long, hi long")
    pt = spark.createDataFrame(points, "f string, i long, at long")
    got = sorted((r.f, r.i, r.k) for r in inside(pt, sp, ["f"], "at").collect())
    assert got == sorted((f, i, k) for f, i, at in points for g, k, lo, hi in spans if f == g and at is not None and at >= 0 and lo <= at < hi)
    best = {(r.f, r.i): r.within for r in innermost(pt, sp, ["f"], "at", "k").collect()}
    for f, i, at in points:
        held = [(lo - hi, lo, k) for g, k, lo, hi in spans if f == g and at is not None and at >= 0 and lo <= at < hi]
        assert best[f, i] == (max(held)[2] if held else None)
    near = sorted((r.f, r.k, r.enclosing, r.distance) for r in containing(sp, sp, ["f"], "k").collect())
    want = []
    for f, k, lo, hi in spans:
        outer = sorted((b - a, -a, j) for g, j, a, b in spans if f == g and a <= lo < b and hi <= b and b - a > hi - lo)
        want += [(f, k, j, n + 1) for n, (_, _, j) in enumerate(outer)]
    assert near == sorted(want)


def test_tours_of_forests(spark):
    rng = random.Random(4)
    rows = [(f"n{i}", None if i < 3 else f"n{rng.randint(max(0, i - rng.choice([2, 400])), i - 1)}", rng.randint(0, 3)) for i in range(600)]
    rows += [(f"c{i}", f"c{i - 1}" if i else "gone", 0) for i in range(300)]
    rng.shuffle(rows)
    kids, parent = {}, {i: p for i, p, _ in rows}
    for i, p, o in sorted(rows, key=lambda r: (r[2], r[0])):
        kids.setdefault(p if p in parent else None, []).append(i)
    want = {}

    def go(i, root, depth, at):
        todo = [(i, depth, False)]
        opened = {}
        while todo:
            x, d, done = todo.pop()
            if done:
                want[x] = (root, d, opened[x], at - opened[x])
                continue
            opened[x] = at
            at += 1
            todo.append((x, d, True))
            todo += [(k, d + 1, False) for k in reversed(kids.get(x, []))]

    for r in kids[None]:
        go(r, r, 0, 0)
    nodes = spark.createDataFrame(rows, "id string, parent string, ord long")
    toured = tour(nodes).checkpoint()
    assert {r.id: (r.root, r.depth, r.preorder, r.size) for r in toured.collect()} == want
    tops = spark.createDataFrame([("n5",), ("n0",), ("c250",), ("none",)], "id string")
    below = {}
    for x, (root, d, pre, _) in want.items():
        for t in ("n5", "n0", "c250"):
            tr, td, tp, ts = want[t]
            if tr == root and tp <= pre < tp + ts:
                below[x, t] = d - td
    assert {(r.id, r.top): r.distance for r in subtree_of(toured, tops).collect()} == below
    assert {(r.id, r.top) for r in subtree_of(toured, tops, 2).collect()} == {k for k, d in below.items() if d <= 2}
    assert {r.id for r in detached(nodes, toured, tops).collect()} == set(want) - {x for x, _ in below}
    assert tour(nodes.where("false")).count() == 0
    with pytest.raises(ValueError):
        tour(spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("r", None, 0)], "id string, parent string, ord long"))


def test_nested_json_from_roots_at_any_depth(spark):
    paths = ["py/lib/a.py", "py/lib/x/b.py", "py/lib/x/y/z/c.py", "top.md", "py/other/d.py", "py/lib-2/e.py"]
    nodes = catalogue(spark.createDataFrame([(p,) for p in paths], "path string"), full=False)
    docs, ids = {}, {}
    for r in nest_tree(nodes, F.struct("name")).orderBy("root", "preorder").collect():
        docs[r.root] = docs.get(r.root, "") + r.json
    walked = walk(nodes).orderBy("root", "preorder").collect()
    for r in walked:
        ids.setdefault(r.root, []).append(r.id)
    assert set(docs) == {"py/lib", "py/lib/x/y/z", "top.md", "py/other", "py/lib-2"}

    def flat(node):
        return [node["id"]] + [i for c in node["children"] or [] for i in flat(c)]

    assert {root: flat(json.loads(d)) for root, d in docs.items()} == ids
    assert {r.id: r.outline for r in walked}["py/lib/x/b.py"] == "    b.py" and {r.id: r.outline for r in walked}["py/lib"] == "lib"
