import ast
import io
import json
import random
import re
import tokenize
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators.lexical import KEY, Reader, _maps, _put_together, _summed, lexed_lines
from quire.plans.scan import CHUNK
from quire.sources.lines import scan_lines

PARTS = ["class A:\n", "    def f(self,\n", "          x=1):\n", "        '''Doc\n", "class Fake:\n", "        '''\n", "    x = 'a \\\n", "b'\n", "(\n", ")\n",
         "    def g(self): pass\n", '    """', '"\n', "  # def no(\n", "\n", "y = [1, # (\n", "]\n", "z = \\\n", "def h():\n", "r'\\'' + '''a''' \"'\"\n", "'unclosed\n",
         "        async def k(a):\n", "   )]}\n", "        return 1\n", "é = '漢字'  # ü\n"]


def read(texts, reader=None):
    reader, out = reader or Reader(), []
    for i, t in enumerate(texts):
        got = reader.line(i, t)
        out.append((*got[:4], reader.stack))
        reader.enter()
    return out, reader


def test_slices_put_together_read_like_the_whole():
    rnd = random.Random(7)
    for _ in range(150):
        texts = [rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))]
        whole, _ = read(texts)
        bodies = [None]         # before each line, the first statement of a body that it may go on with
        for i, (start, code, _, first, _) in enumerate(whole):
            bodies.append((i if first else None) if start and code.strip() else bodies[-1])
        for size in (1, 3, 7):
            slices = [list(enumerate(texts))[i:i + size] for i in range(0, len(texts), size)]
            states = _put_together([_summed(s) for s in slices])
            got = []
            for rows, state in zip(slices, states):
                state = dict(state)
                assert state.pop("body") == bodies[rows[0][0]] and state.pop("offset") == sum(map(len, texts[:rows[0][0]]))
                reader = Reader(**state)
                for number, text in rows:
                    got.append((*reader.line(number, text)[:4], reader.stack))
                    reader.enter()
            plain = lambda rows: [(s, c, list(x), f, [tuple(y) for y in st]) for s, c, x, f, st in rows]
            assert plain(got) == plain(whole)


def test_a_slice_is_summed_up_without_its_rows_being_kept():
    rnd = random.Random(11)
    texts = [rnd.choice(PARTS) for _ in range(400)]
    batch = lambda at, ts: pa.RecordBatch.from_pydict(
        {KEY: ["=a"] * len(ts), CHUNK: pa.array([3] * len(ts), pa.int64()), "number": pa.array(range(at, at + len(ts)), pa.int64()), "text": ts})
    got = [r for b in _maps(batch(i, texts[i:i + 7]) for i in range(0, len(texts), 7)) for r in b.to_pylist()]
    assert got == [{KEY: "=a", CHUNK: 3, "map": json.dumps(_summed(list(enumerate(texts))))}]
    long = "x = y  " + "z" * 2000 + "\n"
    tracemalloc.start()
    try:
        assert len(list(_maps(batch(i, [long] * 500) for i in range(0, 10_000, 500)))) == 1
        assert tracemalloc.get_traced_memory()[1] < 6 << 20        # all rows: 20 MB
    finally:
        tracemalloc.stop()


SOURCE = '''"""Module
def no(): pass
"""
import os

class A(
    B,
    C,
):  # class D:
    \'\'\'class Fake:
    def inner(): pass
    \'\'\'
    x: int = (1 +
def_ + 2)

    async def m(
        self,
        y="def z():",
    ):
        "One line."
        t = f"""
class Not: {y}
"""
        def nested(): return \\
            1
# at the margin
        return t, r'\\'', """a""b""", 'it\\'s' \\
          "class E:"

    def last(self): ...

def g():
    r"""Raw \\d
    text."""
'''


def test_declarations_and_code_equal_the_parser_of_python(spark):
    lines = scan_lines(spark.createDataFrame([("m.py", SOURCE)], "path string, content string"))
    rows = lexed_lines(lines).orderBy("number").collect()
    want = {n.lineno - 1: n.name for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))}
    names = {r.number: re.search(r"(?:class|def)\s+(\w+)", r.code)[1] for r in rows if r.decl}
    assert names == want
    # logical lines begin where the tokenizer has the first token after a NEWLINE
    begins, fresh = set(), True
    for t in tokenize.generate_tokens(io.StringIO(SOURCE).readline):
        if t.type in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            continue
        if fresh:
            begins.add(t.start[0] - 1)
        fresh = t.type == tokenize.NEWLINE
    assert {r.number for r in rows if r.start and r.code.strip()} == begins
    assert all(len(r.code) == len(r.text) for r in rows)
    assert not any("Fake" in r.code or "Not" in r.code or "class E" in r.code for r in rows)


@pytest.mark.parametrize("chunk_rows", [2, 5, 1000])
def test_slices_in_spark(spark, chunk_rows):
    rnd = random.Random(3)
    files = [(f"f{i}", "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 30])))) for i in range(12)] + [(None, "class A:\n  'd'\n x\n")]
    lines = scan_lines(spark.createDataFrame(files, "path string, content string"), chunk_rows=chunk_rows)
    got = {}
    for r in lexed_lines(lines).orderBy("path", "number").collect():
        got.setdefault(r.path, []).append((r.start, r.code, list(r.closes), [s.line for s in r.scopes]))
    once = scan_lines(spark.createDataFrame(files, "path string, content string"))
    names = ["path", "number", "first", "said", "open", "decl", "offset"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(lexed_lines(lines.drop("offset")).select(*names).collect()) == key(lexed_lines(once).select(*names).collect())
    assert key(lexed_lines(lines).select(*names).collect()) == key(lexed_lines(once).select(*names).collect())
    for path, content in files:
        texts = content.splitlines(keepends=True)
        whole, _ = read(texts)
        assert got.get(path, []) == [(s, c, x, [y.line for y in st]) for s, c, x, _, st in whole]


def test_many_indents_need_no_driver(spark):
    n = 5000
    text = "".join(" " * ((7 * i) % n) + f"def f{i}(): pass\n" for i in range(n))
    lines = scan_lines(spark.createDataFrame([("deep.py", text)], "path string, content string"), chunk_rows=700)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    frame = lexed_lines(lines)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    got = frame.select(F.count_if("decl").alias("n"), F.sum(F.size("closes")).alias("closed"), F.sum(F.size("scopes")).alias("open")).first()
    stack, closed, opened = [], 0, 0
    for i in range(n):
        indent = (7 * i) % n
        while stack and stack[-1] >= indent:
            stack.pop()
            closed += 1
        opened += len(stack)
        stack.append(indent)
    assert (got.n, got.closed, got.open) == (n, closed, opened)
