import random
import re

from pyspark.sql import functions as F

from quire.operators.blocks import blocks, classify_lines, prose_blocks, runs, typed_blocks
from quire.sources.lines import scan_lines
from tests import folds

# The example text and its block spans.
EXAMPLE = "Code\n# --\n# Block\n# Block\nCode\nCode\nCode\n# --\n# Block\nCode\n"
SPANS = [(0, 5, 0), (5, 21, 1), (26, 15, 4), (41, 13, 7), (54, 6, 9)]

CODE = ["# --", "# -- meta x", "  # --", "# ---", "#--", "#  --", "# c", "  # c", "\t# c", "x = 1", "", "  y", "#"]
NOTE = ["== T", "# H", "--m", "# -- c", "```", "``` py", "- [x] a", "- [ ] b", "1. c", "a) d", "- e", "* f", "plain", "", " more"]


def test_reference_block_spans(spark):
    files = spark.createDataFrame([("a.py", EXAMPLE)], "path string, content string")
    lines = scan_lines(files, eol=False)
    got = blocks(classify_lines(lines)).orderBy("block_no").select("offset", "length", "line").collect()
    assert [tuple(r) for r in got] == SPANS


def _files(spark, pool, seed, eol):
    rng = random.Random(seed)
    files = {p: [rng.choice(pool) + eol for _ in range(rng.randint(1, 60))] for p in [f"f{i}" for i in range(60)] + [None]}
    rows = [(p, i, t) for p, ts in files.items() for i, t in enumerate(ts)]
    return files, spark.createDataFrame(rows, "path string, number bigint, text string")


def _by_path(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.line):
        out.setdefault(r.path, []).append(r)
    return out


def test_doc_blocks_match_fold_across_slices(spark):
    files, lines = _files(spark, CODE, 7, "\n")
    for chunk in (1, 3, 7, 1 << 16):
        got = _by_path(blocks(classify_lines(lines, chunk_rows=chunk)).collect())
        for p, texts in files.items():
            assert [(r.kind, r.meta, r.offset, r.length, r.line) for r in got[p]] == folds.doc_blocks(texts), (chunk, p)
            assert [r.block_no for r in got[p]] == list(range(len(got[p])))


def test_typed_blocks_match_fold_across_slices(spark):
    files, lines = _files(spark, CODE, 8, "\n")
    for chunk in (1, 4, 1 << 16):
        got = _by_path(typed_blocks(lines, chunk_rows=chunk).collect())
        for p, texts in files.items():
            assert [(r.kind, r.line, r.n_lines) for r in got[p]] == folds.typed_blocks(texts), (chunk, p)
            ends = [sum(map(len, texts[:r.line + r.n_lines])) for r in got[p]]
            assert [r.end for r in got[p]] == ends and [r.start for r in got[p]] == [0, *ends[:-1]]


def test_prose_blocks_match_fold_across_slices(spark):
    def rule_of(text):
        for name, pattern in [("fence", r"```(\s.+)*$"), ("Title", "==+"), ("Heading", "#+"), ("Meta", "--"),
                              ("TodoList", r"[ \t]*-[ ]*\[[ xX]\]"), ("OrderedList", r"[ \t]*[0-9a-zA-Z][).]"), ("UnorderedList", r"[ \t]*[-*]")]:
            if re.match(pattern, text):
                return name
    files, lines = _files(spark, NOTE, 9, "")
    for chunk in (1, 5, 1 << 16):
        got = _by_path(prose_blocks(lines, chunk_rows=chunk).collect())
        for p, texts in files.items():
            assert [(r.kind, r.line, r.n_lines) for r in got[p]] == folds.prose_blocks(texts, rule_of), (chunk, p)


def test_runs_across_slices(spark):
    files, lines = _files(spark, ["a", "b"], 10, "")
    got = {(r.path, r.number): r.block_no for r in runs(lines, F.col("text"), chunk_rows=4).collect()}
    for p, texts in files.items():
        no = 0
        for i, t in enumerate(texts):
            no += bool(i) and t != texts[i - 1]
            assert got[p, i] == no


def test_plan_reads_its_input_twice_at_most(spark, tmp_path):
    _, lines = _files(spark, CODE, 7, "\n")
    lines.write.parquet(f"{tmp_path}/lines")
    plan = blocks(classify_lines(spark.read.parquet(f"{tmp_path}/lines")))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("+- == Initial Plan ==")[-1]
    assert initial.count("FileScan") <= 2
    assert initial.count("Exchange hashpartitioning(_key_path") <= 4     # rows and their summary, twice read
