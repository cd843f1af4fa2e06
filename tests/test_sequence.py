import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators.sequence import Compiled, match_each, match_sequence
from quire.operators.marks import marks
from quire.streaming.sequence import events_as_stream, marks_stream, match_sequence_stream


def _atoms(spark, *seqs):
    rows = [(k, i, a) for k, s in enumerate(seqs) for i, a in enumerate(s.split())]
    return spark.createDataFrame(rows, "k long, i long, a string")


def _run(spark, rules, *seqs):
    got = match_sequence(_atoms(spark, *seqs), "k", ["i"], "a", rules).collect()
    return sorted(((r.k, r.rule, r.start, r.end) for r in got), key=lambda t: (t[0], t[2], t[3]))


def test_reference_many_rules(spark):
    # block comment code comment comment code code code
    rules = {"Block": "block comment+", "Comment": "comment+", "Code": "_+"}
    got = _run(spark, rules, "block comment code comment comment code code code")
    assert got == [(0, "Block", 0, 2), (0, "Code", 2, 3), (0, "Comment", 3, 5), (0, "Code", 5, 8)]


def test_reference_one_rule_cardinalities(spark):
    assert _run(spark, {"M": "T"}, "T T") == [(0, "M", 0, 1), (0, "M", 1, 2)]
    assert _run(spark, {"M": "T+"}, "T T T T T T T") == [(0, "M", 0, 7)]
    assert _run(spark, {"M": "T?"}, "T T") == [(0, "M", 0, 1), (0, "M", 1, 2)]
    assert _run(spark, {"Sep": "sep+"}, "sep sep sep") == [(0, "Sep", 0, 3)]
    assert _run(spark, {"Any": "_+"}, "_ _ _") == [(0, "Any", 0, 3)]
    assert _run(spark, {"Block": "block comment+"}, "block comment comment block comment comment") == [
        (0, "Block", 0, 3), (0, "Block", 3, 6)]


def test_muxed_runs(spark):
    # every A-run and B-run of "AA AAAA BB BBBB CCCC AA BBBBB", one atom per char
    s = " ".join("AAAAAABBBBBBCCCCAABBBBB")
    got = _run(spark, {"A": "A+", "B": "B+"}, s)
    assert got == [(0, "A", 0, 6), (0, "B", 6, 12), (0, "A", 16, 18), (0, "B", 18, 23)]


def test_optional_rules_emit_only_non_empty(spark):
    assert Compiled({"M": "A? B*"}).regex["M"].count("|") == 1
    assert _run(spark, {"M": "T*"}, "A T T A") == [(0, "M", 1, 3)]


def _run_stream(spark, df, batches, name):
    """All rows of ``df`` (column ``b`` says in which micro-batch) through the stream."""
    src = tempfile.mkdtemp(prefix="quire-stream-")
    for b in range(batches):
        df.where(F.col("b") == b).drop("b").coalesce(1).write.parquet(os.path.join(src, f"b{b}"))
    flat = tempfile.mkdtemp(prefix="quire-stream-flat-")
    for b in range(batches):
        for f in os.listdir(os.path.join(src, f"b{b}")):
            if f.endswith(".parquet"):
                os.link(os.path.join(src, f"b{b}", f), os.path.join(flat, f"part-{b:03d}.parquet"))
                os.utime(os.path.join(flat, f"part-{b:03d}.parquet"), (1000 + b, 1000 + b))

    def run(rules, **more):
        stream = events_as_stream(spark, flat, df.drop("b").schema)
        out = match_sequence_stream(stream, "k", "ts", ["ts", "i"], "a", rules, **more)
        q = (out.writeStream.outputMode("append").format("memory").queryName(name)
             .option("checkpointLocation", tempfile.mkdtemp(prefix="quire-st1-ckpt-")).trigger(availableNow=True).start())
        q.awaitTermination(600)
        return sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name} WHERE k >= 0").collect())
    return run


def test_stream_equals_batch_with_idle_keys(spark):
    import datetime
    import random

    rng = random.Random(5)
    start, rows, n = datetime.datetime(2024, 1, 1), [], {}
    for b in range(6):
        for k in range(12):
            if rng.random() < 0.6:               # a key often skips whole micro-batches
                for _ in range(rng.randint(1, 5)):
                    n[k] = n.get(k, -1) + 1
                    rows.append((k, n[k], start + datetime.timedelta(hours=6 * b, seconds=n[k]), rng.choice(["T", "T", "U", "x", None]), b))
        rows.append((-1, b, start + datetime.timedelta(hours=6 * b + 1), "x", b))
    rows += [(0, 10 ** 6, start + datetime.timedelta(hours=40), "T", 6), (0, 10 ** 6 + 1, start + datetime.timedelta(hours=40, seconds=1), "x", 6)]
    rows += [(k, 10 ** 6 + 2, start + datetime.timedelta(hours=41), "x", 7) for k in n]      # ends every open match
    df = spark.createDataFrame(rows, "k long, i long, ts timestamp_ntz, a string, b int")
    run = _run_stream(spark, df, 8, "st1_out")
    for rules in ({"A": "T+", "B": "T U"}, {"A": "T T+", "B": "_+"}):
        batch = match_sequence(df.where("k >= 0"), "k", ["ts", "i"], "a", rules).collect()
        want = sorted(tuple(r) for r in batch)
        ended = [w for w in want if w[3] < max(x[3] for x in want if x[0] == w[0])] if "B" in rules and rules["B"] == "_+" else want
        got = run(rules)
        assert set(ended) <= set(got) <= set(want)
    limited = run({"A": "T+"}, idle_limit_ms=3 * 3600 * 1000)
    ends = [r for r in match_sequence(df.where("k >= 0"), "k", ["ts", "i"], "a", {"A": "T+"}).collect()]
    assert sum(r[3] - r[2] for r in limited) == sum(r.end - r.start for r in ends)    # same atoms, cut at pauses
    assert {(r[0], p) for r in limited for p in range(r[2], r[3])} == {(r.k, p) for r in ends for p in range(r.start, r.end)}


def test_pending_atoms_stay_few_and_are_final():
    import random

    from quire.streaming.sequence import Pending

    rng = random.Random(21)
    for rules in RULE_SETS + [{"All": "a+ b", "One": "a"}]:
        c = Compiled(rules)
        symbols = {a: n for n, a in enumerate([None, "", *c.atoms])}
        machine = c.machine(symbols)
        for _ in range(60):
            atoms = [rng.choice(["a", "b", "c", "d", None, "a", "a"]) for _ in range(rng.randint(0, 30))]
            pending, got, at = Pending(machine), [], 0
            while at < len(atoms):
                n = rng.randint(1, 4)
                pending.add([symbols.get(a, 1) for a in atoms[at:at + n]])
                got += list(pending.decided())
                pending = Pending(machine, pending.state, pending.begun, pending.base, pending.runs)
                at += n
            got += list(pending.decided(ended=True))
            assert [(list(rules)[r], s, e) for r, s, e in got] == _walk(rules, atoms)
    c = Compiled({"All": "a+ b", "One": "a", "Two": "c c+"})
    symbols = {a: n for n, a in enumerate([None, "", *c.atoms])}
    for atom, runs in (("a", 1), ("c", 1)):
        pending = Pending(c.machine(symbols))
        for _ in range(1000):
            pending.add([symbols[atom]] * 1000)
            assert list(pending.decided()) == [] and len(pending.runs) == runs
        assert pending.runs[0][1] == (1_000_000 if atom == "a" else 1)
        pending.add([symbols["b"]])
        assert list(pending.decided(True)) == ([(0, 0, 1_000_001)] if atom == "a" else [(2, 0, 1_000_000)])


def test_typed_lines_stream_equals_batch(spark):
    import random

    from quire.operators.blocks import typed_lines
    from quire.sources.lines import scan_lines
    from quire.streaming.lines import typed_lines_stream

    rng = random.Random(6)
    parts = ["# -- one two \n", "#\t--- x\n", "# note\n", "  # note é\n", "x = 1\n", "\n", "#--\n", "# -\n"]
    files = [(f"f{i}", "".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 25])))) for i in range(15)]
    lines = scan_lines(spark.createDataFrame(files, "path string, content string"))
    rows = [(r.path, r.number, r.text) for r in lines.collect()]
    src = tempfile.mkdtemp(prefix="quire-st2-")
    # most lines in order, some early, some twice
    batches = [[] for _ in range(6)]
    for path, number, text in rows:
        b = min(5, max(0, number // 5 + rng.choice([0, 0, 0, -1, 1])))
        batches[b].append((path, number, text))
        if rng.random() < 0.1:
            batches[min(5, b + 1)].append((path, number, text))
    for b, some in enumerate(batches):
        rng.shuffle(some)
        spark.createDataFrame(some, "path string, number long, text string").coalesce(1).write.parquet(os.path.join(src, f"b{b}"))
    flat = tempfile.mkdtemp(prefix="quire-st2-flat-")
    for b in range(6):
        for f in os.listdir(os.path.join(src, f"b{b}")):
            if f.endswith(".parquet"):
                os.link(os.path.join(src, f"b{b}", f), os.path.join(flat, f"part-{b:03d}.parquet"))
                os.utime(os.path.join(flat, f"part-{b:03d}.parquet"), (1000 + b, 1000 + b))
    stream = spark.readStream.schema("path string, number long, text string").option("maxFilesPerTrigger", 1).parquet(flat)
    q = (typed_lines_stream(stream).writeStream.outputMode("append").format("memory").queryName("st2_lines")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="quire-st2-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    names = ["path", "number", "text", "offset", "kind", "meta", "block_no", "starts"]
    got = sorted(tuple(r) for r in spark.sql(f"SELECT {', '.join(names)} FROM st2_lines").collect())
    want = sorted(tuple(r) for r in typed_lines(lines.drop("offset")).select(*names).collect())
    assert got == want and len(got) == len(rows)


def test_marks_stream_equals_batch(spark):
    rules = [("END_tag", "</[a-z]+>"), ("STA_tag", "<[a-z]+>"), ("word", r"\bx\b")]
    docs = spark.createDataFrame([(i, f"<a>x{i} x </a> é<b>" * i) for i in range(20)], "doc_id long, text string")
    src = tempfile.mkdtemp(prefix="quire-st2-")
    docs.repartition(3).write.mode("overwrite").parquet(src)
    stream = marks_stream(spark.readStream.schema(docs.schema).parquet(src), rules)
    q = (stream.writeStream.outputMode("append").format("memory").queryName("st2_out")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="quire-st2-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM st2_out").collect())
    assert got == sorted(tuple(r) for r in marks(docs, rules).collect()) and len(got) > 400
    with pytest.raises(ValueError):
        marks(docs, [("any", "x*")])


def _walk(rules, atoms, contiguous=True):
    """Plain search at each position: items greedy with backtracking, first rule wins."""
    parsed = [(n, [(t.rstrip("?+*"), t[-1] if t[-1] in "?+*" else "") for t in r.split()]) for n, r in rules.items()]
    firsts = {n: its[0][0] for n, its in parsed}

    def fits(rule, item, atom):
        if atom is None:
            return False
        return atom not in {f for m, f in firsts.items() if m != rule and f != "_"} if item == "_" else atom == item

    def ends(rule, items, at):
        if not items:
            yield at
            return
        (item, card), rest = items[0], items[1:]
        n = 0
        while at + n < len(atoms) and fits(rule, item, atoms[at + n]) and (n == 0 or card in ("+", "*")):
            n += 1
        for took in range(n, (0 if card in ("?", "*") else 1) - 1, -1):
            yield from ends(rule, rest, at + took)

    out, at = [], 0
    while at < len(atoms):
        hit = next(((n, e) for n, its in parsed for e in ends(n, its, at) if e > at), None)
        if hit:
            out.append((hit[0], at, hit[1]))
        at = hit[1] if hit else at + 1
    return out


RULE_SETS = [
    {"A": "a+", "B": "b c"}, {"A": "a+ b", "C": "c"}, {"A": "a a+", "B": "a"}, {"X": "a b? c*", "Y": "_+"}, {"X": "a* b", "Y": "c+"},
    {"M": "a? b*"}, {"A": "a b+", "B": "b+ c", "C": "_"}, {"A": "a+ a", "B": "b"}, {"A": "a b a+", "C": "c* b"}, {"A": "_+ a"},
]


def test_matches_equal_plain_search(spark):
    import random

    rng = random.Random(11)
    seqs = [[rng.choice(["a", "b", "c", "d", None, "a", "a"]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(k, i, a) for k, s in enumerate(seqs) for i, a in enumerate(s)], "k long, i long, a string")
    got = match_each(df, "k", ["i"], "a", {str(n): r for n, r in enumerate(RULE_SETS)}, partitions=6).collect()
    want = [(k, str(n), *m) for n, r in enumerate(RULE_SETS) for k, s in enumerate(seqs) for m in _walk(r, s)]
    assert sorted((r.k, r.machine, r.rule, r.start, r.end) for r in got) == sorted(want)


def test_null_atoms_break_a_match(spark):
    df = spark.createDataFrame([(0, 0, "T"), (0, 1, None), (0, 2, "T")], "k long, i long, a string")
    got = match_sequence(df, "k", ["i"], "a", {"M": "T+"}).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 1), (2, 3)]


def test_not_contiguous_and_empty(spark):
    assert [(r.start, r.end) for r in match_sequence(_atoms(spark, "T x T y T"), "k", ["i"], "a", {"M": "T+"}, contiguous=False).collect()] == [(0, 5)]
    got = match_sequence(_atoms(spark, "A T T A"), "k", ["i"], "a", {"M": "T*"}, emit_empty=True).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 0), (1, 3), (3, 3)]


def test_one_key_with_all_rows_keeps_runs_short(spark):
    long = spark.range(200000).selectExpr("0L AS k", "id AS i", "CASE WHEN id % 50000 = 49999 THEN 'stop' ELSE 'go' END AS a")
    got = match_sequence(long, "k", ["i"], "a", {"Run": "go+ stop", "Any": "_+"}, partitions=8).collect()
    assert sorted((r.rule, r.start, r.end) for r in got) == [("Run", n * 50000, (n + 1) * 50000) for n in range(4)]


def test_one_key_of_alternating_atoms_is_read_in_slices(spark):
    long = spark.range(1_000_000).selectExpr("0L AS k", "id AS i", "CASE WHEN id = 999999 THEN 'c' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS a")
    rules = {"Whole": "x a+", "Pair": "a b? c*", "Late": "b+ c"}
    got = match_sequence(long, "k", ["i"], "a", rules, partitions=8)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
    found = got.groupBy("rule").agg(F.count("*").alias("n"), F.sum("start").alias("s"), F.max("end").alias("e")).collect()
    assert {r.rule: (r.n, r.e) for r in found} == {"Pair": (500_000, 1_000_000)}
    # what the first atom belongs to is decided by the last
    ahead = spark.range(100_000).selectExpr("0L AS k", "id AS i", "CASE WHEN id = 99999 THEN 'c' ELSE 'a' END AS a")
    got = match_sequence(ahead, "k", ["i"], "a", {"All": "a+ c", "One": "a"}, partitions=8).collect()
    assert [(r.rule, r.start, r.end) for r in got] == [("All", 0, 100_000)]
    got = match_sequence(ahead, "k", ["i"], "a", {"All": "a+ b", "One": "a"}, partitions=8)
    assert got.where("rule = 'One' and end = start + 1").count() == 99_999 and got.count() == 99_999


def test_slices_of_all_sizes_not_contiguous_and_empty(spark):
    import random

    rng = random.Random(13)
    seqs = [[rng.choice(["a", "b", "c", "d", None, "a", "a"]) for _ in range(rng.randint(0, 30))] for _ in range(25)]
    df = spark.createDataFrame([(k, i, a) for k, s in enumerate(seqs) for i, a in enumerate(s)], "k long, i long, a string")
    machines = {str(n): r for n, r in enumerate(RULE_SETS)}
    want = []
    for n, r in enumerate(RULE_SETS):
        atoms = {t.rstrip("?+*") for x in r.values() for t in x.split()}
        usable = lambda a: a is not None and ("_" in atoms or a in atoms)
        empty = [m for m, x in r.items() if all(t[-1] in "?*" for t in x.split())]
        for k, s in enumerate(seqs):
            at = [i for i, a in enumerate(s) if usable(a)]
            hits = [(m, at[a], at[b - 1] + 1) for m, a, b in _walk(r, [s[i] for i in at])]
            covered = {p for _, a, b in hits for p in range(a, b)}
            want += [(k, str(n), *h) for h in hits] + [(k, str(n), empty[0], p, p) for p in range(len(s)) if empty and p not in covered]
    for partitions in (1, 40):
        got = match_each(df, "k", ["i"], "a", machines, partitions=partitions, contiguous=False, emit_empty=True).collect()
        assert sorted((r.k, r.machine, r.rule, r.start, r.end) for r in got) == sorted(want)
