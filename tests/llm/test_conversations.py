import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import conversations as c
from quire.llm.roles import CUT_OFF, FINE, GONE, Repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) over all edit sequences, by plain recursion over rows and the role initials so far."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, last, inserts):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            initial, role, text, fault = rows[i]
            def go(cost, letter, to, made):
                rest = best(i + 1, to, 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], made + rest[2]))
            go(2, "D", last, ())
            late = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if (last, initial) in step:
                    go(late, "K", step[last, initial], ((role, text),))
                for t, name in (("u", "user"), ("a", "assistant")):
                    if (last, t) in step:
                        go(late + 1, "R", t, ((name, text),))
        if inserts < 3:
            for t, name in (("u", "user"), ("a", "assistant")):
                if (last, t) in step and (rest := best(i, t, inserts + 1)):
                    found.append((5 + rest[0], "I" + rest[1], ((name, ""),) + rest[2]))
        return min(found, default=None, key=lambda f: f[:2])

    return best(0, "", 0)


def brute(table, damaged):
    out = []
    for conv in {r[0] for r in table}:
        rows = [r for r in table if r[0] == conv]
        if damaged:
            harmed = []
            for _, turn, role, text in rows:
                show = lambda v: " " if v is None else str(v)
                h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
                role, text = show(role), show(text)
                if h == 1:
                    text = ""
                if h == 2:
                    text = re.sub("[.!?]", "", text)
                if h == 4:
                    role = "user"
                harmed += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
            rows = harmed
        rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            core = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role[:1], role, text, fault))
        n = lambda kind: sum(m[3] == kind for m in marked)
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, made = cheapest(tuple(marked))
        illegal = sum((a[0], b[0]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(marked))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal,
                    cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(11)
    table = []
    for conv in [None, *range(120)]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "unknown", "User"])
            text = rnd.choice(["Yes.", "No!", "Why? ", "cut off", "cut", None, "", " \n", "long.. text\x0b", "é?"]) 
            table.append((conv, rnd.choice([turn, turn, 2 * turn, None]), role, text))
    return table + table[:5] + [(500, None, None, None), (501, 3, "system", "Only rules."), (502, 0, "user", "x " * 40000 + "?")]


def digest(frame, damaged):
    rows = c.damage(frame) if damaged else frame
    return sorted((tuple(r) for r in c.with_digest(frame, c.repair(rows)).collect()), key=str)


@pytest.mark.parametrize("damaged", [True, False])
def test_repairs_equal_plain_recursion(spark, damaged):
    table = cases()
    frame = spark.createDataFrame([(*r, 0) for r in table], SCHEMA + ", NUMBER int")
    assert digest(frame, damaged) == brute(table, damaged)
    assert digest(frame.filter("false"), damaged) == []


def test_one_long_conversation_in_many_slices(spark):
    rnd = random.Random(3)
    table = [(1, t, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice([f"t{rnd.randint(0, 99)}.", "", f"c{t}"])) for t in range(300)]
    table += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(table, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edits = c.repair(frame)
        assert edits.filter("conv_id = 1").select("_chunk").distinct().count() > 2
        assert sorted((tuple(r) for r in c.with_digest(frame, edits).collect()), key=str) == brute(table, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slice_maps_compose():
    rnd, repair = random.Random(9), Repair()
    for _ in range(200):
        rows = [(rnd.choice(["s", "u", "a", ""]), rnd.choice([FINE, FINE, CUT_OFF, GONE])) for _ in range(rnd.randint(1, 14))]
        whole = "".join("I" * len(p) + e for e, p, _ in repair.trace(rows)[0]) + "I" * len(repair.trace(rows)[1])
        cuts = sorted(rnd.sample(range(1, len(rows)), min(len(rows) - 1, 3)))
        parts = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        ways = repair.chain([repair.slice_map(p) for p in parts])
        audit = ""
        for i, (p, (entry, leave)) in enumerate(zip(parts, ways)):
            edits, closing = repair.trace(p, entry, leave, i == len(parts) - 1)
            audit += "".join("I" * len(x) + e for e, x, _ in edits) + "I" * len(closing)
        assert audit == whole


def test_steps_of_ordinary_rows_are_worked_out_once():
    repair = Repair()
    repair.trace([("s", FINE), *[("u", FINE), ("a", FINE), ("u", CUT_OFF), ("a", FINE)] * 5000])
    assert len(repair._steps) < 100
