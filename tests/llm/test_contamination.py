import hashlib
import random
import re

from quire.llm import contamination as c

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def brute(docs, items, size):
    wins = {}
    for item, text in items:
        w = re.findall(WORD, lower(text))
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, who = re.findall(WORD, lower(text)), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    who |= found
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(5)
    text = lambda n, k: "".join(rnd.choice("aBcÉ")[:1] * rnd.randint(1, 2) * 1 + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))[:k]
    items = [(i, text(rnd.choice([1, 2, 3, 5, 8, 12]), 200)) for i in range(12)]
    items += [(3, "other words of item three"), (None, "one two"), (20, None), (21, " .. "), (22, "A" * 3), (22, "A" * 3)]
    docs = [(i, text(rnd.choice([0, 1, 4, 30, 200]), 900)) for i in range(60)]
    docs += [(7, "x One, two; OTHER words of item three"), (None, "aaa"), (None, None), (8, ""), (8, "AAA " * 30000), (8, "AAA " * 30000)]
    return docs, items


def test_hits_equal_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "extra") for r in docs], "doc_id long, text string, N_WORDS string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, items int")
    for size in (3, 5):
        want = brute(docs, items, size)
        for block_bytes in (64 << 20, 4000):
            got = c.with_digest(c.contamination(d, b, size=size, block_bytes=block_bytes)).collect()
            assert sorted((tuple(r) for r in got), key=str) == want
    none = c.with_digest(c.contamination(d, b.filter("false")))
    assert none.filter("contaminated or n_items > 0").count() == 0 and none.count() == len(docs)
    assert c.contamination(d.filter("false"), b).count() == 0


def test_shift_table_skips_and_buckets_hold_last_blocks():
    table = c.WindowClass(4)
    table.add((b"a", b"b", b"c", b"d"), "1")
    table.add((b"c", b"d", b"e", b"f"), "2")
    assert table.skip == 3 and table.shift[(b"c", b"d")] == 0 and table.shift[(b"a", b"b")] == 2
    assert set(table.buckets) == {(b"c", b"d"), (b"e", b"f")}
    assert [(e, i) for e, i in table.find(b"x a b c d e f a".split())] == [(5, ["1"]), (7, ["2"])]


def test_one_block_moves_no_document(spark):
    docs, items = cases()
    plan = c.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
