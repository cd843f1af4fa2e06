import random
import re
from collections import Counter

import numpy as np

from quire.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string, A int"


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def brute(rows, longest, threshold, inside, top):
    f, n = Counter(), Counter()
    for _, lang, text, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = {}
    for (lang, w), a in cand.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        over = [b for (other, v), b in cand.items() if other == lang and len(v) > len(w)
                and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= inside * a for b in over):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def cases():
    rnd = random.Random(2)
    rows = []
    for i in range(150):
        words = [rnd.choice(["The", "of", "naïve", "naïve cat sat", "x", "Ünder", "漢字", "\x1c", "a b"]) + rnd.choice(
            [" ", " ", "  ", "\t", ", ", ".", "\n", "!\r\n"]) for _ in range(rnd.choice([0, 3, 20, 120]))]
        rows.append((i, rnd.choice(["en", "fr", None, "und"]), "".join(words), 1))
    return rows + rows[:3] + [(None, "de", None, 2), (1, "de", "", 2), (2, "de", "ja nein " * 20000, 2), (3, "en", " .\t,", 2)]


def test_collocations_equal_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for longest, threshold, inside, top in ((5, 6, 100, 2000), (3, 2, 60, 4)):
        got = c.collocations(docs, longest=longest, threshold=threshold, inside=inside, top=top, filter_bits=18)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, longest, threshold, inside, top)
    assert c.collocations(docs.filter("false")).count() == 0
    assert c.collocations(docs, threshold=10 ** 6).count() == 0


def test_full_filters_lose_nothing(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = c.collocations(docs, threshold=6, filter_bits=6)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 6, 100, 2000)


def test_large_numbers_are_exact(spark):
    big = 9 * 10 ** 14
    x = spark.createDataFrame([(big, 10 ** 17, big + 1, big + 2)], "a long, n long, l long, r long")
    text = "div(1000BD * cast(a as decimal(15,0)) * cast(n as decimal(18,0)), cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    assert x.selectExpr(text).first()[0] == 1000 * big * 10 ** 17 // ((big + 1) * (big + 2))


def test_summaries_keep_every_frequent_key_in_bounded_room():
    rnd = np.random.default_rng(4)
    threshold = 50
    keys = np.concatenate([rnd.integers(0, 1 << 62, 300_000), np.repeat(rnd.integers(0, 1 << 62, 40), rnd.integers(50, 400, 40))]).astype(np.uint64)
    rnd.shuffle(keys)
    mass = len(keys)
    whole = c.MisraGries(mass // threshold + 1)
    for part in np.array_split(keys, 37):
        local = c.MisraGries(mass // threshold + 1)
        local.add(*np.unique(part, return_counts=True))
        local.merge()
        whole.add(local.keys, local.counts, local.taken)
        whole.merge()
        assert len(whole.keys) <= whole.capacity
    assert whole.taken < threshold
    true, n = np.unique(keys, return_counts=True)
    assert np.isin(true[n >= threshold], whole.frequent(threshold)).all()


def test_blocks_join_what_a_task_reads(spark):
    import pyarrow as pa

    texts = [b"A b, c", b"", b"d " * 10, b"\xc3\xa9 e."]
    batch = pa.record_batch([pa.array(["x", "x", "y", "x"]), pa.array(texts)], names=["lang", "text"])
    found = list(c.blocks([batch, batch], size=8))
    words = [b.words[i] for b in found for i in b.ids]
    assert words == 2 * [b"a", b"b", c.END, b"c", c.END, *[b"d"] * 10, c.END, b"\xc3\xa9", b"e", c.END, c.END]
    assert len(found) > 1 and all(len(b.ids) == len(b.lang) for b in found)


def test_keys_pack_and_unpack():
    rnd = np.random.default_rng(1)
    for n, high in ((0, 10), (1, 1 << 48), (2, 1 << 63), (1000, 1 << 20), (1000, 1 << 48)):
        keys = np.unique(rnd.integers(0, high, n).astype(np.uint64))
        assert (c.unpack(c.pack(keys)) == keys).all()


def test_counts_that_do_not_fit_are_added_up(spark, monkeypatch):
    rows = cases()
    monkeypatch.setattr(c, "HELD_COUNTS", 3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = c.collocations(docs, threshold=6, filter_bits=12)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 6, 100, 2000)
