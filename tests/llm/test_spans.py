import random

import xxhash

from quire.llm.spans import remove_repeats, runs_of, sentences_of


def signed(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def brute(rows, sentences=3, words=20):
    """All rows at once: hash-free comparison of every run's folded sentences."""
    first, out = {}, []
    runs = []
    rank = lambda doc, text: (doc is None, doc or 0, signed(text or ""))
    for n, (doc, text) in enumerate(rows):
        units = sentences_of(text or "")
        mine = []
        for i in range(len(units)):
            for j in range(i + sentences - 1, len(units)):
                if sum(u[3] for u in units[i:j + 1]) >= words:
                    mine.append((i, j, tuple(u[2] for u in units[i:j + 1])))
                    break
        runs.append((units, mine))
        for _, _, key in mine:
            ids = first.setdefault(key, set())
            ids.add(rank(doc, text))
    for (doc, text), (units, mine) in zip(rows, runs):
        seen, gone = set(), set()
        for i, j, key in mine:
            if key in seen or rank(doc, text) != min(first[key]):
                gone.update(range(i, j + 1))
            seen.add(key)
        kept = "".join(text[u[0]:u[1]] for n, u in enumerate(units) if n not in gone) if gone else text
        out.append((doc, kept, len(units), len(gone)))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def test_sentences_cover_the_text():
    for text in ["", "a", "...", "A b. C, d; e\n\nf", "。x！y", "no stop at all", "one.\n\n\ntwo!?  three", " , , a"]:
        units = sentences_of(text)
        assert "".join(text[u[0]:u[1]] for u in units) == text
        assert all(u[0] == p[1] for p, u in zip(units, units[1:]))
    assert list(runs_of(sentences_of("a b. c d."), 3, 1)) == []
    assert [(f, last) for f, last, _ in runs_of(sentences_of("a b. c d. e f. g h."), 2, 6)] == [(0, 2), (1, 3)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    passages = [prose(70) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng.randint(0, 40))]
        rows.append((rng.choice([i, i, i, i, 7, None]), " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "..."), (503, rows[0][1]), (503, rows[0][1]), (504, ("long words here, " * 20000))]
    rows += [(None, passages[0] + f" tail {i}") for i in range(30)] + [(7, passages[1] + f" tail {i}") for i in range(30)]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, removed string, Text int").repartition(5)
    got = sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in remove_repeats(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert sum(r[3] for r in got) > 200


def test_spans_carry_and_empty(spark):
    passage = "one two three four five six, seven eight nine ten eleven twelve; thirteen fourteen fifteen sixteen. " \
              "seventeen eighteen nineteen twenty and more."
    docs = spark.createDataFrame([(1, "Start here. " + passage, "a"), (2, "Other words, " + passage + " End.", "b")],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: r for r in remove_repeats(docs, carry=["source"]).collect()}
    assert got[1].n_removed == 0 and got[1].rest.source == "a"
    assert got[2].text == "Other words, End." and got[2].rest.source == "b"
    assert [(s.start, s.end) for s in got[2].removed] == [(13, 13 + len(passage) + 1)]
    assert remove_repeats(docs.filter("false")).count() == 0


def test_passages_pasted_into_sentences(spark):
    """51 words with 0, 1, 2 or many stops, pasted into running text, go from all but the first place."""
    rng, docs, limits = random.Random(8), [], {}
    for n in range(80):
        stops = rng.sample(range(5, 46), [0, 1, 2, 9][n % 4])
        passage = [f"p{n}x{rng.randrange(400)}" + "." * (i in stops) for i in range(51)]
        for copy in range(2):
            around = [f"d{n}c{copy}x{i}" for i in range(60)]
            docs.append((2 * n + copy, " ".join(around[:30] + passage + around[30:])))
            limits[2 * n + copy] = (around, passage)
    docs += [(1000, "start " + "the " * 51 + "end"), (1001, "begin " + "the " * 51 + "stop")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, (around, passage) in limits.items():
        left = got[doc].text.split()
        assert [w for w in left if w.startswith("d")] == around
        kept = len(left) - len(around)
        assert kept == 51 if doc % 2 == 0 else kept <= 31, (doc, passage, left)
    assert got[1001].text.split().count("the") < 31


def test_long_sentences_are_cut_by_content():
    rng = random.Random(3)
    for _ in range(300):
        words = [f"w{rng.randrange(rng.choice([1, 2, 5, 1000]))}" for _ in range(rng.randint(1, 90))]
        text = "  " + " \t".join(words) + " "
        units = sentences_of(text)
        assert "".join(text[u[0]:u[1]] for u in units) == text and b" ".join(u[2] for u in units).decode().split() == words
        assert all(0 < u[3] <= 8 for u in units)
        inner = sentences_of(" ".join([f"a{rng.randrange(99)}" for _ in range(40)] + words + ["z"] * 40))
        common = {u[2] for u in inner} & {u[2] for u in units}
        assert sum(u[3] for u in units if u[2] in common) >= len(words) - 4 * 8 + 4
