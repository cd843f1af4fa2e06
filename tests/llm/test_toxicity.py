import random

from quire.llm import toxicity
from quire.llm.common import table

SF = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_equals_edit_distance():
    rng = random.Random(8)
    words = ["idiot", "scum", "worthless", "moron", "pathetic", "idiots"]
    trie = toxicity.FuzzyTrie(words, ["lowei", "veju"], ["moron"])
    tried = set()
    for term in words + ["lowei", "veju", "xlowei"]:
        for _ in range(150):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 1)] = rng.choice(["", "é", "o", "s", "i"])
            tried.add("".join(w))
    tried |= {"lowei" + s for s in ("", "schaft", "é")} | {"veju" * 2, ""}
    for w in tried:
        best = [(edits(w, t), t) for t in words if edits(w, t) <= trie.allowed[t]] + [(0, s) for s in ("lowei", "veju") if w.startswith(s)]
        found = trie.match(w)
        assert (found is None) == (not best), w
        if best:
            assert (found[1], found[0]) == min(best), w


def test_context_windows():
    trie = toxicity.FuzzyTrie(["idiot"], [])
    context = lambda text: [h[4] for h in toxicity.find_hits(text, trie, frozenset())]
    assert context("they called him an idiot in court") == ["quoted"]
    assert context('the sign read "no idiot here" and that was all') == ["quoted"]
    assert context("you idiot") == ["abuse"]
    assert context("idiot and idiot") == ["abuse", "abuse"]
    assert context("an idiot walked past") == ["plain"]
    assert toxicity.find_hits("An Idjot.", trie, frozenset()) == [(3, 8, "idiot", 1, "plain")]
    assert toxicity.find_hits("An Idjot.", trie, frozenset(["idjot"])) == []


def test_held_out_accuracy_and_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    assert {"idiot", "stupid", "worthless"} <= set(model.words)
    rows = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hit = [r for r in rows if r.hits]
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.toxic == 1 for r in hit)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id][h.start:h.end].lower() == h.term for r in hit for h in r.hits if not h.edits)


def test_corner_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "you idiot, stupid", 5), (2, "", 5), (3, "x" * 300000, 5),
                                  (4, "İdiot idiot", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model, carry=["score"]).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.rest.score == 5 for r in rows)
    model = toxicity.fit(docs, labels.filter("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0
    assert toxicity.fit(docs.filter("false"), labels).words == []
