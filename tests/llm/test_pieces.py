import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quire.llm import pieces
from quire.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "e", "t", "h", "th", "in", "ing", " ", "  ", "\n", "é", "▁", "漢", "字", "😀", ".", ",", "...", "','", "</", "aaaa",
            "123", "_", "\t", "<s>", "<0x41>", "ſ", "ﬁ", "́", "==", '")', " " * 15, "\x00", "Version 2.0"]


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_equal_the_library(reference):
    transducer, decoder = pieces.compiled(MODEL, True)
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        ids = reference.encode(text)
        assert transducer.encode(text) == ids, text
        assert decoder.decode(ids) == reference.decode(ids), text
    for text in ["a" * 20000, "漢" * 5000, " " * 3000, "😀" * 500, "ab" * 9000 + " é"]:
        assert transducer.encode(text) == reference.encode(text)
    broken = [rng.randrange(3, 32000) for _ in range(300)]
    assert decoder.decode(broken) == reference.decode(broken)


def test_merging_equals_naive_merging():
    rng = random.Random(3)
    for _ in range(40):
        symbols, made = list("abc"), {}
        for rank in range(14):
            piece = rng.choice(symbols) + rng.choice(symbols)
            if piece not in made and len(piece) <= 6:
                made[piece] = (3 + rank, -float(3 + rank))
                symbols.append(piece)
        vocabulary = {c: (n, -100.0 - n) for n, c in enumerate("abc")} | made
        transducer = pieces.Transducer(vocabulary, None, 99, True, dummy_prefix=False)
        for text in map("".join, product("abc", repeat=6)):
            parts = list(text)
            while True:
                scores = [made.get(x + y, (0, -1e9))[1] for x, y in zip(parts, parts[1:])]
                if not scores or max(scores) == -1e9:
                    break
                at = scores.index(max(scores))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            assert transducer.encode(text) == [vocabulary[x][0] for x in parts], (text, made)


def test_unigram_path_is_the_least_sum():
    rng = random.Random(7)
    vocabulary = {p: (n, -round(rng.uniform(1, 9), 3)) for n, p in enumerate(["a", "b", "ab", "ba", "aab", "bab", "abba", "bb"])}
    transducer = pieces.Transducer(vocabulary, None, 99, False, dummy_prefix=False)

    def cuts(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in vocabulary:
                for rest in cuts(text[n:]):
                    yield [text[:n], *rest]
    for text in map("".join, product("ab", repeat=8)):
        weigh = lambda path: sum(-vocabulary[p][1] for p in path)
        ids = transducer.encode(text)
        names = {n: p for p, (n, _) in vocabulary.items()}
        assert abs(weigh([names[i] for i in ids]) - min(map(weigh, cuts(text)))) < 1e-9
    assert transducer.encode("axb") == [0, 99, 1]


def test_round_trip_of_the_table_and_corner_rows(spark, reference):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pieces.round_trip(docs, MODEL).collect()
    assert len(rows) == len(text) and all(r.round_trip for r in rows)
    for r in rows[::7]:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == reference.encode(text[r.doc_id]) and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "▁x y", 0), (2, "", 0), (3, "z" * 300000, 0)], "doc_id long, text string, IDS int")
    got = pieces.round_trip(odd, MODEL).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert [r.n_ids for r in got if r.doc_id in (1, 2)] == [0, 0, 0]
    assert pieces.round_trip(odd.filter("false"), MODEL).count() == 0
