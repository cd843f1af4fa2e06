import hashlib
import re
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import exact, packing

ROWS = [(4, "a  b", 1), (2, "a\tb", 2), (7, "a b", 3), (7, "a b", 3), (5, None, 4), (6, "", 5), (None, "a b", 6),
        (None, "solo", 7), (9, "A b", 8), (10, " a b", 9), (11, "x<|endoftext|>y é 漢字 \n\n  z", 10), (12, "word " * 40000, 11)]
SCHEMA = "doc_id long, text string, KEPT int"


def test_exact_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    folded = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in ROWS]
    want = []
    for i, t in folded:
        ids = [j for j, u in folded if u == t]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_groups(docs.filter("false")).count() == 0
    assert "Python" not in exact.exact_groups(docs)._jdf.queryExecution().toString()


def test_pack_ids_places_and_cuts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=64, open_bins=8)
    rows = packing.with_digest(pieces).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text, _ in ROWS:
        if doc in (None, 7):
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(q.length for q in mine[:n]) for n in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 64 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start:r.start + r.length]))
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(docs.filter("false"), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_bins_choose_least_space_and_close_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)           # least sufficient space
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)           # two open already (4 and 5 free): the fullest, bin 0, closes
    assert bins.place(5) == (2, 5)
    assert bins.place(2) == (3, 8)
    assert bins.bits == 0 and bins.open == 0


def test_pack_very_long_white_space(spark):
    texts = ["a" + " " * 2_000_000 + "b <|endoftext|> c", "\n" * 1_000_000 + "end", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in enumerate(texts):
        mine = sorted((r.piece, bytes(r.ids)) for r in rows if r.doc_id == doc)
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert b"".join(b for _, b in mine) == struct.pack(f"<{len(ids)}I", *ids)


def test_both_tokenizers_agree_on_white_space():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for text in ["x" + " " * 1000 + "y", "\t \n" * 700 + "z", "\u3000" * 500 + " a", " " * 999, "<|endoftext|> \n  b"]:
        assert packing.encode(path, text).tolist() == packing.whole_bpe(path).encode(text, add_special_tokens=False).ids
