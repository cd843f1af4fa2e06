"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file: a normaliser (dummy prefix,
spaces to U+2581), one arc for each piece in a letter trie, and byte fallback
for letters without a piece.  A text is composed with it into a lattice over
its positions, and the shortest path in the tropical semiring gives the ids.

For a unigram model an arc weighs the negated score of its piece.  For a BPE
model scores are merge ranks, not path weights, so the path with the best sum
is not what merging yields; there the transducer's state also remembers the
last piece and has an arc only to pieces that may follow it.  Two pieces may
follow each other if merging their joint text leaves exactly these two.  A
piece sequence is the result of merging if and only if all its neighbours may
follow each other, so each prefix has one accepting path, and arcs of equal
weight lead to the ids that merging gives.

Texts are composed piecewise: where no piece of the vocabulary can span two
letters, every path passes a boundary, so segments between such boundaries are
independent and the paths of frequent ones are remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches

SPACE = "▁"
LETTERS = "A-Za-zÀ-ɏ"
STOPS = ",.;:!?\n"
INFINITE = float("inf")


class Transducer:
    """Compiled normaliser, pieces and byte fallback of a SentencePiece model."""

    MOST_PATHS = 300_000  # remembered segments; they are forgotten, and composed again, beyond that

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, merging: bool,
                 dummy_prefix: bool = True):
        """``pieces`` maps text to id and score; ``byte_ids`` are the 256 byte pieces, if there are any."""
        self.byte_ids, self.unknown, self.merging, self.dummy_prefix = byte_ids, unknown, merging, dummy_prefix
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.rank = {p: -s for p, (_, s) in pieces.items()}
        self.last_merge: dict[str, tuple[str, str] | None] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.paths: dict[str, tuple[int, ...]] = {}
        self.fallback_weight = max(self.rank.values(), default=0.0) + 10.0
        self.trie: dict = {}
        for piece in pieces:
            if merging and len(piece) > 1 and not self._merge_of(piece):
                continue
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[None] = piece
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        stopped = any(re.search(f"[{LETTERS}][{STOPS}]", p) for p in pieces)
        words = "" if stopped else f"{SPACE}*[{LETTERS}]+(?=[{STOPS}{SPACE}]|\\Z)|"
        self.segments = None if inner else re.compile(f"{words}{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def load(cls, path: str, merging: bool = True) -> Transducer:
        """Compile a model file (its vocabulary is read through the sentencepiece library)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text = {i: model.id_to_piece(i) for i in range(size)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        bytes_of = {int(text[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        byte_ids = [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None
        return cls({text[i]: (i, model.get_score(i)) for i in plain}, byte_ids, model.unk_id(), merging)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def _merge_of(self, symbol: str) -> tuple[str, str] | None:
        """The last merge that makes a symbol out of its letters; None if merging ends elsewhere or it is one letter."""
        if symbol not in self.last_merge:
            parts = list(symbol)
            last = None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, INFINITE) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == INFINITE:
                    last = None
                    break
                at = ranks.index(best)
                last = (parts[at], parts[at + 1])
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.last_merge[symbol] = last
        return self.last_merge[symbol]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two symbols leaves exactly these two.

        Follows the symbols that stood at the boundary while both were being
        merged: a pair of them merges across it if its rank comes before the
        merges that consume either (at equal ranks the one further left first).
        """
        known = self.follows.setdefault(left, {})
        if right not in known:
            known[right] = self._keep_apart(left, right)
        return known[right]

    def _keep_apart(self, left: str, right: str) -> bool:
        a, a_ends = left, INFINITE
        while True:
            b, b_ends = right, INFINITE
            while True:
                rank = self.rank.get(a + b, INFINITE)
                if rank < a_ends and rank <= b_ends and rank < INFINITE:
                    return False
                merge = self._merge_of(b)
                if merge is None:
                    break
                b, b_ends = merge[0], self.rank[b]
            merge = self._merge_of(a)
            if merge is None:
                return True
            a, a_ends = merge[1], self.rank[a]

    def arcs(self, text: str, at: int) -> list[str]:
        """Symbols consumed by the arcs of the composition at a position, shortest first.

        A letter without a piece of its own has one arc, its byte fallback.
        """
        found, node = [], self.trie
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if None in node:
                found.append(node[None])
        if not found or len(found[0]) > 1:
            found.insert(0, text[at])
        return found

    def ids_of(self, symbol: str) -> tuple[int, ...]:
        if symbol in self.ids:
            return (self.ids[symbol],)
        return tuple(self.byte_ids[b] for b in symbol.encode()) if self.byte_ids else (self.unknown,)

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids along the shortest path of the composition with a normalised text."""
        symbols = self._only_path(text) if self.merging else self._least_path(text)
        return tuple(i for s in symbols for i in self.ids_of(s))

    def _least_path(self, text: str) -> list[str]:
        """Least sum of weights, by one pass over the positions."""
        best: list[tuple[float, str]] = [(0.0, "")] + [(INFINITE, "")] * len(text)
        for at in range(len(text)):
            for symbol in self.arcs(text, at):
                end, total = at + len(symbol), best[at][0] + self.rank.get(symbol, self.fallback_weight)
                if total < best[end][0]:
                    best[end] = (total, symbol)
        path, at = [], len(text)
        while at > 0:
            path.append(best[at][1])
            at -= len(path[-1])
        return path[::-1]

    def _only_path(self, text: str) -> list[str]:
        """The one accepting path of a merging model, depth first with the longest arc first.

        The path to a position is the only one to it, so a position from which
        the search comes back is given up for good: time stays linear.
        """
        size, follows, may_follow = len(text), self.follows, self.may_follow
        path, place, open_arcs = [], [0], [self.arcs(text, 0)]
        given_up = bytearray(size + 1)
        while place[-1] < size:
            arcs, at = open_arcs[-1], place[-1]
            known = follows.get(path[-1], {}) if path else None
            while arcs:
                symbol = arcs.pop()
                end = at + len(symbol)
                if given_up[end]:
                    continue
                if known is not None:
                    fits = known.get(symbol)
                    if not (may_follow(path[-1], symbol) if fits is None else fits):
                        continue
                path.append(symbol)
                place.append(end)
                if end < size:
                    open_arcs.append(self.arcs(text, end))
                break
            else:
                given_up[at] = 1
                path.pop(), place.pop(), open_arcs.pop()
        return path

    def encode(self, text: str) -> list[int]:
        normal = self.normalise(text)
        parts = self.segments.findall(normal) if self.segments else [normal] if normal else []
        ids, paths = [], self.paths
        for part in parts:
            path = paths.get(part)
            if path is None:
                path = self.shortest_path(part)
                if len(part) <= 64:
                    if len(paths) >= self.MOST_PATHS:
                        paths.clear()
                        self.follows.clear()
                    paths[part] = path
            ids += path
        return ids


class Decoder:
    """The inverse relation: pieces to text, byte pieces to bytes, without the dummy prefix."""

    def __init__(self, transducer: Transducer, size: int):
        self.text = [b""] * size
        for piece, number in transducer.ids.items():
            self.text[number] = piece.replace(SPACE, " ").encode()
        for byte, number in enumerate(transducer.byte_ids or ()):
            self.text[number] = bytes([byte])
        self.text[transducer.unknown] = " ⁇ ".encode()
        self.dummy_prefix = transducer.dummy_prefix

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.text.__getitem__, ids))
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_compiled: dict[tuple[str, bool], tuple[Transducer, Decoder]] = {}


def compiled(path: str, merging: bool) -> tuple[Transducer, Decoder]:
    """Transducer and decoder of a model file, compiled once per Python worker."""
    if (path, merging) not in _compiled:
        transducer = Transducer.load(path, merging)
        size = 1 + max([*transducer.ids.values(), *(transducer.byte_ids or ()), transducer.unknown])
        _compiled[path, merging] = (transducer, Decoder(transducer, size))
    return _compiled[path, merging]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", merging: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_ids, n_byte_ids, ids, text_crc32``.

    ``model`` is a file that every executor can open, ``merging`` says that it
    is a BPE model.  ``ids`` are little-endian unsigned 32-bit numbers;
    ``text_crc32`` is the checksum of the text with U+2581 read as a space,
    which is what decoding gives back.

    * null or empty text: no ids; null id and repeated rows: each on its own;
    * empty table: no rows.  Other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, _ = compiled(model, merging)
        is_byte = np.zeros(1 + max([*transducer.ids.values(), *(transducer.byte_ids or (0,)), transducer.unknown]), bool)
        is_byte[list(transducer.byte_ids or ())] = True
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            ids = [np.array(transducer.encode(t), "<u4") for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                pa.array([zlib.crc32(t.replace(SPACE, " ").encode()) for t in texts], pa.int64()),
            ], names=["doc_id", "n_ids", "n_byte_ids", "ids", "text_crc32"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids long, n_byte_ids long, ids binary, text_crc32 long")


def decode_ids(encoded: DataFrame, model: str, merging: bool = True) -> DataFrame:
    """The columns of ``encoded`` and ``text``, decoded from its ``ids``; null ids give a null text."""
    short_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = compiled(model, merging)
        for batch in batches:
            texts = [None if (i := x.as_py()) is None else decoder.decode(np.frombuffer(i, "<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    back = decode_ids(encode_texts(docs, model, id_col, text_col), model)
    return back.select("doc_id", "n_ids", "n_byte_ids", F.crc32("ids").alias("ids_crc32"),
                       (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"), "ids")
