"""Best-fit packing: tokenised documents into fixed-length sequences, in bounded space.

Each task tokenises its rows and packs them as they come: a fixed number of
open bins, kept in a bitset keyed by free space.  A piece goes to the open bin
with the least sufficient space; when none fits and the bins are used up, the
fullest is closed.  A bin is only a number and a free length, so tokens are
never held back: a row leaves the task as soon as its place is known.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches

#: Fixed values of the tokenizer: its pre-tokenisation pattern and special token.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict = {}


def byte_bpe(path: str):
    """Encoder for a byte-level BPE rank file, loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def whole_bpe(path: str):
    """The tokenizer in JSON form beside a rank file, loaded when the first text needs it."""
    path = os.path.splitext(path)[0] + ".json"
    if path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def encode(path: str, text: str) -> np.ndarray:
    """Token ids of a text.

    The expression engine of the rank file's encoder gives up on white space of
    hundreds of thousands of characters; the JSON form takes such texts and
    gives the same ids.
    """
    try:
        return byte_bpe(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(whole_bpe(path).encode(text, add_special_tokens=False).ids, np.uint32)


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of ``length`` (1 to capacity)."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than the capacity."""
    start = length % capacity
    if start:
        yield 0, start
    for at in range(start, length, capacity):
        yield at, capacity


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
         end_id: int = 2, open_bins: int = 4096) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, sequence_id, offset, ids``.

    ``vocabulary`` is a byte-level BPE rank file that every executor can open,
    with the same tokenizer in JSON form beside it (``.json``);
    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    numbers (the real sequences are the pieces of a ``sequence_id`` in order
    of ``offset``, without gaps).  A document is its ids followed by
    ``end_id``; only documents longer than ``capacity`` are cut.  Rows of one
    Arrow batch are placed longest first, which leaves fewer gaps; bins stay
    open across the batches of a task.  There is no shuffle, and a rerun task
    repeats the same numbers.

    * null or empty text: one piece holding ``end_id`` alone;
    * null id, repeated rows: packed like any other row, each on its own;
    * empty table: no rows.  Other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            tokens, pieces = [], []
            for row, text in enumerate(batch.column("text")):
                ids = encode(vocabulary, text.as_py() or "")
                tokens.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                pieces += [(size, row, n, start) for n, (start, size) in enumerate(cuts(len(tokens[-1]), capacity))]
            pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
            places = [bins.place(p[0]) for p in pieces]
            rows = [p[1] for p in pieces]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array([p[2] for p in pieces], pa.int32()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([p[0] for p in pieces], pa.int64()),
                pa.array([base + number for number, _ in places], pa.int64()),
                pa.array([offset for _, offset in places], pa.int64()),
                pa.array([tokens[r][s:s + size].tobytes() for size, r, _, s in pieces], pa.binary()),
            ], names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, sequence_id long, "
                                "offset long, ids binary")


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
