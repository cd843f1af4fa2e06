"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs that occur in more
than one place are found by one global join; the sentences covered by any
occurrence but the first are removed.

Sentences are cut fine, at every stop, comma, colon or line break, so that a
passage pasted into the middle of a sentence still has most of its sentences
whole.  One of ``WINDOW`` words or more is cut further, after the word of the
lowest rank in each window of so many words.  Where it is cut depends on no
word outside the window, so equal passages are cut alike wherever they stand,
and no piece has more than ``WINDOW`` words.  Of a passage of n words at least
n - 4 * ``WINDOW`` + 4 lie in whole common pieces, with or without stops.

A run starts at every sentence and is the shortest one of at least
``sentences`` sentences and ``words`` words: short sentences extend it, so
stock phrases of a few words do not count as a repeat.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, short_batches

BREAKS = ".!?,;:\n。！？，；：…"
_SENTENCE = re.compile(rf"[^{BREAKS}]*[{BREAKS}]+\s*|[^{BREAKS}]+\Z")
_WORD = re.compile(r"\S+")
#: Longest piece in words: 8 is the most that leaves 20 words of any 48 in whole pieces.
WINDOW = 8

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = "n_sentences long, n_removed long, removed array<struct<start: long, end: long>>"


class _Ranks(dict):
    """Rank of a word by its content alone; bare punctuation comes last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        rank = zlib.crc32(word.encode("utf-8", "surrogatepass")) if word.isalnum() or any(map(str.isalnum, word)) else 1 << 32
        self[word] = rank
        return rank


_rank = _Ranks().__getitem__


def cuts_of(words: list[str]) -> list[int]:
    """Where a sentence is cut further: the number of words before each cut, in order.

    Of each window the last word of the lowest rank ends a piece.
    """
    ranks, found, place, least = list(map(_rank, words)), [], -1, 0
    for last in range(WINDOW - 1, len(ranks)):
        if place <= last - WINDOW:
            window = ranks[last:last - WINDOW:-1] if last >= WINDOW else ranks[last::-1]
            least = min(window)
            place = last - window.index(least)
        elif ranks[last] <= least:
            place, least = last, ranks[last]
        else:
            continue
        found.append(place + 1)
    if found and found[-1] == len(words):
        found.pop()
    return found


def sentences_of(text: str) -> list[tuple[int, int, bytes, int]]:
    """``(start, end, folded text, words)`` of each sentence, long ones in pieces; together they cover the text.

    Folding lower-cases and joins words with one space; a sentence without a word
    (bare punctuation) belongs to the one before it.
    """
    found: list[tuple[int, int, bytes, int]] = []
    begin = 0
    for m in _SENTENCE.finditer(text):
        lowered, end = m.group().lower(), m.end()
        words = lowered.split()
        folded = " ".join(words)
        if folded[:1].isalnum() or any(map(str.isalnum, folded)) or not found:
            cuts = cuts_of(words) if len(words) >= WINDOW else None
            if cuts:
                plain = len(lowered) == end - begin and lowered.startswith(folded)
                starts = None if plain else [w.start() for w in _WORD.finditer(text, begin, end)]
                done = 0
                for cut in cuts:
                    folded = " ".join(words[done:cut])
                    after = begin + len(folded) + 1 if plain else starts[cut]
                    found.append((begin, after, folded.encode(), cut - done))
                    begin, done = after, cut
                words = words[done:]
                folded = " ".join(words)
            found.append((begin, end, folded.encode(), len(words)))
        else:
            found[-1] = (found[-1][0], end, *found[-1][2:])
        begin = end
    return found


def runs_of(units: list[tuple[int, int, bytes, int]], sentences: int, words: int) -> Iterator[tuple[int, int, bytes]]:
    """``(first, last, hash)`` of the run starting at each sentence, while one fits."""
    folded = [u[2] for u in units]
    buffer, at = b"\n".join(folded), []
    place = 0
    for f in folded:
        at.append(place)
        place += len(f) + 1
    last, have = -1, 0
    for first in range(len(units)):
        while last - first + 1 < sentences or have < words:
            last += 1
            if last >= len(units):
                return
            have += units[last][3]
        yield first, last, xxhash.xxh3_128_digest(buffer[at[first]:at[last] + len(folded[last])])
        have -= units[first][3]


def _halves(hashes: list[bytes]) -> np.ndarray:
    """High and low half of each 128-bit hash as signed numbers."""
    return np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)


#: Runs a task compares among themselves before it sends them on.
HELD_RUNS = 1 << 19


def repeated_runs(rows: DataFrame, sentences: int, words: int) -> DataFrame:
    """``doc_id, row_key, hashes``: per document the runs (low halves of their hashes) that an earlier document has too.

    A document is ``(doc_id, row_key)``, and documents are in that order, those without an id last.
    A task first compares the runs it has itself: of a run in several of its documents, only the first one's goes on to be
    compared, the others are repeats already and are dealt by document.  So a run that a third of all documents
    share is one row a task, and one exchange serves for finding the first place and for marking the others.
    """
    def settled(parts):
        docs = pa.Table.from_batches([d for d, _, _ in parts])
        order = pc.sort_indices(docs, [("doc_id", "ascending"), ("row_key", "ascending")], null_placement="at_end").to_numpy()
        sorted_docs = docs.take(pa.array(order))
        rank = np.zeros(len(order), np.int64)
        if len(order) > 1:
            same = np.ones(len(order) - 1, bool)
            for c in sorted_docs.columns:
                a, b = c.slice(0, len(order) - 1).combine_chunks(), c.slice(1).combine_chunks()
                alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                same &= alike.to_numpy(zero_copy_only=False).astype(bool)
            rank[order] = np.concatenate([[0], np.cumsum(~same)])
        offsets = np.cumsum([0, *[len(d) for d, _, _ in parts]])
        doc = np.concatenate([np.repeat(np.arange(len(counts)), counts) + at for (_, counts, _), at in zip(parts, offsets)])
        halves = np.concatenate([h for _, _, h in parts])
        by = np.lexsort((rank[doc], halves[:, 1], halves[:, 0]))
        doc, halves = doc[by], halves[by]
        if not len(doc):
            return
        new = np.concatenate([[True], (halves[1:] != halves[:-1]).any(axis=1)])
        first = rank[doc][np.flatnonzero(new)][np.cumsum(new) - 1]
        again = rank[doc] != first
        kept = new | again          # a row that repeats an id and a text adds nothing
        for i in range(0, len(kept), 1 << 16):
            at = np.flatnonzero(kept[i:i + (1 << 16)]) + i
            of = docs.take(pa.array(doc[at])).combine_chunks()
            yield pa.RecordBatch.from_arrays([of["doc_id"].combine_chunks(), of["row_key"].combine_chunks(), pa.array(halves[at, 0]), pa.array(halves[at, 1]),
                                              pa.array(again[at])], names=["doc_id", "row_key", "high", "low", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            counts, hashes = [], []
            for text in batch.column("text"):
                mine = {h for _, _, h in runs_of(sentences_of(text.as_py() or ""), sentences, words)}
                counts.append(len(mine))
                hashes += mine
            held.append((batch.select(["doc_id", "row_key"]), counts, _halves(hashes)))
            size += len(hashes)
            if size >= HELD_RUNS:
                yield from settled(held)
                held, size = [], 0
        if held:
            yield from settled(held)

    kind = rows.schema["doc_id"].dataType.simpleString()
    runs = rows.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {kind}, row_key bigint, high bigint, low bigint, again boolean")
    # repeats that are known are dealt by document, each a group of its own
    runs = runs.select("doc_id", "row_key", "high", "low", F.when(F.col("again"), F.xxhash64("doc_id", "row_key")).alias("apart"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = F.min(own).over(Window.partitionBy("apart", "high", "low"))
    again = runs.withColumn("first", first).filter(F.col("apart").isNotNull() | ~own.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "row_key").agg(F.collect_set("low").alias("hashes"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3,
                   words: int = 20, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, text, n_sentences, n_removed, removed``.

    ``text`` is what remains, ``removed`` the removed spans as character offsets
    of the input text.  Of a run found in several documents the one with the
    smallest id keeps it (rows that share an id: the smallest hash of the text); inside one
    document the earliest place does.  Only hashes and ids are shuffled to find
    repeats, a run once per document, and of a run that many documents share
    once per task.  A document's own list of repeated runs is no longer than the document.

    ``carry`` names further input columns to hand through in a struct ``rest``.

    * null text: stays null, no sentence; empty text: no sentence;
    * null id: never first unless every document with the run lacks an id, then the
      smallest hash of the text is;
    * repeated rows: rows with one id and one text are one document and get one answer, so a run
      they share with each other only is kept in all of them; rows that share an id only are documents of their own;
    * very long texts are cut and compared whole;
    * empty table: no rows.  Columns not named are ignored.
    """
    short_batches(docs.sparkSession)
    names = {f"r{i}": n for i, n in enumerate(carry or [])}
    rows = pick(docs, doc_id=id_col, text=text_col, **names).withColumn("row_key", F.xxhash64("text"))
    again = repeated_runs(rows, sentences, words).withColumnsRenamed({"doc_id": "again_id", "row_key": "again_key"})
    rest = [F.struct(*[F.col(a).alias(n) for a, n in names.items()]).alias("rest")] if names else []
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("row_key") == F.col("again_key"))
    joined = rows.select("doc_id", "row_key", "text", *rest).join(again, same, "left").drop("row_key", "again_id", "again_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, spans = [], [], [], []
            for text, hashes in zip(batch.column("text"), batch.column("hashes")):
                text, listed = text.as_py(), {low.to_bytes(8, "big", signed=True) for low in hashes.as_py() or ()}
                units, seen, drop, covered = sentences_of(text or ""), set(), [], 0
                for first, last, value in runs_of(units, sentences, words):
                    if value in seen or value[8:] in listed:
                        drop += range(max(first, covered), last + 1)
                        covered = max(covered, last + 1)
                    seen.add(value)
                dropped, pieces = set(drop), []
                for n in drop:
                    if pieces and pieces[-1]["end"] == units[n][0]:
                        pieces[-1]["end"] = units[n][1]
                    else:
                        pieces.append({"start": units[n][0], "end": units[n][1]})
                texts.append("".join(text[u[0]:u[1]] for n, u in enumerate(units) if n not in dropped) if dropped else text)
                counts.append(len(units))
                gone.append(len(dropped))
                spans.append(pieces)
            out = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                   pa.array(gone, pa.int64()), pa.array(spans, pa.list_(SPAN))]
            label = ["doc_id", "text", "n_sentences", "n_removed", "removed"]
            if names:
                out.append(batch.column("rest"))
                label.append("rest")
            yield pa.RecordBatch.from_arrays(out, names=label)

    schema = joined.schema
    tail = f", rest {schema['rest'].dataType.simpleString()}" if names else ""
    return joined.mapInArrow(run, f"doc_id {schema['doc_id'].dataType.simpleString()}, text string, {RESULT}{tail}")
