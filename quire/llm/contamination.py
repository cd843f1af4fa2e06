"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of ``size`` consecutive words of the benchmark
items; an item with fewer words is one window of its own length.  Windows of
one length form a class with

* a shift table from blocks of two words (one, for windows of one word) to the
  distance between the block's last place in any window and the window's end:
  a text position whose block is in no window moves on by the whole window less
  the block, so most words of a clean text are never looked at;
* buckets of windows under their last block, the only block with shift 0.  The
  words before the position are compared with the windows of its bucket.

Windows come to the driver and go to the tasks in blocks of a stated number of
bytes, so the benchmark may be of any size: documents are read once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, short_batches, text_key

#: Fixed value: what is not part of a word, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: other characters have bytes from 0x80 on only.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Memory that a window takes in a task's tables besides its text.
ENTRY_BYTES = 600
FOUND = "doc_id {id}, copy string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``(item, n, window)``: the distinct windows of every item, words joined by a space."""
    rows = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i")
    each = rows.select("item", "w", start).select("item", F.slice("w", F.col("i") + 1, F.lit(size)).alias("w"))
    return each.select("item", F.size("w").alias("n"), F.array_join("w", " ").alias("window")).distinct()


class WindowClass:
    """Wu-Manber tables of the windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[str]]] = {}

    def add(self, window: tuple, item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = window[end - self.block:end]
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
        self.buckets.setdefault(window[-self.block:], {}).setdefault(window, []).append(item)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """``(end, items)`` of every occurrence, ends ascending; ``end`` is exclusive."""
        shift, skip, block, length, n = self.shift.get, self.skip, self.block, self.length, len(text)
        end = length
        while end <= n:
            last = (text[end - 2], text[end - 1]) if block == 2 else (text[end - 1],)
            far = shift(last, skip)
            if far:
                end += far
                continue
            items = self.buckets[last].get(tuple(text[end - length:end]))
            if items:
                yield end, items
            end += 1


def compile_windows(rows: list[tuple[str, int, str]]) -> list[WindowClass]:
    """Tables for ``(item, n, window)`` rows, one class a length."""
    classes: dict[int, WindowClass] = {}
    for item, n, window in rows:
        classes.setdefault(n, WindowClass(n)).add(tuple(window.encode().split(b" ")), item)
    return [classes[n] for n in sorted(classes)]


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Union of word ranges as disjoint ranges, ascending."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def _search(docs: DataFrame, rows: list[tuple[str, int, str]], kind: str) -> DataFrame:
    """One pass over ``docs(doc_id, copy, text as bytes)`` with the windows of one block."""
    shipped = docs.sparkSession.sparkContext.broadcast(rows)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        classes = compile_windows(shipped.value)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                found = (text or b"").translate(_WORD_BYTES).split()
                hits, who = [], set()
                for c in classes:
                    for end, names in c.find(found):
                        hits.append((end - c.length, end))
                        who.update(names)
                counts.append(len(found))
                spans.append(merged(hits))
                items.append(sorted(who))
            yield pa.record_batch([batch.column("doc_id"), batch.column("copy"), pa.array(counts, pa.int64()),
                                   pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                                  names=["doc_id", "copy", "n_words", "spans", "items"])

    return docs.mapInArrow(run, FOUND.format(id=kind))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans`` are the disjoint word ranges ``[start, end)`` covered by occurrences of
    benchmark windows, ``items`` the sorted ids (as strings) of the items they belong to.

    ``block_bytes`` bounds the windows that are at the driver and in a task at a
    time.  A benchmark of one block is searched without any shuffle of documents;
    with more, the documents that have hits are joined back on id and text.

    * null or empty text: no words, no hit; texts of any length are searched whole;
    * null id and repeated rows: each row is answered; rows with one id and one text alike;
    * items without words have no window; a repeated item counts once, its windows
      together; items without an id go by the empty string;
    * empty documents: no rows; empty benchmark: no hits.  Columns not named are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    listed = cut(windows(benchmark, item_col, item_text_col, size))
    weight = F.octet_length("window") + F.octet_length("item") + ENTRY_BYTES
    blocks = max(1, -(-(listed.agg(F.sum(weight)).first()[0] or 0) // block_bytes))
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    copy = text_key(F.col("text")) if blocks > 1 else F.lit(None).cast("string")
    rows = rows.select("doc_id", copy.alias("copy"), F.col("text").cast("binary").alias("text"))
    passes = []
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        passes.append(_search(rows, [tuple(r) for r in part.select("item", "n", "window").toArrow().to_pandas().itertuples(index=False)], kind))
    if blocks == 1:
        return passes[0].drop("copy")
    hits = passes[0]
    for other in passes[1:]:
        hits = hits.unionByName(other)
    hits = hits.filter("size(items) > 0").groupBy("doc_id", "copy").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = passes[0].select("doc_id", "copy", "n_words").alias("d").join(
        hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.copy = h.copy"), "left")
    none = FOUND.split("spans ")[1].split(", items")[0]
    return out.select("d.doc_id", "n_words", F.coalesce(union_of(F.col("spans")), F.array().cast(none)).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def union_of(spans: Column) -> Column:
    """Word ranges of several passes as disjoint ranges, ascending."""
    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return (F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= F.try_element_at(done, F.lit(-1))["end"], F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x))))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def with_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of :func:`contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


CONTAMINATION_SQL = r"""
WITH folded AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), coalesce(text, '') FROM benchmark),
cut AS (SELECT side, id, rid, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (SELECT coalesce(id::VARCHAR, '') AS item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM cut WHERE side = 'b' AND len(w) > 0),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM items),
places AS (SELECT c.rid, l.n, w, unnest(range(1, len(w) - l.n + 2)) AS i FROM cut c, (SELECT DISTINCT n FROM wins) l
           WHERE side = 'd' AND len(w) >= l.n),
hits AS (SELECT p.rid, p.n, p.i, q.item FROM places p JOIN wins q ON q.n = p.n AND q.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
who AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT c.id AS doc_id, len(c.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hit USING (rid) LEFT JOIN who USING (rid) WHERE c.side = 'd'
"""
