"""Phrase collocation mining with mergeable Misra-Gries summaries.

1. Words are counted exactly per language.  Only phrases of words that are
   themselves frequent can be frequent; a Bloom filter of fixed size holds those words.
2. Every task sums up the hashes of its phrases and deals them by hash to partitions.
   There the summaries are merged into one Misra-Gries summary whose capacity exceeds the
   partition's mass divided by the threshold (``SPARE`` times): what merging takes off any
   counter stays below the threshold, so every frequent phrase survives.  The mass comes ahead
   of the counters in the sort order, so a partition is read as a stream.
3. A second pass counts, as words, the phrases whose hashes survived (again a
   filter of fixed size, which lets none of them be missed).  Counts go in lists by hash partition,
   are added up there in bounded room, and what did not fit is added up by Spark.

Hashes only ever choose what is counted; every number returned is a count of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, short_batches

#: A byte that UTF-8 never has, for the end of a piece.
END = b"\xff"
#: Fixed value: what ends a piece (``.,;:!?`` and line breaks), what separates words, A-Z to a-z.
_BYTES = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words a task holds at a time, entries of a summary before it is sent on, mass dealt to a partition.
BLOCK_WORDS, SUMMARY_ENTRIES, PARTITION_MASS = 1 << 19, 1 << 21, 1 << 23
#: Counts by word that a task holds before it sends them on.
HELD_COUNTS = 300_000
FILTER_BITS, PROBES = 27, 4
#: Bits of a phrase's hash that are dealt (equal ones are counted together at first, never in the end),
#: and how often a summary's capacity exceeds mass / threshold.
KEY_BITS, SPARE = 48, 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Ids(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class Block:
    """Words of whole documents as numbers; 0 ends a piece."""

    def __init__(self, words: _Ids, langs: _Ids, ids: list, owners: list, lengths: list):
        self.words, self.langs = list(words), list(langs)
        self.ids = np.concatenate(ids)
        self.lang = np.repeat(np.array(owners, np.int64), lengths)

    def hashes(self) -> np.ndarray:
        """64 bits of each word and its language."""
        word = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        lang = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))
        return _mix(word[self.ids] + lang[self.lang])


def blocks(batches, size: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of about ``size`` words from batches of ``(lang, text as bytes)``; a document is never divided."""
    words, langs, ids, owners, lengths = _Ids({END: 0}), _Ids(), [], [], []
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            tokens = text.translate(_BYTES).replace(END, b" \xff ").split()
            if not tokens:
                continue
            tokens.append(END)
            ids.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
            owners.append(langs[lang])
            lengths.append(len(tokens))
            if sum(lengths[-64:]) >= size or len(lengths) % 64 == 0 and sum(lengths) >= size:
                yield Block(words, langs, ids, owners, lengths)
                words, langs, ids, owners, lengths = _Ids({END: 0}), _Ids(), [], [], []
    if ids:
        yield Block(words, langs, ids, owners, lengths)


class Filter:
    """Bloom filter of ``2**bits`` bits over 64-bit hashes."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        step = _mix(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) >> np.uint64(64 - bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for place in self.places(h, self.bits):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def build_filter(hashes: DataFrame, bits: int) -> Filter:
    """Filter of the column ``h``: tasks set bits, Spark joins equal words of 64 bits, at most
    ``2**bits / 64`` of them reach the driver."""
    def spots(batches):
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate([np.empty(0, np.uint64), *Filter.places(h, bits)]))
            words, start = np.unique(place >> np.uint64(6), return_index=True)
            ones = np.uint64(1) << (place & np.uint64(63))
            value = np.bitwise_or.reduceat(ones, start) if len(start) else ones
            yield pa.record_batch([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "ones"])

    table = hashes.mapInArrow(spots, "word bigint, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    words = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    words[table["word"].to_numpy()] = table["ones"].to_numpy().view(np.uint64)
    return Filter(bits, words)


class MisraGries:
    """Summary of at most ``capacity`` counters; ``taken`` is what each counter may be short of."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Merge counters, those of another summary with what it has ``taken`` from them; they are held
        back until there are enough to make a merge worth while."""
        self.taken += taken
        self._held.append((keys, counts))
        self._size += len(keys)
        if self._size > max(self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys, counts = summed([(self.keys, self.counts), *self._held])
        self._held, self._size = [], 0
        if len(keys) > self.capacity:
            least = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.taken += int(least)
            left = counts > least
            keys, counts = keys[left], counts[left] - least
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may have ``threshold`` occurrences: all that have, if the capacity exceeds mass / threshold."""
        self.merge()
        return self.keys[self.counts + self.taken >= threshold]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return pick(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                                   F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one, the bytes a gap needs, and the gaps byte by byte."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], -1)
    wide = np.zeros((gaps.shape[1], 8), np.uint8)
    wide[:, :data[8]] = gaps.T
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), wide.view(np.uint64).ravel()]), dtype=np.uint64)


class Totals:
    """Counts of ``(lang, words)`` held by a task; :meth:`take` empties it."""

    def __init__(self):
        self.counts: dict[tuple[str, bytes], int] = {}

    def add(self, langs, words, counts) -> bool:
        """Whether it is time to send the counts on."""
        held, get = self.counts, self.counts.get
        for key, n in zip(zip(langs, words), counts):
            held[key] = get(key, 0) + n
        return len(held) >= HELD_COUNTS

    def take(self) -> dict[tuple[str, bytes], int]:
        out, self.counts = self.counts, {}
        return out


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, phrase, a)`` of every word of ``rows(lang, text as bytes)``."""
    def count(batches):
        totals = Totals()

        def send():
            found = list(totals.take().items())
            for i in range(0, len(found), 1 << 16):
                some = found[i:i + (1 << 16)]
                yield pa.record_batch([pa.array([k[0] for k, _ in some]), pa.array([k[1] for k, _ in some], pa.binary()),
                                       pa.array([n for _, n in some], pa.int64())], names=["lang", "phrase", "a"])

        for b in blocks(batches):
            pairs, n = np.unique((b.lang * len(b.words) + b.ids)[b.ids > 0], return_counts=True)
            lang, word = pairs // len(b.words), pairs % len(b.words)
            if totals.add(map(b.langs.__getitem__, lang.tolist()), map(b.words.__getitem__, word.tolist()), n.tolist()):
                yield from send()
        yield from send()

    return rows.mapInArrow(count, "lang string, phrase binary, a bigint").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def word_hashes(words: DataFrame) -> DataFrame:
    """``h`` of ``words(lang, phrase)``, as :meth:`Block.hashes` has it."""
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            h = np.array([xxhash.xxh64_intdigest(w.encode()) + xxhash.xxh64_intdigest(x.encode(), 1) & (1 << 64) - 1 for x, w in pairs], np.uint64)
            yield pa.record_batch([pa.array(_mix(h).view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h bigint")


def _phrases(b: Block, frequent: Filter, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, begins, hashes)`` of the phrases of each length whose words are all in ``frequent``;
    ``begins`` is a mask over places."""
    word = b.hashes()
    good = frequent.has(word) & (b.ids > 0)
    begins, h = good, word
    for n in range(2, longest + 1):
        begins = begins[:-1] & good[n - 1:]
        h = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1:])
        yield n, begins, h


def surviving_hashes(rows: DataFrame, frequent, longest: int, threshold: int, partitions: int) -> DataFrame:
    """``h`` (of the key that was dealt) of all phrases that may be frequent: merged Misra-Gries summaries, one a hash partition.

    ``frequent`` is the broadcast filter of frequent words.
    """
    def deal(parts):
        keys, counts = summed(parts)
        part = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(partitions)) >> np.uint64(32)  # ascending with the key
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        for i, j in zip(start, [*start[1:], len(keys)]):
            once = counts[i:j] == 1
            yield {"part": int(part[i]), "kind": 0, "mass": int(counts[i:j].sum()), "once": None, "keys": None, "counts": None}
            yield {"part": int(part[i]), "kind": 1, "mass": 0, "once": pack(keys[i:j][once]),
                   "keys": pack(keys[i:j][~once]), "counts": counts[i:j][~once].tobytes()}

    kind = "part int, kind int, mass bigint, once binary, keys binary, counts binary"
    fields = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("once", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def local(batches):
        held, size = [], 0

        def send():
            batch = []
            for row in deal(held):
                batch.append(row)
                if len(batch) == 64:
                    yield pa.RecordBatch.from_pylist(batch, fields)
                    batch = []
            yield pa.RecordBatch.from_pylist(batch, fields)

        for b in blocks(batches):
            found = np.concatenate([h[begins] for _, begins, h in _phrases(b, frequent.value, longest)])
            held.append(np.unique(found >> np.uint64(64 - KEY_BITS), return_counts=True))
            size += len(held[-1][0])
            if size >= SUMMARY_ENTRIES:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    def merge(batches):
        at, mass, summary = None, 0, None
        out = lambda keys: pa.record_batch([pa.array(_mix(keys).view(np.int64))], names=["h"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != at:
                    if summary is not None:
                        yield out(summary.frequent(threshold))
                    at, mass, summary = row["part"], 0, None
                if row["kind"] == 0:
                    mass += row["mass"]
                    continue
                summary = summary or MisraGries(SPARE * mass // threshold + 1)
                once = unpack(row["once"])
                summary.add(once, np.ones(len(once), np.int64))
                summary.add(unpack(row["keys"]), np.frombuffer(row["counts"], np.int64))
        if summary is not None:
            yield out(summary.frequent(threshold))

    dealt = rows.mapInArrow(local, kind).repartition(partitions, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(merge, "h bigint")


def phrase_counts(rows: DataFrame, frequent, survivors, longest: int, threshold: int, partitions: int) -> DataFrame:
    """``(lang, phrase, a)``: exact counts, from ``threshold`` on, of the phrases that pass both filters; words joined by a space."""
    lists = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
    flat = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64())])

    def count(batches):
        totals = Totals()

        def send():
            dealt: dict = {}
            for (lang, phrase), n in totals.take().items():
                phrases, counts = dealt.setdefault((xxhash.xxh64_intdigest(phrase) % partitions, lang), ([], []))
                phrases.append(phrase)
                counts.append(n)
            found = [{"part": p, "lang": x, "phrases": v[0], "counts": v[1]} for (p, x), v in dealt.items()]
            for i in range(0, len(found), 64):
                yield pa.RecordBatch.from_pylist(found[i:i + 64], lists)

        for b in blocks(batches):
            prefix, number = None, None
            for n, begins, h in _phrases(b, frequent.value, longest):
                at = np.flatnonzero(begins)
                if prefix is not None:  # a frequent phrase begins and ends with a frequent one
                    at = at[prefix[at] & prefix[at + 1]]
                at = at[survivors.value.has(_mix(h[at] >> np.uint64(64 - KEY_BITS)))]
                head = b.lang[at] * len(b.words) + b.ids[at] if number is None else number[at]
                _, own = np.unique(head, return_inverse=True)
                _, first, which, a = np.unique(own * np.int64(len(b.words)) + b.ids[at + n - 1], return_index=True,
                                               return_inverse=True, return_counts=True)
                prefix, number = np.zeros(len(b.ids), bool), np.zeros(len(b.ids), np.int64)
                prefix[at], number[at] = True, which
                spots = at[first]
                words = (b" ".join([b.words[w] for w in ids]) for ids in b.ids[spots[:, None] + np.arange(n)].tolist())
                if totals.add(map(b.langs.__getitem__, b.lang[spots].tolist()), words, a.tolist()):
                    yield from send()
        yield from send()

    def add(batches):
        at, held, sent = None, {}, False

        def send(least):
            found = [(p, n) for p, n in held.items() if n >= least]
            held.clear()
            return pa.record_batch([pa.array([at[1]] * len(found), pa.string()), pa.array([p for p, _ in found], pa.binary()),
                                    pa.array([n for _, n in found], pa.int64())], schema=flat)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != at:
                    if held:
                        yield send(0 if sent else threshold)
                    at, sent = (row["part"], row["lang"]), False
                for phrase, n in zip(row["phrases"], row["counts"]):
                    held[phrase] = held.get(phrase, 0) + n
                if len(held) >= HELD_COUNTS:
                    yield send(0)
                    sent = True
        if held:
            yield send(0 if sent else threshold)

    dealt = rows.mapInArrow(count, "part int, lang string, phrases array<binary>, counts array<bigint>").repartition(partitions, "part")
    added = dealt.sortWithinPartitions("part", "lang").mapInArrow(add, "lang string, phrase binary, a bigint")
    return added.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= threshold)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, threshold: int = 100,
                     filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``(totals, phrases)``: ``(lang, n)`` and every ``(lang, phrase, size, a)`` of 1 to ``longest`` words with ``a >= threshold``.

    ``filter_bits`` is the base-2 logarithm of the bits of each of the two filters that are broadcast (2**27: 16 MB).
    With more frequent phrases than that more is counted, and nothing is missed.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = _rows(docs, text_col, lang_col)
    counted = word_counts(rows)
    # one pass gives the totals and the frequent words: rare words go to one row a language and task
    kept = cut(counted.groupBy("lang", F.when(F.col("a") >= threshold, F.col("phrase").cast("string")).alias("phrase")).agg(F.sum("a").alias("a")))
    totals = kept.groupBy("lang").agg(F.sum("a").alias("n"))
    words = kept.filter("phrase is not null")
    n = totals.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (longest - 1) // PARTITION_MASS))
    frequent = spark.sparkContext.broadcast(build_filter(word_hashes(words), filter_bits))
    survivors = spark.sparkContext.broadcast(build_filter(surviving_hashes(rows, frequent, longest, threshold, partitions), filter_bits))
    exact = phrase_counts(rows, frequent, survivors, longest, threshold, partitions).select("lang", F.col("phrase").cast("string").alias("phrase"), "a")
    return totals, cut(exact.unionByName(words).withColumn("size", F.size(F.split("phrase", " "))))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, threshold: int = 100,
                 inside: int = 100, top: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased, ``.,;:!?`` and line breaks end a piece, words stand between blanks
    and tabs.  ``a`` counts a phrase within pieces, overlaps included, and ``n`` all words of the
    language.  Of the cuts of a phrase into a first part (``l``) and a rest (``r``) the one with the
    least ``floor(1000 * a * n / (l * r))`` counts (ties: shortest first part).  A phrase inside a longer
    one that has ``inside`` per cent of its occurrences or more is left out.  Order: score and ``a`` descending, phrase.

    * null text: empty; null language: ``und``, together with texts of that language;
    * repeated rows count each; texts are read whole;
    * empty table, or no phrase with ``threshold`` occurrences: no rows.  Columns not named are ignored.
    """
    totals, counts = frequent_phrases(docs, text_col, lang_col, longest, threshold, filter_bits)
    phrases = counts.filter("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    product = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * wide("n")
    score = F.call_function("div", product, wide("l") * wide("r"))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(best)
    begin = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")
    inner = (phrases.filter("size > 2").select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
             .select("lang", "w", "a", "m", begin).groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer")))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    flat = left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM cut, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, m, w, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
             ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM cand g WHERE g.lang = b.lang AND length(g.phrase) > length(b.phrase)
    AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * g.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
