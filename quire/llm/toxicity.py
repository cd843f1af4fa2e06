"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

* Lexicon.  Words and stems (prefixes with several completions) whose uses
  lean towards toxic documents.  A use is counted once per pair of
  neighbouring words, so copies of one text count as one.
* Matching.  Words run through the intersection of the lexicon trie with the
  Levenshtein automaton of the distance that a term's length allows; its
  states are made when first reached, so a word costs one lookup per letter.
* Context.  A window around each hit tells quotation (quote marks, reporting
  words) from abuse (second person, further hits).
* Score.  Logistic regression on counts of hits by kind and context.

Labels are used from a bounded sample of labelled rows (``sample``, a
parameter); scoring reads every document whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, short_batches

WORD = re.compile(r"[^\W_]+")
WINDOW = 8
QUOTES = frozenset("\"“”„«»‘’`")
REPORTING = frozenset("said says quote quoted quotes called wrote written term word slur sagte zitat zitiert dit écrit cite dijo cita".split())
SECOND_PERSON = frozenset("you your yours youre u ur du dich dir dein deine euch tu toi ton vous votre tú usted ustedes".split())


def distance_for(term: str) -> int:
    """Edits that a term of this length may carry."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Lexicon trie intersected with Levenshtein automata, determinised as words arrive.

    A state is the set of (trie node, edits so far) a prefix can be in, closed
    under skipped letters.  A stem matches any word that begins with it; stems
    and ``rigid`` words allow no edits.
    """

    MOST_MOVES = 400_000  # remembered moves; they are forgotten, and made again, beyond that

    def __init__(self, words: list[str], stems: list[str], rigid: list[str] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.term, self.stem = [0], [""], [False]
        exact = {*stems, *(rigid or [])}
        self.allowed = {t: 0 if t in exact else distance_for(t) for t in [*words, *stems]}
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node, allowed = 0, self.allowed[term]
            self.budget[0] = max(self.budget[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.term.append("")
                    self.stem.append(False)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], allowed)
            self.term[node], self.stem[node] = term, self.stem[node] or is_stem
        self.letters = frozenset(c for node in self.children for c in node)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.seen: dict[str, tuple[str, int] | None] = {}
        self.first = self._intern({0: 0})

    def _intern(self, nodes: dict[int, int]) -> int:
        """Number of the state for these nodes and edits, closed under letters left out; -1 if none is left."""
        open_nodes = list(nodes)
        while open_nodes:
            node = open_nodes.pop()
            for child in self.children[node].values():
                edits = nodes[node] + 1
                if edits <= self.budget[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    open_nodes.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] and e <= self.allowed[self.term[n]]]
            self.final.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            steps = [(node, edits + 1)] + [(c, edits + (a != letter)) for a, c in self.children[node].items()]
            if self.stem[node]:
                steps.append((node, edits))
            for target, cost in steps:
                if cost <= self.budget[target] and cost < reached.get(target, 99):
                    reached[target] = cost
        return self._intern(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        """``(term, edits)`` of the nearest term, if one is near enough."""
        if word in self.seen:
            return self.seen[word]
        if len(self.moves) + len(self.seen) > self.MOST_MOVES:
            self._reset()
        state = self.first
        for letter in word:
            if letter not in self.letters:
                letter = "\0"
            move = (state, letter)
            if move not in self.moves:
                self.moves[move] = self._move(state, letter)
            state = self.moves[move]
            if state < 0:
                break
        self.seen[word] = found = self.final[state] if state >= 0 else None
        return found


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    rigid: list[str] = field(default_factory=list)
    clean_forms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (1 + len(KINDS) * 2))

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(self.words, self.stems, self.rigid)

    def score(self, counts: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-float(np.dot(self.weights, features(counts)))))


KINDS = ("exact", "near", "quoted", "abuse")
MOST = (8, 4, 4, 4)


def features(counts: tuple[int, ...]) -> list[float]:
    return [1.0] + [x for c in counts for x in (float(c > 0), math.log1p(c))]


def find_hits(text: str, trie: FuzzyTrie, clean: frozenset) -> list[tuple[int, int, str, int, str]]:
    """``(start, end, term, edits, context)`` of the hits in a text, context one of plain, quoted, abuse."""
    lowered = text.lower()
    marked = {}
    for word in set(WORD.findall(lowered)):
        found = trie.match(word)
        if found and not (found[1] and word in clean):
            marked[word] = found
    if not marked:
        return []
    places = list(WORD.finditer(lowered))
    words = [m.group() for m in places]
    at = [i for i, w in enumerate(words) if w in marked]
    same_length, hits = len(lowered) == len(text), []
    for n, i in enumerate(at):
        low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before = lowered[places[low].start():places[i].start()]
        after = lowered[places[i].end():places[high - 1].end()]
        near = words[low:i] + words[i + 1:high]
        quoted = (sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)) \
            or any(w in REPORTING for w in near)
        abuse = any(w in SECOND_PERSON for w in near) or (n > 0 and at[n - 1] >= low) or (n + 1 < len(at) and at[n + 1] < high)
        context = "quoted" if quoted else "abuse" if abuse else "plain"
        term, edits = marked[words[i]]
        span = places[i].span() if same_length else (-1, -1)
        hits.append((*span, term, edits, context))
    return hits


def counts_of(hits: list[tuple[int, int, str, int, str]]) -> tuple[int, ...]:
    """Hits by kind, saturating."""
    own = (sum(1 for h in hits if not h[3] and h[4] != "quoted"), sum(1 for h in hits if h[3] and h[4] != "quoted"),
           sum(1 for h in hits if h[4] == "quoted"), sum(1 for h in hits if h[4] == "abuse"))
    return tuple(map(min, own, MOST))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _leaning(counts: DataFrame, precision: float, least: int = 8, strength: float = 30.0) -> DataFrame:
    """Terms of ``counts(term, toxic, clean, ...)`` that lean towards toxic beyond chance (G-test)."""
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not total["t"] or not total["c"]:
        return counts.filter("false").withColumn("g", F.lit(0.0))
    rate = total["t"] / (total["t"] + total["c"])
    n = F.col("toxic") + F.col("clean")
    g = 2 * (F.col("toxic") * F.log(F.col("toxic") / (n * rate))
             + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - rate)))).otherwise(0.0))
    return counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= precision * n)).withColumn("g", g).filter(F.col("g") >= strength)


def _top(terms: DataFrame, most: int) -> list[str]:
    return [r["term"] for r in terms.orderBy(F.desc("g"), "term").limit(most).collect()]


def train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``text, toxic`` of the sampled labelled rows that are not held out.

    At most ``sample`` ids are drawn, by hash; that bound is what allows the broadcast.
    """
    own = (pick(labels, doc_id=id_col, toxic=label_col).filter("doc_id is not null and toxic is not null")
           .filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(own), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = 12_000, most_terms: int = 2_000) -> Model:
    """Learn lexicon, exceptions and weights from at most ``sample`` labelled documents.

    What reaches the driver is the model: at most ``most_terms`` words, stems
    and exceptions each, and a table of hit counts that has no more rows than
    saturated counts have combinations.
    """
    short_batches(docs.sparkSession)
    train = cut(train_rows(docs, labels, id_col, text_col, label_col, sample))

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = WORD.findall((text.as_py() or "").lower())
                for before, word, after in zip([""] + words, words, words[1:] + [""]):
                    if 3 <= len(word) <= 40:
                        found[word, xxhash.xxh32_intdigest(f"{before} {after}"), toxic] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                 pa.array([k[2] for k in found], pa.int32())], names=["term", "around", "toxic"])

    each = (train.mapInArrow(uses, "term string, around long, toxic int").groupBy("term", "around")
            .agg(F.max("toxic").alias("toxic"))
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    each = cut(each)
    model = Model()
    model.words = _top(_leaning(each, 0.8), most_terms)
    starts = (each.select(F.explode(F.sequence(F.lit(4), F.least(F.length("term") - 1, F.lit(8)))).alias("n"), "term", "toxic", "clean")
              .filter("n >= 4 and n < length(term)")
              .groupBy(F.expr("left(term, n)").alias("term"))
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum((F.col("toxic") > 0).cast("int")).alias("forms")))
    stems = _top(_leaning(starts, 0.95).filter("forms >= 3"), most_terms)
    model.stems = [s for s in stems if not any(s[:n] in set(stems) for n in range(4, len(s)))]
    _learn_exceptions(train, model, most_terms)
    model.weights = _weights(train, model)
    return model


def _learn_exceptions(train: DataFrame, model: Model, most: int, crowded: int = 2) -> None:
    """Forms near a word that clean documents use are no hits; a word with ``crowded`` such forms
    lies among ordinary words and is matched exactly from then on."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.trie()
        for batch in batches:
            rows = [(w, found[0], t) for text, t in zip(batch.column("text"), batch.column("toxic").to_pylist())
                    for w in set(WORD.findall((text.as_py() or "").lower())) if (found := trie.match(w)) and found[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int32())], names=["form", "term", "toxic"])

    seen = (train.mapInArrow(forms, "form string, term string, toxic int").groupBy("form", "term")
            .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).filter("clean > 0"))
    near = seen.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= crowded)
    model.rigid = [r["term"] for r in near.collect()]
    rest = seen.filter(~F.col("term").isin(model.rigid)) if model.rigid else seen
    model.clean_forms = [r["form"] for r in rest.orderBy(F.desc("clean"), "form").limit(most).collect()]


def _weights(train: DataFrame, model: Model, ridge: float = 0.05) -> list[float]:
    """Ridge logistic regression by Newton steps on the table of hit counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, clean = model.trie(), frozenset(model.clean_forms)
        for batch in batches:
            rows = [counts_of(find_hits(t.as_py() or "", trie, clean)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(len(KINDS))]
                                             + [batch.column("toxic")], names=[*KINDS, "toxic"])

    schema = ", ".join(f"{k} int" for k in (*KINDS, "toxic"))
    table = train.mapInArrow(counted, schema).groupBy(*KINDS).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    size = 1 + 2 * len(KINDS)
    weights = np.zeros(size)
    if not table:
        return weights.tolist()
    x = np.array([features(tuple(r[k] for k in KINDS)) for r in table])
    n, y = np.array([r["n"] for r in table], float), np.array([r["toxic"] for r in table], float)
    shrink = np.full(size, ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - n * p) - shrink * weights
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(shrink), slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return weights.tolist()


HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("context", pa.string())])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, hits``.

    ``hits`` are the matched words as character spans with term, edits and
    context (spans are -1 where lower-casing changes a text's length).
    ``carry`` names input columns to hand through in a struct ``rest``; nothing is shuffled.

    * null or empty text: no hit, the score of a text without hits;
    * null id: scored, never held out; repeated rows: each scored alike;
    * empty table: no rows.  A model fitted without labels scores 0.5.
      Other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, clean = model.trie(), frozenset(model.clean_forms)
        for batch in batches:
            hits = [find_hits(t.as_py() or "", trie, clean) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.score(counts_of(h)) for h in hits], pa.float64()),
                 pa.array([[dict(zip(("start", "end", "term", "edits", "context"), x)) for x in h] for h in hits], pa.list_(HIT)),
                 *[batch.column(n) for n in rest]],
                names=["doc_id", "score", "hits", *rest])

    names = {f"r{i}": n for i, n in enumerate(carry or [])}
    rest = ["rest"] if names else []
    rows = pick(docs, doc_id=id_col, text=text_col, **names)
    rows = rows.select("doc_id", "text", *[F.struct(*[F.col(a).alias(n) for a, n in names.items()]).alias(r) for r in rest])
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = "".join(f", rest {rows.schema['rest'].dataType.simpleString()}" for _ in rest)
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double, "
                                  f"hits array<struct<start: int, end: int, term: string, edits: int, context: string>>{tail}")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", *rest)
