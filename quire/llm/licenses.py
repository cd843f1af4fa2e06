"""Licence scan: ordered signature rules behind a keyword prefilter.

Everything is an expression over one row, so the scan is a single stage
without a shuffle.  A rule's expression is tried only on texts that contain
its keyword.  Overlapping detections are resolved by interval containment: in
order of start (longer first) a detection is suppressed when one of the same
or a higher tier has been seen that ends no earlier, because then its interval
contains this one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .licence_rules import RULES, WEIGHT, Rule

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    """The words of a text (A-Z lower-cased), each between single spaces; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NOT_WORD, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rules(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(
        F.lit(r.number).alias("number"), F.lit(r.tier).alias("tier"), F.lit(r.keyword).alias("keyword"),
        F.lit(r.label).alias("label"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern")) for r in rules])


#: Places of one rule in the text ``s``, as intervals of words: what lies between matches and the
#: matches themselves are walked once, counting spaces.  ``back`` is the negated end.
_PLACES = """
aggregate(
  zip_with(slice(split(s, m.r.pattern, -1), 1, size(m.found)), m.found, (g, h) -> named_struct(
    'gap', length(g) - length(replace(g, ' ', '')), 'hit', length(h) - length(replace(h, ' ', '')))),
  named_struct('at', 0, 'all', cast(array() AS array<struct<start:int,back:int,tier:int,number:int,label:string>>)),
  (a, z) -> named_struct(
    'at', a.at + z.gap + z.hit,
    'all', concat(a.all, array(named_struct('start', a.at + z.gap - 1, 'back', -(a.at + z.gap + z.hit),
                                            'tier', m.r.tier, 'number', m.r.number, 'label', m.r.label)))),
  a -> a.all)
"""

_KEEP = """
aggregate(
  hits,
  named_struct('ends', array(-1, -1, -1, -1),
               'kept', cast(array() AS array<struct<start:int,end:int,tier:int,number:int,label:string>>)),
  (a, d) -> named_struct(
    'ends', transform(a.ends, (e, i) -> CASE WHEN i + 1 >= d.tier THEN greatest(e, -d.back) ELSE e END),
    'kept', CASE WHEN element_at(a.ends, d.tier) >= -d.back THEN a.kept
                 ELSE concat(a.kept, array(named_struct('start', d.start, 'end', -d.back, 'tier', d.tier,
                                                        'number', d.number, 'label', d.label))) END),
  a -> a.kept)
"""


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``detections`` are the rules' matches that no containing one suppresses, as
    ``(start, end, tier, number, label)`` with word positions from 0, end
    exclusive.  ``labels`` joins their labels with those of the base phrases;
    ``score`` is the chance that at least one detection holds, taking the
    weights of their tiers as independent.

    * null or empty text: no word, no place, empty labels, score 0;
    * null id and repeated rows: each row is scanned on its own;
    * equal intervals: the higher tier wins, then the earlier rule;
    * empty table: no rows.  Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", folded_words(F.col("text")).alias("s"))
    keywords = sorted({r.keyword for r in rules})
    held = {p: F.col("s").contains(f" {p} ") for p in BASE}
    count = [F.when(held[p], F.regexp_count("s", F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for p in BASE]
    first = [F.when(held[p], spaces(F.substring_index("s", f" {p} ", 1))) for p in BASE]
    last = [F.when(held[p], F.col("n_words") - len(p.split()) - spaces(F.substring_index("s", f" {p} ", -1))) for p in BASE]
    base = F.array_compact(F.array(*[F.when(held[p], F.lit(label)) for p, label in BASE.items()]))

    rows = rows.withColumn("n_words", F.when(F.col("s") == "  ", 0).otherwise(spaces(F.col("s")) - 1).cast("long"))
    rows = rows.select(
        "*", sum(count[1:], count[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), base.alias("base"),
        F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("s"), k)).alias("present"))
    tried = F.filter(_rules(rules), lambda r: F.array_contains("present", r["keyword"]))
    rows = rows.withColumn("tried", F.when(F.size("present") > 0, tried).otherwise(F.slice(_rules(rules), 1, 0)))
    found = "transform(tried, r -> named_struct('r', r, 'found', regexp_extract_all(s, r.pattern, 0)))"
    rows = rows.withColumn("matched", F.expr(f"filter({found}, m -> size(m.found) > 0)"))
    rows = rows.withColumn("hits", F.expr(f"sort_array(flatten(transform(matched, m -> {_PLACES})))"))
    rows = rows.withColumn("detections", F.expr(_KEEP))
    weight = F.create_map(*[x for tier, w in WEIGHT.items() for x in (F.lit(tier), F.lit(w))])
    missed = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - F.element_at(weight, d["tier"])))
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), (1 - missed).alias("score"), "detections")
