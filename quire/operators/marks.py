"""Tokenising text by ordered rules (W-6), pairing start/end marks (W-7).

``marks(docs, rules)`` finds every match of the rules, leftmost first and the
first rule winning at a position (one alternation, as a regex engine does),
with the text between matches as ``#text`` rows and a final ``#eos`` row
holding the tail.  Rules are data: an ordered list of ``(name, regex)``;
names starting with ``STA_`` / ``END_`` give start / end events.

Matches come from ``regexp_extract_all`` and the gaps from ``split`` on the
same pattern, so no sentinel character is injected into the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import starts
from ..functions.text import _group_numbers
from ..plans.scan import CHUNK_ROWS, chunk_by_position, scan

Rules = Sequence[tuple[str, str]]


def combined(rules: Rules, multiline: bool = True) -> tuple[str, list[int]]:
    """One alternation of all rules and the group number of each rule."""
    parts, numbers, n = [], [], 0
    for _, rx in rules:
        numbers.append(n + 1)
        n += 1 + len(_group_numbers(rx))
        parts.append(f"({rx})")
    return ("(?m)" if multiline else "") + "|".join(parts), numbers


def event_of(name: str) -> str:
    return "+" if name.startswith("STA_") else "-" if name.startswith("END_") else "="


#: What makes a rule depend on the text around its match.
LOOKS_AROUND = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[bBAzZG]|(?<![\[\\])[$^]")


def marks(docs: DataFrame, rules: Rules, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, type, event, text, start, end)``; ``piece`` orders the
    marks of a document (gap ``2i``, match ``2i+1``, ``#eos`` last).

    One row in, its marks out: matches and gaps come from one pattern each, a
    match is named by the first rule that fits it whole, and starts are summed
    up inside the row.  Only rules that look around are read from their group
    instead.  Nothing is shuffled, so it runs on streams too (ST-2).
    """
    for name, rx in rules:
        if re.compile(rx).fullmatch(""):
            raise ValueError(f"rule {name!r} matches the empty text")
    rx, groups = combined(rules)
    s = F.col("_s")
    around = {i: g for i, ((_, r), g) in enumerate(zip(rules, groups)) if LOOKS_AROUND.search(r)}
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_s"))
    base = base.select("_key", F.split(s, rx, -1).alias("_gaps"), F.regexp_extract_all(s, F.lit(rx), 0).alias("_toks"),
                       *[F.regexp_extract_all(s, F.lit(rx), g).alias(f"_g{i}") for i, g in around.items()])
    # gap 0, match 0, gap 1, ...: one array, so that one running sum gives every start
    pieces = F.transform(F.sequence(F.lit(0), 2 * F.size("_toks")), lambda i: F.when(
        i % 2 == 0, F.get("_gaps", (i / 2).cast("int"))).otherwise(F.get("_toks", (i / 2).cast("int"))))
    base = base.withColumn("_pieces", pieces).withColumn("_starts", starts(F.transform("_pieces", lambda x: F.length(x))))
    rows = base.select("_key", F.size("_toks").alias("_n"), *[f"_g{i}" for i in around],
                       F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("piece", "_x"))
    body, is_match = F.col("_x._pieces"), F.col("piece") % 2 == 1
    kind = F.when(F.col("piece") == 2 * F.col("_n"), F.lit("#eos")).when(~is_match, F.lit("#text"))
    for i, (name, r) in enumerate(rules):
        whole = F.get(f"_g{i}", (F.col("piece") / 2).cast("int")) != "" if i in around else body.rlike(f"(?m)\\A(?:{r})\\z")
        kind = kind.when(whole, F.lit(name))
    rows = rows.select("_key", F.col("piece").cast("bigint").alias("piece"), kind.alias("type"), body.alias("text"),
                       F.col("_x._starts").alias("start"))
    ev = F.when(F.col("type") == "#eos", F.lit(".")).when(F.col("type") == "#text", F.lit("="))
    for name, _ in rules:
        ev = ev.when(F.col("type") == name, F.lit(event_of(name)))
    return rows.where((F.col("type") != "#text") | (F.col("text") != "")).select(
        F.col("_key").alias(key), "piece", "type", ev.alias("event"), "text", "start",
        (F.col("start") + F.length("text")).cast("bigint").alias("end"))


def pair_marks(mk: DataFrame, *, key: str = "doc_id", name: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-7: nesting level and the matching end of every start mark.

    A start at level ``d`` is closed by the next end mark that returns to
    ``d - 1``: the next row in the ``(key, name, level)`` sequence, where a
    start's level is the running sum of +1/-1 events after it and an end's the
    one before.  ``name`` is a column with the tag name: starts and ends then
    pair by name, so crossed and unclosed tags of other names do not matter.
    """
    by = [key] if name is None else [key, name]
    step = F.when(F.col("event") == "+", 1).otherwise(-1).cast("bigint")
    paired = chunk_by_position(mk.where(F.col("event").isin("+", "-")), "piece", chunk_rows)
    d = scan(paired, by, ["piece"], sums={"depth": step})
    d = d.withColumn("level", F.when(F.col("event") == "+", F.col("depth")).otherwise(F.col("depth") + 1))
    nxt = scan(d, [*by, "level"], ["piece"], next={"_ne": F.col("event"), "_np": F.col("piece"), "_nend": F.col("end")})
    closed = F.col("_ne") == "-"
    return nxt.where(F.col("event") == "+").select(
        *by, "piece", "type", "text", "start", "level", F.when(closed, F.col("_np")).alias("end_piece"),
        F.when(closed, F.col("_nend")).alias("span_end"))
