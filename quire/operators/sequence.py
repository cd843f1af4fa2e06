"""Rule matching over ordered atoms (W-8, W-9).

Rules are data: ``{"Block": "block comment+", "Code": "_+"}``.  A rule is a
sequence of items, each an atom name with an optional cardinality ``?``,
``+`` or ``*``; ``_`` is any atom that does not start another rule.
Matching is greedy, leftmost and non-overlapping; at a position the first
rule in order that matches wins (as in a regex alternation; the reference's
hand-built machine lets the later rule win).  Atoms break a match
(``contiguous``): an atom no rule can use is never inside a match, and
neither is a null atom.

Plan: atoms are dealt by a range repartition on ``(key, order)`` and written once, sorted, so a key that
holds most of the rows lies in many slices and a slice is read as it lies.  All machines read it in
one pass, as automata (:mod:`quire.operators.automaton`): no string, no list of a
key's rows, two looks at each atom.  Keys within one slice, nearly all, need nothing else.  For the
others each slice is summed up, first by what it makes of the set of states that can go on after it,
then, with that set known, by what it makes of the state before it; one small row a
slice and pass is put together per key.  There are at most two such rows a slice, and the number of
slices is that of the ranges, so these rows are broadcast.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import CHUNK, chunk_by_range, key_name, with_key
from ..session import ensure_checkpoint_dir
from .automaton import IDLE, Machine

BASE_CHAR = 0xE000  # first private-use code point
_ITEM = re.compile(r"^([A-Za-z0-9_.:\-]+?)([?+*]?)$")


class Compiled:
    """Rules compiled to regexes over one character per atom."""

    def __init__(self, rules: Mapping[str, str]):
        self.rules = dict(rules)
        items = {n: [self._item(t) for t in r.split()] for n, r in self.rules.items()}
        self.atoms = list(dict.fromkeys(a for its in items.values() for a, _ in its if a != "_"))
        self.code = {a: chr(BASE_CHAR + i) for i, a in enumerate(self.atoms)}
        self.other = chr(BASE_CHAR + len(self.atoms))
        self.wild = any(a == "_" for its in items.values() for a, _ in its)
        firsts = {n: its[0][0] for n, its in items.items()}
        every = [*self.code.values(), self.other]

        def chars(rule: str, atom: str) -> str:
            if atom != "_":
                return self.code[atom]
            banned = {self.code[f] for m, f in firsts.items() if m != rule and f != "_"}
            return "".join(c for c in every if c not in banned)

        #: Per rule its items as (characters, least count, unbounded).
        self.items = {n: [(chars(n, a), 1 if c in ("", "+") else 0, c in ("+", "*")) for a, c in its] for n, its in items.items()}
        self.regex: dict[str, str] = {}
        for n, its in items.items():
            body = [(f"[{chars(n, a)}]" if len(chars(n, a)) > 1 else chars(n, a), c) for a, c in its]
            if all(c in ("?", "*") for _, c in body):
                # Only the non-empty matches are emitted: the first present item
                # becomes mandatory (``A? B*`` -> ``A B*|B+``), earlier ones absent.
                alts = []
                for i, (rx, c) in enumerate(body):
                    first = f"(?:{rx})" + ("+" if c == "*" else "")
                    alts.append(first + "".join(f"(?:{r}){cc}" for r, cc in body[i + 1:]))
                self.regex[n] = "(?:" + "|".join(alts) + ")"
            else:
                self.regex[n] = "".join(f"(?:{rx}){c}" for rx, c in body)
        #: Rules that also match nothing.
        self.empty = [n for n, its in items.items() if all(c in ("?", "*") for _, c in its)]

    @staticmethod
    def _item(tok: str) -> tuple[str, str]:
        m = _ITEM.match(tok)
        if not m:
            raise ValueError(f"bad rule item {tok!r}")
        return m.group(1), m.group(2)

    def encode(self, atom_col: Column) -> Column:
        out = None
        for a, ch in self.code.items():
            out = F.when(atom_col == a, F.lit(ch)) if out is None else out.when(atom_col == a, F.lit(ch))
        return F.lit(self.other) if out is None else out.otherwise(F.lit(self.other))

    def consumable(self, atom_col: Column) -> Column:
        """Atoms some rule can use; never null ones."""
        return atom_col.isNotNull() if self.wild else F.coalesce(atom_col.isin(*self.atoms), F.lit(False))

    def neighbours(self) -> list[str]:
        """Pairs of characters that can stand side by side inside a match."""
        pairs = set()
        for items in self.items.values():
            for i, (chars, _, unbounded) in enumerate(items):
                if unbounded:
                    pairs |= {a + b for a in chars for b in chars}
                for after, least, _ in items[i + 1:]:
                    pairs |= {a + b for a in chars for b in after}
                    if least:
                        break
        return sorted(pairs)

    def machine(self, symbols: Mapping[str, int], contiguous: bool = True) -> Machine:
        """Automaton over the symbols that atoms have; ``symbols`` has one more for any other atom and one for null, ``""`` and ``None``."""
        of: dict[str, set[int]] = {}
        unusable = {symbols[None]}
        for a, n in symbols.items():
            if a is not None and (a in self.code or self.wild):
                of.setdefault(self.code.get(a, self.other), set()).add(n)
            else:
                unusable.add(n)
        items = [[(frozenset().union(*(of.get(c, ()) for c in chars)), least, unbounded) for chars, least, unbounded in its]
                 for its in self.items.values()]
        return Machine(items, len(symbols), *((unusable, frozenset()) if contiguous else (frozenset(), frozenset(unusable))))

    def sql_encode(self, atom_sql: str) -> str:
        whens = " ".join(f"WHEN {atom_sql} = '{a}' THEN chr({ord(ch)})" for a, ch in self.code.items())
        return f"CASE {whens} ELSE chr({ord(self.other)}) END"

    def ordered_rules(self) -> list[tuple[str, str]]:
        return list(self.regex.items())


def match_sequence(df: DataFrame, key: str, order: Sequence[str], atom: str, rules: Mapping[str, str],
                   partitions: int | None = None, *, contiguous: bool = True, emit_empty: bool = False) -> DataFrame:
    """W-8: ``(key, rule, start, end)`` with ``end`` exclusive, in atom positions.

    ``contiguous=False`` passes over atoms that no rule can use instead of
    letting them end a match.  ``emit_empty`` adds a match of length 0 at each
    atom that no match covers, for the first rule that also matches nothing.
    """
    return match_each(df, key, order, atom, {"": rules}, partitions, contiguous=contiguous, emit_empty=emit_empty).drop("machine")


def match_each(df: DataFrame, key: str, order: Sequence[str], atom: str, machines: Mapping[str, Mapping[str, str]],
               partitions: int | None = None, *, contiguous: bool = True, emit_empty: bool = False) -> DataFrame:
    """W-9: several independent matchers over one stream: ``(key, machine, rule, start, end)``.

    Null keys are one key, a null atom is one that no rule can use, rows that are equal in ``order`` stand in any order.
    """
    compiled = {name: Compiled(rules) for name, rules in machines.items()}
    names = [None, ""] + [a for a in dict.fromkeys(a for c in compiled.values() for a in c.atoms) if a != ""]
    symbols = {a: n for n, a in enumerate(names)}
    symbol = F.when(F.col(atom).isNull(), F.lit(0))
    for a, n in symbols.items():
        if n > 1:
            symbol = symbol.when(F.col(atom) == a, F.lit(n))
    own = key_name([key])
    rows = with_key(df.select(key, *order, symbol.otherwise(F.lit(1)).alias("_symbol")), [key])
    ensure_checkpoint_dir(df.sparkSession)
    rows = (chunk_by_range(rows, [own], order, partitions).sortWithinPartitions(own, *order)
            .select(own, CHUNK, F.col(key).alias("_k"), "_symbol").checkpoint(eager=True))
    build = lambda: [c.machine(symbols, contiguous) for c in compiled.values()]
    several = rows.groupBy(own).agg(F.min(CHUNK).alias("a"), F.max(CHUNK).alias("b")).where("a < b").select(own)
    narrow = rows.join(F.broadcast(several), own, "left_semi")
    ids = f"`{own}` string, {CHUNK} bigint"

    def effects(batches):
        found = build()
        for k, chunk, _, _, seen in _sequences(batches, own):
            yield pa.RecordBatch.from_pylist([{own: k, CHUNK: chunk, "n": len(seen), "sum": json.dumps([m.effect(seen) for m in found])}])

    def sets(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        after, out = None, []
        for n, text in zip(reversed(table["n"].to_pylist()), reversed(table["sum"].to_pylist())):
            each = json.loads(text)
            after = [0] * len(each) if after is None else after
            out.append({"n": n, "after": list(after)})
            after = [Machine.applied(e, a) for e, a in zip(each, after)]
        at = 0
        for x in reversed(out):
            x["base"], at = at, at + x["n"]
        return pa.table({own: table[own], CHUNK: table[CHUNK], "known": [json.dumps(x) for x in reversed(out)]})

    def passages(batches):
        found = build()
        for k, chunk, _, known, seen in _sequences(batches, own):
            yield pa.RecordBatch.from_pylist([{own: k, CHUNK: chunk, "known": json.dumps(known), "sum": json.dumps(
                [m.passage(seen, a) for m, a in zip(found, known["after"])])}])

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        now, out = None, []
        for text, summed in zip(table["known"].to_pylist(), table["sum"].to_pylist()):
            known, each = json.loads(text), json.loads(summed)
            now = [(IDLE, 0)] * len(each) if now is None else now
            out.append(json.dumps(known | {"state": [s for s, _ in now], "begun": [b for _, b in now]}))
            moved = [e[s] for e, (s, _) in zip(each, now)]      # the last entry is that of the idle state, -1
            now = [(s, known["base"] + at if at >= 0 else b) for (s, at), (_, b) in zip(moved, now)]
        return pa.table({own: table[own], CHUNK: table[CHUNK], "known": out})

    def final(batches):
        found, rules, free = build(), [list(c.rules) for c in compiled.values()], [c.empty for c in compiled.values()]
        for _, _, k, known, seen in _sequences(batches, own):
            out = []
            for i, (name, m) in enumerate(zip(compiled, found)):
                at = {"after": known["after"][i], "state": known["state"][i], "begun": known["begun"][i], "base": known["base"]} if known else {}
                for rule, start, end in m.matches(seen, **at):
                    if rule >= 0:
                        out.append((name, rules[i][rule], start, end))
                    elif emit_empty and free[i]:
                        out.append((name, free[i][0], start, end))
            for i in range(0, len(out), 1 << 16):
                some = out[i:i + (1 << 16)]
                yield pa.record_batch([pa.array([k] * len(some), key_type), *(pa.array([x[c] for x in some], t) for c, t in enumerate(
                    (pa.string(), pa.string(), pa.int64(), pa.int64())))], names=[key, "machine", "rule", "start", "end"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[key].dataType)
    back = narrow.withColumn("known", F.lit(None).cast("string")).mapInArrow(effects, f"{ids}, n bigint, sum string").groupBy(own).applyInArrow(
        sets, f"{ids}, known string")
    ahead = narrow.join(F.broadcast(back), [own, CHUNK]).mapInArrow(passages, f"{ids}, known string, sum string").groupBy(own).applyInArrow(
        entries, f"{ids}, known string")
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, machine string, rule string, start bigint, `end` bigint"
    return rows.join(F.broadcast(ahead), [own, CHUNK], "left").mapInArrow(final, out)


def _sequences(batches, own: str):
    """``(key string, chunk, key, what is known of the slice, symbols)`` for each key of a partition, as its rows lie."""
    at, first, seen = None, None, []
    for batch in batches:
        keys, chunks, ks, knowns = (batch.column(c) for c in (own, CHUNK, "_k", "known"))
        ids, symbols = keys.to_pylist(), batch.column("_symbol").to_pylist()
        begin = 0
        while begin < len(ids):
            # a batch is cut where the key changes; keys lie together
            end = begin + 1
            while end < len(ids) and ids[end] == ids[begin]:
                end += 1
            if at is None or ids[begin] != at:
                if at is not None:
                    yield at, *first, seen
                known = knowns[begin].as_py()
                at, first, seen = ids[begin], (chunks[begin].as_py(), ks[begin].as_py(), json.loads(known) if known else None), []
            seen += symbols[begin:end]
            begin = end
    if at is not None:
        yield at, *first, seen


def sequence_sql(comp: Compiled, table: str, key: str, order: str, atom: str, machine: str | None = None) -> str:
    """DuckDB text of W-8 over whole keys (one string per key)."""
    rules = comp.ordered_rules()
    alts, groups, n = [], [], 0
    for _, rx in rules:
        groups.append(n + 1)
        n += 1
        alts.append(f"({rx})")
    rx = "|".join(alts)
    g_cols = ", ".join(f"regexp_extract_all(s, '{rx}', {g}) AS g{i}" for i, g in enumerate(groups))
    g_un = ", ".join(f"unnest(g{i}) AS g{i}" for i in range(len(groups)))
    case = " ".join(f"WHEN COALESCE(g{i}, '') <> '' THEN '{name}'" for i, (name, _) in enumerate(rules))
    mcol = f"'{machine}' AS machine, " if machine else ""
    return f"""(
WITH e AS (SELECT {key} AS k, string_agg({comp.sql_encode(atom)}, '' ORDER BY {order}) AS s FROM {table} GROUP BY {key}),
b AS (SELECT k, regexp_split_to_array(s, '{rx}') AS gaps, regexp_extract_all(s, '{rx}', 0) AS toks, {g_cols} FROM e),
gp AS (SELECT k, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS t FROM b),
tk AS (SELECT k, generate_subscripts(toks, 1) AS i, unnest(toks) AS t, {g_un} FROM b),
pc AS (SELECT k, 2 * (i - 1) AS piece, NULL AS rule, t FROM gp
       UNION ALL SELECT k, 2 * (i - 1) + 1 AS piece, CASE {case} END AS rule, t FROM tk),
st AS (SELECT *, COALESCE(SUM(length(t)) OVER (PARTITION BY k ORDER BY piece
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pc)
SELECT k AS {key}, {mcol}rule, CAST(start AS BIGINT) AS start, CAST(start + length(t) AS BIGINT) AS "end"
FROM st WHERE rule IS NOT NULL)"""
