"""Lexical state and open scopes of Python source lines (Y-1 .. Y-6).

A line means something else inside a string, inside brackets or after a backslash,
so each line is read from the state the one before it left: code, continued
code, inside ``'''`` or ``\"\"\"``, inside a one-line string continued by a backslash, and the number of
open brackets.  Where a logical line begins, its indent closes scopes and a declaration opens one.

A file within one slice is read once.  A slice of a longer file is first summed up
as a map from every state it can begin in to the state it ends in.  Brackets need no
bound on their depth: a slice closes ``popped`` brackets of those before it and leaves
``pushed`` open.  Scopes are summed up as the least indent seen and the declarations
left open (a monotone stack), apart for each value of ``popped``, as lines count only once the
brackets that were open at the slice's begin are closed.  The maps of a file, one row a
slice, are put together in order, and then every slice is read with its true state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import CHUNK, CHUNK_ROWS, chunk_by_position, key_name, with_key

CODE, CONTINUED, TRIPLE_1, TRIPLE_2, SINGLE_1, SINGLE_2 = range(6)
#: More brackets than can be open.
ALL = 1 << 60
DECL = r"^([ \t]*)(async[ \t]+)?(class|def)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
RECORD_CLASS = r"^[ \t]*class[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*\(([^)]*[^A-Za-z0-9_])?(NamedTuple|dataclass)([^A-Za-z0-9_][^)]*)?\)"
SCOPES = "array<struct<line:bigint,name:string,kind:string,record:boolean,indent:bigint>>"
KEY = key_name(["path"])

_DECL, _RECORD = re.compile(DECL), re.compile(RECORD_CLASS)
_PLAIN = re.compile(r"""['"#\\]""")
_BRACKET = re.compile(r"[()\[\]{}]")
_TOKEN = re.compile(r"""(?P<prefix>(?<![A-Za-z0-9_])[rRuUbBfF]{1,2}(?=['"]))?(?P<quote>'''|\"\"\"|'|")|(?P<comment>\#)|(?P<open>[(\[{])|(?P<close>[)\]}])
                     |(?P<go>\\\r?(?:\n|\Z))|\\.""", re.S | re.X)
_MODE = {"'''": TRIPLE_1, '"""': TRIPLE_2, "'": SINGLE_1, '"': SINGLE_2}
_STRING_END = {TRIPLE_1: re.compile(r"\\.|'''", re.S), TRIPLE_2: re.compile(r'\\.|"""', re.S),
               SINGLE_1: re.compile(r"\\(?:\r\n|.)|'|\r?\n", re.S), SINGLE_2: re.compile(r'\\(?:\r\n|.)|"|\r?\n', re.S)}
_CHAR = re.compile(r"[^\r\n]")


class Scope(NamedTuple):
    line: int
    name: str
    kind: str
    record: bool
    indent: int


def _masked(text: str) -> str:
    """As many quotes as there are characters; line ends stay."""
    return '"' * len(text) if "\n" not in text and "\r" not in text else _CHAR.sub('"', text)


class Reader:
    """Reads the lines of a file in order from a given state."""

    def __init__(self, mode: int = CODE, pushed: int = 0, stack: tuple = (), fresh: bool = False):
        self.mode, self.popped, self.pushed = mode, 0, pushed
        self.stack: tuple[Scope, ...] = tuple(stack)
        self.fresh = fresh

    def line(self, number: int, text: str) -> tuple[bool, str, list[int], bool, str | None]:
        """``(start, code, closed, first, said)``: whether a logical line begins here; the text with strings as quotes and
        comments as blanks; lines of the declarations that end; whether it is the first of the body of the last
        declaration; what the strings of the line say, if it is in such a line."""
        # ``class`` and ``def`` cannot stand within brackets: brackets still open there are given up
        if self.mode == CODE and _DECL.match(text):
            self.popped, self.pushed = ALL, 0
        start = self.mode == CODE and not self.pushed
        said: list[str] = []
        code = self._read(text, said)
        closed, first = [], False
        if start and code.strip():
            indent = len(code) - len(code.lstrip(" \t"))
            keep = len(self.stack)
            while keep and self.stack[keep - 1].indent >= indent:
                keep -= 1
            closed = [s.line for s in self.stack[keep:]]
            self.stack = self.stack[:keep]
            first = self.fresh and not closed
            declared = _DECL.match(code)
            self.fresh = declared is not None
            self.opens = Scope(number, declared[4], declared[3], _RECORD.match(text) is not None, indent) if declared else None
        else:
            self.opens = None
        return start, code, closed, first, "".join(said)

    def enter(self) -> None:
        """Open the scope that the line just read declares."""
        if self.opens:
            self.stack = (*self.stack, self.opens)

    def _read(self, text: str, said: list[str]) -> str:
        if self.mode <= CONTINUED and not _PLAIN.search(text):
            for b in _BRACKET.findall(text):
                self._bracket(b in "([{")
            self.mode = CODE
            return text
        out, i, go = [], 0, False
        while i < len(text):
            if self.mode > CONTINUED:
                at, end = i, _STRING_END[self.mode]
                while True:
                    m = end.search(text, i)
                    if m is None:
                        said.append(text[at:])
                        out.append(_masked(text[at:]))
                        return "".join(out)
                    i = m.end()
                    if m[0][0] != "\\":
                        break
                if m[0][-1] == "\n":  # a one-line string that is not closed ends with its line
                    i = m.start()
                said.append(text[at:m.start()])
                out.append(_masked(text[at:i]))
                self.mode = CODE
                continue
            m = _TOKEN.search(text, i)
            if m is None:
                out.append(text[i:])
                break
            out.append(text[i:m.start()])
            i = m.end()
            if m["quote"]:
                self.mode = _MODE[m["quote"]]
                out.append(_masked(m[0]))
            elif m["comment"]:
                rest = text[m.start():]
                body = rest.rstrip("\r\n")
                out.append(" " * len(body) + rest[len(body):])
                break
            else:
                out.append(m[0])
                go = m["go"] is not None
                if m["open"] or m["close"]:
                    self._bracket(m["open"] is not None)
        if self.mode <= CONTINUED:
            self.mode = CONTINUED if go else CODE
        return "".join(out)

    def _bracket(self, opens: bool) -> None:
        if opens:
            self.pushed += 1
        elif self.pushed:
            self.pushed -= 1
        else:
            self.popped = min(self.popped + 1, ALL)


class _Sum:
    """Sums up a slice that is read piece by piece: none of its rows is kept."""

    def __init__(self):
        self.readers, self.parts, self.chars = [Reader(mode) for mode in range(6)], [[] for _ in range(6)], 0

    def add(self, rows: Sequence[tuple[int, str]]) -> None:
        self.chars += sum(len(text) for _, text in rows)
        for reader, parts in zip(self.readers, self.parts):
            for number, text in rows:
                before = reader.popped
                start, code, _, _, _ = reader.line(number, text)
                reader.stack = ()
                if not (start and code.strip()):
                    continue
                level = ALL if reader.opens else before
                if not parts or parts[-1]["popped"] != level:
                    parts.append({"popped": level, "least": ALL, "stack": [], "fresh": False, "head": (number, len(code) - len(code.lstrip(" \t")))})
                part = parts[-1]
                indent = len(code) - len(code.lstrip(" \t"))
                # the first statement of a part may belong to a declaration before it, which is not known yet
                part["last"], part["body"] = number, number if part["fresh"] and part["stack"][-1].indent < indent else None
                part["least"] = min(part["least"], indent)
                part["stack"] = [s for s in part["stack"] if s.indent < indent] + ([reader.opens] if reader.opens else [])
                part["fresh"] = reader.opens is not None

    def maps(self) -> list[dict]:
        """For each mode a slice can begin in, where it ends and its scopes for each value of ``popped``; its characters."""
        return [{"mode": reader.mode, "popped": reader.popped, "pushed": reader.pushed, "parts": parts, "chars": self.chars}
                for reader, parts in zip(self.readers, self.parts)]


def _summed(rows: Sequence[tuple[int, str]]) -> list[dict]:
    """The maps of a slice that is there whole."""
    summed = _Sum()
    summed.add(rows)
    return summed.maps()


def _put_together(maps: list[list[dict]]) -> list[dict]:
    """The state that each of a file's slices begins in, from the maps of its slices in order."""
    mode, depth, stack, fresh, body, offset, out = CODE, 0, [], False, None, 0, []
    for each in maps:
        out.append({"mode": mode, "pushed": depth, "stack": stack, "fresh": fresh, "body": body, "offset": offset})
        found = each[mode]
        offset += found["chars"]
        for part in found["parts"]:
            if part["popped"] >= depth:
                at, indent = part["head"]
                body = part["body"]
                if part["last"] == at and fresh and stack[-1][4] < indent:
                    body = at
                stack = [s for s in stack if s[4] < part["least"]] + part["stack"]
                fresh = part["fresh"]
        mode, depth = found["mode"], max(depth - found["popped"], 0) + found["pushed"]
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """``((key, chunk), begin, end)`` of the stretches of a batch that belong to one slice."""
    ids = list(zip(batch.column(KEY).to_pylist(), batch.column(CHUNK).to_pylist()))
    begin = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[begin]:
            yield ids[begin], begin, i
            begin = i


def _maps(batches):
    at, summed = None, _Sum()

    def row():
        return pa.RecordBatch.from_pylist([{KEY: at[0], CHUNK: at[1], "map": json.dumps(summed.maps())}])

    for batch in batches:
        numbers, texts = batch.column("number").to_pylist(), batch.column("text").to_pylist()
        for key, begin, end in _runs(batch):
            if key != at:
                if at is not None:
                    yield row()
                at, summed = key, _Sum()
            summed.add([(n, t or "") for n, t in zip(numbers[begin:end], texts[begin:end])])
    if at is not None:
        yield row()


def _chain(maps: pa.Table) -> pa.Table:
    maps = maps.sort_by(CHUNK)
    found = _put_together([json.loads(m) for m in maps["map"].to_pylist()])
    return pa.table({KEY: maps[KEY], CHUNK: maps[CHUNK], "_entry": [json.dumps(x) for x in found]})


_SCOPE_TYPE = pa.list_(pa.struct([("line", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("record", pa.bool_()), ("indent", pa.int64())]))


def _listed(stacks: list[tuple[Scope, ...]], of: list[int]) -> pa.Array:
    return pa.array([[s._asdict() for s in stack] for stack in stacks], _SCOPE_TYPE).take(pa.array(of, pa.int64()))


def _final(batches):
    at, reader = None, Reader()
    body, offset = None, 0
    for batch in batches:
        numbers, texts, entries = batch.column("number").to_pylist(), batch.column("text").to_pylist(), batch.column("_entry")
        starts, codes, closes, docs, says, decls, opens, stacks, of, offsets = [], [], [], [], [], [], [], [], [], []
        last = None
        for key, begin, end in _runs(batch):
            if key != at:
                at, entry = key, entries[begin].as_py()
                known = json.loads(entry) if entry else {}
                known["stack"] = tuple(Scope(*s) for s in known.get("stack", ()))
                body, offset = known.pop("body", None), known.pop("offset", 0)
                reader = Reader(**known)
            for i in range(begin, end):
                start, code, closed, first, said = reader.line(numbers[i], texts[i] or "")
                if start and code.strip():
                    body = numbers[i] if first else None
                if reader.stack is not last:
                    last = reader.stack
                    stacks.append(last)
                offsets.append(offset)
                offset += len(texts[i] or "")
                starts.append(start)
                codes.append(code)
                closes.append(closed)
                decls.append(reader.opens is not None)
                docs.append(body)
                opens.append(reader.mode > CONTINUED)
                says.append(said if body is not None else None)
                of.append(len(stacks) - 1)
                reader.enter()
        kept = [c for c in batch.schema.names if c != "_entry"]
        own = [] if "offset" in kept else [pa.array(offsets, pa.int64())]
        yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(starts, pa.bool_()), pa.array(codes, pa.string()),
                               pa.array(decls, pa.bool_()), pa.array(closes, pa.list_(pa.int64())), pa.array(docs, pa.int64()),
                               pa.array(says, pa.string()), pa.array(opens, pa.bool_()), _listed(stacks, of), *own],
                              names=[*kept, "start", "code", "decl", "closes", "first", "said", "open", "scopes", *["offset"] * len(own)])


def lexed_lines(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every line of ``(path, number, text)`` with, besides its own columns,

    * ``start``: a logical line begins here (not in a string or brackets, nor after a backslash);
    * ``code``: the text, strings as ``\"`` (prefix and quotes too) and comments as blanks, columns unchanged;
    * ``decl``: it declares a class or function; ``scopes``: the declarations open at it from the outside
      in, ``struct(line, name, kind, record, indent)``; ``closes``: lines of the declarations that end before it;
    * ``first``: for a line of the first statement in a declaration's body, the number of that statement's first
      line; ``said``: what the strings on such a line say, without quotes;
    * ``open``: the line ends within a string; ``offset``, unless the lines have it: characters of the file before it.

    Comments and blank lines close no scope.  ``class`` or ``def`` at the begin of a line within brackets
    ends those brackets, so a bracket that is never closed loses no later declaration.  An unclosed
    one-line string ends with its line; one of three quotes lasts to the end of the file.
    Null text: an empty line.  Lines may be of any length.  Lines that were read already are returned as they are.
    """
    if "scopes" in lines.columns:
        return lines
    df = lines if CHUNK in lines.columns else chunk_by_position(lines, "number", chunk_rows)
    df = with_key(df, ["path"])
    # dealt by a hash of its own: see the join below
    dealt = lambda x: x.repartition(F.xxhash64(KEY, CHUNK)).sortWithinPartitions(KEY, CHUNK, "number")
    long = df.groupBy(KEY).agg(F.min(CHUNK).alias("a"), F.max(CHUNK).alias("b")).filter("a < b").select(KEY)
    narrow = df.select(KEY, CHUNK, "number", "text").join(long, KEY, "left_semi")
    maps = dealt(narrow).mapInArrow(_maps, f"{KEY} string, {CHUNK} bigint, map string")
    entries = maps.groupBy(KEY).applyInArrow(_chain, f"{KEY} string, {CHUNK} bigint, _entry string")
    rows = dealt(df.join(entries, [KEY, CHUNK], "left"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_entry")
    return rows.mapInArrow(_final, f"{kinds}, start boolean, code string, decl boolean, closes array<bigint>, first bigint, said string, open boolean, scopes {SCOPES}"
                            + ("" if "offset" in rows.columns else ", offset bigint"))
