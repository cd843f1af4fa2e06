"""Rule sets as automata that read a sequence in two deterministic passes.

Which rule matches at a position, and where the match ends, depends on what follows, and
how far one must look has no bound (``a+ b`` or else ``a``).  So a backward
pass finds, for each position, the states from which a match can go on: a set of states
that follows from the next position's set and the atom alone.  With those sets a forward pass
decides every step at once: greedy, first rule first, never taking a way that fails later.
Each atom is looked at twice, whatever the rules.

Both passes are finite, so a slice of a sequence is summed up by what it does to
the set at its end (a union of the sets it makes of single states) and to the state at its begin.
"""

from __future__ import annotations

from collections.abc import Sequence

IDLE = -1


class Machine:
    """``items``: for each rule in order its ``(symbols, least, unbounded)`` items; a match is the longest by items in
    order (greedy with going back), of the first rule that matches at a position, and never empty.

    ``breaks`` are symbols that end a match, ``skips`` ones that are passed over.
    """

    def __init__(self, items: Sequence[Sequence[tuple[frozenset[int], int, bool]]], symbols: int,
                 breaks: frozenset[int] = frozenset(), skips: frozenset[int] = frozenset()):
        self.breaks, self.skips = breaks, skips
        places = [(r, i, c) for r, its in enumerate(items) for i in range(len(its)) for c in (0, 1)]
        number = {p: n for n, p in enumerate(places)}
        self.size = len(places)
        self.rule = [r for r, _, _ in places]
        self.begins = [number[r, 0, 0] for r in range(len(items))]
        #: States that may end where they are.
        self.nullable = 0
        self.targets: list[list[list[int]]] = []      # [symbol][state]: states after it, best first
        for n, (r, i, c) in enumerate(places):
            if (c or items[r][i][1] == 0) and all(x[1] == 0 for x in items[r][i + 1:]):
                self.nullable |= 1 << n
        for a in range(symbols):
            row = []
            for r, i, c in places:
                found, j, had = [], i, c
                while j < len(items[r]):
                    chars, least, unbounded = items[r][j]
                    if a in chars and (not had or unbounded):
                        found.append(number[r, j, 1])
                    if not had and least:
                        break
                    j, had = j + 1, 0
                row.append(found)
            self.targets.append(row)
        self._back: dict[tuple[int, int], int] = {}
        self._step: dict[tuple[int, int, int], tuple[int, int, bool]] = {}

    def before(self, symbol: int, after: int) -> int:
        """Set of states that can go on from a position with ``symbol``, given the set of the next position."""
        key = (symbol, after)
        if key not in self._back:
            if symbol in self.skips:
                found = after
            elif symbol in self.breaks:
                found = 0
            else:
                ends = after | self.nullable
                found = sum(1 << q for q, ts in enumerate(self.targets[symbol]) if any(ends >> t & 1 for t in ts))
            self._back[key] = found
        return self._back[key]

    def sets(self, symbols: Sequence[int], after: int) -> list[int]:
        """The sets at every position of ``symbols`` and, last, the one after them."""
        out, before, known = [after] * (len(symbols) + 1), self.before, self._back
        for p in range(len(symbols) - 1, -1, -1):
            key = (symbols[p], after)
            after = known[key] if key in known else before(*key)
            out[p] = after
        return out

    def step(self, state: int, symbol: int, after: int) -> tuple[int, int, bool]:
        """``(state, rule that begins here or -1, whether the match ends after this atom)``."""
        key = (state, symbol, after)
        if key not in self._step:
            self._step[key] = self._stepped(*key)
        return self._step[key]

    def _stepped(self, state: int, symbol: int, after: int) -> tuple[int, int, bool]:
        if symbol in self.skips:
            return state, -1, False
        if symbol in self.breaks:
            return IDLE, -1, False
        ends = after | self.nullable
        for rule, at in ([(-1, state)] if state != IDLE else list(enumerate(self.begins))):
            for t in self.targets[symbol][at]:
                if ends >> t & 1:
                    going = bool(after >> t & 1)
                    return (t if going else IDLE), rule, not going
        return IDLE, -1, False

    def effect(self, symbols: Sequence[int]) -> list[int]:
        """What a slice makes of the set after it: of the empty set, and of each single state."""
        out = []
        for start in [0, *(1 << q for q in range(self.size))]:
            after = start
            for a in reversed(symbols):
                after = self.before(a, after)
            out.append(after)
        return out

    @staticmethod
    def applied(effect: list[int], after: int) -> int:
        found = effect[0]
        for q in range(len(effect) - 1):
            if after >> q & 1:
                found |= effect[q + 1]
        return found

    def passage(self, symbols: Sequence[int], after: int) -> list[tuple[int, int]]:
        """For each state before a slice (the last one: idle) the state after it and the offset at which the match that is
        then open began, -1 if before the slice."""
        sets = self.sets(symbols, after)
        now = {s: (s, -1) for s in [*range(self.size), IDLE]}       # state before -> (state, begun)
        for p, a in enumerate(symbols):
            moved: dict[tuple[int, int], tuple[int, int]] = {}
            for state, begun in set(now.values()):
                to, rule, _ = self.step(state, a, sets[p + 1]) if state == IDLE or self._alive(state, a, sets[p + 1]) else (IDLE, -1, False)
                moved[state, begun] = (to, p if rule >= 0 and to != IDLE else begun if to != IDLE else -1)
            now = {s: moved[v] for s, v in now.items()}
        return [now[s] for s in [*range(self.size), IDLE]]

    def _alive(self, state: int, symbol: int, after: int) -> bool:
        """Whether a match in ``state`` can go on over ``symbol``; states that cannot are never reached."""
        return bool(self.before(symbol, after) >> state & 1)

    def matches(self, symbols: Sequence[int], after: int = 0, state: int = IDLE, begun: int = 0, base: int = 0):
        """``(rule, start, end)`` of the matches that end in a slice at ``base``, entered in ``state`` of a match begun at
        ``begun``; and ``(-1, p, p)`` for each atom outside all matches."""
        sets, step, known = self.sets(symbols, after), self.step, self._step
        rule = self.rule[state] if state != IDLE else -1
        for p, a in enumerate(symbols):
            key = (state, a, sets[p + 1])
            inside = state != IDLE
            state, begins, ends = known[key] if key in known else step(*key)
            if begins >= 0:
                rule, begun = begins, base + p
            if ends:
                yield rule, begun, base + p + 1
            elif not inside and state == IDLE:
                yield -1, base + p, base + p
