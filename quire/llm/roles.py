"""Generalised LR repair of role sequences.

The grammar's SLR table drives a graph-structured stack.  Stacks are interned, so
two ways that lead to the same stack are one top, and of those the one with the least
``(cost, audit)`` stays.  Because the grammar is left-recursive, few stacks
exist, and reading a row is a move between numbered tops.

A slice of rows is read from every top at once, which gives a map (top before ->
top after, with cost and the rank of its audit); maps of neighbouring slices are
put together without their rows.  Audits are never compared as strings: every way
up to a row has consumed the same rows, so no audit is a proper prefix of another and
``(rank so far, letters of this row)`` decides.
"""

from __future__ import annotations

from functools import cached_property

#: Roles by initial, productions of ``(s?(ua)+)?``, costs of the edits.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
GRAMMAR = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that rerole and insert may give.
GIVEN = "ua"
#: Faults of a row.
FINE, CUT_OFF, GONE = 0, 1, 2


class Table:
    """SLR(1) table of a grammar whose lower-case letters are terminals."""

    def __init__(self, grammar):
        self.rules = [("^", grammar[0][0]), *grammar]
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for state, items in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.goto[state, symbol] = self.states.index(to)

    def _closure(self, items):
        items, todo = set(items), list(items)
        while todo:
            r, d = todo.pop()
            symbol = self.rules[r][1][d:d + 1]
            new = {(k, 0) for k, (head, _) in enumerate(self.rules) if head == symbol} - items
            items |= new
            todo += new
        return frozenset(items)

    def _first(self, symbols: str, seen=()) -> set[str]:
        """Terminals that may begin ``symbols``; ``""`` if it may be empty."""
        if not symbols:
            return {""}
        x = symbols[0]
        own = {x} if x.islower() or x == "$" else set()
        if not own and x not in seen:
            for head, body in self.rules:
                if head == x:
                    own |= self._first(body, (*seen, x))
        return (own - {""}) | self._first(symbols[1:], seen) if "" in own else own

    def _follow(self):
        follow = {head: {"$"} if head == "^" else set() for head, _ in self.rules}
        while True:
            before = {k: set(v) for k, v in follow.items()}
            for head, body in self.rules:
                for i, x in enumerate(body):
                    if x in follow:
                        after = self._first(body[i + 1:])
                        follow[x] |= (after - {""}) | (follow[head] if "" in after else set())
            if before == follow:
                return follow

    def shifts(self, stack: tuple[int, ...], terminal: str) -> set[tuple[int, ...]]:
        """Every stack after the reductions ``terminal`` allows and its shift; ``$`` gives the stacks that accept."""
        out, seen, todo = set(), {stack}, [stack]
        while todo:
            at = todo.pop()
            if (at[-1], terminal) in self.goto:
                out.add((*at, self.goto[at[-1], terminal]))
            for r, d in self.states[at[-1]]:
                head, body = self.rules[r]
                if d < len(body) or terminal not in self.follow[head]:
                    continue
                if r == 0:
                    out.add(at)
                    continue
                below = at[:len(at) - len(body)]
                new = (*below, self.goto[below[-1], head])
                if new not in seen:
                    seen.add(new)
                    todo.append(new)
        return out


class Repair:
    """Least-cost edits of a row sequence under the grammar, by moves between interned stacks."""

    def __init__(self, grammar=GRAMMAR, most_stacks: int = 1000):
        self.table = Table(grammar)
        self.stacks = [(0,)]
        self.moves: list[dict[str, set[int]]] = []
        self.accepts: list[bool] = []
        for stack in self.stacks:  # grows meanwhile
            to = {}
            for t in ROLES:
                to[t] = set()
                for new in self.table.shifts(stack, t):
                    if new not in self.stacks:
                        self.stacks.append(new)
                    to[t].add(self.stacks.index(new))
            if len(self.stacks) > most_stacks:
                raise ValueError("the grammar has too many stacks for repair by slices")
            self.moves.append(to)
            self.accepts.append(bool(self.table.shifts(stack, "$")))
        self._steps: dict = {}

    @property
    def size(self) -> int:
        return len(self.stacks)

    @cached_property
    def inserts(self) -> list[dict[int, str]]:
        """For each top, the tops that inserted rows alone lead to, with the fewest (ties: first in ASCII order)."""
        out = []
        for top in range(self.size):
            best, todo = {top: ""}, [top]
            for at in todo:  # breadth first
                for t in sorted(GIVEN):
                    for new in sorted(self.moves[at][t]):
                        if new not in best:
                            best[new] = best[at] + t
                            todo.append(new)
            out.append(best)
        return out

    @cached_property
    def ends(self) -> list[tuple[int, str] | None]:
        """For each top, cost and inserted roles of the cheapest way to an accepted end."""
        out = []
        for best in self.inserts:
            ways = [(len(path), path) for to, path in best.items() if self.accepts[to]]
            out.append((INSERT * min(ways)[0], min(ways)[1]) if ways else None)
        return out

    @cached_property
    def behind(self) -> list[list[int]] | None:
        """``behind[y][x]``: the most that going on from ``y`` can cost more than going on from ``x``, whatever rows follow.

        Value of the game in which ``x`` edits and ``y`` answers, over more and more rows until it
        stays as it is; None if it does not.  A top that is further behind is on no best way.
        """
        n, worst = self.size, float("inf")
        end = [e[0] if e else worst for e in self.ends]
        steps = [(t, x, cost, row) for t in ROLES for x in range(n) for cost, row in (
            [(KEEP, True)] + ([(REROLE, True), (INSERT, False)] if t in GIVEN else []))]
        now = [[end[y] - end[x] if end[x] < worst else -worst for x in range(n)] for y in range(n)]
        for _ in range(100):
            new = [list(row) for row in now]
            for y in range(n):
                for x in range(n):
                    values = []
                    for mid, path in self.inserts[y].items():
                        most = end[mid] - end[x] if end[x] < worst else -worst
                        for t, from_x, cost, row in steps:
                            for to in self.moves[from_x][t] if from_x == x else ():
                                answers = [now[z][to] for z in self.moves[mid][t]]
                                answers.append((DELETE if row else 0) - cost + now[mid][to])
                                if row:
                                    answers += [REROLE - cost + now[z][to] for g in GIVEN for z in self.moves[mid][g]]
                                most = max(most, min(answers))
                        values.append(INSERT * len(path) + most)
                    new[y][x] = min(values)
            if new == now:
                return now
            now = new
        return None

    def ways(self, initial: str, fault: int) -> list[list[tuple[int, int, str, str, str]]]:
        """For each top: ``(top after, cost, letters, inserted roles, role given or "")`` over one row."""
        late = TRUNCATED if fault == CUT_OFF else 0
        out = []
        for best in self.inserts:
            found: dict[int, tuple] = {}
            for mid, path in best.items():
                cost, letters = INSERT * len(path), "I" * len(path)
                steps = [(mid, cost + DELETE, letters + "D", path, "")]
                if fault != GONE:
                    for to in self.moves[mid].get(initial, ()):
                        steps.append((to, cost + late + KEEP, letters + "K", path, ""))
                    for t in GIVEN:
                        for to in self.moves[mid][t]:
                            steps.append((to, cost + late + REROLE, letters + "R", path, t))
                for s in steps:
                    if s[0] not in found or s[1:] < found[s[0]][1:]:
                        found[s[0]] = s
            out.append(list(found.values()))
        return out

    def start(self, entries: list[int]) -> tuple:
        """Frontier before any row: for each entry the tops reached, ``(top, cost, rank)`` with the entry's least cost 0."""
        return tuple(((e, 0, 0),) for e in entries)

    def step(self, frontier: tuple, initial: str, fault: int):
        """``(frontier, cost added to each entry, back)``; ``back[entry][top]`` is ``(top before, letters, inserted, role)``.

        Frontiers are relative and hold no top that is too far behind, so few of them exist and each
        step is worked out once.
        """
        key = (frontier, initial, fault)
        if key not in self._steps:
            if len(self._steps) > 100_000:
                self._steps.clear()
            self._steps[key] = self._step(frontier, self.ways(initial, fault))
        return self._steps[key]

    def _step(self, frontier, ways):
        merged = []
        for tops in frontier:
            best: dict[int, tuple] = {}
            for top, cost, rank in tops:
                for to, more, letters, path, role in ways[top]:
                    new = (cost + more, rank, letters, top, path, role)
                    if to not in best or new[:3] < best[to][:3]:
                        best[to] = new
            if self.behind:
                best = {to: w for to, w in best.items() if not any(w[0] > o[0] + self.behind[y][to] for y, o in best.items())}
            merged.append(best)
        ranks = {x: i for i, x in enumerate(sorted({w[1:3] for best in merged for w in best.values()}))}
        least = [min(w[0] for w in best.values()) for best in merged]
        after = tuple(tuple((to, w[0] - low, ranks[w[1:3]]) for to, w in sorted(best.items())) for best, low in zip(merged, least))
        return after, tuple(least), [{to: (w[3], w[2], w[4], w[5]) for to, w in best.items()} for best in merged]

    def slice_map(self, rows) -> tuple[list[list[int]], list[list[int]]]:
        """``cost[entry][top]`` and ``rank[entry][top]`` (-1: not reached) over ``(initial, fault)`` rows."""
        frontier, base = self.start(list(range(self.size))), [0] * self.size
        for initial, fault in rows:
            frontier, more, _ = self.step(frontier, initial, fault)
            base = [b + m for b, m in zip(base, more)]
        cost, rank = [[-1] * self.size for _ in base], [[-1] * self.size for _ in base]
        for e, tops in enumerate(frontier):
            for top, c, r in tops:
                cost[e][top], rank[e][top] = base[e] + c, r
        return cost, rank

    def best_end(self, tops: dict[int, tuple]) -> int:
        """Of ``top: (cost, rank)``, the top whose cheapest accepted end is least by cost and audit."""
        return min((c + self.ends[t][0], r, "I" * len(self.ends[t][1]), t) for t, (c, r) in tops.items() if self.ends[t])[3]

    def chain(self, maps) -> list[tuple[int, int]]:
        """``(top before, top after)`` of every slice on the best way through consecutive slice maps."""
        now, back = {0: (0, 0)}, []
        for cost, rank in maps:
            best: dict[int, tuple] = {}
            for top, (c, r) in now.items():
                for to in range(self.size):
                    if cost[top][to] >= 0 and (to not in best or (c + cost[top][to], r, rank[top][to]) < best[to][:3]):
                        best[to] = (c + cost[top][to], r, rank[top][to], top)
            order = {x: i for i, x in enumerate(sorted({w[1:3] for w in best.values()}))}
            now = {to: (w[0], order[w[1:3]]) for to, w in best.items()}
            back.append({to: w[3] for to, w in best.items()})
        top, out = self.best_end(now), []
        for links in reversed(back):
            out.append((links[top], top))
            top = links[top]
        return out[::-1]

    def trace(self, rows, entry: int = 0, leave: int | None = None, last: bool = True) -> tuple[list[tuple[str, str, str]], str]:
        """``(edit, inserted roles before it, role given)`` of every row from ``entry`` to ``leave`` (None: the best
        end), and the roles inserted at the end of the ``last`` slice."""
        frontier, backs = self.start([entry]), []
        for initial, fault in rows:
            frontier, _, back = self.step(frontier, initial, fault)
            backs.append(back[0])
        top = self.best_end({t: (c, r) for t, c, r in frontier[0]}) if leave is None else leave
        closing, out = self.ends[top][1] if last else "", []
        for links in reversed(backs):
            top, letters, path, role = links[top]
            out.append((letters[-1], path, role))
        return out[::-1], closing
