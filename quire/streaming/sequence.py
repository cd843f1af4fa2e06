"""Streaming rule matching (ST-1) and stateless streaming marks (ST-2).

ST-1 runs the automata of :mod:`quire.operators.automaton` over a stream of atoms with
``transformWithState`` on RocksDB, keyed by ``key``.  What is still to come may
decide what an atom belongs to, so sets of states are taken twice, as if nothing
followed and as if anything might: where both lead to the same step, the step is
final.  The state of a key is therefore the automaton's state, the begin of the open match, the
position, and the atoms from the first undecided one on, as runs of equal atoms: a rule that repeats an
atom keeps one run, however often the atom comes.

The position is never given up, so a key that pauses continues where it was and
its matches are those of the batch operator, however long the pause.  Only with
``idle_limit_ms`` is a key's sequence closed without a following atom: a timer ends it once the
watermark has passed its last event by that much, and later atoms start a match of their own.  Batch and
stream then agree if no match spans a longer pause.  Atoms of a key are expected in
order across micro-batches (event time of a key never goes back); within a micro-batch they are sorted.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.automaton import IDLE, Machine
from ..operators.marks import marks
from ..operators.sequence import Compiled

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark) -> None:
    """``transformWithState`` needs this store; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Pending:
    """Atoms of a key that are not decided yet, as ``[symbol, count]`` runs, and the automaton before them."""

    def __init__(self, machine: Machine, state: int = IDLE, begun: int = 0, base: int = 0, runs: list | None = None):
        self.machine, self.state, self.begun, self.base, self.runs = machine, state, begun, base, runs or []

    def add(self, symbols: Sequence[int]) -> None:
        for a, same in itertools.groupby(symbols):
            n = sum(1 for _ in same)
            if self.runs and self.runs[-1][0] == a:
                self.runs[-1][1] += n
            else:
                self.runs.append([a, n])

    def _sets(self, after: int) -> list[list[int]]:
        """For each run the sets by the number of its atoms that follow, up to where they stay the same."""
        out = []
        for a, n in reversed(self.runs):
            found = [after]
            while len(found) <= n:
                found.append(self.machine.before(a, found[-1]))
                if found[-1] == found[-2]:
                    break
            out.append(found)
            after = found[min(n, len(found) - 1)]
        return out[::-1]

    def decided(self, ended: bool = False):
        """``(rule, start, end)`` of the matches that are final now; all of them if the sequence has ``ended``."""
        everything = (1 << self.machine.size) - 1
        few = self._sets(0)
        many = few if ended else self._sets(everything)
        rule = self.machine.rule[self.state] if self.state != IDLE else -1
        for i, (a, n) in enumerate(self.runs):
            for done in range(n):
                left = n - done - 1
                step = self.machine.step(self.state, a, few[i][min(left, len(few[i]) - 1)])
                if not ended and step != self.machine.step(self.state, a, many[i][min(left, len(many[i]) - 1)]):
                    self.runs = [[a, n - done], *self.runs[i + 1:]]
                    return
                self.state, begins, ends = step
                if begins >= 0:
                    rule, self.begun = begins, self.base
                self.base += 1
                if ends:
                    yield rule, self.begun, self.base
        self.runs = []


class Matcher(StatefulProcessor):
    """State and timers of ST-1; one value a key."""

    def __init__(self, rules: Mapping[str, str], key: str, ts: str, order: Sequence[str], atom: str, idle_limit_ms: int | None):
        compiled = Compiled(rules)
        self.symbols = {a: n for n, a in enumerate([None, "", *(a for a in compiled.atoms if a != "")])}
        self.machine, self.names = compiled.machine(self.symbols), list(compiled.rules)
        self.key, self.ts, self.order, self.atom, self.idle_limit_ms = key, ts, list(order), atom, idle_limit_ms

    def init(self, handle):
        self.handle = handle
        self.value = handle.getValueState("open", "state int, begun bigint, base bigint, atoms array<int>, counts array<bigint>")

    def _pending(self) -> Pending:
        if not self.value.exists():
            return Pending(self.machine)
        state, begun, base, atoms, counts = self.value.get()
        return Pending(self.machine, state, begun, base, [list(r) for r in zip(atoms, counts)])

    def _emit(self, key, pending: Pending, ended: bool):
        for rule, start, end in pending.decided(ended):
            yield Row(**{self.key: key[0], "rule": self.names[rule], "start": start, "end": end})
        self.value.update((pending.state, pending.begun, pending.base, [r[0] for r in pending.runs], [r[1] for r in pending.runs]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        batch = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        pending = self._pending()
        pending.add([self.symbols.get(r[self.atom], 1) for r in batch])
        yield from self._emit(key, pending, False)
        if self.idle_limit_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            last = max(int(r[self.ts].timestamp() * 1000) for r in batch)
            self.handle.registerTimer(max(last + self.idle_limit_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        pending = self._pending()
        yield from self._emit(key, pending, True)

    def close(self):
        pass


def match_sequence_stream(stream: DataFrame, key: str, ts: str, order: Sequence[str], atom: str, rules: Mapping[str, str], *,
                          delay: str = "0 seconds", idle_limit_ms: int | None = None) -> DataFrame:
    """Streaming W-8: ``(key, rule, start, end)`` rows in append mode.

    ``ts`` must be a TIMESTAMP column (cast TIMESTAMP_NTZ first); ``delay`` is the watermark delay.  Null keys are one key.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    key_type = dict(stream.dtypes)[key]
    matcher = Matcher(rules, key, ts, order, atom, idle_limit_ms)
    return stream.withWatermark(ts, delay).groupBy(key).transformWithState(
        matcher, f"`{key}` {key_type}, rule string, start bigint, `end` bigint", "append", "EventTime")


def marks_stream(stream: DataFrame, rules, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ST-2 for marks: W-6 works inside each row, so it runs on a stream as it is and keeps no state."""
    return marks(stream.select(key, text), rules, key=key, text=text)


def events_as_stream(spark, source_dir: str, schema) -> DataFrame:
    """Events parquet files as a stream, one file per micro-batch, ``ts`` as TIMESTAMP."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_dir)
            .withColumn("ts", F.col("ts").cast("timestamp")))
