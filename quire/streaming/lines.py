"""Typed lines on a stream (ST-2): W-3 with its state kept between micro-batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.blocks import COMMENT, TYPED_MARKER, TYPED_META
from .sequence import keep_state_in_rocksdb

_MARKER, _META, _COMMENT = (re.compile(p, re.ASCII) for p in (TYPED_MARKER, TYPED_META, COMMENT))


class TypedLines(StatefulProcessor):
    """Per file: the next line, its offset, the open block and what continues it; lines that came early wait by number."""

    def init(self, handle):
        self.value = handle.getValueState("at", "number bigint, offset bigint, block bigint, comment boolean, marked boolean")
        self.early = handle.getMapState("early", "number bigint", "text string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        number, offset, block, comment, marked = self.value.get() if self.value.exists() else (0, 0, -1, None, False)
        new = sorted({(r.number, r.text) for r in rows if r.number is not None and r.number >= number}, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        waiting = {n: t for n, t in reversed(new)}
        while True:
            if number in waiting:
                text = waiting.pop(number)
            elif self.early.exists() and self.early.containsKey((number,)):
                text = self.early.getValue((number,))[0]
                self.early.removeKey((number,))
            else:
                break
            line = text or ""
            is_marker, is_comment = _MARKER.match(line) is not None, _COMMENT.match(line) is not None
            starts = comment is None or is_marker or is_comment != comment
            if is_marker or not is_comment:
                marked = is_marker
            block += starts
            kind = "code" if not is_comment else "text" if marked else "comment"
            meta = _META.match(line)[1].strip(" \t\n\r\f\v") if is_marker else None
            yield Row(path=key[0], number=number, text=text, offset=offset, kind=kind, meta=meta, block_no=block, starts=starts)
            number, offset, comment = number + 1, offset + len(line), is_comment
        for n, t in waiting.items():
            self.early.updateValue((n,), (t,))
        self.value.update((number, offset, block, comment, marked))

    def close(self):
        pass


def typed_lines_stream(stream: DataFrame) -> DataFrame:
    """ST-2: ``(path, number, text, offset, kind, meta, block_no, starts)``, a row for each line of ``(path, number, text)``.

    The rows are those of :func:`quire.operators.blocks.typed_lines` over the whole file, whatever the cuts between
    micro-batches.  A line is given out as soon as all lines before it have come; one that comes
    early waits in the state, one that comes again is ignored, as are lines without a number.  Null text is an empty line.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    out = "path string, number bigint, text string, offset bigint, kind string, meta string, block_no bigint, starts boolean"
    return stream.select("path", "number", "text").groupBy("path").transformWithState(TypedLines(), out, "append", "None")
