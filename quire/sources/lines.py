"""S-2 / W-11: text files to a table of numbered lines with character offsets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import starts
from ..plans.scan import CHUNK, CHUNK_ROWS, chunk_by_position, scan


def scan_lines(files: DataFrame, *, path: str = "path", content: str = "content", eol: bool = True,
               universal_newlines: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(path, content)`` rows to ``(path, number, offset, text, _chunk)``.

    ``eol=True`` follows ``readlines()``: each line keeps its ``\\n`` and a
    trailing empty piece is dropped.  ``eol=False`` follows ``split('\\n')``
    with ``\\n`` appended to every piece, the last empty one included.
    ``offset`` counts characters (code points) from the start of the file; it
    is summed up inside the file's row, so nothing is shuffled.
    """
    body = F.col(content)
    if universal_newlines:
        body = F.regexp_replace(body, "\r\n?", "\n")
    rows = _line_rows(files, path, F.split(body, "\n", -1), eol)
    rows = rows.withColumn("_o", starts(F.transform("_t", lambda x: F.length(x))))
    lines = rows.select("path", F.posexplode(F.arrays_zip("_t", "_o")).alias("number", "_x")).select(
        "path", F.col("number").cast("bigint").alias("number"), F.col("_x._o").alias("offset"), F.col("_x._t").alias("text"))
    return chunk_by_position(lines, "number", chunk_rows)


def read_lines(spark: SparkSession, root: str, *, eol: bool = True, universal_newlines: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """S-2 for files of any size below ``root``: the lines of :func:`scan_lines`, read in byte ranges by several tasks.

    Spark's text source cuts a file into ranges (``spark.sql.files.maxPartitionBytes``) and gives each line to the range it
    begins in.  Lines are numbered and summed up within their range as they come; a prefix sum over
    the ranges of a file, one row each, turns that into numbers and offsets of the file.  Whether a file ends with a line
    end follows from its size.  No line moves unless the join with the ranges is too large to broadcast.

    ``path`` is relative to ``root``.  Names that begin with ``_`` or ``.`` are left out, as Spark's listing has it, and empty
    files have no lines.  Compressed files are one range.  Wrong UTF-8 is replaced; one line must fit a row (2 GB).
    """
    meta = F.col("_metadata")
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    raw = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"),
                     F.col("value").cast("binary").alias("value"))

    def cut(batches):
        at, number, offset = None, 0, 0
        for batch in batches:
            out = {c: [] for c in ("file", "block", "size", "n", "o", "text", "bytes", "cr")}
            for file, block, size, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size", "value"))):
                if (file, block) != at:
                    at, number, offset = (file, block), 0, 0
                text, spare = value.decode("utf-8", "replace"), len(value) + 1
                cr = universal_newlines and text.endswith("\r")
                if universal_newlines and "\r" in text:
                    pieces = (text[:-1] if cr else text).split("\r")
                else:
                    pieces = [text]
                for piece in pieces:
                    for c, v in zip(out, (file, block, size, number, offset, piece + "\n", spare, cr)):
                        out[c].append(v)
                    number, offset, spare = number + 1, offset + len(piece) + 1, 0
            yield pa.record_batch([pa.array(out["file"], pa.string()), *(pa.array(out[c], pa.int64()) for c in ("block", "size", "n", "o")),
                                   pa.array(out["text"], pa.string()), pa.array(out["bytes"], pa.int64()), pa.array(out["cr"], pa.bool_())], names=list(out))

    rows = raw.mapInArrow(cut, "file string, block bigint, size bigint, n bigint, o bigint, text string, bytes bigint, cr boolean")
    part = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum("bytes").alias("bytes"),
                                             F.max("size").alias("size"), F.max_by("cr", "n").alias("cr"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # every line counts one byte for its end: one too many (less a byte order mark) if the last line has none
    spare = F.sum("bytes").over(whole) - F.col("size")
    part = part.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("o0"),
                       F.when(F.col("block") == F.max("block").over(whole), F.col("lines") - 1).alias("last"), (spare.isin(1, -2) & ~F.col("cr")).alias("bare"))
    out = rows.select("file", "block", "n", "o", "text").join(part, ["file", "block"])
    base = re.sub(r"^file:/*(?=/)", "", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("file", r"^file:/*(?=/)", ""), "^" + re.escape(base), "")
    final = F.coalesce(F.col("n") == F.col("last"), F.lit(False))
    return _finished(out.withColumns({"path": F.call_function("url_decode", F.replace(path, F.lit("+"), F.lit("%2B"))), "final": final}),
                     eol, universal_newlines, chunk_rows)


def _finished(rows: DataFrame, eol: bool, universal_newlines: bool, chunk_rows: int) -> DataFrame:
    """Numbers and offsets of the file, and the last line as ``readlines()`` or ``split`` has it."""
    ended = ~F.col("bare")
    text = F.when(F.col("final") & F.col("bare") & F.lit(eol), F.regexp_replace("text", "\n$", "")).otherwise(F.col("text"))
    lines = rows.select("path", (F.col("n0") + F.col("n")).alias("number"), (F.col("o0") + F.col("o")).alias("offset"), text.alias("text"), "final",
                        ended.alias("ended"))
    if not eol:  # a last, empty piece stands after the last line end
        more = F.array(F.struct("number", "offset", "text"), F.struct((F.col("number") + 1).alias("number"), (
            F.col("offset") + F.length("text")).alias("offset"), F.lit("\n").alias("text")))
        both = F.when(F.col("final") & F.col("ended"), more).otherwise(F.slice(more, 1, 1))
        lines = lines.select("path", F.explode(both).alias("x")).select("path", "x.*")
    return chunk_by_position(lines.select("path", "number", "offset", "text"), "number", chunk_rows)


def _line_rows(files: DataFrame, path: str, pieces, eol: bool) -> DataFrame:
    """``(path, _t)`` with the lines of each file as an array, ends of line restored."""
    rows = files.select(F.col(path).alias("path"), pieces.alias("_p"))
    if not eol:
        return rows.select("path", F.transform("_p", lambda x: F.concat(x, F.lit("\n"))).alias("_t"))
    last = F.element_at("_p", -1)
    whole = F.transform(F.slice("_p", 1, F.size("_p") - 1), lambda x: F.concat(x, F.lit("\n")))
    return rows.select("path", F.when(last == "", whole).otherwise(F.concat(whole, F.array(last))).alias("_t"))


def line_index(lines: DataFrame) -> DataFrame:
    """W-11: (path, line) -> start offset, end offset and length of each line."""
    return lines.select("path", "number", "offset", (F.col("offset") + F.length("text")).alias("end"),
                        F.length("text").cast("bigint").alias("length"))


def position_of(lines: DataFrame, points: DataFrame) -> DataFrame:
    """W-11 (column form): ``(path, line, column)`` points to character offsets.

    An equi join on ``(path, number)``; lines are one row each, so the join is
    even however large a single file is.
    """
    idx = lines.select("path", F.col("number").alias("line"), F.col("offset").alias("_line_offset"))
    return points.join(idx, ["path", "line"], "left").withColumn(
        "offset", F.col("_line_offset") + F.col("column")).drop("_line_offset")


def line_of(lines: DataFrame, points: DataFrame) -> DataFrame:
    """W-11 (reverse form): ``(path, offset)`` points to line and column.

    Offsets are cut into buckets of 4096 characters and lines listed under every
    bucket they touch, so the range condition is an equi join on ``(path, bucket)``.
    An offset past the end of its file keeps nulls.
    """
    size = 4096
    spans = lines.where(F.length("text") > 0).select(
        "path", F.col("number").alias("line"), F.col("offset").alias("_lo"), (F.col("offset") + F.length("text")).alias("_hi"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.expr(f"_lo div {size}"), F.expr(f"(_hi - 1) div {size}"))))
    asked = points.withColumn("_b", F.expr(f"offset div {size}"))
    own = (asked["path"] == spans["path"]) & (asked["_b"] == spans["_b"]) & (asked["offset"] >= F.col("_lo")) & (asked["offset"] < F.col("_hi"))
    return asked.join(spans, own, "left").select(*[asked[c] for c in points.columns], F.col("line"),
                                                 (asked["offset"] - F.col("_lo")).alias("column"))


def with_offsets(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``offset`` (characters before the line in its file) to a lines table."""
    if "offset" in lines.columns:
        return lines
    df = lines if CHUNK in lines.columns else chunk_by_position(lines, "number", chunk_rows)
    return scan(df, ["path"], ["number"], sums={"offset": (F.length("text").cast("bigint"), False)})
