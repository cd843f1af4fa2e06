"""File sources (S-1, S-4).

``scan_files`` reads a directory tree, ``read_manifest`` the files that a ``path`` table names; both read
inside tasks, from a file system that the executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .documents import scan_folder


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """S-1: ``(path, content)`` for every file under ``root``, hidden and private names included; ``path`` is
    relative to the root; content decoded as UTF-8 (see :func:`quire.sources.documents.scan_folder`)."""
    return scan_folder(spark, root, [glob] if glob else None).select("path", "content")


#: Characters of content handed on at once.
BATCH_CHARS = 8 << 20


def read_manifest(manifest: DataFrame, root: str = "", path: str = "path") -> DataFrame:
    """S-1 for listed files: ``(path, content)`` read inside the tasks.

    ``root`` may be a folder or a URI that ``pyarrow.fs`` knows (HDFS, S3, GCS).
    A missing file gives a null ``content``; any other failure to read fails
    the task, so that it is tried again.  Contents are handed on whenever
    ``BATCH_CHARS`` have been read.
    """
    from pyarrow import fs

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        base = base.rstrip("/") + "/" if base else ""
        for b in batches:
            paths, out, size = [], [], 0
            for p in b[path]:
                try:
                    with system.open_input_stream(base + p, compression=None) as f:
                        text = f.read().decode("utf-8")
                except FileNotFoundError:
                    text = None
                paths.append(p)
                out.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield pd.DataFrame({"path": paths, "content": out})
                    paths, out, size = [], [], 0
            yield pd.DataFrame({"path": paths, "content": out}, dtype=object)

    return manifest.select(path).mapInPandas(read, "path string, content string")


def read_json_tree(spark: SparkSession, source: str) -> DataFrame:
    """S-4: nested ``{id, value, children}`` JSON (a list of roots) to node
    rows ``(id, parent, ord, depth, value)``; ``value`` as JSON text.

    Level by level: ``posexplode(children)`` of the level above, one step per
    level of the data (the schema itself says how deep it is, and ends the loop).
    """
    df = spark.read.option("multiLine", "true").json(source)
    level = df.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"),
                      F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("depth"),
                      F.to_json(F.col("value")).alias("value") if "value" in df.columns else F.lit(None).alias("value"),
                      *([F.col("children")] if "children" in df.columns else []))
    out = level.drop("children")
    d = 0
    while "children" in level.columns:
        d += 1
        if d % 8 == 0:  # keeps the plans of deep trees short
            ensure_checkpoint_dir(spark)
            level = level.checkpoint(eager=True)
        kids = level.select(F.col("id").alias("_pid"), F.posexplode("children").alias("_ord", "_c"))
        fields = kids.schema["_c"].dataType.fieldNames() if isinstance(kids.schema["_c"].dataType, T.StructType) else []
        level = kids.select(F.col("_c.id").cast("string").alias("id"), F.col("_pid").alias("parent"),
                            F.col("_ord").cast("bigint").alias("ord"), F.lit(d).cast("bigint").alias("depth"),
                            (F.to_json(F.col("_c.value")) if "value" in fields else F.lit(None).cast("string")).alias("value"),
                            *([F.col("_c.children").alias("children")] if "children" in fields else []))
        out = out.unionByName(level.drop("children"))
    return out


def json_nodes(docs: DataFrame, key: str, column: str) -> DataFrame:
    """S-4 from a column: ``(key, id, parent, ord, depth, value)`` of the ``{id, value, children}`` trees in JSON text or bytes.

    A text holds one tree or a list of them.  Texts are parsed once, to VARIANT, so no schema is inferred and a
    node's value may have any type; ``value`` is JSON text, null if there is none or it is null.  Levels are taken one
    after the other until one is empty, and checkpointed.  A null, empty or malformed text has no nodes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    whole = docs.select(F.col(key).alias("key"), F.try_parse_json(F.col(column).cast("string")).alias("v"))
    roots = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    level = whole.where("v is not null").select("key", F.lit(None).cast("string").alias("parent"), F.posexplode(roots).alias("ord", "v"))
    out, depth = None, 0
    while True:
        level = level.where(F.try_variant_get("v", "$.id", "string").isNotNull()).select(
            "key", F.try_variant_get("v", "$.id", "string").alias("id"), "parent", F.col("ord").cast("bigint").alias("ord"),
            F.lit(depth).cast("bigint").alias("depth"), F.nullif(F.to_json(F.try_variant_get("v", "$.value", "variant")), F.lit("null")).alias("value"),
            F.try_variant_get("v", "$.children", "array<variant>").alias("children")).checkpoint(eager=True)
        rows = level.drop("children")
        out = rows if out is None else out.unionByName(rows)
        below = level.where(F.size("children") > 0)
        if below.isEmpty():
            return out.withColumnRenamed("key", key)
        level, depth = below.select("key", F.col("id").alias("parent"), F.posexplode("children").alias("ord", "v")), depth + 1
