"""

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
tables Spark derives from them), registered together with the DuckDB SQL that
computes the same rows.  The SQL is written as the plain single-node
definition (sequential recursion or whole-key windows); the Spark side is the
sliced, shuffle-aware form, so the pair checks one against the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import the query modules so that they register themselves."""
    from .plans import q_files, q_lines, q_marks, q_sequence, q_symbols, q_tags, q_text, q_trees  # noqa: F401
