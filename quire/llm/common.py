"""Helpers shared by the operators of this subpackage.

Every operator reads the columns it needs through :func:`pick`, so any other
column of its input (also one whose name equals an output column, or differs
from an input column by case only) is ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows and bytes per Arrow batch handed to a Python task.  Texts can be long, so batches are
#: kept short: this bounds a task's memory, it does not bound or drop rows.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``alias=name`` pairs; names are matched exactly, other columns are left out.

    Columns are renamed by position first, so names that clash by case stay unambiguous.
    """
    names = df.columns
    missing = [n for n in columns.values() if n not in names]
    if missing:
        raise ValueError(f"no column {missing} in {names}")
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(n)}").alias(a) for a, n in columns.items()])


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_key(text: Column) -> Column:
    """128 bits of a text, for telling rows with one id apart."""
    return F.md5(F.coalesce(text, F.lit("")))


#: Pairs in one file of a round of :func:`connected_components`, about; there is a file for each core at least, if there are as many partitions.
ROUND_PAIRS = 1 << 18


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star steps: each step is a partial
    aggregation (smallest neighbour) and an equi join, so no neighbour list is
    ever gathered and a hub is an ordinary skewed join key.  Every round is
    checkpointed, in as many files as its pairs need; the loop ends when a round
    changes nothing.  Null or equal ends are ignored.
    """
    pairs = (edges.filter("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    pairs, seen, cores = cut(pairs), None, edges.sparkSession.sparkContext.defaultParallelism
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u and v <> m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(low.select("hi", "m")).distinct())
        # a round has no more pairs than the one before it
        pairs = cut(small.coalesce(max(cores, -(-now[0] // ROUND_PAIRS))))
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
