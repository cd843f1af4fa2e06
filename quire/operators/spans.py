"""Spans that hold points and other spans, as equi joins (J-3, J-4, T-6).

A span ``[lo, hi)`` is the union of at most two aligned bins of ``2**level`` positions a level, so it is
listed under O(log n) bins however long it is, and a point lies in one bin of each
level.  Points are listed for the levels that occur among the spans only, a
one-row aggregate of at most 63 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_LEVEL = 62


def bins_of_span(lo: Column, hi: Column) -> Column:
    """Array of ``struct(level, bin)`` of the aligned bins that make up ``[lo, hi)``; none if it is empty or negative."""
    def at(level):
        up = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        down = F.call_function("shiftright", hi, level)
        own = lambda taken, b: F.when((up < down) & taken, F.struct(level.alias("level"), b.alias("bin")))
        return F.array(own(up % 2 == 1, up), own(down % 2 == 1, down - 1))

    top = F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double"))).cast("int") + 1)
    bins = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at)))
    return F.when((lo >= 0) & (lo < hi), bins).otherwise(F.slice(bins, 1, 0))


def inside(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each point joined to every span of the same ``by`` that holds it: ``lo <= at < hi``.

    All columns of both; ``by`` once.  Other names must differ.  Null or negative positions are in no span.
    """
    listed = spans.withColumn("_b", F.explode(bins_of_span(F.col(lo), F.col(hi))))
    listed = listed.select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"))
    levels = listed.agg(F.collect_set("_level").alias("_levels"))
    asked = points.where(F.col(at) >= 0).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).withColumn(
        "_bin", F.call_function("shiftright", F.col(at), F.col("_level"))).drop("_levels")
    return asked.join(listed, [*by, "_level", "_bin"]).drop("_level", "_bin")


def containing(spans: DataFrame, outer: DataFrame, by: Sequence[str], key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """J-4: ``(by, key, enclosing, distance)``: the spans of ``outer`` that hold each span strictly, the shortest at distance 1.

    Both have ``by``, ``key``, ``lo`` and ``hi``; of equally long ones the one that begins later is nearer, then the
    smaller key.  A span is not held by an equal one.
    """
    asked = spans.select(*by, F.col(key).alias("_in"), F.col(lo).alias("_a"), F.col(hi).alias("_z"))
    held = inside(asked, outer.select(*by, F.col(key).alias("enclosing"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), by, "_a", "_lo", "_hi")
    held = held.where((F.col("_z") <= F.col("_hi")) & (F.col("_hi") - F.col("_lo") > F.col("_z") - F.col("_a")))
    # a span's own list of holders is as long as it lies deep
    order = F.struct((F.col("_hi") - F.col("_lo")).alias("n"), (-F.col("_lo")).alias("l"), F.col("enclosing").alias("e"))
    lists = held.groupBy(*by, "_in").agg(F.array_sort(F.collect_list(order)).alias("_o"))
    rows = lists.select(*by, F.col("_in").alias(key), F.posexplode("_o").alias("_d", "_x"))
    return rows.select(*by, key, F.col("_x.e").alias("enclosing"), (F.col("_d") + 1).cast("bigint").alias("distance"))


def innermost(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """J-3: the points with ``within``, the ``key`` of the shortest span that holds them (of equally long ones that which begins
    later, then the larger key); null if none does.  Points are told apart by all their columns; equal ones are one."""
    own = points.distinct()
    held = inside(own, spans.select(*by, F.col(key).alias("_k"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), by, at, "_lo", "_hi")
    best = held.groupBy(*own.columns).agg(F.max_by("_k", F.struct((F.col("_lo") - F.col("_hi")).alias("n"), F.col("_lo"), F.col("_k"))).alias("within"))
    same = None
    for c in own.columns:
        here = F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = here if same is None else same & here
    return own.alias("p").join(best.alias("b"), same, "left").select("p.*", "b.within")
