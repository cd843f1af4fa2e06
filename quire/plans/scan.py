"""Ordered scans that stay parallel when one key holds most of the rows.

A window partitioned by ``path`` (or ``user_id``) alone sends every row of that
key to one task, so a single huge file or user serialises the job.  Every
sequential pass in this library is instead partitioned by ``(keys..., _chunk)``
where ``_chunk`` is an order-preserving slice of the key's sequence with a
bounded number of rows:

* ``chunk_by_position`` when the rows carry a dense position (line numbers
  from ``posexplode``): ``_chunk = number div CHUNK_ROWS``; no shuffle of its own.
* ``chunk_by_range`` when they only carry a sort order (events by ``ts, id``):
  a range repartition on ``(keys, order)`` splits a hot key over many
  partitions and the partition id becomes the chunk (written once with
  ``checkpoint()``: a partition id is not data, two readers may disagree).
  The number of ranges follows from the size of the input.

What a row needs from earlier or later slices (previous row, next row, running
total, last non-null value) comes from a per-slice summary: one row per slice,
``CHUNK_ROWS`` times smaller than the data, combined across slices by a window
over the summary, and joined back on ``(keys..., _chunk)`` -- the partitioning
the data already has, so the big side never moves again.  AQE turns that join
into a broadcast when the summary is small enough at run time.

A pass reads its input twice (summary and rows), so passes are not chained:
an operator with dependent steps computes all of them inside the slice, once
for each state a slice can begin in, and settles the states on the summary
(:mod:`quire.operators.blocks`).

Keys are compared through one string column in which null is a value of its
own, so rows with a null key form a sequence like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHUNK = "_chunk"
CHUNK_ROWS = 1 << 16
RANGE_BYTES = 64 << 20

_Spec = Column | tuple[Column, bool]


def chunk_by_position(df: DataFrame, pos: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Slice each key's sequence by a dense 0-based position column."""
    return df.withColumn(CHUNK, F.expr(f"`{pos}` div {int(rows)}"))


def chunk_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Slice by a range repartition on ``(keys, order)``.

    Range bounds are sampled over the full sort key, so a key holding a third
    of all rows is cut into about a third of the partitions.  Partition ids
    are monotone in the sort order, also after AQE coalesces neighbours.
    """
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _ranges_for(df))
    return df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("bigint"))


def _ranges_for(df: DataFrame) -> int:
    """Ranges of about ``RANGE_BYTES`` of what the plan reads (the estimate of a join is a product and
    says nothing); at most 100,000, ranges grow beyond that."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return min(100_000, -(-sum(n for n in sizes if n < 1 << 55) // RANGE_BYTES))


def key_name(keys: Sequence[str]) -> str:
    return "_key_" + "_".join(keys)


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the column that slices are partitioned by: never null, different for null and any value."""
    if key_name(keys) in df.columns:
        return df
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]
    return df.withColumn(key_name(keys), parts[0] if len(parts) == 1 else F.array(*parts))


def slice_windows(keys: Sequence[str], order: Sequence[str]):
    """``(partition columns, rows of a slice, slices of a key)`` for a frame with key and chunk columns."""
    part = [key_name(keys), CHUNK]
    return part, Window.partitionBy(*part).orderBy(*order), Window.partitionBy(key_name(keys)).orderBy(CHUNK)


def _spec(v: _Spec) -> tuple[Column, bool]:
    return v if isinstance(v, tuple) else (v, True)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    sums: Mapping[str, _Spec] | None = None,
    lasts: Mapping[str, _Spec] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """One sequential pass over ``df`` ordered by ``order`` within ``keys``.

    ``prev`` / ``next``: value of an expression on the previous / next row of
    the same key (null at the ends).  ``sums``: running sum of an expression,
    ``(expr, inclusive)``; exclusive sums start at 0.  ``lasts``: last non-null
    value of an expression up to this row (``inclusive``) or before it.
    Expressions may only use columns of ``df``.  ``df`` needs ``_chunk``.
    ``reverse=True`` runs the pass from the end of each key backwards (same
    slices, same partitioning): ``lasts`` then give the next non-null value.
    """
    prev, next, sums, lasts = dict(prev or {}), dict(next or {}), dict(sums or {}), dict(lasts or {})
    columns = df.columns
    df = with_key(df, keys)
    part = [key_name(keys), CHUNK]
    ords = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    w = Window.partitionBy(*part).orderBy(*ords)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(key_name(keys)).orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc())
    slices_before = slices.rowsBetween(Window.unboundedPreceding, -1)
    ordkey = F.struct(*[F.col(c) for c in order])

    # -- per-slice summary, aggregated where the data already sits
    aggs: list[Column] = []
    hi_by, lo_by = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    hi = F.min if reverse else F.max
    if prev:
        aggs.append(hi_by(F.struct(*[e.alias(n) for n, e in prev.items()]), ordkey).alias("_s_last_row"))
    if next:
        aggs.append(lo_by(F.struct(*[e.alias(n) for n, e in next.items()]), ordkey).alias("_s_first_row"))
    for n, spec in sums.items():
        aggs.append(F.sum(_spec(spec)[0]).alias(f"_s_sum_{n}"))
    for n, spec in lasts.items():
        e = _spec(spec)[0]
        aggs.append(hi(F.when(e.isNotNull(), F.struct(ordkey.alias("o"), e.alias("v")))).alias(f"_s_last_{n}"))

    carry_cols: list[Column] = []
    if prev:
        carry_cols.append(F.lag("_s_last_row").over(slices).alias("_c_prev"))
    if next:
        carry_cols.append(F.lead("_s_first_row").over(slices).alias("_c_next"))
    for n in sums:
        carry_cols.append(F.coalesce(F.sum(f"_s_sum_{n}").over(slices_before), F.lit(0)).alias(f"_c_sum_{n}"))
    for n in lasts:
        carry_cols.append(F.last(F.col(f"_s_last_{n}.v"), ignorenulls=True).over(slices_before).alias(f"_c_last_{n}"))
    summary = df.groupBy(*part).agg(*aggs).select(*part, *carry_cols)

    # -- local pass inside each slice
    local: list[Column] = [F.col(c) for c in df.columns]
    if prev:
        local.append(F.lag(F.lit(True)).over(w).isNull().alias("_l_first"))
        local += [F.lag(e).over(w).alias(f"_l_prev_{n}") for n, e in prev.items()]
    if next:
        local.append(F.lead(F.lit(True)).over(w).isNull().alias("_l_last"))
        local += [F.lead(e).over(w).alias(f"_l_next_{n}") for n, e in next.items()]
    for n, spec in sums.items():
        e, inclusive = _spec(spec)
        local.append(F.sum(e).over(upto if inclusive else before).alias(f"_l_sum_{n}"))
    for n, spec in lasts.items():
        e, inclusive = _spec(spec)
        local.append(F.last(e, ignorenulls=True).over(upto if inclusive else before).alias(f"_l_last_{n}"))
    out = df.select(*local).join(summary, part, "left")

    final: list[Column] = [F.col(c) for c in columns]
    for n in prev:
        final.append(F.when(F.col("_l_first"), F.col(f"_c_prev.{n}")).otherwise(F.col(f"_l_prev_{n}")).alias(n))
    for n in next:
        final.append(F.when(F.col("_l_last"), F.col(f"_c_next.{n}")).otherwise(F.col(f"_l_next_{n}")).alias(n))
    for n in sums:
        final.append((F.coalesce(F.col(f"_l_sum_{n}"), F.lit(0)) + F.col(f"_c_sum_{n}")).alias(n))
    for n in lasts:
        final.append(F.coalesce(F.col(f"_l_last_{n}"), F.col(f"_c_last_{n}")).alias(n))
    return out.select(*final)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "number", partitions: int | None = None,
                prev: Mapping[str, Column] | None = None) -> DataFrame:
    """Dense 0-based row number within ``keys`` by ``order`` without a per-key window; ``prev`` as in
    :func:`scan`, in the same pass.

    The result keeps ``_chunk`` and the key column, so later scans over the
    same keys reuse the slices and the partitioning.
    """
    one = "_one"
    # The partition id is a physical property: two readers of the same range
    # shuffle may see it coalesced differently.  Materialise it once, in the
    # checkpoint folder, so the slice summary and the rows agree (and a lost
    # executor cannot re-derive other ids).
    ensure_checkpoint_dir(df.sparkSession)
    ranged = chunk_by_range(df, keys, order, partitions).checkpoint(eager=True).withColumn(one, F.lit(1))
    return scan(with_key(ranged, keys), keys, order, sums={out: (F.col(one), False)}, prev=prev).drop(one)
