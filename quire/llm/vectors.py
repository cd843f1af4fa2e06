"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A vector's hash under one rotation is the signed axis nearest to the rotated
vector; a table joins two or more such hashes (places) into a cell, and each
vector also goes to the cells reached by taking the second nearest axis in one
place.  Vectors that meet in a cell are candidates; their cosine is computed in
double precision, so no link below the threshold is reported.

The number of cells follows the data: :func:`layout` takes as many places, the
last of them over as few axes, as keep the candidates expected of a vector
below a constant, and with them the tables that keep the recall.

Equal vectors are folded first.  Members of a cell are compared in blocks of
bounded size: a crowded cell is split, and each pair of its blocks is a group
of its own.  Vectors that meet in several cells are counted in the first one
only, and groups report sums of links and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, pick, short_batches

TABLES, ROUNDS, SEED, BLOCK = 8, 3, 11, 512

#: Tables for a number of places.  Of 3,000 random pairs at cosine 0.93 exactly, up to four places over all
#: axes missed none at 64 components and at most 0.2 % at 256; five missed none at 64 with 24 tables.  More
#: places were not measured at 256 components, six at neither width.
TABLES_OF = {2: TABLES, 3: 12, 4: 20, 5: 32, 6: 48}

#: Candidates a vector may expect among vectors in random directions, each counted once a cell, if all
#: cells were equally likely.  They are not, as the axes of two rotations are not independent: 1.7 to 1.9
#: times as many were met with two places of 64 and 32 axes, and up to ``UNEVEN`` times more with each
#: further one.  Measured at 32 axes: 136 candidates a vector at 4,000 vectors, 213 at 120,000.
MOST_CANDIDATES, UNEVEN = 72, 2.2


@cache
def signs(width: int, table: int, place: int) -> np.ndarray:
    """Random sign flips of one rotation: a row for each of its rounds."""
    return np.random.default_rng([SEED, width, table, place]).choice([-1.0, 1.0], (ROUNDS, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(rows, width) / np.sqrt(width)


def nearest_axes(x: np.ndarray, table: int, place: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis, of the first ``axes`` of each rotated row, as numbers below twice ``axes``."""
    for flips in signs(x.shape[1], table, place):
        x = hadamard(x * flips)
    x = x[:, :axes]
    size = np.abs(x)
    rows = np.arange(len(x))
    first = size.argmax(axis=1)
    size[rows, first] = -1
    second = size.argmax(axis=1)
    axis = lambda best: 2 * best + (x[rows, best] < 0)
    return axis(first), axis(second)


def padded(width: int) -> int:
    """The power of two a vector's width is filled up to."""
    return 1 << max(0, width - 1).bit_length()


def layout(rows: int, width: int) -> tuple[int, ...]:
    """Axes of each place of a table, for ``rows`` vectors of a width that share a label.

    Two places over all axes at least; more while a vector would expect over
    ``MOST_CANDIDATES`` others in its cells.  The last place takes the fewest
    axes that do, a power of two.  Beyond six places cells fill up, and blocks
    bound what meets at once.
    """
    axes = padded(width)
    for places in TABLES_OF:
        probes = TABLES_OF[places] * (places + 1) ** 2 * UNEVEN ** (places - 2)
        last = axes if places == 2 else min(2, axes)
        while True:
            if (2 * axes) ** (places - 1) * 2 * last * MOST_CANDIDATES >= rows * probes:
                return (axes,) * (places - 1) + (last,)
            if last == axes:
                break
            last *= 2
    return (axes,) * len(TABLES_OF) + (axes,)


def cell_type(width: int, tables: int = TABLES, places: tuple[int, ...] | None = None) -> str:
    """The integers that hold every cell of vectors of a width; with two places 32 bits do up to 8,192 components and 8 tables."""
    return "<i4" if tables * prod(2 * axes for axes in places or (padded(width),) * 2) <= 1 << 31 else "<i8"


def cells(x: np.ndarray, tables: int = TABLES, places: tuple[int, ...] | None = None) -> np.ndarray:
    """Cells of each row, one more for each table than it has places, in ascending order of table."""
    width = padded(x.shape[1])
    places = places or (width, width)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for table in range(tables):
        found = [nearest_axes(x, table, place, axes) for place, axes in enumerate(places)]
        for changed in range(-1, len(places)):
            cell = np.full(len(x), table, np.int64)
            for place, (axes, (nearest, second)) in enumerate(zip(places, found)):
                cell = cell * 2 * axes + (second if place == changed else nearest)
            out.append(cell)
    return np.stack(out, axis=1)


def link_group(x: np.ndarray, own: np.ndarray, side: np.ndarray, copies: np.ndarray, here: int, least: float,
               cross: bool, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of links and a root (row number) for each row of one group.

    ``x`` holds unit rows, ``own`` their cells, ``side`` the block of each row;
    with ``cross`` only rows of different blocks are compared.  A pair counts
    here only if ``here`` is the first cell both have; cells of different tables never agree.
    """
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    if cross:
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(close))
    first = np.empty(len(a), bool)
    own = own.reshape(len(x), tables, -1)
    for at in range(0, len(a), 4096):
        p, q = own[a[at:at + 4096]], own[b[at:at + 4096]]
        shared = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)
        first[at:at + 4096] = np.where(shared, p, np.iinfo(p.dtype).max).min(axis=(1, 2)) == here
    a, b = a[first], b[first]
    links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    root = np.arange(len(x))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return links, root
        root = after


def links_of(classes: DataFrame, least: float, rows: int, tables: int | None = None, number: str = "<f8") -> DataFrame:
    """``class_id, links, root``: per class and group the vectors linked to it, and a class it is connected with.

    ``rows`` is the number of classes the cells are laid out for; ``tables`` overrides the tables of that layout.
    ``number`` is the type the components came in: single precision moves half the bytes and loses none.
    """
    short_batches(classes.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column("width").to_pylist(), np.int64)
            for width in np.unique(widths):
                some = np.flatnonzero(widths == width)
                part = batch.take(pa.array(some))
                x = np.array(part.column("v").to_pylist(), np.float64)
                places = layout(rows, int(width))
                many = tables or TABLES_OF[len(places)]
                own = cells(x, many, places)
                packed = pa.array([row.tobytes() for row in own.astype(cell_type(int(width), many, places))], pa.binary())
                row = np.repeat(np.arange(len(x)), own.shape[1])
                vectors = pa.array([v.tobytes() for v in x.astype(number)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n).take(pa.array(row)) for n in ("class_id", "label", "width", "copies")]
                    + [pa.array(own.ravel().astype(np.int64)), packed.take(pa.array(row)), vectors.take(pa.array(row))],
                    names=["class_id", "label", "width", "copies", "cell", "own", "v"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.mapInArrow(place, f"class_id long, label {kind}, width int, copies long, cell long, own binary, v binary")
    cell = ["label", "width", "cell"]
    crowded = (placed.select(*cell).groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
               .select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    split = placed.join(crowded, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*cell, "low", "high"]
    split = split.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    split = split.select(*group, "side", "class_id", "copies", "own", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close_group() -> list:
            if len(held) < 2:
                return []
            places = layout(rows, key[1])
            many = tables or TABLES_OF[len(places)]
            x = np.frombuffer(b"".join(r["v"] for r in held), number).reshape(len(held), -1).astype(np.float64)
            own = np.frombuffer(b"".join(r["own"] for r in held), cell_type(key[1], many, places)).reshape(len(held), -1)
            ids = np.array([r["class_id"] for r in held])
            links, root = link_group(x / np.linalg.norm(x, axis=1, keepdims=True), own, np.array([r["side"] for r in held]),
                                     np.array([r["copies"] for r in held]), key[2], least, key[3] != key[4], many)
            return [(int(ids[i]), int(links[i]), int(ids[root[i]])) for i in np.flatnonzero(links)]

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)],
                                              names=["class_id", "links", "root"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                mine = tuple(row[g] for g in group)
                if mine != key:
                    found += close_group()
                    key, held = mine, []
                held.append(row)
            yield batch_of(found)
        yield batch_of(close_group())

    return split.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "class_id long, links long, root long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     least: float = 0.93, tables: int | None = None, expected: int | None = None) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, they have the same
    length and their cosine is at least ``least``.  ``n_links`` counts the other
    rows linked directly, copies included; ``component_id`` is the smallest id
    reachable.  Cells are laid out for the different vectors of the commonest
    label, counted unless ``expected`` states them; ``tables`` overrides the
    number of hash tables that :func:`layout` goes with.

    * a null or zero vector, one with a null or non-finite component, a null
      label or a null id: links with nothing, is its own component and kept;
    * repeated rows: each counts as a vector, all get the same answer;
    * empty table: no rows.  Other columns are ignored.
    """
    rows = pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col).select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    sound = _is_sound(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    folded = cut(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies")))
    classes = cut(folded.select(F.monotonically_increasing_id().alias("class_id"), "label", F.size("v").alias("width"), "v",
                                "smallest", "copies"))
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    if expected is None:
        expected = classes.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    found = cut(links_of(classes.select("class_id", "label", "width", "v", "copies"), least, expected, tables,
                         "<f4" if single else "<f8"))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class_id")
    member = (classes.join(links, "class_id", "left").join(roots, "class_id", "left")
              .withColumn("root", F.coalesce("root", "class_id")))
    smallest = member.groupBy("root").agg(F.min("smallest").alias("component_id"))
    answers = member.join(smallest, "root").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.join(answers, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))


def _is_sound(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


EMBEDDINGS_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM r WHERE r.a = vec_id) AS kept
FROM embeddings
"""
