import random

from pyspark.sql import functions as F

from quire.plans.scan import chunk_by_position, number_rows, scan


def test_scan_matches_plain_windows_across_slices(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, 1, 2, 3])) for k in range(5) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = scan(chunk_by_position(df, "i", 4), ["k"], ["i"], prev={"p": F.col("v")}, next={"n": F.col("v")},
               sums={"s": F.coalesce(F.col("v"), F.lit(0)), "sx": (F.coalesce(F.col("v"), F.lit(0)), False)},
               lasts={"l": F.col("v")}).collect()
    back = scan(chunk_by_position(df, "i", 4), ["k"], ["i"], lasts={"nx": (F.col("v"), False)}, reverse=True).collect()
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append(v)
    nx = {(r.k, r.i): r.nx for r in back}
    for r in got:
        seq = by[r.k]
        assert r.p == (seq[r.i - 1] if r.i > 0 else None)
        assert r.n == (seq[r.i + 1] if r.i + 1 < len(seq) else None)
        assert r.s == sum(x or 0 for x in seq[:r.i + 1])
        assert r.sx == sum(x or 0 for x in seq[:r.i])
        assert r.l == next((x for x in reversed(seq[:r.i + 1]) if x is not None), None)
        assert nx[(r.k, r.i)] == next((x for x in seq[r.i + 1:] if x is not None), None)


def test_number_rows_is_dense_per_key(spark):
    rows = [(k % 3, 1000 - k) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = number_rows(df, ["k"], ["t"], partitions=7).collect()
    for k in range(3):
        ts = sorted(r.t for r in got if r.k == k)
        assert sorted((r.t, r.number) for r in got if r.k == k) == [(t, i) for i, t in enumerate(ts)]


def test_null_keys_are_a_sequence_of_their_own(spark):
    rows = [(k, i) for k in (None, "", "a") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = number_rows(df, ["k"], ["t"], partitions=4).collect()
    assert sorted((str(r.k), r.t, r.number) for r in got) == sorted((str(k), t, t) for k, t in rows)
    both = scan(chunk_by_position(df.withColumn("j", F.col("t") % 1), "t", 2), ["k", "j"], ["t"], sums={"s": F.col("t")}).collect()
    assert all(r.s == sum(range(r.t + 1)) for r in both)
