import numpy as np
from pyspark.sql import functions as F

from quire.llm import vectors
from quire.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(rows, least=0.93):
    good = [i for i, (n, v, label) in enumerate(rows) if n is not None and label is not None and v is not None and len(v)
            and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    keys = {(rows[i][2], len(rows[i][1])) for i in good}
    for label, width in keys:
        own = [i for i in good if rows[i][2] == label and len(rows[i][1]) == width]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[own[a]].add(own[b])
    out = []
    for i, (n, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((n, len(links[i]), low, n == low))
    return sorted(out, key=str)


def test_hadamard_keeps_length_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = vectors.hadamard(x * vectors.signs(64, 0, 0)[0])
    assert np.allclose(x @ x.T, y @ y.T)
    assert vectors.cells(x).shape == (5, 3 * vectors.TABLES) and len(set(map(tuple, vectors.cells(x)))) == 5


def test_equals_brute_force_with_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []

    def add(v, label):
        rows.append((len(rows) * 3 % 1999, None if v is None else [None if c is None else float(c) for c in v], label))
    for label in (1, 2):
        for spread in (0.02, 0.045, 0.06):
            centre = rng.normal(size=24)
            centre /= np.linalg.norm(centre)
            for _ in range(120):
                add(np.float32(centre + spread * rng.normal(size=24)), label)
        for _ in range(100):
            add(np.float32(rng.normal(size=24)), label)
    same = np.float32(rng.normal(size=24))
    for _ in range(50):
        add(same, 1)
    add(same, 2), add(same, None), add(same * 2, 1), add(np.zeros(24), 1), add(None, 1), add([], 1), add([None] * 24, 1)
    add([float("nan")] * 24, 1), add([float("inf")] * 24, 1), add(same[:16], 1), add(same[:16], 1), add([-0.0, 1.0], 1), add([0.0, 1.0], 1)
    rows += [(None, rows[0][1], 1), (rows[5][0], rows[5][1], 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, copies int")
    monkeypatch.setattr(vectors, "BLOCK", 50)
    got = vectors.embedding_groups(frame, tables=14).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert vectors.embedding_groups(frame.filter("false")).count() == 0


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in range(800):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        cosine = rng.uniform(0.9, 0.97)
        rows += [(len(rows), [float(c) for c in x], n % 3), (len(rows) + 1, [float(c) for c in cosine * x + (1 - cosine ** 2) ** 0.5 * z / np.linalg.norm(z)], n % 3)]
    want = {r[0]: r for r in brute(rows)}
    got = vectors.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found, there = sum(r.n_links for r in got), sum(r[1] for r in want.values())
    assert len(got) == len(rows) and there > 500 and 0.99 * there <= found <= there
    assert all(r.n_links <= want[r.vec_id][1] for r in got)


def test_table_has_every_row(spark):
    data = table(spark, SF, "embeddings")
    assert vectors.embedding_groups(data).agg(F.countDistinct("vec_id")).first()[0] == data.count()


def test_links_of_wide_vectors(spark):
    """Cells of more than 8,192 components do not fit 32 bits; links are found in all tables."""
    x = np.random.default_rng(5).normal(size=(4, 8200))
    rows = [(2 * n + copy, "a", (v if copy == 0 else 2 * v + 1e-9).tolist()) for n, v in enumerate(x) for copy in range(2)]
    docs = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.embedding_groups(docs).collect()}
    assert got == {i: (1, i - i % 2) for i in range(8)}
    own = vectors.cells(x)
    assert own.max() >= 1 << 31 and (own.astype(vectors.cell_type(8200)) == own).all()
    assert vectors.cell_type(8192) == "<i4" and vectors.cell_type(8193) == "<i8"


def test_candidates_do_not_grow_with_the_rows():
    """Vectors in random directions: pairs met, each once a cell, per vector."""
    rng, met = np.random.default_rng(8), {}
    for n in (4_000, 20_000, 60_000):
        places = vectors.layout(n, 32)
        own = vectors.cells(rng.normal(size=(n, 32)), vectors.TABLES_OF[len(places)], places)
        assert own.shape == (n, vectors.TABLES_OF[len(places)] * (len(places) + 1))
        assert own.max() < np.iinfo(vectors.cell_type(32, vectors.TABLES_OF[len(places)], places)).max
        _, counts = np.unique(own, return_counts=True)
        met[n] = int((counts * (counts - 1)).sum()) / n
    assert len({len(vectors.layout(n, 32)) for n in met}) > 1
    assert max(met.values()) < 1.5 * min(met.values()) and max(met.values()) < 2.5 * vectors.MOST_CANDIDATES, met


def test_layouts():
    assert vectors.layout(0, 64) == vectors.layout(16_384, 64) == (64, 64)
    assert vectors.layout(20_000, 64) == (64, 64, 4) and len(vectors.layout(10 ** 6, 64)) == 4
    assert vectors.layout(10 ** 9, 1) == (1,) * 6
    sizes = [np.prod([2.0 * a for a in vectors.layout(n, 48)]) for n in (10 ** e for e in range(13))]
    assert sizes == sorted(sizes)


def test_finer_cells_find_the_same_links(spark):
    """The layouts of a hundred thousand and a billion vectors, on rows with pairs near the threshold."""
    rng = np.random.default_rng(16)
    rows = []
    for n in range(500):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        cosine = rng.uniform(0.925, 0.95)
        pair = cosine * x + (1 - cosine ** 2) ** 0.5 * z / np.linalg.norm(z)
        rows += [(2 * n, x.tolist(), n % 2), (2 * n + 1, pair.tolist(), n % 2)]
    there = sum(r[1] for r in brute(rows))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r[0]: r[1] for r in brute(rows)}
    for expected in (10 ** 5, 10 ** 9):
        got = vectors.embedding_groups(frame, expected=expected).collect()
        found = sum(r.n_links for r in got)
        assert len(got) == len(rows) and 0.995 * there <= found <= there, expected
        assert all(r.n_links <= want[r.vec_id] for r in got)
