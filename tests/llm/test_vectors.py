"""Near vectors, held against all pairs."""

import numpy as np
import pytest

from kpiforge.llm import vector_index

SCHEMA = "vec_id bigint, embedding array<float>, node string, cells string, least string, weight string, id string, n string, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 7) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    """vec_id -> links, by row number, and the smallest id reached."""
    units = []
    for _, v in rows:
        ok = bool(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.abs(np.array(v, float)).max() > 0
        units.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    links = [set() for _ in rows]
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 24))
    rows = []
    for c in centres:
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (c + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.35])).tolist()))
    big = centres[0] * 3
    rows += [(len(rows) + i, (big + rng.standard_normal(24) * 0.05).tolist()) for i in range(150)]  # a third are near copies
    rows += [(len(rows) + i, big.tolist()) for i in range(120)]  # and as many exact ones
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] + [1.0] * 23),
             (n + 5, [float("inf")] + [1.0] * 23), (n + 6, [1.0, 1.0]), (n + 7, [2.0, 2.0]), (n + 8, [1e30] * 24), (n + 9, [1e-30] * 24)]
    return rows


@pytest.mark.parametrize("block,sample", [(4096, 20_000), (16, 60)])
def test_near_vectors(spark, rows, block, sample):
    got = {r.vec_id: r for r in vector_index.near_vectors(table(spark, rows), block=block, sample=sample, cell_rows=8).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i, _ in rows)
    assert 0.95 * sum(map(len, want)) <= found <= sum(map(len, want))
    assert all(got[i].n_links <= len(w) for (i, _), w in zip(rows, want))
    for (i, _), w in zip(rows, want):
        r = got[i]
        assert r.component_id <= i and r.kept == (r.component_id == i) and (w or r.component_id == i)
    assert got[len(rows) - 3].component_id == len(rows) - 4  # the short vectors link with each other


def test_all_cells_give_all_links(spark, rows):
    got = {r.vec_id: r for r in vector_index.near_vectors(table(spark, rows), recall=1.0, cell_rows=100_000).collect()}
    want = brute(rows)
    assert [got[i].n_links for i, _ in rows] == [len(w) for w in want]
    root = list(range(len(rows)))
    for i, w in enumerate(want):  # ids are row numbers, in order
        for j in w:
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got[i].component_id for i, _ in rows] == root


def test_a_hot_cell_is_split_on_both_sides(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    near = centre + rng.standard_normal((600, 8)) * rng.choice([0.05, 0.4, 1.0], (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = [{r.vec_id: (r.n_links, r.component_id) for r in vector_index.near_vectors(
        table(spark, rows), recall=1.0, cell_rows=100_000, block=block, visitors=visitors).collect()}
        for block, visitors in ((4096, 8192), (64, 100), (50, 8))]
    assert [got[0][i][0] for i in range(600)] == want.tolist() and got[0] == got[1] == got[2]
    visits = spark.createDataFrame([(f"{i:032d}", 1, b"", 7, [7]) for i in range(2000)] + [(f"x{i}", 1, b"", 8, [8, 7]) for i in range(4000)],
                                   "node string, weight bigint, unit binary, home bigint, cells array<bigint>")
    places = vector_index._spread(visits, block=100, visitors=200).groupBy("place").count().toPandas()["count"]
    assert len(places) > 600 and places.max() < 500


def test_order_of_visits_is_that_of_the_distances():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((30, 8))
    books = rng.standard_normal((5, 4)), rng.standard_normal((6, 4))
    got = vector_index.visited(points, books, 12)
    for p, cells in zip(points, got):
        d = {i * 6 + j: ((p[:4] - books[0][i]) ** 2).sum() + ((p[4:] - books[1][j]) ** 2).sum() for i in range(5) for j in range(6)}
        assert cells.tolist() == sorted(d, key=d.get)[:12]


def test_no_and_repeated_rows(spark):
    assert vector_index.near_vectors(table(spark, [])).count() == 0
    got = sorted(tuple(r) for r in vector_index.near_vectors(table(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (3, None), (None, [1.0, 0.01])])).collect() if r.vec_id is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True)]


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {r.vec_id: r.n_links for r in vector_index.near_vectors(table(spark, rows)).collect()}
    want = brute(rows)
    assert all(got[i] <= len(w) for (i, _), w in zip(rows, want))
    assert sum(got.values()) >= 0.9 * sum(map(len, want))
