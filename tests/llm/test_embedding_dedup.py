import math

import numpy as np
import pytest

from storyloom.llm import embedding_dedup as ed


def brute(rows, least=0.95):
    """{position: (n_links, component)} by all cosines."""
    fits = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [ed.units(np.array([v], float))[0] if ok else None for (_, v), ok in zip(rows, fits)]
    parent = list(range(len(rows)))
    count = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fits[i] and fits[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least:
                count[i] += 1
                count[j] += 1
                parent[root(i)] = root(j)
    last = float("inf")
    low = {}
    for i, (vec, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), last), last if vec is None else vec)
    return sorted((last if v is None else v, count[i], low[root(i)]) for i, (v, _) in enumerate(rows))


def answers(frame):
    last = float("inf")
    out = frame.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((last if r.vec_id is None else r.vec_id, r.n_links, last if r.component_id is None else r.component_id) for r in out)


def corpus(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = [v for v in rng.standard_normal((250, dim))]
    for size, spread in ((60, 0.02), (40, 0.2), (30, 0.3), (3, 0.1)):
        base = rng.standard_normal(dim)
        rows += [base / np.linalg.norm(base) + spread * rng.standard_normal(dim) / math.sqrt(dim) for _ in range(size)]
    rows += [rows[5]] * 20 + [rows[5] * 2, rows[260] * 1e30, rows[261] * 1e-30]
    rows = [r.astype(np.float32).tolist() for r in rows]
    rng.shuffle(rows)
    return list(enumerate(rows))


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed,occupancy,chunk", [(1, 16, 8192), (2, 4, 16)])
def test_matches_brute_force(spark, monkeypatch, seed, occupancy, chunk):
    monkeypatch.setattr(ed, "OCCUPANCY", occupancy)
    monkeypatch.setattr(ed, "CHUNK", chunk)
    rows = corpus(seed)
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA + ", key int, block string").repartition(3)
    got, want = answers(ed.links(table)), brute(rows)
    assert [v for v, _, _ in got] == [v for v, _, _ in want]
    assert all(g <= w for (_, g, _), (_, w, _) in zip(got, want))
    assert sum(g for _, g, _ in got) >= 0.99 * sum(w for _, w, _ in want)
    assert sum(g != w for g, w in zip(got, want)) <= 4


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs between cosines 0.95 and 0.96 only, the hardest."""
    monkeypatch.setattr(ed, "OCCUPANCY", 4)
    rng = np.random.default_rng(3)
    base = ed.units(rng.standard_normal((600, 32)))
    away = rng.standard_normal(base.shape)
    away = ed.units(away - (away * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.9501, 0.96, (600, 1))
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away]).tolist()
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    grid = ed.fitted(np.array(rows), len(rows))
    assert grid.visits < len(grid.left) * len(grid.right) / 3
    assert sum(n for _, n, _ in answers(ed.links(table))) >= 0.97 * 1200


def test_edges(spark):
    a, b, nan = [1.0, 0.0, 0.0, 0.0], [0.99, 0.01, 0.0, 0.0], float("nan")
    rows = [(1, a), (2, b), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 0.0, 0.0]), (7, [nan, 1.0, 0.0, 0.0])]
    rows += [(8, [float("inf"), 0.0, 0.0, 0.0]), (None, a), (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, [3.0]), (12, [-1.0]), (13, [5.0]), (1, a), (14, [-0.0, 3.0]), (15, [0.0, 3.0])]
    assert answers(ed.links(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert ed.links(spark.createDataFrame([], SCHEMA)).collect() == []
    assert answers(ed.links(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA))) == [(1, 0, 1), (2, 0, 2)]


def test_the_sequence_is_in_order_and_complete():
    rng = np.random.default_rng(4)
    grid = ed.Grid(rng.standard_normal((12, 4)), rng.standard_normal((9, 4)), visits=20)
    d1, d2 = grid.distances(rng.standard_normal((30, 8)))
    c1, c2, sums, bound = grid.sequence(d1, d2)
    every = np.sort((d1[:, :, None] + d2[:, None, :]).reshape(30, -1), axis=1)
    assert np.allclose(sums, every[:, : sums.shape[1]])
    assert np.allclose(sums, d1[np.arange(30)[:, None], c1] + d2[np.arange(30)[:, None], c2])
    assert ((sums <= bound[:, None]).sum(axis=1) >= 12).all()
    assert (grid.ranks(d1, d2, (c1[:, 5], c2[:, 5])) - 5 <= 1).all()  # rounding may count the cell itself


def test_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert answers(ed.links(table)) == brute([(r.vec_id, r.embedding) for r in table.collect()])
