"""Lattice hashing against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegrid.llm import lattice


def plain(rows, least):
    """All pairs by numpy."""
    ids, labels = [r[0] for r in rows], [r[2] for r in rows]
    fine = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and labels[i] == labels[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(ids[i])
    small = {r: min((x for x in m if x is not None), default=None) for r, m in groups.items()}
    return sorted(((ids[i], links[i], small[root(i)], ids[i] == small[root(i)]) for i in range(n)), key=str)


def run(spark, rows, least=0.93, kind="array<double>"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").withColumns({c: F.lit(1) for c in ("node", "grp", "v", "cell", "n", "kept", "host")})
    return sorted((tuple(r) for r in lattice.near_copies(table, least).collect()), key=str)


def near(rng, x, cosine):
    """A unit vector at the given cosine to x."""
    y = rng.normal(size=len(x))
    y -= (y @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_decode_is_nearest():
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (500, 8))
    at = lattice.decode(y) / 2
    assert ((at * 2 % 2 == (at * 2 % 2)[:, :1]).all(axis=1) & (at.sum(axis=1) % 2 == 0)).all()
    own = ((y - at) ** 2).sum(axis=1)
    beside = ((y[:, None] - at[:, None] - lattice.ROOTS[None] / 2) ** 2).sum(axis=2)
    assert (own <= beside.min(axis=1) + 1e-12).all() and own.max() <= 1 + 1e-9
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and ((lattice.ROOTS**2).sum(axis=1) == 8).all()


def test_steps_are_the_nearest_cells():
    rng = np.random.default_rng(2)
    y = rng.uniform(-2, 2, (50, 2, 8))
    at = lattice.decode(y)
    step, cost = lattice.steps(y, at, 16)
    assert (np.diff(cost, axis=1) >= -1e-12).all() and not (step < 0).all(axis=2).any()
    every = np.concatenate([np.zeros((1, 8)), lattice.ROOTS / 2])
    for row in range(50):
        price = [((y[row, b] - at[row, b] / 2 - every) ** 2).sum(axis=1) - ((y[row, b] - at[row, b] / 2) ** 2).sum() for b in (0, 1)]
        both = np.sort((price[0][:, None] + price[1]).ravel())[1:17]
        assert np.allclose(both, cost[row])


@pytest.mark.parametrize("crowd,tile", [(4096, 2048), (20, 16)])
def test_equals_all_pairs(spark, monkeypatch, crowd, tile):
    """Two blocks and small tiles in the second run; clusters, copies, chains and a crowd of near copies."""
    monkeypatch.setattr(lattice, "CROWD", crowd)
    monkeypatch.setattr(lattice, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(200)]
    rows += [(1000 + i, near(rng, np.array(rows[i][1]), 0.99).tolist(), i % 3) for i in range(40)]
    centre = rng.normal(size=16)
    rows += [(2000 + i, near(rng, centre, 0.985).tolist(), 1) for i in range(80)]
    rows += [(3000 + i, centre.tolist(), 1) for i in range(30)] + [(4000, (centre * 7).tolist(), 1), (4001, centre.tolist(), 2)]
    monkeypatch.setattr(lattice, "RECALL", 0.99999)
    assert run(spark, rows) == plain(rows, 0.93)


@pytest.mark.parametrize("largest", [1000, 1_000_000, 10_000_000])
def test_recall_at_the_threshold(largest):
    """Pairs just above the threshold meet in one of the planned tables."""
    rng = np.random.default_rng(4)
    tables, blocks = lattice.plan(largest, 0.93)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([near(rng, v, 0.9301) for v in x])
    index = lattice.Index(64, tables, blocks)
    a, b = index.cells(lattice.unit_rows(x)), index.cells(lattice.unit_rows(y))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.97


def test_recall_of_the_operator(spark):
    """Links found of all links of whole tables whose pairs lie between 0.93 and 0.95."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist(), 0) for i in range(600)]
    rows += [(1000 + i, near(rng, np.array(rows[i][1]), rng.uniform(0.9301, 0.95)).tolist(), 0) for i in range(600)]
    found, want = run(spark, rows), plain(rows, 0.93)
    assert sum(r[1] for r in found) >= 0.97 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [None, 1.0], 0), (8, [inf, 1.0], 0),
        (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 3), (2, [2.0, 0.0], 0), (2, [0.0, 1.0], 0), (10, [], 0), (11, [1e300, 1e300], 1), (12, [1e-300, 1e-300], 1),
        (0, [-1.0, -0.0], 0), (13, [1.0], 2), (14, [5.0], 2), (15, [-5.0], 2),
    ]
    assert run(spark, rows) == plain(rows, 0.93)
    assert run(spark, rows[:0]) == []
