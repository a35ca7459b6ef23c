import math

import numpy as np
import pytest
from brute import components

from leadtime.llm import vectors as V


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def brute(rows):
    """{row number: (links, smallest id of the component)} of (id, vector, label)."""
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def linked(a, b):
        x, y = rows[a], rows[b]
        return x[2] == y[2] and len(x[1]) == len(y[1]) and cosine(x[1], y[1]) >= V.COSINE
    root = components(good, linked)
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    for k in good:
        ids = [rows[j][0] for j in good if root[j] == root[k] and rows[j][0] is not None]
        out[k] = (sum(linked(k, j) for j in good if j != k), min(ids) if ids else None)
    return sorted(((rows[k][0] is None, rows[k][0] or 0, n, c is None, c or 0) for k, (n, c) in out.items()))


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0)
                 for r in V.vector_links(df).collect())
    assert got == brute([(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, lab) for i, v, lab in rows])


@pytest.mark.parametrize("cell", [2000, 30])
def test_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(V, "CELL", cell)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(12, 24))
    rows = []
    for k in range(260):
        v = centre[k % 12] + rng.normal(size=24) * [0.0, 0.05, 0.18][k % 3]
        rows.append((k, v.tolist(), k % 2))
    rows += [(300 + k, centre[0].tolist(), 0) for k in range(40)]  # copies
    check(spark, rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [nan, 1.0, 1.0], 0), (5, [inf, 1.0, 1.0], 0), (6, [None, 1.0, 1.0], 0),
            (7, v, None), (8, v, 0), (9, [2.0, 4.0, 6.0], 0), (10, v, 1), (11, [1.0, 2.0], 0), (8, v, 0), (None, v, 2), (None, v, 2), (12, [5.0], 3), (13, [7.0], 3)]
    check(spark, rows)
    assert V.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n_links int")).count() == 0


def test_recall_at_the_border():
    rng = np.random.default_rng(11)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = V.COSINE * a + math.sqrt(1 - V.COSINE ** 2) * b
    met = np.zeros(2000, bool)
    for t in range(V.TABLES):
        x, y = V.codes(a, t), V.codes(b, t)
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
    assert met.mean() >= 0.99
