"""Pivot index against all pairs, and recall at the limit."""
import numpy as np
import pytest

from recset.llm import pivots as p
from tests.llm.test_simhash import unite

INF, NAN = float("inf"), float("nan")


def brute(rows, least=p.LEAST):
    def good(x, label):
        return label is not None and x and all(e is not None and np.isfinite(e) for e in x) and any(x)

    n = len(rows)
    links, root = [0] * n, np.arange(n)
    for i in range(n):
        for j in range(i):
            (_, x, a), (_, y, b) = rows[i], rows[j]
            if good(x, a) and good(y, b) and a == b and len(x) == len(y):
                u, v = np.array(x, np.float64), np.array(y, np.float64)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                    links[i] += 1
                    links[j] += 1
                    unite(root, np.array([i]), np.array([j]))
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((rows[i][0], links[i], c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=str)


def fixture():
    rng = np.random.default_rng(8)
    rows, centre = [], rng.normal(size=(12, 16))
    for i in range(150):
        x = centre[i % 12] + 0.1 * rng.normal(size=16) * (i % 5)
        rows.append((i, np.float32(x).tolist(), i % 3))
    hot = np.float32(centre[0]).tolist()
    rows += [(500 + i, hot, 0) for i in range(30)] + [(500, hot, 0), (None, hot, 0), (600, hot, None), (601, None, 1), (602, [0.0] * 16, 1), (603, [], 1),
             (604, [NAN] + hot[1:], 0), (605, [INF] + hot[1:], 0), (606, [None] + hot[1:], 0), (607, hot[:8], 0), (608, hot[:8], 0), (None, None, None), (609, [2 * e for e in hot], 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    monkeypatch.setattr(p, "TASK_ROWS", 500)
    rows = fixture()
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, entry int, key string")
    got = sorted(map(tuple, p.near_vectors(frame).collect()), key=str)
    want = brute([(i, None if x is None else [e if e is None else float(np.float32(e)) for e in x], label) for i, x, label in rows])
    assert got == want
    assert p.near_vectors(frame.limit(0)).count() == 0


def test_recall_at_the_limit(spark):
    """Pairs exactly at the limit among unrelated vectors, with as many pivots as 50,000 vectors would have."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    c = p.LEAST + 1e-4
    y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    _, distinct = p.entries(frame, "vec_id", "embedding", "label")
    lists = p.inverted(p.described(distinct, {64: p.filled(np.zeros((0, 64)), 1024)}, 1024))
    found = {r.a for r in p.verify(lists, distinct).filter("b IS NULL").collect()}
    assert len(found) >= 0.98 * 800
