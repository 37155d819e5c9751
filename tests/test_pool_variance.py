"""The pool variance takes the whole of each vector; a candidate's label is a rank-one update of the information."""
import numpy as np
import pytest

from recset.plans import rewards as rw

SF = "/root/testdata/sf0.001"


def test_expected_variance_equals_direct_inversion(spark):
    rows = rw.pool_rows(spark, SF)
    pool = [(r.cand, np.array(r.x), np.array(r.p)) for r in rows.collect()]
    d = len(pool[0][1])
    assert d == 64
    f, a = np.eye(5 * d), np.zeros((5 * d, 5 * d))
    for _, e, p in pool:
        cov = np.diag(p) - np.outer(p, p)
        f += np.kron(np.diag(p * (1 - p)) + np.outer(p, p) - np.diag(p * p), np.outer(e, e))
        a += np.kron(cov @ cov, np.outer(e, e))
    f /= len(pool)
    fisher, output, n = rw.pool_matrices(rows, 5, d)
    assert n == len(pool) and np.allclose(fisher, f) and np.allclose(output, a)
    got = {r.cand: r.expected for r in rw.expected_variance(rows, fisher, output, n).collect()}
    assert len(got) == n
    for cand, e, p in pool[:20]:
        value = 0.0
        for y in range(5):
            g = np.kron(np.eye(5)[y] - p, e)
            value += p[y] * np.trace(a @ np.linalg.inv(f + np.outer(g, g) / n))
        assert got[cand] == pytest.approx(value, rel=1e-9)


def test_ranking(spark):
    got = sorted(rw.al_pool_variance(spark, SF).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 500
    assert all(a.expected <= b.expected for a, b in zip(got, got[1:]))
