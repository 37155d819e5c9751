"""The rank fits take the whole of each vector, go on until the loss stands, and score a query by the fit that has not seen it."""
import random

import numpy as np
import pytest

from recset.operators import models as md
from recset.plans import models as pm


def test_rank_fit_uses_every_slot_and_converges(spark, monkeypatch):
    """Only a slot in front of the last ten tells positives from negatives; in the rows of the query's own fold it misleads."""
    r = random.Random(1)
    rows = []
    for q in range(6):
        for i in range(10):
            for fold in (0, 1):
                mine = q % 2 == fold
                x = [(1.0 if i < 3 else -1.0)] + [r.gauss(0, 1) for _ in range(11)]
                rows.append((fold, mine, q, 10 * q, 3, 10 * q + i, int(i < 3), x))
    d = spark.createDataFrame(rows, "fold long, test boolean, qid long, start long, len int, poi long, occ long, x array<double>")
    d = d.selectExpr("*", "CAST(occ AS DOUBLE) AS rank_label")
    monkeypatch.setattr(pm, "labelled", lambda *_: d)
    for fit in (pm.pairwise_rank, pm.ranking_svm, pm.poi_rank_linreg, pm.poi_occurrence_lr):
        got = fit(spark, None).collect()
        assert len(got) == 6
        for p in got:
            assert {int(x) % 10 for x in p.path.split(",")[1:]} <= {1, 2}


def test_hinge_solve_against_plain_descent(spark):
    r = random.Random(1)
    rows = [(q, 10 * q + i, int(i < 3), [1.0 if i < 3 else -1.0] + [r.gauss(0, 1) for _ in range(11)]) for q in range(6) for i in range(10)]
    x = spark.createDataFrame(rows, "qid long, id long, pos int, x array<double>")
    w, losses = md.hinge_rank_solve(x, 12, 0.3, 0.1)
    assert all(b <= a for a, b in zip(losses, losses[1:]))
    # Plain descent over all pairs, until it stands.
    near = np.array([np.subtract(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[2] and not b[2]])
    v = np.zeros(12)
    value = lambda v: np.mean(np.maximum(0, 1 - near @ v) ** 2) + 0.05 * v @ v
    for _ in range(3000):
        v -= 0.01 * (-2 * np.maximum(0, 1 - near @ v) @ near / len(near) + 0.1 * v)
    assert losses[0] == pytest.approx(1) and value(w) <= value(v) + 0.01
