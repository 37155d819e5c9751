"""Path metrics in batches against the array functions and against counting pairs."""
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import metrics as ms
from recset.plans import metrics_seq as mq


def rows(n, seed):
    r = random.Random(seed)
    return [(r.sample(range(20), r.randint(1, 7)), r.sample(range(20), r.randint(1, 7))) for _ in range(n)]


def by_hand(a, b, m):
    both = len(set(a) & set(b))
    pairs = sum(1 for x, y in itertools.combinations(a, 2) if x in b and y in b and b.index(x) < b.index(y))
    rank = lambda p, i: m - p.index(i) if i in p else 0
    sign = lambda p, i, j: np.sign(rank(p, i) - rank(p, j))
    every = list(itertools.combinations(range(m), 2))
    s, n1, n2 = (sum(f(i, j) for i, j in every) for f in (lambda i, j: sign(a, i, j) * sign(b, i, j), lambda i, j: abs(sign(a, i, j)), lambda i, j: abs(sign(b, i, j))))
    n = lambda p: len(p) * (len(p) - 1) // 2
    return 2 * both / (len(a) + len(b)), 2 * pairs / (n(a) + n(b)) if pairs else 0.0, s / (n1 * n2) ** 0.5


def test_agreement_equals_counting(monkeypatch):
    data = rows(120, 1)
    monkeypatch.setattr(ms, "CELLS", 400)  # several blocks
    got = ms.agreement(pd.Series([a for a, _ in data]), pd.Series([b for _, b in data]), np.full(len(data), 20))
    for (a, b), row in zip(data, got):
        assert row == pytest.approx(by_hand(a, b, 20), abs=1e-12)
    assert ms.agreement(pd.Series([], dtype=object), pd.Series([], dtype=object), np.zeros(0, int)).shape == (0, 3)


def test_agreement_equals_array_functions(spark):
    df = spark.createDataFrame(rows(200, 2), "path array<long>, y array<long>").withColumn("m", F.lit(25).cast("long"))
    d = df.withColumn("e", ms.path_agreement("path", "y", "m")).select("e.*", mq.f1_points().alias("a"), mq.f1_pairs().alias("b"), c.kendall_tau_b(F.col("path"), F.col("y"), F.col("m")).alias("t"))
    for r in d.collect():
        assert (r.f1, r.pf1, r.tau) == pytest.approx((r.a, r.b, r.t), abs=1e-12)
