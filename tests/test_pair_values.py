"""Pairs that truths share with predictions, by query, against arrays of pairs."""
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import metrics as ms
from recset.plans import metrics_seq as mq, rankers


def example(spark):
    """Truths with null items and without a start, of queries with and without predictions; paths that repeat items or are short."""
    r = random.Random(6)
    truth = []
    for traj in range(300):
        y = r.sample(range(9), r.randint(2, 6))
        if traj % 7 == 0:
            y[r.randrange(len(y))] = None
        truth.append((10**12 + traj, y[0], len(y), y))
    pred = []
    for qid, (start, n) in enumerate(itertools.product(range(8), range(2, 7))):
        for k in range(1, r.randint(1, 4) + 1):
            path = [start] + r.sample([p for p in range(9) if p != start], n - 1)
            path = path + path[1:3] if k == 2 else path[:-1] if k == 3 else path
            pred.append((qid, start, n, "pop" if k == 1 else "rand", k, path))
    return spark.createDataFrame(truth, "traj long, start long, len long, y array<long>").repartition(3), spark.createDataFrame(pred, "qid long, start long, len long, method string, k int, path array<long>")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "method", "k", "traj", "pf1").collect())


def test_values_equal_arrays_of_pairs(spark, monkeypatch):
    truth, pred = example(spark)
    want = rows(truth.join(pred, ["start", "len"]).withColumn("n", F.size(c.pairs_of(F.col("y")))).select("qid", "method", "k", "traj", F.round(mq.f1_pairs(), 6).alias("pf1")))
    value = lambda hits, n_true, n_pred: F.round(c.f1(hits, n_true, n_pred), 6)
    for size in (1 << 17, 20):
        monkeypatch.setattr(ms, "TRUTHS", size)
        assert rows(ms.pair_values(truth, pred, value, "pf1")) == want and len(want) > 400


def test_no_arrays_of_pairs_are_built(spark):
    truth, pred = example(spark)
    plan = ms.pair_values(truth, pred, lambda h, n, m: c.f1(h, n, m), "pf1")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "Join" in plan
    assert ms.pair_values(truth.limit(0), pred, lambda h, n, m: c.f1(h, n, m), "pf1").count() == 0


def test_hits_of_repeated_items():
    y = np.array([[1, 2, 3], [3, 2, 1], [2, 9, 1]])
    known = np.ones_like(y, bool)
    known[2, 1] = False
    assert ms.pair_hits(np.array([1, 2, 1, 3]), y, known).tolist() == [3, 1, 1]
    assert ms.pair_hits(np.array([7]), y, known).tolist() == [0, 0, 0]


def test_lost_users_of_popularity(spark):
    """A user lost to a POI in a query has all its visits of it in that query; a trajectory may have several users."""
    r = random.Random(2)
    lists = [(t, u, r.sample(range(5), r.randint(2, 4))) for t in range(40) for u in ([r.randrange(6)] if t % 9 else [7, 8, None])]
    p = spark.createDataFrame([(t, u, x, len(x), x[0]) for t, u, x in lists], "traj long, usr long, path array<long>, len long, start long")
    got = {(x.start, x.len): x.path for x in rankers.popularity_paths(spark, None, rankers.spans(p)).collect()}
    of = {}
    for t, _, x in lists:
        of.setdefault(t, set()).add((x[0], len(x)))
    seen = {}
    for t, u, x in lists:
        for poi in x:
            seen.setdefault((poi, u), set()).update(of[t])
    for start, n in {s for x in of.values() for s in x}:
        pop = {poi: sum(q == poi and (u is None or s != {(start, n)}) for (q, u), s in seen.items()) for poi in range(5)}
        assert got[start, n] == [start] + sorted((q for q in pop if q != start), key=lambda q: (-pop[q], q))[:n - 1]
