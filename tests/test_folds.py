"""Held-out statistics, fits and pair sums against counting again, DuckDB and all pairs."""
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recset.operators import folds as fd
from recset.plans import models as pm
from recset.sources import views as v


def visits(seed=2, n=60):
    r = random.Random(seed)
    rows = []
    for t in range(n):
        for k, p in enumerate(r.sample(range(8), r.randint(1, 4))):
            rows.append((t, p, r.randrange(12), float(r.randint(1, 50)), r.randint(1, 5)))
    return rows


def frames(spark, rows):
    seq = spark.createDataFrame(rows, "traj long, poi long, usr long, duration double, photos long")
    first = {}
    for t, p, *_ in rows:
        first.setdefault(t, p)
    size = {t: sum(1 for x in rows if x[0] == t) for t in first}
    fold = {t: (first[t], size[t]) for t in first if size[t] > 1}
    names = {k: i for i, k in enumerate(sorted(set(fold.values())))}
    trajs = spark.createDataFrame([(t, first[t]) for t in first], "traj long, start long")
    folds = spark.createDataFrame([(t, names[k]) for t, k in fold.items()], "traj long, fold long")
    return seq, trajs, folds, {t: names[k] for t, k in fold.items()}, {i: k for k, i in names.items()}, first


def test_statistics_and_candidates_without_the_fold(spark):
    rows = visits()
    seq, trajs, folds, fold_of, names, first = frames(spark, rows)
    queries = spark.createDataFrame([(f, s, n) for f, (s, n) in names.items()], "fold long, start long, len long")
    grid = {(r.fold, r.poi) for r in fd.left_out_grid(queries, seq, trajs, folds).collect()}
    keys = spark.createDataFrame([(f, p) for f in names for p in range(8)], "fold long, poi long")
    info = {(r.fold, r.poi): (r.dur, r.nvisit, r["pop"]) for r in fd.left_out_info(seq, folds, keys).collect()}
    sums = {(r.fold, r.poi): r.s for r in fd.left_out_sums(seq, folds, keys, {"s": F.sum("photos")}).collect()}
    mid = {(r.fold, r.poi): r.p for r in fd.left_out_percentiles(seq, folds, keys, "photos", {"p": 0.5}).collect()}
    for f, (start, _) in names.items():
        rest = [x for x in rows if fold_of.get(x[0]) != f]
        assert {p for g, p in grid if g == f} == {x[1] for x in rest if first[x[0]] == start}
        for p in range(8):
            own = [x for x in rest if x[1] == p]
            if own:
                assert info[f, p] == (pytest.approx(np.mean([x[3] for x in own])), len(own), len({x[2] for x in own}))
                assert sums[f, p] == sum(x[4] for x in own) and mid[f, p] == np.median([x[4] for x in own])
            else:
                assert (f, p) not in info


def pairs_by_hand(rows, kind):
    """Mean over queries of the mean pair loss, and its slope by every score: rows (qid, pos, s)."""
    loss, g = 0.0, np.zeros(len(rows))
    qs = sorted({q for q, *_ in rows if {p for r, p, _ in rows if r == q} == {0, 1}})
    for q in qs:
        a, b = ([i for i, r in enumerate(rows) if r[0] == q and r[1] == k] for k in (1, 0))
        wt = 1 / (len(a) * len(b) * len(qs))
        for i in a:
            for j in b:
                z = rows[i][2] - rows[j][2]
                if kind == "logistic":
                    value, slope = np.logaddexp(0, -z), -1 / (1 + np.exp(z)) if z < 700 else 0.0
                else:
                    value, slope = max(0, 1 - z) ** 2, -2 * max(0, 1 - z)
                loss += wt * value
                g[i] += wt * slope
                g[j] -= wt * slope
    return loss, g


@pytest.mark.parametrize("kind, spread", [("logistic", 1.0), ("logistic", 60.0), ("hinge", 1.0)])
def test_pair_sums_equal_all_pairs(spark, kind, spread):
    r = random.Random(7)
    rows = [(q, r.randint(0, 1), round(r.gauss(0, spread), 2)) for q in range(4) for _ in range(25)] + [(9, 1, 0.5)]
    df = spark.createDataFrame([(f, q, i, p, [s, 1.0]) for f in (0, 1) for i, (q, p, s) in enumerate(rows)], "fold long, qid long, id long, pos int, x array<double>")
    base = fd.with_scores(fd.pair_rows(df), {0: np.array([1.0, 0.0]), 1: np.array([-0.5, 3.0])})
    got = (fd.hinge_slopes(base) if kind == "hinge" else fd.logistic_slopes(base, ["fold", "qid"])).collect()
    for f, scale in ((0, 1.0), (1, -0.5)):
        loss, g = pairs_by_hand([(q, p, scale * s) for q, p, s in rows], kind)
        own = {x.id: x for x in got if x.fold == f}
        assert sum(x.loss for x in own.values()) == pytest.approx(loss, abs=1e-9)
        assert all(own[i].gs == pytest.approx(g[i], abs=1e-9) for i in own) and set(own) == {i for i, x in enumerate(rows) if x[0] != 9}


def test_series_bound():
    x = np.linspace(-45, 45, 2000)
    for e in (-fd.CELL, -0.2, fd.CELL):
        value, slope = fd.series(x)
        powers = e ** np.arange(fd.ORDER)
        assert np.abs(value @ powers - np.logaddexp(0, -(x + e))).max() < 2e-11
        assert np.abs(slope @ powers + 1 / (1 + np.exp(x + e))).max() < 2e-11


def samples(spark, n=400, d=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * [1, 50, 0.01] + [0, 1000, 5]
    y = (x @ [1, 0.02, 40] + rng.normal(size=n) > 220).astype(float)
    rows = [(int(i % 2), [*map(float, x[i]), 7.0], float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "fold long, x array<double>, y double")


def test_normal_equations_against_sql(spark):
    rows, df = samples(spark)
    grams = fd.gram(df)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, fold INT, i INT, z DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k, f, i, z) for k, (f, x, y) in enumerate(rows) for i, z in enumerate([1.0, *x, y])])
    for f, i, j, v in con.execute("SELECT a.fold, a.i, b.i, sum(a.z * b.z) FROM t a JOIN t b USING (id) GROUP BY ALL").fetchall():
        assert grams[f][i, j] == pytest.approx(v, rel=1e-12)
    for f, (w, b) in fd.ridge(grams, 0.01).items():
        x = np.array([r[1] for r in rows if r[0] == f])
        y = np.array([r[2] for r in rows if r[0] == f])
        z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        u = np.linalg.solve(z.T @ z / len(z) + 0.01 * np.eye(4), z.T @ (y - y.mean()) / len(z))
        assert x @ w + b == pytest.approx(z @ u + y.mean(), abs=1e-8)


def test_logistic_stands_still(spark):
    rows, df = samples(spark)
    for f, (w, b) in fd.logistic(df, fd.gram(df), 0.01).items():
        x = np.array([r[1] for r in rows if r[0] == f])
        y = np.array([r[2] for r in rows if r[0] == f])
        sd = np.where(x.std(0) > 0, x.std(0), 1)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert abs((p - y).mean()) < 1e-4 and np.abs(((x - x.mean(0)) / sd).T @ (p - y) / len(y) + 0.01 * w * sd).max() < 1e-4


@pytest.mark.parametrize("kind", ["logistic", "hinge"])
def test_pair_fit_descends_and_ranks(spark, kind):
    """One slot tells positives from negatives; the fold with the signs turned learns the opposite."""
    r = random.Random(1)
    rows = [(f, q, 10 * q + i, int(i < 3), [(1.0 if i < 3 else -1.0) * (1 - 2 * f)] + [r.gauss(0, 1) for _ in range(4)]) for f in (0, 1) for q in range(5) for i in range(9)]
    df = spark.createDataFrame(rows, "fold long, qid long, id long, pos int, x array<double>")
    scale = fd.scales(fd.gram(df.withColumn("y", F.col("pos").cast("double"))))
    weights, losses = fd.pair_fit(df, scale, kind, 0.3, 0.01)
    for f in (0, 1):
        assert all(b <= a for a, b in zip(losses[f], losses[f][1:])) and losses[f][-1] < 0.5 * losses[f][0]
        w = weights[f][0]
        assert np.abs(w).argmax() == 0 and np.sign(w[0]) == 1 - 2 * f


def test_a_held_out_trajectory_changes_no_score_of_its_query(spark, monkeypatch):
    """Other POI, durations and users in one trajectory (start and length stay): nothing that scores its query moves."""
    sf = "/root/testdata/sf0.001"
    real = v.city_visit(spark, sf)
    rows = sorted(map(tuple, real.collect()))
    names = real.columns
    by = {}
    for r in rows:
        by.setdefault(r[names.index("traj")], []).append(r)
    at = {c: names.index(c) for c in names}
    traj = next(t for t in sorted(by) if len(by[t]) == 4)
    own = sorted(by[traj], key=lambda r: (r[at["start_ts"]], r[at["poi"]]))
    used = {r[at["poi"]] for r in own}
    others = [p for p in sorted({r[at["poi"]] for r in rows}) if p not in used][:3]
    changed = []
    for r, p in zip(own[1:], others):
        r = list(r)
        r[at["poi"]], r[at["duration"]] = p, r[at["duration"]] * 9 + 1
        changed.append(tuple(r))
    new = [r for r in rows if r[at["traj"]] != traj] + [own[0]] + changed
    start, n = own[0][at["poi"]], len(own)

    def seen(data):
        df = spark.createDataFrame(data, real.schema)
        monkeypatch.setattr(v, "city_visit", lambda *_: df)
        d = pm.labelled(spark, sf)
        q = d.filter((F.col("start") == start) & (F.col("len") == n) & F.col("test"))
        scored = fd.scored(q, fd.ridge(fd.gram(pm.rank_targets(d)), 0.01))
        return sorted((r.poi, tuple(r.x), r.score) for r in scored.collect()), d

    before, _ = seen(rows)
    after, d = seen(new)
    assert before and [r[:2] for r in before] == [r[:2] for r in after]
    assert [r[2] for r in before] == pytest.approx([r[2] for r in after], rel=1e-9)  # sums over tasks come in any order
    # The other folds do see the change.
    assert d.filter("not test").count() > 0 and sorted(new) != rows


def test_labels_together_equal_one_by_one(spark, monkeypatch):
    """Gradients against numpy, fits against the minimum of each label alone; blocks of two labels."""
    monkeypatch.setattr(fd, "LABELS", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    labels = [[int(k) for k in range(5) if x[i, k % 4] + 0.3 * rng.normal() > 0.4 and k != 3] for i in range(300)]
    df = spark.createDataFrame([(x[i].tolist(), labels[i]) for i in range(300)], "x array<double>, labels array<bigint>").repartition(3)
    w = {k: rng.normal(size=5) for k in range(5)}
    z, y = np.column_stack([np.ones(300), x]), np.array([[float(k in own) for k in range(5)] for own in labels])
    for k, (loss, g) in fd.label_slopes(df, w).items():
        s = z @ w[k]
        assert loss == pytest.approx((np.logaddexp(0, s) - y[:, k] * s).sum()) and g == pytest.approx(z.T @ (1 / (1 + np.exp(-s)) - y[:, k]))
    fits, losses = fd.label_fit(df, 5, 4, 0.1, 1e-7)
    for k in range(5):
        u = np.zeros(5)
        for _ in range(3000):
            u -= 0.5 * (z.T @ (1 / (1 + np.exp(-z @ u)) - y[:, k]) / 300 + 0.1 * np.array([0, 1, 1, 1, 1]) * u)
        value = np.logaddexp(0, z @ u).mean() - (y[:, k] * (z @ u)).mean() + 0.05 * (u[1:] ** 2).sum()
        assert losses[k][-1] == pytest.approx(value, abs=1e-3) and all(b <= a for a, b in zip(losses[k], losses[k][1:]))
