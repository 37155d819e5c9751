"""The multitask fit in slices and by series, against a plain fit that scores every pair."""
import random

import numpy as np
import pytest

from recset.operators import models as md, multitask as mt

D = 3


def example():
    """Songs with a zero vector and repeated ones; lists of users of one to many songs, one list of all songs, one without a user."""
    rng, r = np.random.default_rng(4), random.Random(4)
    X = rng.normal(size=(30, D)) * 0.5
    X[3], X[7] = 0, X[8]
    lists = [(p, r.choice([1, 2, 3, 4, 5, 6, 7]), r.sample(range(30), r.choice([1, 2, 5]))) for p in range(40)]
    lists += [(40, 8, list(range(30))), (41, None, [2, 4]), (42, 9, [1])] + [(50 + p, 10, r.sample(range(30), 3)) for p in range(12)]
    return X, lists


def plain(X, lists, p, c1, c2, steps, rate):
    mu, w, v, losses = np.zeros(D), {k: np.zeros(D) for k, u, _ in lists if u is not None}, {u: np.zeros(D) for _, u, _ in lists if u is not None}, []
    for _ in range(steps):
        g, risk = {}, 0
        for k, u, ix in lists:
            if u is None:
                continue
            t = mu + w[k] + v[u]
            out = [i for i in range(len(X)) if i not in ix]
            a, e = np.exp(-p * X[ix] @ t), np.exp(X[out] @ t)
            risk += (a.mean() / p + (e.mean() if out else 0)) / len(lists)
            g[k] = ((e @ X[out] / len(out) if out else 0) - a @ X[ix] / len(ix)) / len(lists)
        losses.append(risk + c1 / 2 * sum(x @ x for x in v.values()) + c2 * (sum(np.abs(x).sum() for x in w.values()) + np.abs(mu).sum()))
        soft = lambda x: np.sign(x) * np.maximum(np.abs(x) - rate * c2, 0)
        v = {u: x - rate * (sum(g[k] for k, o, _ in lists if o == u) + c1 * x) for u, x in v.items()}
        w = {k: soft(x - rate * g[k]) for k, x in w.items()}
        mu = soft(mu - rate * sum(g.values()))
    return w, v, mu, losses


def fit(spark, X, lists, *args):
    songs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "song long, x array<double>")
    entries = spark.createDataFrame([(k, i) for k, _, ix in lists for i in ix], "pid long, song long").repartition(3)
    return md.mtc_fit(songs, entries, spark.createDataFrame([(k, u) for k, u, _ in lists], "pid long, usr long"), D, *args)


# The rates keep all lists near, move some of them out of reach, and move all.
@pytest.mark.parametrize("rate, slice", [(1e-4, 1 << 18), (3e-3, 60), (0.4, 60), (0.4, 1 << 18)])
def test_fit_equals_all_pairs(spark, monkeypatch, rate, slice):
    monkeypatch.setattr(mt, "SLICE", slice)
    monkeypatch.setattr(md, "SONGS", 9)
    X, lists = example()
    w, v, mu, losses = plain(X, lists, 2.0, 0.1, 0.001, 4, rate)
    state, users, got_mu, got = fit(spark, X, lists, 2.0, 0.1, 0.001, 4, rate)
    assert got == pytest.approx(losses, rel=1e-10) and got_mu == pytest.approx(mu, rel=1e-8, abs=1e-12)
    state, users = {r.pid: r.w for r in state.collect()}, {r.usr: r.v for r in users.collect()}
    assert sorted(state) == sorted(w) and all(state[k] == pytest.approx(w[k], rel=1e-7, abs=1e-12) for k in w)
    assert sorted(users) == sorted(v) and all(users[u] == pytest.approx(v[u], rel=1e-7, abs=1e-12) for u in v)


def test_near_lists_meet_no_songs(spark, monkeypatch):
    def none(*_):
        raise AssertionError("scored in pairs of blocks")

    X, lists = example()
    monkeypatch.setattr(md, "block_totals", none)
    *_, losses = fit(spark, X, lists, 2.0, 0.1, 0.001, 3, 1e-4)
    assert losses == pytest.approx(plain(X, lists, 2.0, 0.1, 0.001, 3, 1e-4)[3], rel=1e-10)


@pytest.mark.parametrize("terms", [1, 2])
def test_series_within_reach(spark, terms):
    rng = np.random.default_rng(2)
    X, mu = rng.normal(size=(500, D)), rng.normal(size=D) * 0.3
    radius = np.linalg.norm(X, axis=1).max()
    delta = rng.normal(size=(50, D))
    delta *= mt.reach(terms) / radius / np.linalg.norm(delta, axis=1, keepdims=True)
    m = mt.moments(spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>").repartition(4), mu, terms)
    e = np.exp(X @ (mu + delta).T)
    want = np.column_stack([e.sum(0), e.T @ X])
    scale = np.exp(X @ mu) @ np.column_stack([np.ones(500), np.abs(X)])
    assert np.abs(mt.series(delta, m, terms, radius) - want).max(axis=0) == pytest.approx(np.zeros(D + 1), abs=5 * mt.TOL * scale.max())


def test_moments_have_a_bound():
    assert [mt.degree(d) for d in (1, 64, 300)] == [2, 2, 1]
