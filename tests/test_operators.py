"""Rankers, metrics, paths, splits and fits against brute force on small fixtures."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recset.operators import metrics as m, models as md, paths as pt, rankers as rk, splits as sp
from recset.streaming import streams as st


def scored_rows(seed=0):
    r = random.Random(seed)
    return [(0 if r.random() < 0.6 else r.randint(1, 6), i, float(r.randint(0, 12)), int(r.random() < 0.3)) for i in range(600)]


def by_unit(rows):
    out = {}
    for u, i, s, p in rows:
        out.setdefault(u, []).append((i, s, p))
    return out


def test_auc_loss_and_ap(spark):
    rows = scored_rows()
    d = spark.createDataFrame(rows, "unit int, item int, score double, pos int")
    auc = {r.unit: r for r in m.auc_and_loss(d).collect()}
    ap = {r.unit: r.ap for r in m.average_precision(d).collect()}
    for u, g in by_unit(rows).items():
        pos, neg = [s for _, s, p in g if p], [s for _, s, p in g if not p]
        loss = sum((a < b) + 0.5 * (a == b) for a in pos for b in neg)
        assert auc[u].loss == loss and auc[u].auc == pytest.approx(1 - loss / len(pos) / len(neg))
        want = sum(sum(1 for t in pos if t >= s) / sum(1 for t in pos + neg if t >= s) for s in pos) / len(pos)
        assert ap[u] == pytest.approx(want)


def test_group_topk_equals_full_grid(spark):
    r = random.Random(5)
    songs = [(f"a{r.randint(0, 14)}", i, float(r.randint(0, 6))) for i in range(300)]
    w = [(u, f"a{k}", r.choice([0.5, 1.0, 2.0])) for u in range(12) for k in range(15) if r.random() < 0.7]
    seen = [(u, s[1]) for u in range(12) for s in r.sample(songs, 3)]
    S = spark.createDataFrame(songs, "artist string, song int, base double")
    W = spark.createDataFrame(w, "unit int, artist string, w double")
    X = spark.createDataFrame(seen, "unit int, song int")
    got = {}
    for row in rk.group_topk(W, S, "unit", 10, 3, X).collect():
        got.setdefault(row.unit, []).append((row["rank"], row.song))
    for u in range(12):
        wu = {a: x for k, a, x in w if k == u}
        all_ = sorted((-round(wu[a] * b, 9), s) for a, s, b in songs if a in wu and wu[a] * b > 0 and (u, s) not in seen)
        assert [s for _, s in sorted(got[u])] == [s for _, s in all_[:10]]


def graph(m, seed):
    r = random.Random(seed)
    return [(a, b, r.randint(-50, 50)) for a in range(m) for b in range(m) if a != b]


def test_paths_against_enumeration(spark):
    M, L = 6, 4
    e = graph(M, 3)
    w = {(a, b): x for a, b, x in e}
    E = spark.createDataFrame(e, "src long, dst long, w long")
    starts = spark.createDataFrame([(k,) for k in range(M)], "start long")
    score = lambda p: sum(w[a, b] for a, b in zip(p, p[1:]))
    top = {}
    for r in pt.beam(starts, E, L, 1000).collect():
        top.setdefault((r.start, r.len), []).append((r["rank"], r.path, r.score))
    vit = {(r.start, r.len): (r.path, r.score) for r in pt.viterbi(starts, E, L).collect()}
    for s0 in range(M):
        for n in range(2, L + 1):
            free = sorted((-score(p), p) for q in itertools.permutations([k for k in range(M) if k != s0], n - 1) for p in [[s0, *q]])
            assert [p for _, p, _ in sorted(top[s0, n])] == [p for _, p in free]
            walks = [[s0, *q] for q in itertools.product([k for k in range(M) if k != s0], repeat=n - 1) if all(a != b for a, b in zip([s0, *q], q))]
            assert vit[s0, n][1] == max(score(p) for p in walks) == score(vit[s0, n][0])


def test_keep_diverse(spark):
    d = spark.createDataFrame([([[1, 2, 3], [1, 3, 2], [1, 2, 4], [1, 4, 2], [1, 3, 2]],)], "paths array<array<long>>")
    assert pt.keep_diverse(d).first().paths == [[1, 2, 3], [1, 2, 4], [1, 3, 2]]


def test_last_holders_keep_every_song(spark):
    r = random.Random(2)
    pairs = [(u, r.randint(0, 40)) for u in range(60) for _ in range(5)]
    d = spark.createDataFrame(pairs, "usr long, song long").distinct()
    stay = {x.usr for x in sp.last_holders(d, "usr", "song", "s").collect()}
    for s in {s for _, s in pairs}:
        assert any(u in stay for u, t in pairs if t == s)


def test_pairwise_hinge_equals_explicit_pairs(spark):
    r = random.Random(7)
    rows = [(0 if r.random() < 0.6 else r.randint(1, 3), i, int(r.random() < 0.4), [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(60)]
    d = spark.createDataFrame(rows, "qid int, id int, pos int, x array<double>")
    w, losses = md.hinge_rank_fit(d, 2, 2, 0.1, 0.01)

    def full(w):
        loss, g, n = 0.0, np.zeros(2), 0
        for q in {x[0] for x in rows}:
            P = [np.array(x[3]) for x in rows if x[0] == q and x[2]]
            N = [np.array(x[3]) for x in rows if x[0] == q and not x[2]]
            if not P or not N:
                continue
            n += 1
            for a in P:
                for b in N:
                    h = max(0.0, 1 - (a - b) @ w)
                    loss += h * h / len(P) / len(N)
                    g += -2 * h * (a - b) / len(P) / len(N)
        return loss / n + 0.005 * w @ w, g / n + 0.01 * w

    v = np.zeros(2)
    for k in range(2):
        loss, g = full(v)
        assert losses[k] == pytest.approx(loss)
        v = v - 0.1 * g
    assert np.allclose(v, w)


def test_dense_mf_objective_falls(spark):
    r = random.Random(1)
    cells = spark.createDataFrame(list({(r.randint(0, 30), r.randint(0, 20)) for _ in range(200)}), "song long, pid long")
    p, q, obj = md.dense_mf(cells, "song", "pid", 3, 4, 0.5)
    assert all(b <= a + 1e-9 for a, b in zip(obj, obj[1:]))
    Y = np.zeros((31, 21))
    for a, b in cells.collect():
        Y[a, b] = 1
    P, Q = np.zeros((31, 3)), np.zeros((21, 3))
    for x in p.collect():
        P[x.song] = x.vec
    for x in q.collect():
        Q[x.pid] = x.vec
    assert obj[-1] == pytest.approx(((Y - P @ Q.T) ** 2).sum() + 0.5 * ((P ** 2).sum() + (Q ** 2).sum()))


def test_multitask_gradient_by_differences(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(12, 2))
    lists = [(0, 0, [0, 3, 5]), (1, 0, [1, 2]), (2, 1, [7])]
    T = rng.normal(size=(3, 2)) * 0.3

    def risk(k, t):
        ix = lists[k][2]
        s = X @ t
        out = [j for j in range(12) if j not in ix]
        return (np.exp(-2 * s[ix]).mean() / 2 + np.exp(s[out]).mean()) / 3

    d = spark.createDataFrame([(p, u, [0.0, 0.0], T[k].tolist(), ix) for k, (p, u, ix) in enumerate(lists)], "pid long, usr long, w array<double>, t array<double>, ix array<int>")
    for r in md.list_gradients(spark, d, X, 2, 2.0, 3).collect():
        assert r.risk == pytest.approx(risk(r.pid, T[r.pid]))
        for i in range(2):
            e = np.eye(2)[i] * 1e-6
            assert r.g[i] == pytest.approx((risk(r.pid, T[r.pid] + e) - risk(r.pid, T[r.pid] - e)) / 2e-6, abs=1e-6)


def test_multitask_objective_falls(spark):
    rng = np.random.default_rng(1)
    songs = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(20)], "song long, x array<double>")
    r = random.Random(0)
    entries = spark.createDataFrame([(p, s) for p in range(6) for s in r.sample(range(20), 4)], "pid long, song long")
    lists = spark.createDataFrame([(p, p % 3) for p in range(6)], "pid long, usr long")
    *_, losses = md.mtc_fit(songs, entries, lists, 2, 1.0, 0.1, 0.001, 4, 0.1)
    assert all(b <= a for a, b in zip(losses, losses[1:]))


def test_stream_transitions_over_batches(spark, tmp_path):
    r = random.Random(4)
    rows, t = [], 0
    for i in range(300):
        t += r.choice([60, 600, 40000])
        rows.append((i, t, 0 if r.random() < 0.6 else r.randint(1, 4), r.choice("abc"), 1.0))
    for lo in range(0, 300, 100):
        d = spark.createDataFrame(rows[lo:lo + 100], "event_id long, t long, user_id long, event_type string, value double")
        d.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = st.run_batches(st.read_events(spark, str(tmp_path / "in"), per_trigger=1), "t", st.transition_batches())
    got = {(x.event_id, x.src, x.dst) for x in spark.read.option("recursiveFileLookup", True).parquet(f"{path}/pairs").collect()}
    # Pairs of the sessions that the watermark has closed.
    want, session, end, last = [], {}, {}, {}
    for i, t, u, a, _ in rows:
        if u in last and t - last[u][0] < 8 * 3600:
            want.append((i, last[u][1], a, (u, session[u])))
        else:
            session[u] = session.get(u, 0) + 1
        last[u], end[u, session[u]] = (t, a), t
    mark = max(r[1] for r in rows) - 600
    want = {(i, a, b) for i, a, b, k in want if end[k] + 8 * 3600 <= mark}
    assert got == want
