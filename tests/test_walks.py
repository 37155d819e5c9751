"""Walks and paths over a class store against enumeration over POI pairs."""
import itertools
import random

import numpy as np
import pytest

from recset.operators import walks as wk

KINDS = ["cat", "zone"]


def city(spark, n, seed, keep, cats="ab", zones="xyz"):
    """A store, its DataFrames, and the weight of every step between POI, computed pair by pair."""
    rng = random.Random(seed)
    vecs = [(i * 7 % 101, rng.choice(cats), rng.choice(zones)) for i in range(n)]
    tables = []
    for kind, names in zip(KINDS, (cats, zones)):
        for a in names:
            p = [rng.random() + 0.1 for _ in names]
            tables += [(kind, a, b, x / sum(p)) for b, x in zip(names, p)]
    nodes = [(v[0], -rng.choice([300_000, 350_000, 400_000, 420_000])) for v in vecs]
    frames = (spark.createDataFrame(vecs, "poi long, cat string, zone string"), spark.createDataFrame(tables, "kind string, c1 string, c2 string, p double"),
              spark.createDataFrame(nodes, "poi long, weight long"))
    prob, size = {(k, a, b): p for k, a, b, p in tables}, {}
    for _, a, b in vecs:
        size[a, b] = size.get((a, b), 0) + 1
    value = {(u[0], v[0]): prob["cat", u[1], v[1]] * prob["zone", u[2], v[2]] / (size[v[1:]] - (u[1:] == v[1:]))
             for u in vecs for v in vecs if u[0] != v[0]}
    total = {u[0]: sum(x for (a, _), x in value.items() if a == u[0]) for u in vecs}
    node = dict(nodes)
    step = {(a, b): node[b] + round(0.5e6 * np.log10(x / total[a])) for (a, b), x in value.items()}
    return wk.class_store(*frames, KINDS, 0.5, keep), frames[0], step, [v[0] for v in vecs]


def found(df):
    return {(r.start, r.len, r["rank"], tuple(r.path), r.score) for r in df.collect()}


def asked(spark, pois, lens):
    return spark.createDataFrame([(s, n) for s in pois for n in lens], "start long, len long")


@pytest.mark.parametrize("n, seed", [(7, 1), (8, 2), (9, 3)])
def test_against_enumeration(spark, n, seed):
    k, lens = 6, [2, 3, 5]
    store, vecs, step, pois = city(spark, n, seed, max(lens) + k)
    starts = wk.starts_with_classes(asked(spark, pois, lens), vecs, KINDS)
    score = lambda p: sum(step[e] for e in zip(p, p[1:]))
    top = {}
    for r in wk.top_paths(starts, store, max(lens), k).collect():
        top.setdefault((r.start, r.len), []).append((r["rank"], r.path, r.score))
    walks = {(r.start, r.len): (r.path, r.score) for r in wk.each_length(starts, store, wk.best_walks).collect()}
    greedy = {(r.start, r.len): (r.path, r.score) for r in wk.each_length(starts, store, wk.best_greedy).collect()}
    for s in pois:
        rest = [p for p in pois if p != s]
        for m in lens:
            paths = sorted((-score(p), p) for q in itertools.permutations(rest, m - 1) for p in [[s, *q]])[:k]
            assert sorted(top[s, m]) == [(i + 1, p, -x) for i, (x, p) in enumerate(paths)]
            every = ([s, *q] for q in itertools.product(rest, repeat=m - 1))
            best = min((-score(p), p) for p in every if all(a != b for a, b in zip(p, p[1:])))
            assert walks[s, m] == (best[1], -best[0])
            path = [s]
            while len(path) < m:
                path.append(min((-step[path[-1], v], v) for v in rest if v not in path)[1])
            assert greedy[s, m] == (path, score(path))


def test_few_of_a_class_are_enough(spark):
    """Ninety POI in four classes: the store holds the first of each class, the result is that of all of them."""
    k, n = 5, 4
    store, vecs, step, pois = city(spark, 90, 5, n + k, cats="ab", zones="xy")
    assert len(store.poi) == 4 * (n + k) < len(pois)
    outside = [p for p in pois if p not in store.poi][:2]
    starts = wk.starts_with_classes(asked(spark, outside, [n]), vecs, KINDS)
    whole = wk.Store(store.index, *_all_of(store, vecs, step, pois))
    assert found(wk.top_paths(starts, store, n, k)) == found(wk.top_paths(starts, whole, n, k))
    for r in wk.each_length(starts, store, wk.best_walks).collect():
        assert r.score == sum(step[e] for e in zip(r.path, r.path[1:]))
        state = {r.start: 0}
        for _ in range(n - 1):
            state = {v: max(x + step[u, v] for u, x in state.items() if u != v) for v in pois if v != r.start}
        assert r.score == max(state.values())


def _all_of(store, vecs, step, pois):
    rows = sorted((r.poi, store.index[r.cat, r.zone]) for r in vecs.collect())
    weight = []
    for p, g in rows:
        u = next(q for q in pois if q != p)
        own = store.index[tuple(vecs.filter(f"poi = {u}").select(*KINDS).first())]
        weight.append(step[u, p] - int(store.edge[own, g]))
    return store.edge, np.array([p for p, _ in rows]), np.array([g for _, g in rows]), np.array(weight)


def test_blocks_and_odd_cities(spark, monkeypatch):
    store, vecs, step, pois = city(spark, 9, 4, 12)
    starts = wk.starts_with_classes(asked(spark, pois[:3], [5, 6]), vecs, KINDS)
    want = found(wk.top_paths(starts, store, 6, 7))
    s = wk.Search(store, 6)
    group = store.index[tuple(vecs.filter(f"poi = {pois[0]}").select(*KINDS).first())]
    monkeypatch.setattr(wk, "CELLS", 40)  # blocks of a few paths
    paths, scores = s.extend(pois[0], group, 6, 7, wk.NONE, np.zeros((1, 0), np.int64), np.zeros(1, np.int64), 6)
    got = {(pois[0], 6, i + 1, (pois[0], *store.poi[p].tolist()), x) for i, (p, x) in enumerate(zip(paths, scores.tolist()))}
    assert got == {r for r in want if r[:2] == (pois[0], 6)}
    # longer than there are POI: no path; a single POI: no step at all
    tiny, v1, _, own = city(spark, 3, 1, 12)
    got = wk.top_paths(wk.starts_with_classes(asked(spark, own, [3, 4]), v1, KINDS), tiny, 4, 10).collect()
    assert {r.len for r in got} == {3} and len(got) == 6
    one, v2, _, own = city(spark, 1, 1, 12, cats="a", zones="x")
    starts = wk.starts_with_classes(asked(spark, own, [2]), v2, KINDS)
    assert wk.top_paths(starts, one, 2, 10).count() == wk.each_length(starts, one, wk.best_walks).count() == wk.each_length(starts, one, wk.best_greedy).count() == 0
