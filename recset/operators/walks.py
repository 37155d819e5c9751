"""Walks and loop-free paths over all POI of a city whose transitions depend on the classes of the POI.

A step from u to v weighs edge(class of u, class of v) + node(v), in whole micro-units, so sums are exact and ties are real.
The store holds class to class, and of every class the best POI by node weight; no pair of POI is ever formed. That is enough:
a path of at most L POI uses fewer than L of a class, so a POI behind the first L + k of its class can be replaced by k + 1
better ones, and no path with it is among the k best.

Starts and (start, length) queries are rows that Spark deals out; each task reads the broadcast store, whose size is bounded by
the number of classes and the length, not by the number of POI.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recset.operators import ordering as o

NONE = -(1 << 50)  # weight of a step that there is not; sums of a path's steps stay far above it
MICRO = 1_000_000
CELLS = 1 << 21  # (path, POI) cells that a task looks at together
WIDTH = 50  # of the beam that gives the first lower bound; it changes the time and never the result
DEALT = 3  # POI of the partial paths that are dealt out to tasks


@dataclass
class Store:
    """`edge` between classes; the POI in ascending order with their class and node weight; `index` of the class vectors."""

    index: dict[tuple, int]
    edge: np.ndarray
    poi: np.ndarray
    group: np.ndarray
    weight: np.ndarray

    def rests(self, longest: int, relief: np.ndarray | None) -> np.ndarray:
        """rest[r, g]: an upper bound for r more steps from class g without the POI's relief (a bonus by class that a loop-free
        path gets once for each POI): best walk over classes that does not turn back to a class of one POI."""
        n = len(self.edge)
        top = np.full(n, NONE)
        np.maximum.at(top, self.group, self.weight)
        gain = self.edge + (top if relief is None else -relief)[None, :]
        single = np.bincount(self.group, minlength=n) == 1
        out = np.zeros((longest + 1, n), np.int64)
        first, other = np.full(n, -1), out[0]
        for r in range(1, longest + 1):
            back = (first[None, :] == np.arange(n)[:, None]) & single[:, None]
            value = gain + np.where(back, other[None, :], out[r - 1][None, :])
            first = value.argmax(axis=1)
            out[r] = np.maximum(value.max(axis=1), NONE)
            value[np.arange(n), first] = NONE
            other = np.maximum(value.max(axis=1), NONE)
        return out


def edge_weights(vectors: np.ndarray, sizes: np.ndarray, tables: list[np.ndarray], share: float) -> np.ndarray:
    """share * log10 of the transition to one POI of a class, in micro-units. The product of the class tables is dealt out evenly
    over the POI of the class (without the POI itself), and a row adds up to one over all POI."""
    value = np.ones((len(sizes), len(sizes)))
    for k, t in enumerate(tables):
        value *= t[np.ix_(vectors[:, k], vectors[:, k])]
    same = np.eye(len(sizes), dtype=bool)
    alone = same & (sizes == 1)[:, None]
    total = np.where(alone, 0.0, value).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.log10(value / np.where(same, np.maximum(sizes - 1, 1)[:, None], sizes[None, :])) - np.log10(total)[:, None]
        out = np.rint(share * log * MICRO)
    return np.where(alone | ~np.isfinite(out), NONE, out).astype(np.int64)


def class_store(vecs: DataFrame, tables: DataFrame, nodes: DataFrame, kinds: list[str], share: float, keep: int) -> Store:
    """vecs(poi, classes...), tables(kind, c1, c2, p), nodes(poi, weight long): the first `keep` POI of every class go in."""
    text = vecs.select("poi", *[F.col(k).cast("string").alias(k) for k in kinds])
    groups = text.groupBy(*kinds).agg(F.count("*").alias("size")).orderBy(*kinds).collect()
    index = {tuple(r[k] for k in kinds): i for i, r in enumerate(groups)}
    cells = tables.collect()
    names = [sorted({r.c1 for r in cells if r.kind == k} | {r.c2 for r in cells if r.kind == k}) for k in kinds]
    place = [{c: i for i, c in enumerate(n)} for n in names]
    mats = [np.zeros((len(n), len(n))) for n in names]
    for r in cells:
        k = kinds.index(r.kind)
        mats[k][place[k][r.c1], place[k][r.c2]] = r.p
    vectors = np.array([[place[j][r[k]] for j, k in enumerate(kinds)] for r in groups], np.int64).reshape(len(groups), len(kinds))
    edge = edge_weights(vectors, np.array([r["size"] for r in groups], np.int64), mats, share)
    best = o.top_k(text.join(nodes, "poi"), kinds, [F.desc("weight"), "poi"], keep).orderBy("poi").collect()
    return Store(index, edge, np.array([r.poi for r in best], np.int64), np.array([index[tuple(r[k] for k in kinds)] for r in best], np.int64),
                 np.array([r.weight for r in best], np.int64))


def starts_with_classes(queries: DataFrame, vecs: DataFrame, kinds: list[str]) -> DataFrame:
    """(start, cls, lens) of queries(start, len)."""
    cls = vecs.select(F.col("poi").alias("start"), F.array(*[F.col(k).cast("string") for k in kinds]).alias("cls"))
    return queries.groupBy("start").agg(F.sort_array(F.collect_set("len")).alias("lens")).join(cls, "start")


def best_walks(store: Store, start: int, group: int, longest: int) -> Iterator[tuple[int, list[int], int]]:
    """(length, path, score) of the best walk of every length that never comes back to the start and never stays; ties go to the
    first path in order. Of a class only its three best POI without the start can end one of its two best walks."""
    first = np.lexsort((store.poi, -store.weight, store.group))
    first = first[store.poi[first] != start]
    nth = np.arange(len(first)) - np.searchsorted(store.group[first], store.group[first])
    own = np.sort(first[nth < 3])
    if not len(own):
        return
    poi, g, w = store.poi[own], store.group[own], store.weight[own]
    score, came = store.edge[group][g] + w, []
    order = np.arange(len(own))  # states in the order of their paths
    for n in range(2, longest + 1):
        ok = score > NONE // 2
        if not ok.any():
            return
        end = order[np.argmax(score[order])]
        path, at = [int(poi[end])], end
        for back in reversed(came):
            at = back[at]
            path.append(int(poi[at]))
        yield n, [start, *reversed(path)], int(score[end])
        step = np.where(ok[order], score[order], NONE)[:, None] + store.edge[g[order]]  # by path order, so the first of equals wins
        best = step.argmax(axis=0)
        top = step[best, np.arange(step.shape[1])]
        step[best, np.arange(step.shape[1])] = NONE
        second = step.argmax(axis=0)
        stays = order[best[g]] == np.arange(len(own))
        row = np.where(stays, second[g], best[g])
        score = np.maximum(np.where(stays, step[second[g], g], top[g]) + w, NONE)
        came.append(order[row])
        order = np.lexsort((poi, row))


def best_greedy(store: Store, start: int, group: int, longest: int) -> Iterator[tuple[int, list[int], int]]:
    """(length, path, score) of the path that goes on to the best unused POI, the smallest of equals."""
    free = store.poi != start
    path, score = [start], 0
    for n in range(2, longest + 1):
        step = np.where(free, store.edge[group][store.group] + store.weight, NONE)
        if not len(step) or step.max() <= NONE // 2:
            return
        v = int(step.argmax())
        free[v], group = False, store.group[v]
        path, score = [*path, int(store.poi[v])], score + int(step[v])
        yield n, path, score


def each_length(starts: DataFrame, store: Store, rule) -> DataFrame:
    """(start, len, path, score) by one of the two rules above, for the lengths that each start asks for."""
    known = starts.sparkSession.sparkContext.broadcast(store)

    def run(batches):
        for b in batches:
            out = []
            for start, cls, lens in zip(b["start"], b["cls"], b["lens"]):
                asked = set(lens)
                found = rule(known.value, int(start), known.value.index[tuple(cls)], int(max(asked)))
                out += [(start, n, path, score) for n, path, score in found if n in asked]
            yield pd.DataFrame(out, columns=["start", "len", "path", "score"])

    return starts.mapInPandas(run, "start long, len long, path array<long>, score long")


class Search:
    """The k best loop-free paths of one start and length: partial paths are extended by blocks, and one is dropped only if its
    score and an upper bound of the rest stay below the score of k known paths, so that it cannot be among them.

    Three bounds: the best walk over classes, and twice the same on weights reduced by a bonus of each POI (its node weight, and its
    best step from anywhere) plus the best bonuses of unused POI, each counted once.
    """

    def __init__(self, store: Store, longest: int):
        self.store = store
        inward = np.full(len(store.edge), NONE)
        np.maximum.at(inward, np.arange(len(store.edge)), store.edge.max(axis=0, initial=NONE))
        zero = np.zeros(len(store.edge), np.int64)
        self.plain = store.rests(longest, None)
        # A class's relief is what its POI get beyond their node weight.
        self.bonus = []
        for relief in (inward, zero):
            value = relief[store.group] + store.weight
            self.bonus.append((store.rests(longest, relief), value, np.argsort(-value, kind="stable")))

    def _steps(self, start: int, group: int, paths: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.store
        used = np.zeros((len(scores), len(s.poi)), bool)
        used[:, s.poi == start] = True
        used[np.arange(len(scores))[:, None], paths] = True
        last = s.group[paths[:, -1]] if paths.shape[1] else np.full(len(scores), group)
        return np.where(used, NONE, scores[:, None] + s.edge[last][:, s.group] + s.weight), used

    def lower_bound(self, start: int, group: int, length: int, k: int) -> int:
        """Score of the k-th path that a beam finds, or a number below all scores."""
        paths, scores = np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
        for _ in range(length - 1):
            total, _ = self._steps(start, group, paths, scores)
            i, v = np.nonzero(total > NONE // 2)
            best = np.argsort(-total[i, v], kind="stable")[: max(k, WIDTH)]
            paths, scores = np.column_stack([paths[i[best]], v[best]]), total[i[best], v[best]]
        return int(scores[k - 1]) if len(scores) >= k else NONE

    def extend(self, start: int, group: int, length: int, k: int, low: int, paths: np.ndarray, scores: np.ndarray, upto: int):
        """Paths (places in the store, without the start) and scores with `upto` POI; the k best if that is the whole length."""
        s = self.store
        held, done, step = [(paths, scores)], [(np.zeros((0, upto - 1), np.int64), np.zeros(0, np.int64))], max(1, CELLS // max(1, len(s.poi)))
        while held:
            paths, scores = held.pop()
            if paths.shape[1] + 1 == upto:
                done.append((paths, scores))
                if upto == length:
                    done = [_first(done, k)]
                    low = max(low, int(done[0][1][-1])) if len(done[0][1]) == k else low
                continue
            if len(scores) > step:
                held += [(paths[a : a + step], scores[a : a + step]) for a in range(0, len(scores), step)][::-1]
                continue
            total, used = self._steps(start, group, paths, scores)
            rest = length - paths.shape[1] - 2
            ok = total > NONE // 2
            i, v = np.nonzero(ok & (total + self.plain[rest][s.group] >= low))
            score = total[i, v]
            for rests, bonus, order in self.bonus if rest else ():
                first = order[: 2 * length]
                free = ~used[i][:, first] & (first[None, :] != v[:, None])
                nth = np.cumsum(free, axis=1)
                most = np.where(free & (nth <= rest), bonus[first], 0).sum(axis=1)
                ok = (nth[:, -1] >= rest) & (score + rests[rest][s.group[v]] + most >= low)
                i, v, score = i[ok], v[ok], score[ok]
            if len(score):
                held.append((np.column_stack([paths[i], v]), score))
        return _first(done, k if upto == length else None)


def _first(parts: list[tuple[np.ndarray, np.ndarray]], k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Paths by falling score, then in order (places follow the POI)."""
    paths, scores = np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])
    if k is None:
        return paths, scores
    best = np.lexsort((*paths.T[::-1], -scores))[:k]
    return paths[best], scores[best]


def top_paths(starts: DataFrame, store: Store, longest: int, k: int) -> DataFrame:
    """(start, len, rank, path, score): the `k` best loop-free paths of every asked length, exactly.

    Partial paths of DEALT POI are dealt out again, so a start with a hard search is spread over tasks; every task returns at most
    k paths of a query and batch.
    """
    known = starts.sparkSession.sparkContext.broadcast((store, longest))
    kept: dict = {}

    def search() -> Search:
        if not kept:
            kept[0] = Search(*known.value)
        return kept[0]

    def open_paths(batches):
        for b in batches:
            out = []
            for start, cls, n in zip(b["start"], b["cls"], b["len"]):
                s, g = search(), known.value[0].index[tuple(cls)]
                low = s.lower_bound(int(start), g, int(n), k)
                p, scores = s.extend(int(start), g, int(n), k, low, np.zeros((1, 0), np.int64), np.zeros(1, np.int64), min(int(n), DEALT))
                out += [(start, n, g, low, path.tolist(), score) for path, score in zip(p, scores.tolist())]
            yield pd.DataFrame(out, columns=["start", "len", "grp", "low", "path", "score"])

    def close_paths(batches):
        for b in batches:
            out = []
            for (start, n, g, low), part in b.groupby(["start", "len", "grp", "low"]):
                s = search()
                paths = np.array(part["path"].tolist(), np.int64).reshape(len(part), -1)
                p, scores = s.extend(int(start), int(g), int(n), k, int(low), paths, part["score"].to_numpy(), int(n))
                out += [(start, n, [start, *path], score) for path, score in zip(s.store.poi[p].tolist(), scores.tolist())]
            yield pd.DataFrame(out, columns=["start", "len", "path", "score"])

    one = starts.select("start", "cls", F.explode("lens").alias("len")).repartition("start", "len")
    partial = one.mapInPandas(open_paths, "start long, len long, grp int, low long, path array<long>, score long")
    closed = partial.repartition("start", "len", "path").mapInPandas(close_paths, "start long, len long, path array<long>, score long")
    return o.top_k(closed, ["start", "len"], [F.desc("score"), "path"], k)
