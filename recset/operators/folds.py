"""Statistics, candidates and fits with a fold held out, for all folds at once.

A fold is a set of queries; its trajectories take no part in the POI statistics, the candidates, the scaling or the fit that
score its queries. Statistics of the rest are the whole minus the fold's own share, so nothing is counted again for each fold. Fits
take one job a step for all folds: tasks add up small sums by fold, and the driver holds a few numbers of each fold.
"""
from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recset.functions import columns as c
from recset.operators import ordering as o
from recset.session import cut


def left_out_info(visits: DataFrame, folds: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(fold, poi, ...) with dur, nvisit and pop (distinct users) of visits(traj, poi, usr, duration) without the trajectories of
    the fold in folds(traj, fold). Keys that nothing is left of go. A user is lost to a POI if all of its visits are the fold's."""
    each = cut(visits.join(folds, "traj", "left").groupBy("poi", "usr", "fold").agg(F.sum("duration").alias("d"), F.count("*").alias("n")), "folds")
    user = each.groupBy("poi", "usr").agg(F.sum("n").alias("n_all"), F.sum("d").alias("d"))
    whole = user.groupBy("poi").agg(F.sum("n_all").alias("n"), F.sum("d").alias("d"), F.count("*").alias("pop"))
    own = each.filter("fold IS NOT NULL").join(user.select("poi", "usr", "n_all"), ["poi", "usr"]).groupBy("fold", "poi").agg(
        F.sum("n").alias("n_own"), F.sum("d").alias("d_own"), F.sum((F.col("n") == F.col("n_all")).cast("long")).alias("lost"))
    rows = keys.join(whole, "poi").join(own, ["fold", "poi"], "left").fillna(0, ["n_own", "d_own", "lost"]).filter("n > n_own")
    return rows.select(*keys.columns, ((F.col("d") - F.col("d_own")) / (F.col("n") - F.col("n_own"))).alias("dur"),
                       (F.col("n") - F.col("n_own")).alias("nvisit"), (F.col("pop") - F.col("lost")).alias("pop"))


def left_out_grid(queries: DataFrame, visits: DataFrame, trajs: DataFrame, folds: DataFrame) -> DataFrame:
    """queries(fold, start, ...) with every POI that a trajectory with the start visits, the fold's trajectories left out."""
    seen = cut(visits.select("traj", "poi").join(trajs.select("traj", "start"), "traj").join(folds, "traj", "left")
               .groupBy("start", "poi", "fold").agg(F.count("*").alias("k")), "folds")
    whole = seen.groupBy("start", "poi").agg(F.sum("k").alias("k_all"))
    own = seen.filter("fold IS NOT NULL")
    rows = queries.join(whole, "start").join(own, ["fold", "start", "poi"], "left")
    return rows.filter(F.col("k_all") > F.coalesce("k", F.lit(0))).drop("k", "k_all")


def left_out_sums(visits: DataFrame, folds: DataFrame, keys: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """keys(fold, poi) with additive aggregates of the visits that the fold does not hold."""
    each = cut(visits.join(folds, "traj", "left").groupBy("poi", "fold").agg(*[x.alias(n) for n, x in parts.items()]), "folds")
    whole = each.groupBy("poi").agg(*[F.sum(n).alias(f"_{n}") for n in parts])
    rows = keys.join(whole, "poi").join(each.filter("fold IS NOT NULL"), ["fold", "poi"], "left")
    return rows.select("fold", "poi", *[(F.col(f"_{n}") - F.coalesce(n, F.lit(0))).alias(n) for n in parts])


def left_out_percentiles(visits: DataFrame, folds: DataFrame, keys: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """keys(fold, poi) with count, sum and percentiles of a column over the visits that the fold does not hold; from counts of
    distinct values, of which the fold's own are taken off."""
    each = cut(visits.filter(F.col(value).isNotNull()).join(folds, "traj", "left").groupBy("poi", value, "fold").agg(F.count("*").alias("k")), "folds")
    whole = each.groupBy("poi", value).agg(F.sum("k").alias("k_all"))
    rows = keys.join(whole, "poi").join(each.filter("fold IS NOT NULL"), ["fold", "poi", value], "left")
    rows = rows.select("fold", "poi", value, (F.col("k_all") - F.coalesce("k", F.lit(0))).alias("n")).filter("n > 0")
    return o.percentiles(rows, ["fold", "poi"], value, qs, "n")


def sums(rows: DataFrame, fn: Callable[[int, pd.DataFrame], np.ndarray]) -> dict[int, np.ndarray]:
    """fn(fold, rows of the fold) gives an array of numbers for a batch; their sums by fold. Tasks add up batches first."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, part in b.groupby("fold"):
                v = fn(int(fold), part)
                held[int(fold)] = held[int(fold)] + v if int(fold) in held else v
        for fold, v in held.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(len(v)), "v": v})

    out: dict[int, dict] = {}
    for r in rows.mapInPandas(run, "fold long, i long, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r.fold, {})[r.i] = r.v
    return {f: np.array([v[i] for i in range(len(v))]) for f, v in out.items()}


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def gram(rows: DataFrame) -> dict[int, np.ndarray]:
    """Z'Z by fold for Z = (1, x, y) of rows(fold, x, y)."""

    def fn(_, part):
        z = np.column_stack([np.ones(len(part)), matrix(part["x"]), part["y"].to_numpy(float)])
        return (z.T @ z).reshape(-1)

    return {f: v.reshape(int(len(v) ** 0.5), -1) for f, v in sums(rows.select("fold", "x", "y"), fn).items()}


def scales(grams: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every slot of x by fold; 1 for a slot that does not vary."""
    out = {}
    for f, g in grams.items():
        mean = g[0, 1:-1] / g[0, 0]
        var = np.maximum(np.diag(g)[1:-1] / g[0, 0] - mean**2, 0.0)
        sd = np.sqrt(var)
        out[f] = mean, np.where(sd > 1e-9 * np.maximum(1, np.abs(mean)), sd, 1.0)
    return out


def ridge(grams: dict[int, np.ndarray], reg: float) -> dict[int, tuple[np.ndarray, float]]:
    """Weights and intercept by fold: least squares on standardised slots plus reg |w|^2 / 2 against half the mean square, from the
    normal equations."""
    out = {}
    for f, (mean, sd) in scales(grams).items():
        g, n = grams[f], grams[f][0, 0]
        cov = (g[1:-1, 1:-1] / n - np.outer(mean, mean)) / np.outer(sd, sd)
        y = g[0, -1] / n
        w = np.linalg.solve(cov + reg * np.eye(len(sd)), (g[1:-1, -1] / n - mean * y) / sd) / sd
        out[f] = w, float(y - w @ mean)
    return out


def logistic(rows: DataFrame, grams: dict[int, np.ndarray], reg: float, tol: float = 1e-8) -> dict[int, tuple[np.ndarray, float]]:
    """Weights and intercept by fold: mean logistic loss of y (0/1) on standardised slots plus reg |w|^2 / 2, by Newton steps until no
    fold's loss falls by more than `tol`. A step that raises a fold's loss is halved."""
    scale = scales(grams)
    at = {f: np.zeros(len(m) + 1) for f, (m, _) in scale.items()}
    step = {f: np.zeros_like(v) for f, v in at.items()}
    best: dict[int, float] = {}
    rows = rows.select("fold", "x", "y")
    going = set(at)
    while going:
        trial = {f: at[f] + step[f] for f in going}
        known = rows.sparkSession.sparkContext.broadcast({f: (trial[f], *scale[f]) for f in going})

        def fn(fold, part):
            w, mean, sd = known.value[fold]
            z = np.column_stack([np.ones(len(part)), (matrix(part["x"]) - mean) / sd])
            y, s = part["y"].to_numpy(float), z @ w
            p = 1 / (1 + np.exp(-s))
            return np.concatenate([[(np.logaddexp(0, s) - y * s).sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).reshape(-1)])

        found = sums(rows.filter(F.col("fold").isin([int(f) for f in going])), fn)
        known.unpersist()
        for f in sorted(going):
            n, d = grams[f][0, 0], len(at[f])
            norm = np.concatenate([[0.0], np.full(d - 1, reg)])
            loss = found[f][0] / n + 0.5 * (norm * trial[f] ** 2).sum()
            if f in best and loss > best[f]:
                step[f] = step[f] / 2
                if np.abs(step[f]).max() < 1e-9:
                    going.discard(f)
                continue
            gain = best.get(f, np.inf) - loss
            best[f], at[f] = loss, trial[f]
            g = found[f][1 : d + 1] / n + norm * at[f]
            step[f] = -np.linalg.solve(found[f][d + 1 :].reshape(d, d) / n + np.diag(norm) + 1e-12 * np.eye(d), g)
            if gain < tol:
                going.discard(f)
    return {f: (v[1:] / scale[f][1], float(v[0] - (v[1:] / scale[f][1]) @ scale[f][0])) for f, v in at.items()}


def scored(rows: DataFrame, weights: dict[int, tuple[np.ndarray, float]], x: str = "x", out: str = "score") -> DataFrame:
    """x . w + b with the weights of the row's fold; rows of a fold without weights go."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(f), [float(v) for v in w], float(b)) for f, (w, b) in weights.items()], "fold long, _w array<double>, _b double")
    return rows.join(F.broadcast(table), "fold").withColumn(out, c.dot(F.col(x), F.col("_w")) + F.col("_b")).drop("_w", "_b")  # a row a fold


def descent(value: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], zero: dict[int, np.ndarray], rate: float, tol: float) -> tuple[dict, dict]:
    """Gradient steps for all folds together until each fold's loss falls by less than `tol` of its first value. Steps follow the
    curvature seen in the last one; a step that raises the loss is taken back and tried at a quarter of its length, so losses
    never rise. Returns weights and losses by fold."""
    w = dict(zero)
    found = value(w)
    loss, g = {f: v[0] for f, v in found.items()}, {f: v[1] for f, v in found.items()}
    w = {f: w[f] for f in found}
    losses, rates = {f: [v] for f, v in loss.items()}, {f: rate for f in w}
    done = lambda f: not (loss[f] > 0 and rates[f] * float(g[f] @ g[f]) > 1e-12 * losses[f][0])
    going = {f for f in w if not done(f)}
    while going:
        to = {f: w[f] - rates[f] * g[f] for f in going}
        found = value(to)
        for f in sorted(going):
            low, grad = found[f]
            if low > loss[f]:
                rates[f] /= 4
            else:
                step, turn, gain = to[f] - w[f], grad - g[f], loss[f] - low
                w[f], loss[f], g[f] = to[f], low, grad
                losses[f].append(low)
                if step @ turn > 0:
                    rates[f] = float(step @ step / (step @ turn))
                if gain < tol * losses[f][0]:
                    going.discard(f)
            if done(f):
                going.discard(f)
    return w, losses


def pair_rows(rows: DataFrame) -> DataFrame:
    """rows(fold, qid, id, pos, x) of queries with both classes, each pair of a query with weight 1 / pairs, each query of a fold with
    the same weight; written once for all steps."""
    n = rows.groupBy("fold", "qid").agg(F.sum("pos").alias("np"), F.sum(1 - F.col("pos")).alias("nn")).filter("np > 0 and nn > 0")
    q = n.groupBy("fold").agg(F.count("*").alias("queries"))
    return cut(rows.join(n, ["fold", "qid"]).join(q, "fold").withColumn("wt", 1.0 / (F.col("np") * F.col("nn") * F.col("queries"))).drop("np", "nn", "queries"), "rank")


def with_scores(base: DataFrame, w: dict[int, np.ndarray]) -> DataFrame:
    return scored(base, {f: (v, 0.0) for f, v in w.items()}, out="s")


def slopes(rows: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient by fold of rows with `loss` and the derivative `gs` by the row's score."""
    t = rows.groupBy("fold").agg(F.sum("loss").alias("loss"), *[F.sum(F.col("gs") * F.get("x", i)).alias(f"g{i}") for i in range(d)]).collect()
    return {r.fold: (r["loss"], np.array([r[f"g{i}"] for i in range(d)])) for r in t}


def hinge_slopes(r: DataFrame) -> DataFrame:
    """`loss` and `gs` of the squared hinge max(0, 1 - (s+ - s-))^2 over all pairs of a query, by running sums on one axis (see
    models.hinge_rank_value): negatives at s, positives at s - 1."""
    r = r.withColumn("at", F.col("s") - F.col("pos")).withColumn("k", F.floor(F.col("at") * 64).cast("long"))
    side = lambda p: F.when(F.col("pos") == p, 1.0).otherwise(0.0)
    unit, s = ["fold", "qid"], F.col("s")
    up = o.running(r, unit, [F.desc("at"), "pos", "id"], -F.col("k"), {"c0": side(0), "s0": side(0) * s, "q0": side(0) * s * s})
    both = o.running(up, unit, ["at", F.desc("pos"), "id"], F.col("k"), {"c1": side(1), "s1": side(1) * s})
    g = F.when(F.col("pos") == 1, -(F.col("c0") * (1 - s) + F.col("s0"))).otherwise(F.col("c1") * (1 + s) - F.col("s1"))
    loss = F.when(F.col("pos") == 1, F.col("c0") * (1 - s) * (1 - s) + 2 * (1 - s) * F.col("s0") + F.col("q0")).otherwise(0.0)
    return both.withColumn("gs", 2 * g * F.col("wt")).withColumn("loss", loss * F.col("wt"))


# Pair sums of log(1 + exp(-(s+ - s-))) without pairs: scores in cells of width CELL, and around a pair of cell centres a series in
# the differences from them. With z = s+ - s- = x + e and |e| <= CELL, the coefficients of the derivative are at most 7.1 / 3^m (the
# largest value on a circle of radius 3, inside the first pole at pi), so ORDER terms leave less than 7.1 (CELL / 3)^ORDER * 1.2
# = 2e-11 for each pair. From FAR on the loss is linear or nothing, but for exp(-FAR) = 4e-18.
CELL, ORDER, FAR = 0.5, 15, 40.0


def series(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of log(1 + exp(-(x + e))) and of its derivative in powers of e."""
    with np.errstate(over="ignore"):
        up = np.empty((len(x), ORDER))  # of 1 / (1 + exp(-(x + e))), from s' = s - s^2
        up[:, 0] = 1 / (1 + np.exp(-x))
    for m in range(ORDER - 1):
        up[:, m + 1] = (up[:, m] - (up[:, : m + 1] * up[:, m::-1]).sum(axis=1)) / (m + 1)
    slope = up.copy()
    slope[:, 0] = -1 / (1 + np.exp(np.minimum(x, 700)))
    value = np.empty((len(x), ORDER))
    value[:, 0] = np.logaddexp(0, -x)
    value[:, 1:] = slope[:, :-1] / np.arange(1, ORDER)
    return value, slope


def _expand(x: np.ndarray, moments: np.ndarray, sign: float) -> np.ndarray:
    """Polynomials in u of the sum over the other side's v (by their moments): value and slope of the loss at x + sign (u - v)."""
    out = []
    for coef in series(x):
        p = np.zeros((len(x), ORDER))
        for m in range(ORDER):
            for k in range(m + 1):
                p[:, k] += coef[:, m] * sign**m * comb(m, k) * (-1.0) ** (m - k) * moments[:, m - k]
        out.append(p)
    return np.hstack(out)


def logistic_slopes(r: DataFrame, unit: list[str]) -> DataFrame:
    """`loss` and `gs` (weighted by wt) of the logistic loss over all pairs of a unit, for rows with s, pos and wt. Rows meet cells,
    cells meet near cells, and what is far comes from running sums over cells; no pair of rows is formed."""
    r = cut(r.withColumn("cell", F.round(F.col("s") / CELL).cast("long")).withColumn("u", F.col("s") - F.col("cell") * CELL), "pairs")
    power = lambda k: F.pow(F.col("u"), F.lit(k))
    cells = cut(r.groupBy(*unit, "pos", "cell").agg(F.array(*[F.sum(power(k)) for k in range(ORDER)]).alias("moments")), "pairs")
    centre, wide = F.col("cell") * CELL, int(FAR / CELL)
    first, second = F.get("moments", 0), F.get("moments", 0) * centre + F.get("moments", 1)
    # Far negatives lie above a positive, far positives below a negative.
    axis = W.partitionBy(*unit).orderBy("cell")
    side = lambda p, col: F.sum(F.when(F.col("pos") == p, col).otherwise(0.0))
    above, below = axis.rangeBetween(wide + 1, W.unboundedFollowing), axis.rangeBetween(W.unboundedPreceding, -wide - 1)
    far = cells.select(*unit, "pos", "cell", *[F.coalesce(F.when(F.col("pos") == 1, side(0, x).over(above)).otherwise(side(1, x).over(below)), F.lit(0.0)).alias(n)
                                               for n, x in (("far_n", first), ("far_s", second))])
    # Near cells of the other side: blocks of cells, each met by its own and the two beside it.
    block = F.floor(F.col("cell") / wide)
    me = cells.select(*unit, "pos", "cell", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    other = cells.select(*unit, (1 - F.col("pos")).alias("pos"), F.col("cell").alias("cell2"), block.alias("block"), "moments")
    near = me.join(other, [*unit, "pos", "block"]).filter(F.abs(F.col("cell") - F.col("cell2")) <= wide).select(*unit, "pos", "cell", "cell2", "moments")
    kinds = {f.name: f.dataType.simpleString() for f in near.schema}

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            sign = np.where(b["pos"] == 1, 1.0, -1.0)
            x, moments = sign * (b["cell"] - b["cell2"]).to_numpy(float) * CELL, matrix(b["moments"])
            p = np.zeros((len(b), 2 * ORDER))
            for v in (1.0, -1.0):
                k = np.flatnonzero(sign == v)
                p[k] = _expand(x[k], moments[k], v)
            yield b[[*unit, "pos", "cell"]].assign(p=list(p))

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*unit, "pos", "cell"]) + ", p array<double>"
    poly = near.mapInPandas(run, schema).groupBy(*unit, "pos", "cell").agg(F.array(*[F.sum(F.get("p", i)) for i in range(2 * ORDER)]).alias("p"))
    polys = far.join(poly, [*unit, "pos", "cell"], "left")
    horner = lambda part: F.coalesce(F.aggregate(F.reverse(F.slice("p", part * ORDER + 1, ORDER)), F.lit(0.0), lambda a, x: a * F.col("u") + x), F.lit(0.0))
    one = F.col("pos") == 1
    loss = F.when(one, horner(0) + F.col("far_s") - F.col("far_n") * F.col("s")).otherwise(0.0)
    # The slope by the score of a negative is that by the difference, turned round.
    slope = F.when(one, horner(1) - F.col("far_n")).otherwise(F.col("far_n") - horner(1))
    return r.join(polys, [*unit, "pos", "cell"]).withColumn("loss", loss * F.col("wt")).withColumn("gs", slope * F.col("wt")).drop("p", "far_n", "far_s", "cell", "u")


def pair_fit(rows: DataFrame, scale: dict[int, tuple[np.ndarray, np.ndarray]], kind: str, rate: float, reg: float, tol: float = 1e-3) -> tuple[dict, dict]:
    """Linear ranking of rows(fold, qid, id, pos, x) on standardised slots: mean over queries of the mean pair loss (`hinge`, squared, or
    `logistic`) plus reg |w|^2 / 2. Returns (weights, 0) on the slots as given, and the losses, by fold."""
    base = pair_rows(rows)
    form = hinge_slopes if kind == "hinge" else lambda r: logistic_slopes(r, ["fold", "qid"])

    def value(w):
        raw = with_scores(base, {f: v / scale[f][1] for f, v in w.items()})
        found = slopes(form(raw), len(next(iter(w.values()))))
        return {f: (loss + 0.5 * reg * float(w[f] @ w[f]), g / scale[f][1] + reg * w[f]) for f, (loss, g) in found.items()}

    zero = {f: np.zeros(len(m)) for f, (m, _) in scale.items()}
    w, losses = descent(value, zero, rate, tol) if zero else ({}, {})
    weights = {f: (w[f] / scale[f][1] if f in w else zero[f], 0.0) for f in zero}
    return weights, losses


LABELS = 1024  # labels that a task adds up side by side


def label_slopes(rows: DataFrame, w: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Sum of logistic losses and its gradient (intercept first) of every label in w over rows(x, labels): one job for all labels. A row
    is positive for the labels in its array. Weights are columns of one matrix; tasks take blocks of rows and of labels."""
    ids = np.array(sorted(w))
    known = rows.sparkSession.sparkContext.broadcast((ids, np.array([w[i] for i in ids])))

    def run(batches):
        ids, weights = known.value
        total = np.zeros((len(ids), weights.shape[1] + 1))
        for b in batches:
            x = np.column_stack([np.ones(len(b)), matrix(b["x"])])
            n = [len(v) for v in b["labels"]]
            owner, label = np.repeat(np.arange(len(b)), n), np.concatenate([np.asarray(v, np.int64) for v in b["labels"]] or [np.zeros(0, np.int64)])
            at = np.minimum(np.searchsorted(ids, label), len(ids) - 1)
            hit = ids[at] == label
            owner, at = owner[hit], at[hit]
            for k in range(0, len(ids), LABELS):
                s = x @ weights[k : k + LABELS].T
                some = (at >= k) & (at < k + LABELS)
                y = np.zeros_like(s)
                y[owner[some], at[some] - k] = 1.0
                total[k : k + LABELS, 0] += (np.logaddexp(0, s) - y * s).sum(axis=0)
                total[k : k + LABELS, 1:] += (1 / (1 + np.exp(-s)) - y).T @ x
        for i, v in zip(ids.tolist(), total):
            yield pd.DataFrame({"label": i, "i": np.arange(len(v)), "v": v})

    found = rows.select("x", "labels").mapInPandas(run, "label long, i long, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    out = {i: np.zeros(len(w[i]) + 1) for i in w}
    for r in found.toLocalIterator():
        out[r.label][r.i] = r.v
    known.unpersist()
    return {i: (float(v[0]), v[1:]) for i, v in out.items()}


def label_fit(rows: DataFrame, n_labels: int, d: int, reg: float, tol: float = 1e-4) -> tuple[dict, dict]:
    """Weights (intercept first) and losses of one logistic model per label 0..n_labels - 1, all fitted together: mean loss plus
    reg |w|^2 / 2, until a step lowers a label's loss by less than `tol` of its first value."""
    rows = cut(rows.select("x", "labels"), "labels")
    n = rows.count()
    norm = np.concatenate([[0.0], np.full(d, reg)])

    def value(w):
        return {i: (loss / n + 0.5 * (norm * w[i] ** 2).sum(), g / n + norm * w[i]) for i, (loss, g) in label_slopes(rows, w).items()}

    return descent(value, {i: np.zeros(d + 1) for i in range(n_labels)}, 1.0, tol) if n and n_labels else ({}, {})
