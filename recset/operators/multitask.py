"""Scores of many lists against every song without forming the pairs, for the multitask fit.

A list is scored by t = mu + (v_user + w_list). Its gradient is its share of a mean over all lists, so in a large table v + w stays
near zero. There the sum over songs of exp(x . t), and of x exp(x . t), is a series in v + w around mu whose coefficients are moments
of the songs: sums of exp(x . mu) times products of slots of x. They are summed once a step, at a cost of the songs; a list then costs
the same whatever the number of songs. The series is taken only where |x| |v + w| bounds its relative error by TOL, in sums
that floats round at about that size; other lists are scored song by song.

Lists lie in slices of whole users, a few megabytes with the vectors of their songs, so a step is one pass over slices and nothing is
shuffled. v stands beside its lists there. A slice in which a user leaves the reach of the series is unpacked to rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOL = 1e-11
MOST = 1 << 20  # numbers in a table of moments
SLICE = 1 << 18  # numbers in the vectors of a slice, about
KINDS = {"usr": np.int64, "pid": np.int64, "owner": np.int64, "n": np.int64, "x": np.float64, "w": np.float64, "v": np.float64}
PACKED = ", ".join(f"{c} binary" for c in KINDS)


def degree(d: int) -> int:
    """Terms up to the second power, if the table of moments is small enough, else up to the first."""
    return 2 if (1 + d + d * (d + 1) // 2) * (d + 1) <= MOST else 1


def reach(terms: int) -> float:
    """The largest |x| |v + w| whose first left-out term is within TOL."""
    return (2 * TOL) ** (1 / 2) if terms == 1 else (6 * TOL) ** (1 / 3)


def powers(z: np.ndarray, terms: int) -> np.ndarray:
    """Each row's 1, its slots and, for two terms, the products of any two slots."""
    out = [np.ones((len(z), 1)), z]
    if terms == 2:
        i, j = np.triu_indices(z.shape[1])
        out.append(z[:, i] * z[:, j])
    return np.hstack(out)


def vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(songs: DataFrame, mu: np.ndarray, terms: int) -> np.ndarray:
    """The coefficients of the series around mu, from songs(x): a row for each power, a column for the sum and for each slot."""
    d = len(mu)
    i, j = np.triu_indices(d)
    factor = np.concatenate([np.ones(1 + d), np.where(i == j, 0.5, 1.0)] if terms == 2 else [np.ones(1 + d)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(factor), d + 1))
        for batch in batches:
            x = vectors(batch.column("x"), d)
            for part in (x[lo:lo + 1024] for lo in range(0, len(x), 1024)):
                total += powers(part, terms).T @ (np.exp(part @ mu)[:, None] * powers(part, 1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(factor) * (d + 1))
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    m = songs.select("x").mapInArrow(run, "m binary").repartition(1).mapInArrow(added, "m binary").first()[0]
    return np.frombuffer(m).reshape(len(factor), d + 1) * factor[:, None]


def series(delta: np.ndarray, m: np.ndarray, terms: int, radius: float) -> np.ndarray:
    """Sums over all songs of exp(x . t) and x exp(x . t) for each row of t - mu, all within reach. Terms that are too small for TOL are left out."""
    if terms == 2 and len(delta) and radius * np.sqrt((delta * delta).sum(1).max()) <= reach(1):
        terms = 1
    out = np.empty((len(delta), m.shape[1]))
    for lo in range(0, len(delta), 1024):
        z = powers(delta[lo:lo + 1024], terms)
        out[lo:lo + 1024] = z @ m[: z.shape[1]]
    return out


def series_totals(rows: DataFrame, mu: np.ndarray, m: np.ndarray, terms: int, radius: float) -> DataFrame:
    """(pid, all) of rows(pid, t), all within reach."""
    d = len(mu)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = series(vectors(batch.column("t"), d) - mu, m, terms, radius)
            ends = np.arange(0, out.size + 1, d + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["pid", "all"])

    return rows.select("pid", "t").mapInArrow(run, "pid long, all array<double>")


def row_of(cells: dict[str, np.ndarray], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(cells[c], k).tobytes()], pa.binary()) for c, k in KINDS.items()] + list(more.values()), [*KINDS, *more])


def cells_of(batch: pa.RecordBatch, k: int, d: int) -> dict[str, np.ndarray]:
    """A slice: of each user `usr` and weights `v`; of each list its number, the place of its user, its number of songs and its weights
    `w` (none if all are zero); the vectors of all songs by list."""
    out = {c: np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in KINDS.items()}
    return out | {c: out[c].reshape(-1, d) for c in ("x", "w", "v")}


def slices(rows: DataFrame, d: int, n: int) -> DataFrame:
    """rows(usr, pid, x), each user's in one slice, in n partitions; all weights are zero."""
    size = max(1, SLICE // max(d, 1))

    def packed(usr: np.ndarray, pid: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.append(True, usr[1:] != usr[:-1])
        heads = np.flatnonzero(first | np.append(True, pid[1:] != pid[:-1]))
        owner = (np.cumsum(first) - 1)[heads]
        return row_of({"usr": usr[first], "pid": pid[heads], "owner": owner, "n": np.diff(np.append(heads, len(usr))), "x": x, "w": x[:0], "v": np.zeros((owner[-1] + 1, d))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            """Slices of whole users; the last user may go on unless it is the end."""
            nonlocal held
            ends = np.append(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])] if last else []).astype(np.int64)
            at = 0
            while at < len(held[0]):
                k = np.searchsorted(ends, at + size, "right")
                if not last and k >= len(ends):
                    break
                to = ends[max(k - 1, np.searchsorted(ends, at, "right"))]
                yield packed(*(c[at:to] for c in held))
                at = to
            held = [c[at:] for c in held]

        for batch in batches:
            part = [batch.column("usr").to_numpy(), batch.column("pid").to_numpy(), vectors(batch.column("x"), d)]
            held = part if held is None else [np.concatenate(c) for c in zip(held, part)]
            yield from full(False)
        if held is not None and len(held[0]):
            yield from full(True)

    return rows.select("usr", "pid", "x").repartition(n, "usr").sortWithinPartitions("usr", "pid").mapInArrow(run, PACKED)


def step(state: DataFrame, mu: np.ndarray, m: np.ndarray, terms: int, radius: float, p: float, n_songs: int, n_lists: int, rate: float, c1: float, c2: float) -> DataFrame:
    """The slices after a proximal gradient step, with `sums` of the step's start (the gradient, |v|^2, the risk, |w|_1) and `far`,
    the largest |x| |v + w| after it."""
    d = len(mu)

    def moved(s: dict[str, np.ndarray]) -> pa.RecordBatch:
        owner, n, x, v = s["owner"], s["n"], s["x"], s["v"]
        w = s["w"] if len(s["w"]) else np.zeros((len(n), d))
        delta, some = v[owner] + w, np.flatnonzero(w.any(axis=1))
        total = series(v, m, terms, radius)[owner]
        total[some] = series(delta[some], m, terms, radius)
        score = (x * np.repeat(delta + mu, n, axis=0)).sum(1)
        a, e = np.exp(-p * score)[:, None], np.exp(score)[:, None]
        own = np.add.reduceat(np.hstack([a, a * x, e, e * x]), np.cumsum(n) - n)
        away = (n_songs - n)[:, None]
        out = np.where(away > 0, (total - own[:, d + 1:]) / np.maximum(away, 1), 0.0)
        inside = own[:, :d + 1] / n[:, None]
        g = (out[:, 1:] - inside[:, 1:]) / n_lists
        risk = (inside[:, 0] / p + out[:, 0]).sum() / n_lists
        sums = np.concatenate([g.sum(0), [(v * v).sum(), risk, np.abs(w).sum()]])
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * c2, 0.0)
        v = v - rate * (np.add.reduceat(g, np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))) + c1 * v)
        far = radius * np.sqrt(max(((v[owner] + w) ** 2).sum(1).max(), (v * v).sum(1).max()))
        s = s | {"v": v, "w": w if w.any() else w[:0]}
        return row_of(s, sums=pa.array([sums.tolist()], pa.list_(pa.float64())), far=pa.array([far if np.isfinite(far) else np.inf]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield moved(cells_of(batch, k, d))

    return state.select(*KINDS).mapInArrow(run, f"{PACKED}, sums array<double>, far double")


def unpacked(state: DataFrame, d: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists (pid, usr, n, w), users (usr, v) and entries (pid, x) of slices."""

    def rows(pick, kinds: str) -> DataFrame:
        names = [c.split()[0] for c in kinds.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    *plain, x = pick(cells_of(batch, k, d))
                    ends = np.arange(0, x.size + 1, d, dtype=np.int32) if d else np.zeros(len(x) + 1, np.int32)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, plain), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names)

        return state.select(*KINDS).mapInArrow(run, kinds)

    weights = lambda s: s["w"] if len(s["w"]) else np.zeros((len(s["n"]), d))
    return (rows(lambda s: (s["pid"], s["usr"][s["owner"]], s["n"], weights(s)), "pid long, usr long, n long, w array<double>"),
            rows(lambda s: (s["usr"], s["v"]), "usr long, v array<double>"),
            rows(lambda s: (np.repeat(s["pid"], s["n"]), s["x"]), "pid long, x array<double>"))
