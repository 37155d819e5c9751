"""Embedding whitening by shifted CholeskyQR.

Every entry c becomes the whole number x = floor(256 c). The fit list holds each distinct vector of such numbers once. Its
centred rows A are orthogonalised by rounds: a distributed pass gives the Gram matrix of the present rows, the driver its
Cholesky factor R, and the next pass solves with all factors so far, row by row, so that A = Q R_k ... R_1. The first factor
is taken with a shift of the Gram matrix, which keeps it positive definite for any condition number; later ones are shifted
only while the rows are still ill-conditioned. When Q is orthonormal, the singular value decomposition of the composed factor
gives the components and the deviations along them, without squaring the condition number as a decomposition of the covariance
would. `fit` returns them, `whiten` applies them to all rows.

The driver holds d x d matrices of each vector length d, nothing that grows with the rows.

Defined results: rows whose vector is null or has a null or non-finite entry are dropped, and an empty vector has no
components; a null id stays, repeated rows stay repeated and count once in the fit; an empty table gives an empty
table. Vectors of different lengths are fitted apart from each other. A component without variance (constant dimensions,
fewer distinct vectors than dimensions) has no unit variance and is not returned. Equal eigenvalues: any orthonormal basis of
their space may come out, the same for all rows; the entry of largest size is positive. Entries beyond 2^32 in size count
as 2^32. `deviation` is an exact decimal, null from 10^38 on. Other columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import ragged_index, sums_between, table, written
from recset.llm.queries import query

UNITS = 256  # whole numbers to one
MOST = 1 << 40  # bound of a whole number, far above any embedding
COMPONENTS = 4
ROUNDS = 12  # safety stop; two to four rounds do, and a few more if the rank is lower than the dimension
TINY = 1e-13  # singular values below this share of the largest count as zero
STEP_BYTES = 8 << 20  # rows handled at a time, as doubles
WHOLE = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


@dataclass
class Space:
    """What is fitted for the vectors of one length: components are the columns of `axes`, by falling eigenvalue."""

    n: int
    total: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    rounds: int
    identity_error: float = 0.0


def steps(n: int, size: int) -> Iterator[slice]:
    step = max(1, STEP_BYTES // (8 * size))
    return (slice(a, a + step) for a in range(0, n, step))


def codes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers as a matrix) of the usable rows, by vector length."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    flat = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(n)])
    good = (n > 0) & (sums_between(missing | ~np.isfinite(flat), off) == 0)
    for size in np.unique(n[good]).tolist():
        rows = np.flatnonzero(good & (n == size))
        for cut in steps(len(rows), size):
            c = flat[ragged_index(off[:-1][rows[cut]], n[rows[cut]])].reshape(-1, size)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(c * UNITS), -MOST, MOST).astype(np.int64)
            yield rows[cut], x


def distinct_codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(size, code): each distinct vector of whole numbers once, in the fewest bytes an entry that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in codes(batch.column("vec")):
                size = x.shape[1]
                low, high = x.min(axis=1), x.max(axis=1)
                width = np.select([(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1) for w in (1, 2, 4)], (1, 2, 4), 8)
                for w in np.unique(width).tolist():
                    raw = x[width == w].astype(WHOLE[w])
                    flat = pa.Array.from_buffers(pa.binary(w * size), len(raw), [None, pa.py_buffer(raw.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), size)), flat.cast(pa.binary())], ["size", "code"])

    return vectors.select(F.col(vector).alias("vec")).mapInArrow(run, "size long, code binary").distinct()


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fit list as matrices of whole numbers."""
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        length = pc.binary_length(batch.column("code")).to_numpy(zero_copy_only=False)
        for s, m in sorted(set(zip(size.tolist(), length.tolist()))):
            rows = np.flatnonzero((size == s) & (length == m))
            for cut in steps(len(rows), s):
                raw = b"".join(batch.column("code").take(pa.array(rows[cut])).to_pylist())
                yield np.frombuffer(raw, WHOLE[m // s]).reshape(-1, s).astype(np.int64)


def totals(codes: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums by dimension, for each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for x in matrices(batches):
            s = x.shape[1]
            n[s] = n.get(s, 0) + len(x)
            total[s] = total.get(s, 0) + x.sum(axis=0).astype(object)  # a part's sums stay below 2^63
        for s in n:
            sums = [n[s], *total[s]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int64()), pa.array(list(map(str, sums)), pa.string())],
                ["size", "place", "v"])

    sums = codes.mapInArrow(run, "size long, place long, v string").groupBy("size", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, list] = {}
    for r in sums.orderBy("size", "place").toLocalIterator():
        out.setdefault(r.size, []).append(int(r.v))
    return {s: (v[0], v[1:]) for s, v in out.items()}


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a inv(r) for an upper triangular r, by substitution over columns of all rows at once."""
    y = np.empty_like(a)
    for j in range(len(r)):
        y[:, j] = (a[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def grams(codes: DataFrame, means: dict[int, np.ndarray], factors: dict[int, list[np.ndarray]], axes: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Gram matrix of the centred rows after a solve with each factor (and a product with `axes` if given), by length."""
    known = codes.sparkSession.sparkContext.broadcast((means, factors, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, factors, axes = known.value
        out: dict[int, np.ndarray] = {}
        for x in matrices(batches):
            s = x.shape[1]
            if s not in means:
                continue
            a = x - means[s]
            for r in factors[s]:
                a = solved(a, r)
            if axes is not None:
                a = a @ axes[s]
            out[s] = out.get(s, 0.0) + a.T @ a
        for s, g in out.items():
            for i in range(0, len(g)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), s)), pa.array(np.arange(len(g)) + i * len(g)), pa.array(g[i])], ["size", "place", "v"])

    sums = codes.mapInArrow(run, "size long, place long, v double").groupBy("size", "place").agg(F.sum("v").alias("v"))
    cells: dict[int, list] = {}
    for r in sums.toLocalIterator():
        cells.setdefault(r.size, []).append((r.place, r.v))
    known.unpersist()
    out = {}
    for s, c in cells.items():
        k = int(round(len(c) ** 0.5))
        g = np.zeros(k * k)
        g[[p for p, _ in c]] = [v for _, v in c]
        out[s] = (g.reshape(k, k) + g.reshape(k, k).T) / 2
    return out


def next_factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Cholesky factor of the Gram matrix, shifted by 11 (n d + d (d + 1)) u |A|^2 at first and while it is near singular."""
    d, w = len(g), np.linalg.eigvalsh(g)
    if first or w[0] <= 1e-8 * w[-1]:
        g = g + 11 * (n * d + d * (d + 1)) * 2.0**-53 * w[-1] * np.eye(d)
    return np.linalg.cholesky(g).T


def fit(codes: DataFrame) -> dict[int, Space]:
    """One Space for each vector length in codes(size, code), the written fit list."""
    sums = totals(codes)
    means = {s: np.array([v / n for v in total]) for s, (n, total) in sums.items()}  # whole numbers: rounded once
    factors: dict[int, list[np.ndarray]] = {s: [] for s in sums}
    whole = {s: np.eye(s) for s in sums}
    going, out = dict(means), {}
    for done in range(1, ROUNDS + 1):
        for s, g in grams(codes, going, factors).items() if going else ():
            n, total = sums[s]
            first, near = not factors[s], False
            if not first:
                # Directions that the composed factor has pressed below double precision hold no variance: set them apart.
                u, sv, _ = np.linalg.svd(whole[s])
                real, null = u[:, sv > TINY * sv[0]], u[:, sv <= TINY * sv[0]]
                g = real @ (real.T @ g @ real) @ real.T + null @ null.T
                near = np.abs(g - np.eye(s)).max() <= 1e-11
            if g.any():
                factors[s].append(next_factor(g, n, first))
                whole[s] = factors[s][-1] @ whole[s]
            else:
                whole[s] = g
            if near or not g.any() or done == ROUNDS:
                out[s] = _space(n, total, means[s], whole[s], done)
                del going[s]
        if not going:
            break
    known = {s: v for s, v in out.items() if len(v.values)}
    if known:
        scaled = {s: v.axes[:, :COMPONENTS] / np.sqrt(v.values[:COMPONENTS]) for s, v in known.items()}
        for s, g in grams(codes, {s: v.mean for s, v in known.items()}, {s: [] for s in known}, scaled).items():
            out[s].identity_error = float(np.abs(g / out[s].n - np.eye(len(g))).max())
    return out


def _space(n: int, total: list[int], mean: np.ndarray, r: np.ndarray, rounds: int) -> Space:
    _, sv, vt = np.linalg.svd(r)
    k = int((sv > TINY * sv[0]).sum()) if sv[0] > 0 else 0
    axes = vt[:k].T.copy()
    big = np.abs(axes).argmax(axis=0)
    axes *= np.where(axes[big, np.arange(k)] < 0, -1.0, 1.0)
    values = sv[:k] ** 2 / n
    return Space(n, total, mean, axes, values, values / (sv**2 / n).sum() if k else values, rounds)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n x - total)^2, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    if most**2 * x.shape[1] < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, spaces: dict[int, Space], id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error) of each usable row and component up to `most`."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    known = vectors.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in codes(batch.column("vec")):
                s = known.value[x.shape[1]]
                k = min(most, len(s.values))
                if not k:
                    continue
                w = (x - s.mean) @ (s.axes[:, :k] / np.sqrt(s.values[:k]))
                far = pa.array([str(v) if v < 10**38 else None for v in deviations(x, s.n, s.total)], pa.string())
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, s.n)), far.take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.reshape(-1)),
                     pa.array(np.tile(s.explained[:k], m)), pa.array(np.full(m * k, s.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(run, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_col)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """`fit` on all vectors, then `whiten` all of them."""
    return whiten(vectors, fit(written(distinct_codes(vectors, vector), "codes")), id_col, vector, most)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(table(spark, sf, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
