"""Whitening against a decomposition of the covariance in numpy."""
import numpy as np
import pytest

from recset.llm import whitening as wh
from recset.llm.common import written

SCHEMA = "vec_id long, embedding array<float>, label int"


def fitted(spark, rows, **names):
    return wh.whitened(spark.createDataFrame(rows, SCHEMA), **names)


def plain(rows):
    """Rows by (vec_id, component), n and shares of the covariance's own decomposition; one vector length."""
    good = [(i, v) for i, v, _ in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    a = fit - total / n
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, int((values > 1e-9 * values[0]).sum()))
    w = (x - total / n) @ axes[:, :k] / np.sqrt(values[:k])
    far = [int(((n * r.astype(object) - total.astype(object)) ** 2).sum()) for r in x]
    return [i for i, _ in good], n, far, w, values[:k] / values.sum()


def compare(got, rows):
    ids, n, far, w, share = plain(rows)
    k = len(share)
    got = sorted(got, key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.whitened if r.component == 1 else 0))
    assert len(got) == k * len(ids) and {r.n for r in got} <= {n}
    own = {}
    for r in got:
        own.setdefault(r.vec_id, []).append(r)
    for c in range(1, k + 1):
        mine = {i: [r for r in v if r.component == c] for i, v in own.items()}
        pairs = [(mine[i][0].whitened, w[j, c - 1]) for j, i in enumerate(ids) if ids.count(i) == 1]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(sign * a - b) for a, b in pairs) < 1e-7
        assert all(abs(r.explained - share[c - 1]) < 1e-9 for v in mine.values() for r in v)
    for i, d in zip(ids, far):
        assert d in {int(r.deviation) for r in own[i]}
    assert max((r.identity_error for r in got), default=0) < 1e-7


def cloud(n, d, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (scale if scale is not None else np.linspace(3, 0.3, d))
    return [(i, x[i].astype(np.float32).tolist(), 0) for i in range(n)]


def test_cloud_with_awkward_rows(spark):
    rows = cloud(700, 12)
    rows += [(900, None, 1), (901, [None] + [1.0] * 11, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 1), (904, [-0.0] * 12, 1)]
    rows += [(905, rows[3][1], 1), (None, rows[5][1], 1)] + [(906, rows[4][1], 2)] * 50
    compare(fitted(spark, rows).collect(), rows)


def test_wide_range_of_variances(spark):
    """Eigenvalues from 1 to 1e-10: the factor keeps what a covariance in double precision keeps."""
    rows = cloud(400, 6, scale=np.array([4e3, 3e3, 10, 1, 0.3, 0.05]))
    got = fitted(spark, rows).collect()
    compare([r for r in got], rows)


@pytest.mark.parametrize("case", ["constant", "double", "few", "one"])
def test_lower_rank(spark, case):
    rows = cloud(200, 8)
    if case == "constant":
        rows = [(i, v[:3] + [2.5] * 5, b) for i, v, b in rows]
    if case == "double":
        rows = [(i, v[:3] + v[:3] + [v[0] * 0, 1.0], b) for i, v, b in rows]
    if case == "few":
        rows = rows[:3]
    if case == "one":
        rows = rows[:1] * 9
    got = fitted(spark, rows).collect()
    if case == "one":
        assert got == []
    else:
        assert {r.component for r in got} == set(range(1, 3 if case == "few" else 4))
        compare(got, rows)


def test_lengths_apart(spark):
    a, b = cloud(80, 5), [(i + 1000, v, c) for i, v, c in cloud(60, 3, seed=2)]
    got = fitted(spark, a + b + [(5000, [], 1)]).collect()
    compare([r for r in got if r.vec_id < 1000], a)
    compare([r for r in got if r.vec_id >= 1000], b)


def test_exact_deviations():
    x = np.array([[1 << 39, -3], [7, 1]], np.int64)
    total = [1 << 45, -5]
    assert wh.deviations(x, 1 << 20, total) == [sum(((1 << 20) * int(v) - t) ** 2 for v, t in zip(r, total)) for r in x]
    assert wh.deviations(np.array([[2, 3]]), 4, [1, 1]) == [49 + 121]


def test_huge_entries(spark):
    rows = cloud(50, 3) + [(60, [3e38, 0.0, 1.0], 0), (61, [-3e38, 0.0, 1.0], 0)]
    got = {(r.vec_id, r.component): r for r in fitted(spark, rows).collect()}
    assert len(got) == 3 * 52 and got[60, 1].deviation is not None and got[60, 1].identity_error < 1e-6


def test_codes_are_distinct_vectors(spark):
    rows = cloud(30, 4) + [(i + 100, [v + 0.0001 for v in x], 0) for i, x, _ in cloud(30, 4)] + [(200, [1e6] * 4, 0), (201, [1e6] * 4, 0)]
    got = written(wh.distinct_codes(spark.createDataFrame(rows, SCHEMA)), "t")
    want = {tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for _, v, _ in rows}
    found = [tuple(np.frombuffer(r.code, wh.WHOLE[len(r.code) // r["size"]]).tolist()) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_rounds_and_names(spark):
    rows = cloud(300, 10)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS n", "embedding AS component", "label AS size", "label AS code", "label AS whitened")
    codes = written(wh.distinct_codes(df, "component"), "t")
    spaces = wh.fit(codes)
    assert set(spaces) == {10} and spaces[10].rounds == 3
    got = wh.whiten(df.withColumnRenamed("n", "key"), spaces, "key", "component", most=10)
    assert got.count() == 3000


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [None], 1)]])
def test_nothing_to_fit(spark, rows):
    assert fitted(spark, rows).count() == 0
