"""Column expressions against direct definitions."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.plans.cleaning import cut_first_loop


def paths(n, m, seed, repeat=False):
    r = random.Random(seed)
    pick = (lambda k: [r.randrange(m) for _ in range(k)]) if repeat else (lambda k: r.sample(range(m), k))
    return [(i, pick(r.randint(2, 6)), pick(r.randint(2, 6))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "i int, y array<int>, z array<int>")


def tau_b(y, z, m):
    r = lambda p: [m - p.index(k) if k in p else 0 for k in range(m)]
    a, b = r(y), r(z)
    sgn = lambda x: (x > 0) - (x < 0)
    s = ta = tb = 0
    for i, j in itertools.combinations(range(m), 2):
        s += sgn(a[i] - a[j]) * sgn(b[i] - b[j])
        ta += a[i] != a[j]
        tb += b[i] != b[j]
    return s / math.sqrt(ta * tb)


def test_kendall_tau(spark):
    rows = paths(80, 9, 1)
    got = dict(table(spark, rows).select("i", c.kendall_tau_b(F.col("y"), F.col("z"), F.lit(9))).collect())
    for i, y, z in rows:
        assert got[i] == pytest.approx(tau_b(y, z, 9))


def test_lcs(spark):
    rows = paths(80, 5, 2, repeat=True)
    got = dict(table(spark, rows).select("i", c.lcs_length(F.col("y"), F.col("z"))).collect())

    def lcs(a, b):
        if not a or not b:
            return 0
        return 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    for i, y, z in rows:
        assert got[i] == lcs(y, z)


def test_pairs_and_ngrams(spark):
    rows = paths(60, 6, 3, repeat=True)
    got = {r.i: r for r in table(spark, rows).select("i", c.pairs_of(F.col("y")).alias("p"), c.ngrams(F.col("y"), 3).alias("g")).collect()}
    for i, y, _ in rows:
        want = {(a, b) for k, a in enumerate(y) for b in y[k + 1:] if a != b}
        assert {tuple(x) for x in got[i].p} == want
        assert got[i].g == [" ".join(map(str, y[k:k + 3])) for k in range(len(y) - 2)]


def test_cut_first_loop(spark):
    d = spark.createDataFrame([(1, [1, 2, 1, 3], []), (2, [4, 5, 6], []), (3, [7, 7], [])], "i int, y array<int>, z array<int>")
    got = {r.i: r.p for r in d.select("i", cut_first_loop(F.col("y")).alias("p")).collect()}
    assert got == {1: [1, 2], 2: [4, 5, 6], 3: [7]}


@pytest.mark.parametrize("n", [1, 10, 1000, 200000])
def test_beta_cdf_matches_binomial_tail(spark, n):
    rows = []
    for k in sorted({0, n // 3, n // 2, max(n - 1, 0)}):
        for d in (0.5, 0.95, 1.0, 1.05, 2.0):
            x = (k + 1) / (n + 1) * d
            if 0 < x < 1 and k < n:
                rows.append((float(k + 1), float(n - k), x, k))
    got = spark.createDataFrame(rows, "a double, b double, x double, k int").select("k", "x", c.beta_cdf(F.col("a"), F.col("b"), F.col("x")).alias("p")).collect()
    for r in got:
        lg = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(r.x) + (n - i) * math.log1p(-r.x)
        tail = math.fsum(math.exp(lg(i)) for i in range(0, r.k + 1))
        assert r.p == pytest.approx(1 - tail, abs=1e-7)


def test_json_repair(spark):
    rows = [(1, '{"MBID":"m", "title":"plain"}'), (2, '{"MBID":"m", "title":"a "b" c"}'), (3, "nonsense"), (4, None)]
    d = spark.createDataFrame(rows, "i int, t string")
    fixed = F.when(F.col("t").startswith("{"), c.rebuild_two_keys(F.col("t"), "MBID", "title"))
    got = {r.i: r.s for r in d.select("i", c.json_repaired(F.col("t"), "MBID string, title string", fixed).alias("s")).collect()}
    assert got[1].title == "plain" and got[2].title == "a b c" and got[3] is None and got[4] is None


def test_kl_indices(spark):
    d = spark.createDataFrame([(0.0, 0.3), (0.5, 0.1), (1.0, 0.2), (0.9, 2.0)], "m double, d double")
    for r in d.select("m", "d", c.klucb_bernoulli(F.col("m"), F.col("d")).alias("u")).collect():
        assert r.m <= r.u <= 1
        kl = lambda x, y: sum(p * math.log(p / q) for p, q in ((x, y), (1 - x, 1 - y)) if p > 0 and q > 0)
        if r.u < 1 - 1e-9:
            assert kl(r.m, r.u) == pytest.approx(r.d, abs=1e-6)


def test_digitize_and_edges(spark):
    d = spark.range(1).select(c.log_edges(F.lit(3), F.lit(450), 5).alias("e"))
    e = d.first().e
    assert e[0] == 0 and e[-1] == 1000 and len(e) == 6
    assert d.select(c.digitize(F.lit(450.0), F.col("e"), 6)).first()[0] == 5
