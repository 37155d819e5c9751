"""Column expressions: geometry, vectors, text repair, divergences, bisection. No Python UDF."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mean earth radius in km, guard for log of small counts, log10 of zero, clip of probabilities.
EARTH_KM = 6371.0088
LOG_SMALL = -10.0
LOG_ZERO = -1000.0
EPS = 1e-15


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(a) - F.radians(b)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def log10_or_small(x: Column) -> Column:
    return F.when(x < 1, F.lit(LOG_SMALL)).otherwise(F.log10(x))


def sign_flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(-1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def vec_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def pick(arr: Column, idx: list[int]) -> Column:
    """Chosen 0-based positions of an array."""
    return F.transform(F.array(*[F.lit(i) for i in idx]), lambda i: F.get(arr, i))


def one_hot(value: Column, vocabulary: Column, on: float = 1.0, off: float = 0.0) -> Column:
    return F.transform(vocabulary, lambda g: F.when(g == value, F.lit(on)).otherwise(F.lit(off)))


def digitize(x: Column, edges: Column, n: int) -> Column:
    """1-based bin: how many of the n edges are not above x. `edges` may be a scalar subquery."""
    return sum((F.when(F.get(edges, i) <= x, 1).otherwise(0) for i in range(n)), F.lit(0))


def log_edges(lo: Column, hi: Column, bins: int, far: bool = False) -> Column:
    """Log-spaced edges that cover [lo, hi]; the first is 0, the last lies beyond hi."""
    a = F.floor(F.log10(F.greatest(lo.cast("double"), F.lit(1.0)))).cast("double")
    b = F.ceil(F.log10(hi.cast("double"))).cast("double")
    top = F.pow(F.lit(10.0), b)
    if far:
        last = F.pow(F.lit(10.0), F.log10(hi.cast("double")) + 2)
    else:
        last = F.when(top < hi, hi.cast("double") + 1).otherwise(top)
    inner = [F.pow(F.lit(10.0), a + (b - a) * F.lit(i / bins)) for i in range(1, bins)]
    return F.array(F.lit(0.0), *inner, last)


def nearest_rank(arr: Column, percents: list[int]) -> Column:
    """Nearest-rank percentiles of a numeric array (half to even), zeros when it is empty."""
    s = F.array_sort(arr)
    n = F.size(arr)
    at = lambda p: F.element_at(s, (F.bround((n - 1) * F.lit(p / 100.0)) + 1).cast("int"))
    return F.when(n > 0, F.array(*[at(p) for p in percents])).otherwise(F.array(*[F.lit(0.0) for _ in percents]))


def array_ranks(arr: Column, largest_first: bool = True) -> Column:
    """1-based rank of every element; equal values are ranked by position."""
    ix = F.transform(arr, lambda v, i: F.struct((-v if largest_first else v).alias("k"), i.alias("i")))
    order = F.transform(F.array_sort(ix), lambda s: s["i"])
    return F.transform(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: F.array_position(order, i).cast("int"))


def f1(hits: Column, n_true: Column, n_pred: Column) -> Column:
    """Harmonic mean of hits/n_true and hits/n_pred, 0 without hits."""
    return F.when(hits > 0, 2.0 * hits / (n_true + n_pred)).otherwise(F.lit(0.0))


def pairs_of(path: Column) -> Column:
    """Distinct ordered pairs (earlier, later) of a short path, equal items skipped."""
    nested = F.transform(
        path,
        lambda a, i: F.transform(
            F.filter(F.slice(path, i + 2, F.size(path)), lambda b: b != a), lambda b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    return F.array_distinct(F.flatten(nested))


def rank_of(path: Column, item: Column, m: Column) -> Column:
    """Rank value M, M-1, ... by position in the path; 0 for items off the path."""
    p = F.array_position(path, item)
    return F.when(p > 0, m - p + 1).otherwise(F.lit(0))


def kendall_tau_b(y: Column, z: Column, m: Column) -> Column:
    """tau-b of two rankings of m items given by their short paths; all absent items tie at 0.

    Only items on one of the paths are compared one by one; absent items enter in closed form.
    """
    ranks = F.transform(F.array_union(y, z), lambda a: F.struct(rank_of(y, a, m).alias("p"), rank_of(z, a, m).alias("q")))
    order = lambda a, b, k: F.signum((a[k] - b[k]).cast("double"))

    def compare(both):
        later = lambda i: F.slice(both, i + 2, F.size(both))
        one = lambda a, i: F.aggregate(later(i), F.lit(0.0), lambda s, b: s + order(a, b, "p") * order(a, b, "q"))
        return vec_sum(F.transform(both, one)) + F.size(F.array_intersect(y, z)) * (m - F.size(both))

    s = let(ranks, compare)
    n0 = m * (m - 1) / 2.0
    tied = lambda p: (m - F.size(p)) * (m - F.size(p) - 1) / 2.0
    return s / F.sqrt((n0 - tied(y)) * (n0 - tied(z)))


def ngrams(path: Column, n: int) -> Column:
    """n-grams as text; empty when the path is shorter than n."""
    last = F.size(path) - n
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                        lambda i: F.array_join(F.slice(path, i + 1, n).cast("array<string>"), " "))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two short arrays: one dynamic-programming row folded over `a`."""
    zeros = F.transform(b, lambda _: F.lit(0))

    def step(row, x):
        # new[j] = max(new[j-1], row[j-1] + 1 on a match, row[j])
        def cell(acc, s):
            diag = F.when(s["i"] > 0, F.get(row, s["i"] - 1)).otherwise(F.lit(0))
            left = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)).otherwise(F.lit(0))
            v = F.when(s["y"] == x, diag + 1).otherwise(F.greatest(left, F.get(row, s["i"])))
            return F.concat(acc, F.array(v))

        cells = F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        return F.aggregate(cells, F.array().cast("array<int>"), cell)

    return F.array_max(F.aggregate(a, zeros, step))


def kl_bernoulli(x: Column, y: Column) -> Column:
    clip = lambda v: F.least(F.greatest(v, F.lit(EPS)), F.lit(1 - EPS))
    x, y = clip(x), clip(y)
    return x * F.ln(x / y) + (1 - x) * F.ln((1 - x) / (1 - y))


def kl_poisson(x: Column, y: Column) -> Column:
    x, y = F.greatest(x, F.lit(EPS)), F.greatest(y, F.lit(EPS))
    return y - x + x * F.ln(x / y)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def bisect(lo: Column, up: Column, too_high, steps: int) -> Column:
    """Middle of the bracket after a fixed number of halvings; `too_high(mid)` moves the upper end."""

    def halve(s, _):
        half = lambda m: let(too_high(m), lambda h: F.struct(
            F.when(h, s["lo"]).otherwise(m).alias("lo"), F.when(h, m).otherwise(s["up"]).alias("up")))
        return let((s["lo"] + s["up"]) / 2, half)

    start = F.struct(lo.cast("double").alias("lo"), up.cast("double").alias("up"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["up"]) / 2)


def ucb_gauss(mean: Column, d: Column, sig2: float = 0.25) -> Column:
    return mean + F.sqrt(2.0 * sig2 * d)


def klucb_bernoulli(mean: Column, d: Column, steps: int = 40) -> Column:
    return bisect(mean, F.least(F.lit(1.0), ucb_gauss(mean, d, 1.0)), lambda m: kl_bernoulli(mean, m) > d, steps)


def klucb_poisson(mean: Column, d: Column, steps: int = 40) -> Column:
    return bisect(mean, mean + d + F.sqrt(d * d + 2 * mean * d), lambda m: kl_poisson(mean, m) > d, steps)


def ln_gamma(x: Column) -> Column:
    """ln Gamma by the Stirling series at x + 7, brought back by the recurrence."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    up = (z - 0.5) * F.ln(z) - z + 0.9189385332046728 + series  # ln(2 pi) / 2
    return up - sum((F.ln(x + i) for i in range(1, 7)), F.ln(x))


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) by its continued fraction; the number of terms grows with sqrt(a + b).

    The fraction converges fast left of the mean, so right of it the mirrored function is taken.
    """
    left = x < (a + 1) / (a + b + 2)
    side = F.struct(F.when(left, a).otherwise(b).alias("a"), F.when(left, b).otherwise(a).alias("b"), F.when(left, x).otherwise(1 - x).alias("x"))

    def tail(v):
        a, b, x = v["a"], v["b"], v["x"]

        def step(s, i):
            m = F.floor(i / 2).cast("double")
            coef = F.when(i % 2 == 1, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))).otherwise(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            return let(coef, lambda k: let(
                F.struct((1 + k / s["c"]).alias("c"), (1 / (1 + k * s["d"])).alias("d")),
                lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"))))

        terms = F.sequence(F.lit(1), (F.ceil(3 * F.sqrt(a + b)) + 24).cast("int"))
        one = F.lit(1.0)
        fraction = F.aggregate(terms, F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("h")), step, lambda s: s["h"])
        return F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / fraction / a

    inner = let(let(side, tail), lambda r: F.when(left, r).otherwise(1 - r))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def clopper_pearson_upper(k: Column, n: Column, alpha: Column, steps: int = 40) -> Column:
    """Upper end of the interval for k successes in n trials; 1 when all trials succeed."""
    hi = bisect(F.lit(0.0), F.lit(1.0), lambda p: beta_cdf(k + 1.0, n - k, p) > 1 - alpha / 2, steps)
    return F.when(k >= n, F.lit(1.0)).otherwise(hi)


def url_name(url: Column) -> Column:
    """Decoded last part of a path after `/`, `_` and `!`, trimmed."""
    text = F.try_url_decode(url)
    for sep in ("/", "_", "!"):
        text = F.element_at(F.split(text, sep), -1)
    return F.trim(text)


def semicolon_to_comma(text: Column) -> Column:
    return F.translate(text, ";", ",")


def json_struct(text: Column, schema: str) -> Column:
    """Parsed struct, or null when the text is not valid JSON."""
    probe = schema + ", _corrupt string"
    parsed = F.from_json(text, probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return let(parsed, lambda s: F.when(s["_corrupt"].isNull() & text.isNotNull(), s))


def json_repaired(text: Column, schema: str, repaired: Column) -> Column:
    """Parse; on failure parse the repaired text; null when both fail."""
    return F.coalesce(json_struct(text, schema), json_struct(repaired, schema))


def rebuild_two_keys(text: Column, first: str, second: str) -> Column:
    """Valid JSON from `{"first": ..., "second": ...}` whose values hold stray quotes or backslashes."""
    bare = F.regexp_replace(text, r'["\\]', "")
    pattern = rf"^\{{{first}:\s*(.*?),\s*{second}:\s*(.*)\}}$"
    clean = lambda i: F.trim(F.regexp_extract(bare, pattern, i))
    return F.to_json(F.struct(clean(1).alias(first), clean(2).alias(second)))


def id_list(ids: Column) -> Column:
    """Comma list of array<struct<id>> or null when empty."""
    return F.nullif(F.array_join(F.transform(ids, lambda s: s["id"].cast("string")), ","), F.lit(""))
