"""Reward logs (index policies) and label acquisition."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import ordering as o
from recset.plans import query
from recset.plans.profiles import _r
from recset.session import share
from recset.sources import views as v

# Lower end and amplitude of the rewards, confidence exponent.
LOWER, AMPLITUDE, CONF = 0.0, 1.0, 1.01


def arm_state(r, *by):
    """Draws and normalised cumulative reward per arm."""
    return r.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.sum((F.col("reward") - LOWER) / AMPLITUDE).alias("s"))


@query("arm_stats", "SELECT arm, count(*) AS draws, sum(reward) AS cum_reward, round(avg(reward), 6) AS mean FROM reward GROUP BY arm", "reward")
def arm_stats(spark, sf):
    return arm_state(v.reward(spark, sf)).select("arm", F.col("n").alias("draws"), F.col("s").alias("cum_reward"), _r(F.col("s") / F.col("n"), "mean"))


@query("arm_stats_prefix", "SELECT event_id, arm, count(*) OVER w AS draws, sum(reward) OVER w AS cum_reward FROM reward WINDOW w AS (PARTITION BY run, arm ORDER BY ts, event_id)", "reward")
def arm_stats_prefix(spark, sf):
    """The state of every arm after each draw of a run."""
    r = v.reward(spark, sf)
    x = o.running(r, ["run", "arm"], ["ts", "event_id"], o.id_bucket(r, "ts"), {"draws": F.lit(1).cast("long"), "cum_reward": (F.col("reward") - LOWER) / AMPLITUDE})
    return x.select("event_id", "arm", "draws", "cum_reward")


def per_run(spark, sf):
    """(run, arm, n, s, t, mean): state of every arm of a run after t draws in all."""
    a = arm_state(v.reward(spark, sf), "run")
    t = a.groupBy("run").agg(F.sum("n").alias("t"))
    return a.join(t, "run").withColumn("mean", F.col("s") / F.col("n"))


PR = "pr AS (SELECT run, arm, count(*) AS n, sum(reward) AS s, sum(count(*)) OVER (PARTITION BY run) AS t, avg(reward) AS mean FROM reward GROUP BY run, arm), d AS (SELECT *, ln(t) / n AS d FROM pr)"
KLB = lambda x, y: f"({x} * ln({x} / ({y})) + (1 - {x}) * ln((1 - {x}) / (1 - ({y}))))"
CLIP = lambda x: f"least(greatest({x}, 1e-15), 1 - 1e-15)"


@query("kl_bernoulli", f"SELECT run, arm, round({KLB('x', 'y')}, 6) AS kl FROM (SELECT run, arm, {CLIP('mean')} AS x, {CLIP('s / n * 0.5 + 0.2')} AS y FROM pr)", "reward", PR)
def kl_bernoulli(spark, sf):
    return per_run(spark, sf).select("run", "arm", _r(c.kl_bernoulli(F.col("mean"), F.col("mean") * 0.5 + 0.2), "kl"))


@query("kl_poisson", "SELECT run, arm, round(y - x + x * ln(x / y), 6) AS kl FROM (SELECT run, arm, greatest(mean, 1e-15) AS x, greatest(t / n, 1e-15) AS y FROM pr)", "reward", PR)
def kl_poisson(spark, sf):
    return per_run(spark, sf).select("run", "arm", _r(c.kl_poisson(F.col("mean"), F.col("t") / F.col("n")), "kl"))


def d_of():
    return F.ln("t") / F.col("n")


@query("ucb_gauss", "SELECT run, arm, round(mean + sqrt(2 * 0.25 * d), 6) AS ucb FROM d", "reward", PR)
def ucb_gauss(spark, sf):
    """mean + sqrt(2 sigma^2 ln t / n) with sigma^2 = 1/4."""
    return per_run(spark, sf).select("run", "arm", _r(c.ucb_gauss(F.col("mean"), d_of()), "ucb"))


def BISECT(lo, up, high, steps=40):
    return f"b AS (SELECT run, arm, mean AS x, d, n, s, t, 0 AS k, ({lo})::DOUBLE AS lo, ({up})::DOUBLE AS up FROM d UNION ALL SELECT run, arm, x, d, n, s, t, k + 1, CASE WHEN {high} THEN lo ELSE (lo + up) / 2 END, CASE WHEN {high} THEN (lo + up) / 2 ELSE up END FROM b WHERE k < {steps})"


@query("klucb_bern", "SELECT run, arm, round((lo + up) / 2, 6) AS klucb FROM b WHERE k = 40", "reward", PR + ", " + BISECT("mean", "least(1.0, mean + sqrt(2 * d))", KLB(CLIP("x"), CLIP("(lo + up) / 2")) + " > d"), recursive=True)
def klucb_bern(spark, sf):
    return per_run(spark, sf).select("run", "arm", _r(c.klucb_bernoulli(F.col("mean"), d_of()), "klucb"))


@query("klucb_poisson", "SELECT run, arm, round((lo + up) / 2, 6) AS klucb FROM b WHERE k = 40", "reward", PR + ", " + BISECT("mean", "mean + d + sqrt(d * d + 2 * mean * d)", "greatest((lo + up) / 2, 1e-15) - greatest(x, 1e-15) + greatest(x, 1e-15) * ln(greatest(x, 1e-15) / greatest((lo + up) / 2, 1e-15)) > d"), recursive=True)
def klucb_poisson(spark, sf):
    return per_run(spark, sf).select("run", "arm", _r(c.klucb_poisson(F.col("mean"), d_of()), "klucb"))


@query("cp_upper", "SELECT run, arm, round(CASE WHEN s >= n THEN 1 ELSE (lo + up) / 2 END, 6) AS cp FROM b WHERE k = 40", "reward", PR + ", " + BISECT("0", "1",
       "s < n AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + up) / 2) + (n - i) * ln(1 - (lo + up) / 2)) FOR i IN range(0, s::BIGINT + 1)]) < 1 / pow(t, 1.01) / 2"), recursive=True)
def cp_upper(spark, sf):
    """Clopper-Pearson upper bound with alpha = 1 / t^1.01, by the incomplete beta function; the twin sums the binomial tail."""
    a = F.lit(1.0) / F.pow(F.col("t").cast("double"), F.lit(CONF))
    return per_run(spark, sf).select("run", "arm", _r(c.clopper_pearson_upper(F.col("s"), F.col("n").cast("double"), a), "cp"))


@query("best_arm", "SELECT run, arg_min(arm, (-round(mean + sqrt(2 * 0.25 * d), 9), md5(arm || '|' || run || '|pick'))) AS arm FROM d GROUP BY run", "reward", PR)
def best_arm(spark, sf):
    """Arm with the maximal index of each run; ties are picked by hash. Undrawn arms have an infinite index and come first."""
    ix = F.when(F.col("n") > 0, F.round(c.ucb_gauss(F.col("mean"), d_of()), 9)).otherwise(F.lit(float("inf")))
    d = per_run(spark, sf).select("run", "arm", ix.alias("ix"))
    return d.groupBy("run").agg(F.min(F.struct((-F.col("ix")).alias("k"), o.md5_of("arm", "run", seed="pick").alias("h"), F.col("arm"))).alias("b")).select("run", "b.arm")


STEPS = [1, 5, 10, 20, 50]  # saved steps


@query("run_summary", """SELECT t, count(*) AS runs, round(avg(cum), 6) AS mean_reward, round(t * max(best) - avg(cum), 6) AS regret FROM (SELECT run, row_number() OVER w AS t, sum(reward) OVER w AS cum FROM reward WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
    (SELECT max(m) AS best FROM (SELECT avg(reward) AS m FROM reward GROUP BY arm)) WHERE t IN (1, 5, 10, 20, 50) GROUP BY t""", "reward")
def run_summary(spark, sf):
    """Mean cumulative reward and mean regret over runs at the saved steps."""
    r = v.reward(spark, sf)
    best = arm_state(r).agg(F.max(F.col("s") / F.col("n"))).scalar()
    x = o.running(r, ["run"], ["ts", "event_id"], o.id_bucket(r, "ts"), {"cum": F.col("reward"), "t": F.lit(1).cast("long")})
    g = x.filter(F.col("t").isin(STEPS)).groupBy("t").agg(F.count("*").alias("runs"), F.avg("cum").alias("m"))
    return g.select("t", "runs", _r("m", "mean_reward"), F.round(F.col("t") * best - F.col("m"), 6).alias("regret"))


@query("run_draws", "SELECT arm, round(avg(n), 6) AS mean_draws FROM pr GROUP BY arm", "reward", PR)
def run_draws(spark, sf):
    return per_run(spark, sf).groupBy("arm").agg(_r(F.avg("n"), "mean_draws"))


# ---- label acquisition: the n best candidates ----

N_PICK = 50


def pick(d, order, *cols):
    return d.orderBy(*order).limit(N_PICK).select("cand", *cols)


@query("al_random", "SELECT vec_id AS cand FROM embeddings ORDER BY md5(vec_id::VARCHAR || '|al'), vec_id LIMIT 50")
def al_random(spark, sf):
    return pick(v.table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "cand"), [o.md5_of("cand", seed="al"), "cand"])


def plogp(p="p"):
    return F.when(F.col(p) > 0, F.col(p) * F.ln(p)).otherwise(0.0)


@query("al_entropy", "SELECT cand, round(-sum(p * ln(p)), 9) AS entropy FROM prob WHERE member = 0 GROUP BY cand ORDER BY entropy DESC, cand LIMIT 50", "prob")
def al_entropy(spark, sf):
    g = v.prob(spark, sf).filter("member = 0").groupBy("cand").agg(F.round(-F.sum(plogp()), 9).alias("entropy"))
    return pick(g, [F.desc("entropy"), "cand"], "entropy")


def margins(d):
    """Gap between the two most probable classes: the maximum, and the largest of the rest (0 when alone)."""
    two = o.top_k(d, ["cand"], [F.desc("p"), "cls"], 2)
    g = two.groupBy("cand").agg((F.max("p") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0))).alias("m"))
    return g.select("cand", F.round("m", 9).alias("margin"))


@query("al_margin", "SELECT cand, round(max(p) - max(CASE WHEN r = 2 THEN p END), 9) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, cls) AS r FROM prob WHERE member = 0) GROUP BY cand ORDER BY margin, cand LIMIT 50", "prob")
def al_margin(spark, sf):
    return pick(margins(v.prob(spark, sf).filter("member = 0")), ["margin", "cand"], "margin")


def committee(p):
    """Mean probability per class; a class that a member does not know counts as 0."""
    members = p.select("member").distinct().agg(F.count("*")).scalar()
    return p.groupBy("cand", "cls").agg(F.sum("p").alias("s")).select("cand", "cls", (F.col("s") / members).alias("p"))


@query("al_committee_margin", "SELECT cand, round(max(p) - max(CASE WHEN r = 2 THEN p END), 9) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, cls) AS r FROM (SELECT cand, cls, sum(p) / 3 AS p FROM prob WHERE NOT (member = 2 AND cls = 4) GROUP BY 1, 2)) GROUP BY cand ORDER BY margin, cand LIMIT 50", "prob")
def al_committee_margin(spark, sf):
    """Member 2 does not know class 4 here."""
    p = v.prob(spark, sf).filter("not (member = 2 and cls = 4)")
    return pick(margins(committee(p)), ["margin", "cand"], "margin")


@query("al_committee_kl", "SELECT cand, round(sum(p.p * ln(p.p / m.p)) / 3, 9) AS kl FROM prob p JOIN (SELECT cand, cls, avg(p) AS p FROM prob GROUP BY 1, 2) m USING (cand, cls) GROUP BY cand ORDER BY kl DESC, cand LIMIT 50", "prob")
def al_committee_kl(spark, sf):
    """Mean divergence of the members from the committee mean."""
    p = v.prob(spark, sf)
    m = committee(p).withColumnRenamed("p", "avg")
    term = F.coalesce(F.nanvl(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("avg"))), F.lit(0.0)), F.lit(0.0))
    members = p.select("member").distinct().agg(F.count("*")).scalar()
    g = p.join(m, ["cand", "cls"]).groupBy("cand").agg(F.sum(term).alias("s")).select("cand", F.round(F.col("s") / members, 9).alias("kl"))
    return pick(g, [F.desc("kl"), "cand"], "kl")


@query("al_pool_entropy", """SELECT g, round(sum(w * h), 6) AS expected FROM (SELECT e.label AS g, p.member AS y, -sum(p.p * ln(p.p)) AS h FROM prob p JOIN embeddings e ON e.vec_id = p.cand GROUP BY 1, 2) a
    JOIN (SELECT e.label AS g, p.cls AS y, avg(p.p) AS w FROM prob p JOIN embeddings e ON e.vec_id = p.cand WHERE p.member = 0 GROUP BY 1, 2) b USING (g, y) GROUP BY g""", "prob")
def al_pool_entropy(spark, sf):
    """Expected pool entropy of a candidate group g: the pool probabilities after assuming label y are those of member y."""
    lab = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cand"), F.col("label").alias("g"))
    p = v.prob(spark, sf).join(lab, "cand")
    h = p.groupBy("g", F.col("member").alias("y")).agg((-F.sum(plogp())).alias("h"))
    w = p.filter("member = 0").groupBy("g", F.col("cls").alias("y")).agg(F.avg("p").alias("w"))
    return h.join(w, ["g", "y"]).groupBy("g").agg(_r(F.sum(F.col("w") * F.col("h")), "expected"))


def pool_moments(rows, n_class, n_feat):
    """(kind, i, v): rows of the Fisher and of the output-variance matrix, summed over all pool rows (x, p).

    A task reduces its Arrow batches, a block of rows at a time, to two square matrices of fixed size; their rows are
    shuffled and summed.
    """
    width = n_class * n_feat

    def reduce(batches):
        import numpy as np
        import pandas as pd

        f, a, seen = np.zeros((width, width)), np.zeros((width, width)), False
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo:lo + 1024]
                x, p = np.array(part["x"].tolist()), np.array(part["p"].tolist())
                seen = True
                jac = np.einsum("nk,kc->nkc", p, np.eye(n_class)) - np.einsum("nk,nc->nkc", p, p)  # d p_k / d score_c
                g = np.einsum("nkc,nf->nkcf", jac, x).reshape(-1, width)
                a += g.T @ g
                px = np.einsum("nc,nf->ncf", p, x).reshape(len(x), width)
                f += px.T @ px
                for k in range(n_class):
                    s = slice(k * n_feat, (k + 1) * n_feat)
                    w = p[:, k] * (1 - p[:, k])
                    f[s, s] += (x * w[:, None]).T @ x - px[:, s].T @ px[:, s]
        if seen:
            for kind, m in (("F", f), ("A", a)):
                yield pd.DataFrame({"kind": kind, "i": range(width), "v": list(m)})

    def total(part):
        import numpy as np

        return part.iloc[:1].assign(v=[np.sum(part["v"].tolist(), axis=0)])

    schema = "kind string, i int, v array<double>"
    return rows.mapInPandas(reduce, schema).groupBy("kind", "i").applyInPandas(total, schema)


def pool_matrices(rows, n_class, n_feat, c=1.0):
    """Fisher matrix (with c on its diagonal, over the rows) and output-variance matrix of the pool, and the number of rows."""
    import numpy as np

    width = n_class * n_feat
    m = {"F": np.zeros((width, width)), "A": np.zeros((width, width))}
    for r in pool_moments(rows, n_class, n_feat).toLocalIterator():
        m[r["kind"]][r["i"]] = r["v"]
    n = rows.count()
    return (m["F"] + c * np.eye(width)) / max(n, 1), m["A"], n


def expected_variance(rows, fisher, output, n):
    """(cand, expected) of rows(cand, x, p): the pool variance trace(A F^-1) that is expected when the candidate's label is known.

    A label y adds the candidate's score g = (e_y - p) x x to the information, F + g g' / n, so by the rank-one update of the inverse
    the variance falls by (g' F^-1 A F^-1 g) / (n + g' F^-1 g). Two matrices of fixed size are sent out once; no fit is made again.
    """
    import numpy as np

    inv = np.linalg.inv(fisher)
    known = rows.sparkSession.sparkContext.broadcast((inv, inv @ output @ inv, float(np.trace(output @ inv))))

    def run(batches):
        import pandas as pd

        inv, mid, whole = known.value
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo:lo + 256]
                x, p = np.array(part["x"].tolist()), np.array(part["p"].tolist())
                k, d = p.shape[1], x.shape[1]
                # x' M x for every pair of classes, so that each label is a small form in (e_y - p).
                forms = [np.einsum("nf,afbg,ng->nab", x, m.reshape(k, d, k, d), x, optimize=True) for m in (mid, inv)]
                turn = np.eye(k)[None, :, :] - p[:, None, :]
                gain, size = (np.einsum("nya,nab,nyb->ny", turn, q, turn) for q in forms)
                yield pd.DataFrame({"cand": part["cand"].to_numpy(), "expected": whole - (p * gain / (n + size)).sum(axis=1)})

    return rows.select("cand", "x", "p").mapInPandas(run, "cand long, expected double")


def pool_rows(spark, sf):
    p = v.prob(spark, sf).filter("member = 0").groupBy("cand").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "p"))), lambda s: s["p"]).alias("p"))
    x = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cand"), F.col("embedding").cast("array<double>").alias("x"))
    return share(p.join(x, "cand").select("cand", "x", "p"))


@query("al_pool_variance")
def al_pool_variance(spark, sf):
    """Every candidate by its expected Fisher-information variance of the pool, the smallest first. The matrices are
    (classes x features)^2, fixed in size."""
    rows = pool_rows(spark, sf)
    n_feat = rows.agg(F.max(F.size("x"))).first()[0] or 0
    fisher, output, n = pool_matrices(rows, 5, n_feat)
    d = share(expected_variance(rows, fisher, output, n))
    ranked = o.ordinal(d, [], ["expected", "cand"], o.id_bucket(d, "expected"), "rank")
    return ranked.select("cand", F.round("expected", 6).alias("expected"), "rank")
