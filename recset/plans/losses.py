"""Risks, likelihoods, penalties and searches over scores and weights."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import folds as fd, metrics as m, ordering as o, sequence as s
from recset.plans import query
from recset.plans.profiles import _r
from recset.plans.sequences import EDGES, city
from recset.sources import views as v


def centred(spark, sf):
    """Scores on a scale where exp stays small."""
    return v.scored(spark, sf).withColumn("s", (F.col("score") - 50) / 50)


SC = "sc AS (SELECT unit, item, pos, (score - 50)::DOUBLE / 50 AS s FROM scored)"


def _sides(d, unit, pos_expr, neg_expr):
    p = F.col("pos") == 1
    g = d.groupBy(unit).agg(F.sum("pos").cast("long").alias("np"), F.sum((~p).cast("long")).alias("nn"),
                            F.sum(F.when(p, pos_expr)).alias("sp"), F.sum(F.when(~p, neg_expr)).alias("sn"))
    return g.filter("np > 0 and nn > 0")


@query("pclass_risk", """SELECT 'label' AS per, unit AS id, round(sum(CASE WHEN pos = 1 THEN exp(-s) END) / sum(pos) + sum(CASE WHEN pos = 0 THEN exp(2 * s) END) / (2 * sum(1 - pos)), 6) AS risk
    FROM sc GROUP BY unit HAVING sum(pos) > 0 AND sum(1 - pos) > 0 UNION ALL
    SELECT 'example', item, round(sum(CASE WHEN pos = 1 THEN exp(-s) END) / sum(pos) + sum(CASE WHEN pos = 0 THEN exp(2 * s) END) / (2 * sum(1 - pos)), 6) FROM sc GROUP BY item HAVING sum(pos) > 0 AND sum(1 - pos) > 0""", "scored", SC)
def pclass_risk(spark, sf):
    """p-classification risk with p = 2, per label and per example."""
    d, p = centred(spark, sf), 2
    out = None
    for per, unit in (("label", "unit"), ("example", "item")):
        g = _sides(d, unit, F.exp(-F.col("s")), F.exp(p * F.col("s")))
        g = g.select(F.lit(per).alias("per"), F.col(unit).alias("id"), _r(F.col("sp") / F.col("np") + F.col("sn") / (p * F.col("nn")), "risk"))
        out = g if out is None else out.unionByName(g)
    return out


@query("bottom_push_risk", "SELECT count(*) AS lists, round(avg(risk), 6) AS risk FROM (SELECT sum(CASE WHEN pos = 1 THEN exp(-2 * s) END) / sum(pos) / 2 + sum(CASE WHEN pos = 0 THEN exp(s) END) / sum(1 - pos) AS risk FROM sc GROUP BY unit HAVING sum(pos) > 0 AND sum(1 - pos) > 0)", "scored", SC)
def bottom_push_risk(spark, sf):
    g = _sides(centred(spark, sf), "unit", F.exp(-2 * F.col("s")), F.exp(F.col("s")))
    return g.agg(F.count("*").alias("lists"), _r(F.avg(F.col("sp") / F.col("np") / 2 + F.col("sn") / F.col("nn")), "risk"))


WEIGHT = "wt AS (SELECT o_custkey AS usr, o_orderkey AS pid, [sum(l_quantity) / 10, sum(l_discount), count(*)::DOUBLE] AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def list_weights(spark, sf):
    """One weight vector per list, derived from its lines."""
    li = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pid")).agg(
        F.array(F.sum("l_quantity") / 10, F.sum("l_discount"), F.count("*").cast("double")).alias("w"))
    return li.join(v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("usr")), "pid")


def pair_distance_sums(w, unit):
    """Per unit: number of ordered pairs and the sum of squared distances over them, n * sum|w|^2 - |sum w|^2, doubled."""
    by = [unit] if unit else []
    x = w.select(*by, F.posexplode("w").alias("i", "z"))
    per = x.groupBy(*by, "i").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    return per.groupBy(*by).agg(F.max("n").alias("n"), F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))).alias("d"))


@query("multitask_penalty", """SELECT round(sum(d) / sum(n * (n - 1)), 6) AS penalty, (sum(n * (n - 1)))::BIGINT AS pairs FROM (SELECT a.usr, sum((a.w[1]-b.w[1])**2 + (a.w[2]-b.w[2])**2 + (a.w[3]-b.w[3])**2) AS d, any_value(n) AS n
    FROM wt a JOIN wt b ON a.usr = b.usr JOIN (SELECT usr, count(*) AS n FROM wt GROUP BY usr) k ON k.usr = a.usr GROUP BY a.usr)""", extra=WEIGHT)
def multitask_penalty(spark, sf):
    """Mean squared distance between the weights of two lists of one user, without forming the pairs."""
    g = pair_distance_sums(list_weights(spark, sf), "usr").filter("n > 1")
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    return g.agg(_r(F.sum("d") / pairs, "penalty"), pairs.alias("pairs"))


@query("weight_distance", """SELECT (usr_a = usr_b)::INT AS same_user, sum(k)::BIGINT AS pairs, round(sum(d) / sum(k) / max(mx), 6) AS mean_sq FROM (
    SELECT a.usr AS usr_a, b.usr AS usr_b, a.n * b.n - CASE WHEN a.usr = b.usr THEN a.n ELSE 0 END AS k,
      a.n * b.q + b.n * a.q - 2 * (a.s1 * b.s1 + a.s2 * b.s2 + a.s3 * b.s3) AS d, mx
    FROM us a CROSS JOIN us b CROSS JOIN (SELECT max(w[1]**2 + w[2]**2 + w[3]**2) AS mx FROM wt)) GROUP BY 1""", extra=WEIGHT + ", us AS (SELECT usr, count(*) AS n, sum(w[1]) AS s1, sum(w[2]) AS s2, sum(w[3]) AS s3, sum(w[1]**2 + w[2]**2 + w[3]**2) AS q FROM wt GROUP BY usr)")
def weight_distance(spark, sf):
    """Mean squared weight distance of same-user and of other pairs of lists, over the largest squared norm; closed form."""
    w = list_weights(spark, sf)
    same = pair_distance_sums(w, "usr").agg(F.struct(F.sum(F.col("n") * (F.col("n") - 1)).alias("k"), F.sum("d").alias("d"))).scalar()
    top = w.agg(F.max(c.dot(F.col("w"), F.col("w")))).scalar()
    a = pair_distance_sums(w, None).select((F.col("n") * (F.col("n") - 1)).alias("k"), "d", same.alias("same"), top.alias("top"))
    row = lambda flag, k, d: F.struct(F.lit(flag).alias("same_user"), k.alias("pairs"), F.round(d / k / F.col("top"), 6).alias("mean_sq"))
    k1, d1 = F.col("same.k"), F.col("same.d")
    return a.select(F.explode(F.array(row(1, k1, d1), row(0, F.col("k") - k1, F.col("d") - d1))).alias("x")).select("x.*")


@query("rank_losses_train", """SELECT unit, round(tp, 6) AS top_push, round(pow(ep / np, 2) * en2 / nn, 6) AS p_norm, round(iw, 6) AS instance, round(tp + 0.5 * xe, 6) AS hybrid, round(pl / np / nn, 6) AS pairwise FROM (
    SELECT s.unit, any_value(np) AS np, any_value(nn) AS nn, avg(CASE WHEN pos = 1 THEN ln(1 + exp(-s + ln(zr) / 4)) END) AS tp, sum(CASE WHEN pos = 1 THEN exp(-s) END) AS ep, sum(CASE WHEN pos = 0 THEN exp(2 * s) END) AS en2,
    sum(CASE WHEN pos = 1 THEN ln(1 + exp(-s)) / np ELSE ln(1 + exp(s)) / nn END) AS iw, sum(CASE WHEN pos = 0 THEN ln(1 + exp(s)) / nn END) AS xe
    FROM sc s JOIN (SELECT unit, sum(pos) AS np, sum(1 - pos) AS nn, sum(CASE WHEN pos = 0 THEN exp(4 * s) END) AS zr FROM sc GROUP BY unit HAVING sum(pos) > 0 AND sum(1 - pos) > 0) z USING (unit) GROUP BY s.unit)
    JOIN (SELECT a.unit, sum(ln(1 + exp(b.s - a.s))) AS pl FROM sc a JOIN sc b ON a.unit = b.unit AND a.pos = 1 AND b.pos = 0 GROUP BY 1) USING (unit)""", "scored", SC)
def rank_losses_train(spark, sf):
    """Top-push (log-sum-exp with r = 4), p-norm push (p = 2), instance-weighted logistic, hybrid and mean logistic loss over all pairs; the
    last by series on cells of scores, without pairs."""
    d, r, p = centred(spark, sf), 4, 2
    y = F.col("pos") == 1
    z = _sides(d, "unit", F.lit(1.0), F.exp(r * F.col("s"))).select("unit", "np", "nn", F.col("sn").alias("zr"))
    x = d.join(z, "unit")
    log1pexp = lambda t: F.log1p(F.exp(t))
    S = F.col("s")
    g = x.groupBy("unit").agg(
        F.max("np").alias("np"), F.max("nn").alias("nn"),
        F.avg(F.when(y, log1pexp(-S + F.ln("zr") / r))).alias("tp"),
        F.sum(F.when(y, F.exp(-S))).alias("ep"), F.sum(F.when(~y, F.exp(p * S))).alias("en"),
        F.sum(F.when(y, log1pexp(-S) / F.col("np")).otherwise(log1pexp(S) / F.col("nn"))).alias("iw"),
        F.sum(F.when(~y, log1pexp(S) / F.col("nn"))).alias("xe"))
    pairs = fd.logistic_slopes(x.select("unit", "pos", S.cast("double").alias("s"), F.lit(1.0).alias("wt")), ["unit"])
    g = g.join(pairs.groupBy("unit").agg(F.sum("loss").alias("pl")), "unit")
    return g.select("unit", _r("tp", "top_push"), _r(F.pow(F.col("ep") / F.col("np"), F.lit(p)) * F.col("en") / F.col("nn"), "p_norm"),
                    _r("iw", "instance"), _r(F.col("tp") + 0.5 * F.col("xe"), "hybrid"), _r(F.col("pl") / F.col("np") / F.col("nn"), "pairwise"))


@query("markov_nll", "SELECT a.traj, round(-sum(ln(e.n) - ln(z.z)), 6) AS nll FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1 JOIN edges e ON e.src = a.poi AND e.dst = b.poi JOIN (SELECT src, sum(n) AS z FROM edges GROUP BY src) z ON z.src = a.poi GROUP BY a.traj", "cseq", EDGES)
def markov_nll(spark, sf):
    """Negative conditional log-likelihood of trajectories; the score of a step is the log of its edge count."""
    _, seq = city(spark, sf)
    e = s.edge_counts(seq).withColumn("score", F.ln("n"))
    top = e.groupBy("src").agg(F.max("score").alias("m"))
    z = e.join(top, "src").groupBy("src").agg((F.max("m") + F.ln(F.sum(F.exp(F.col("score") - F.col("m"))))).alias("lse"))
    return s.steps(seq).join(e, ["src", "dst"]).join(z, "src").groupBy("traj").agg(_r(-F.sum(F.col("score") - F.col("lse")), "nll"))


@query("mf_rmse", "SELECT count(*) AS cells, round(sqrt(avg(pow(l_quantity - (c_acctbal / 1000 * p_size / 10 + p_retailprice / 100), 2))), 6) AS rmse FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey")
def mf_rmse(spark, sf):
    """Root mean squared error of given two-dimensional factors on the observed cells."""
    u = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("usr"), F.array(F.col("c_acctbal") / 1000, F.lit(1.0)).alias("f"))
    i = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.array(F.col("p_size") / 10, F.col("p_retailprice") / 100).alias("g"))
    od = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("usr"))
    d = v.table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity").join(od, "l_orderkey").join(u, "usr").join(i, "l_partkey")
    return d.agg(F.count("*").alias("cells"), _r(F.sqrt(F.avg(F.pow(F.col("l_quantity") - c.dot(F.col("f"), F.col("g")), F.lit(2.0)))), "rmse"))


RUNS = "runs AS (SELECT l_suppkey AS q, l_linenumber AS c, l_tax AS alpha, l_discount AS metric FROM lineitem)"


@query("grid_best", "SELECT q, c, alpha, metric FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY metric DESC, c, alpha) AS r FROM (SELECT q, c, alpha, round(avg(metric), 9) AS metric FROM runs GROUP BY 1, 2, 3)) WHERE r = 1", extra=RUNS)
def grid_best(spark, sf):
    """Best (C, alpha) per query by mean metric; the smallest setting wins ties."""
    r = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_linenumber").alias("c"), F.col("l_tax").alias("alpha"), F.col("l_discount").alias("metric"))
    g = r.groupBy("q", "c", "alpha").agg(F.round(F.avg("metric"), 9).alias("metric"))
    best = F.min(F.struct((-F.col("metric")).alias("k"), "c", "alpha", "metric"))
    return g.groupBy("q").agg(best.alias("b")).select("q", "b.c", "b.alpha", "b.metric")


CUM = """tie AS (SELECT unit, score, sum(count(*)) OVER w AS cn, sum(sum(pos)) OVER w AS cp, count(*) AS n, sum(pos) AS np FROM scored GROUP BY unit, score WINDOW w AS (PARTITION BY unit ORDER BY score DESC)),
    tot AS (SELECT unit, count(*) AS n, sum(pos)::BIGINT AS p FROM scored GROUP BY unit)"""


@query("threshold_search", "SELECT unit, score AS threshold, round(f1, 6) AS f1 FROM (SELECT t.unit, t.score, 2.0::DOUBLE * cp / (p + cn) AS f1, row_number() OVER (PARTITION BY t.unit ORDER BY 2.0::DOUBLE * cp / (p + cn) DESC, t.score DESC) AS r FROM tie t JOIN tot USING (unit) WHERE p > 0) WHERE r = 1", "scored", CUM)
def threshold_search(spark, sf):
    """Threshold with the best F1 per label, over all distinct scores instead of random candidates."""
    d = v.scored(spark, sf)
    t = m.tie_table(d).join(m.totals(d).select("unit", "P"), "unit").filter("P > 0")
    f = t.withColumn("f1", 2.0 * F.col("cum_pos") / (F.col("P") + F.col("cum_n")))
    return f.groupBy("unit").agg(F.max(F.struct("f1", "score")).alias("b")).select("unit", F.col("b.score").alias("threshold"), _r("b.f1", "f1"))


@query("group_top_bottom", """SELECT genre, side, rank, song, title, coef, n FROM (SELECT genre, 'top' AS side, row_number() OVER (PARTITION BY genre ORDER BY coef DESC, song) AS rank, song, title, coef, count(*) OVER (PARTITION BY genre) AS n FROM cf
    UNION ALL SELECT genre, 'bottom', row_number() OVER (PARTITION BY genre ORDER BY coef, song), song, title, coef, count(*) OVER (PARTITION BY genre) FROM cf) WHERE rank <= 10""", "song", "cf AS (SELECT genre, song, title, p_retailprice AS coef FROM song JOIN part ON p_partkey = song WHERE genre IS NOT NULL)")
def group_top_bottom(spark, sf):
    """Ten largest and ten smallest coefficients per genre with names and group size."""
    d = v.song(spark, sf).filter("genre is not null").join(v.table(spark, sf, "part").select(F.col("p_partkey").alias("song"), F.col("p_retailprice").alias("coef")), "song")
    n = d.groupBy("genre").agg(F.count("*").alias("n"))
    side = lambda name, order: o.top_k(d, ["genre"], [order, "song"], 10).withColumn("side", F.lit(name))
    both = side("top", F.desc("coef")).unionByName(side("bottom", F.asc("coef")))
    return both.join(n, "genre").select("genre", "side", F.col("rank").cast("long").alias("rank"), "song", "title", "coef", "n")
