"""Sequence metrics: predicted paths against all true trajectories of a query."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import metrics as ms, sequence as s, walks as wk
from recset.plans import query
from recset.plans.paths import EW, NEED as PATHS, VIT, setup as path_setup
from recset.plans.profiles import _r, city_queries
from recset.plans.rankers import DRAWS, LOSS, RANDOM, city_paths, popularity_paths
from recset.plans.sequences import city
from recset.session import share
from recset.sources import views as v

PRED = LOSS + f""", pred AS (SELECT qid, 'pop' AS method, 1 AS k, list_prepend(start, list(poi ORDER BY rn)) AS path FROM (SELECT q.qid, q.start, q.len, i.poi,
    row_number() OVER (PARTITION BY q.qid ORDER BY i.pop - coalesce(lost, 0) DESC, i.poi) AS rn FROM cquery q JOIN cinfo i ON i.poi <> q.start LEFT JOIN lossp l ON l.qid = q.qid AND l.poi = i.poi) WHERE rn < len GROUP BY qid, start
    UNION ALL SELECT qid, 'rand', draw, list_prepend(start, list(poi ORDER BY rn)) FROM (SELECT qid, draw, start, len, poi,
    row_number() OVER (PARTITION BY qid, draw ORDER BY md5(poi || '|' || start || '|' || len || '|' || draw || '|rnd'), poi) AS rn FROM cquery, cpoi, {DRAWS} WHERE poi <> start) WHERE rn < len GROUP BY qid, draw, start),
    truth AS (SELECT qid, traj, path AS y FROM ctraj JOIN cquery USING (start, len)),
    pt AS (SELECT qid, method, k, traj, path, y FROM pred JOIN truth USING (qid))"""
NEED = "ctraj cquery cseq cvisit cinfo cpoi"
F1P = "f1p AS (SELECT *, len(list_intersect(path, y)) AS h, 2.0::DOUBLE * len(list_intersect(path, y)) / (len(path) + len(y)) AS f1 FROM pt)"
# ordered pairs by position tables
POS = """pp AS (SELECT qid, method, k, unnest(path) AS poi, unnest(range(1, len(path) + 1)) AS i FROM pred), tp AS (SELECT qid, traj, unnest(y) AS poi, unnest(range(1, len(y) + 1)) AS i FROM truth),
    bth AS (SELECT p.qid, p.method, p.k, t.traj, p.poi, p.i AS pi, t.i AS ti FROM pp p JOIN tp t USING (qid, poi)),
    nc AS (SELECT a.qid, a.method, a.k, a.traj, count(*) AS nc FROM bth a JOIN bth b ON a.qid = b.qid AND a.method = b.method AND a.k = b.k AND a.traj = b.traj AND a.pi < b.pi AND a.ti < b.ti GROUP BY 1, 2, 3, 4),
    pf AS (SELECT pt.qid, pt.method, pt.k, pt.traj, 2.0::DOUBLE * coalesce(nc, 0) / (len(path) * (len(path) - 1) // 2 + len(y) * (len(y) - 1) // 2) AS pf1 FROM pt LEFT JOIN nc USING (qid, method, k, traj))"""
TAU = """grid AS (SELECT pt.*, p.poi FROM pt, cpoi p), rkk AS (SELECT qid, method, k, traj, poi, CASE WHEN list_position(path, poi) > 0 THEN 26 - list_position(path, poi) ELSE 0 END AS r1, CASE WHEN list_position(y, poi) > 0 THEN 26 - list_position(y, poi) ELSE 0 END AS r2 FROM grid),
    tau AS (SELECT a.qid, a.method, a.k, a.traj, sum(sign(a.r1 - b.r1) * sign(a.r2 - b.r2))::DOUBLE / sqrt(sum(abs(sign(a.r1 - b.r1)))::DOUBLE * sum(abs(sign(a.r2 - b.r2)))::DOUBLE) AS tau
    FROM rkk a JOIN rkk b ON a.qid = b.qid AND a.method = b.method AND a.k = b.k AND a.traj = b.traj AND a.poi < b.poi GROUP BY 1, 2, 3, 4)"""
ALL3 = PRED + ", " + F1P + ", " + POS + ", " + TAU + ", ev AS (SELECT f1p.qid, f1p.method, f1p.k, f1p.traj, len(y) AS len, round(f1, 9) AS f1, round(pf1, 9) AS pf1, round(tau, 9) AS tau FROM f1p JOIN pf USING (qid, method, k, traj) JOIN tau USING (qid, method, k, traj))"


def predictions(spark, sf, p):
    """pred(qid, start, len, method, k, path): one popularity path and RANDOM random paths per query."""
    from recset.plans.rankers import with_places
    pop = popularity_paths(spark, sf, p).select("qid", "start", "len", F.lit("pop").alias("method"), F.lit(1).alias("k"), "path")
    q = with_places(pop.select("qid", "start", "len"), v.city_poi(spark, sf)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(RANDOM))))
    key = lambda p: F.md5(F.concat_ws("|", p.cast("string"), F.col("start").cast("string"), F.col("len").cast("string"), F.col("k").cast("string"), F.lit("rnd")))
    order = F.filter(F.transform(F.array_sort(F.transform("all", lambda p: F.struct(key(p).alias("h"), p.alias("p")))), lambda x: x["p"]), lambda p: p != F.col("start"))
    rnd = q.select("qid", "start", "len", F.lit("rand").alias("method"), "k", F.concat(F.array("start"), F.slice(order, 1, F.col("len") - 1)).alias("path"))
    return share(pop.unionByName(rnd))


def evaluated(spark, sf):
    """One row per (prediction, truth) with the paths; truths stay rows, so a query with many truths is spread."""
    p = city_paths(spark, sf)
    truth = p.select("traj", "start", "len", F.col("path").alias("y"))
    pred = predictions(spark, sf, p).select("qid", "start", "len", "method", "k", "path")
    return truth.join(pred, ["start", "len"])


def f1_points():
    return c.f1(F.size(F.array_intersect("path", "y")), F.size("y"), F.size("path"))


def f1_pairs():
    n = lambda p: F.size(p) * (F.size(p) - 1) / 2
    hits = F.size(F.array_intersect(c.pairs_of(F.col("path")), c.pairs_of(F.col("y"))))
    return c.f1(hits, n("y"), n("path"))


METRICS = ["f1", "pf1", "tau"]


def three(spark, sf):
    m = F.lit(0) + v.city_poi(spark, sf).agg(F.count("*")).scalar()
    d = evaluated(spark, sf).withColumn("e", ms.path_agreement("path", "y", m.cast("long")))
    return d.select("qid", "method", "k", "traj", "len", *[F.round(f"e.{x}", 9).alias(x) for x in METRICS])


@query("m_f1_points", "SELECT qid, method, k, traj, round(f1, 6) AS f1 FROM f1p", NEED, PRED + ", " + F1P)
def m_f1_points(spark, sf):
    return evaluated(spark, sf).select("qid", "method", "k", "traj", _r(f1_points(), "f1"))


@query("m_f1_pairs", "SELECT qid, method, k, traj, round(pf1, 6) AS pf1 FROM pf", NEED, PRED + ", " + POS)
def m_f1_pairs(spark, sf):
    p = city_paths(spark, sf)
    truth = p.select("traj", "start", "len", F.col("path").alias("y"))
    return ms.pair_values(truth, predictions(spark, sf, p), lambda hits, n_true, n_pred: F.round(c.f1(hits, n_true, n_pred), 6), "pf1")


@query("m_f1_pairs_path", """SELECT qid, method, k, traj, round(2.0::DOUBLE * coalesce(nc, 0) / (n1 + n0), 6) AS pf1 FROM (SELECT qid, method, k, traj, 2 * len(path) * (2 * len(path) - 1) // 2 AS n1, len(y) * (len(y) - 1) // 2 AS n0 FROM pt)
    LEFT JOIN (SELECT a.qid, a.method, a.k, t1.traj, count(*) AS nc FROM wp a JOIN wp b ON a.qid = b.qid AND a.method = b.method AND a.k = b.k AND a.i < b.i AND a.poi <> b.poi JOIN tp t1 ON t1.qid = a.qid AND t1.poi = a.poi JOIN tp t2 ON t2.qid = b.qid AND t2.traj = t1.traj AND t2.poi = b.poi AND t1.i < t2.i GROUP BY 1, 2, 3, 4) USING (qid, method, k, traj)""",
       NEED, PRED + ", tp AS (SELECT qid, traj, unnest(y) AS poi, unnest(range(1, len(y) + 1)) AS i FROM truth), w2 AS (SELECT qid, method, k, list_concat(list_reverse(path), path) AS p FROM pred), wp AS (SELECT qid, method, k, unnest(p) AS poi, unnest(range(len(p))) AS i FROM w2)")
def m_f1_pairs_path(spark, sf):
    """Pairs of a path that repeats POI (there and back again), counted with repetition against a loop-free truth."""
    d = evaluated(spark, sf).withColumn("path", F.concat(F.reverse("path"), "path"))
    n = lambda p: F.size(p) * (F.size(p) - 1) / 2
    at = F.transform("path", lambda p: F.array_position(F.col("y"), p))

    def count(pos):
        later = lambda a, i: F.size(F.filter(F.slice(pos, i + 2, F.size(pos)), lambda b: (a > 0) & (b > a)))
        return F.aggregate(F.transform(pos, later), F.lit(0), lambda x, z: x + z)

    return d.select("qid", "method", "k", "traj", _r(c.f1(c.let(at, count), n("y"), n("path")), "pf1"))


@query("m_kendall_tau", "SELECT qid, method, k, traj, round(tau, 6) AS tau FROM tau", NEED, PRED + ", " + TAU)
def m_kendall_tau(spark, sf):
    return three(spark, sf).select("qid", "method", "k", "traj", _r("tau", "tau"))


@query("m_hamming_seq", "SELECT qid, method, len, round(min(h::DOUBLE / len), 6) AS best, round(sum(h)::DOUBLE / sum(len), 6) AS mean FROM (SELECT qid, method, k, traj, len(any_value(y)) AS len, sum((path[i] <> y[i])::INT) AS h FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM pt) GROUP BY qid, method, k, traj) GROUP BY qid, method, len", NEED, PRED)
def m_hamming_seq(spark, sf):
    """Share of differing positions: minimum and mean over the truths and predictions of a query, by method."""
    diff = F.aggregate(F.zip_with("path", "y", lambda a, b: (a != b).cast("int")), F.lit(0), lambda x, z: x + z)
    d = evaluated(spark, sf).select("qid", "method", "len", diff.alias("h"))
    return d.groupBy("qid", "method", "len").agg(_r(F.min(F.col("h") / F.col("len")), "best"), _r(F.sum("h") / F.sum("len"), "mean"))


@query("m_truth_diversity", "SELECT qid, count(*) AS pairs, round(avg(h), 6) AS diversity FROM (SELECT a.qid, a.traj AS t1, b.traj AS t2, list_sum([(x[1] <> x[2])::INT FOR x IN list_zip(a.y, b.y)])::DOUBLE / len(a.y) AS h FROM (SELECT qid, traj, path AS y FROM ctraj JOIN cquery USING (start, len)) a JOIN (SELECT qid, traj, path AS y FROM ctraj JOIN cquery USING (start, len)) b ON a.qid = b.qid AND a.traj < b.traj) GROUP BY qid", "ctraj cquery")
def m_truth_diversity(spark, sf):
    """Mean pairwise Hamming distance between the truths of a query, from value counts per position; no pairs."""
    _, seq = city(spark, sf)
    t = share(s.paths(seq).select("traj", "start", "len"))
    per = seq.join(t, "traj").groupBy("start", "len", "ord", "poi").agg(F.count("*").alias("k"))
    pos = per.groupBy("start", "len", "ord").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    g = pos.groupBy("start", "len").agg(F.max("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("d")).filter("n > 1")
    return city_queries(t).join(g, ["start", "len"]).select("qid", pairs.cast("long").alias("pairs"), _r(F.col("d") / pairs / F.col("len"), "diversity"))


BEST = "best AS (SELECT qid, method, any_value(len) AS len, max(f1) AS f1, max(pf1) AS pf1, max(tau) AS tau, count(DISTINCT traj) AS truths FROM ev GROUP BY qid, method)"


def best_of_k(ev, *by):
    """Each metric on its own: best over the truths, then best over the top k."""
    return ev.groupBy("qid", "method", *by).agg(*[F.max(x).alias(x) for x in METRICS])


@query("m_best_of_k", "SELECT b.qid, b.method, round(f1, 6) AS f1, round(pf1, 6) AS pf1, round(tau, 6) AS tau, round(mf, 6) AS mean_f1 FROM best b JOIN (SELECT qid, method, max(m) AS mf FROM (SELECT qid, method, k, avg(f1) AS m FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (qid, method)", NEED, ALL3 + ", " + BEST)
def m_best_of_k(spark, sf):
    """Best over truths and top k per metric; `mean_f1` averages over the truths first."""
    per = three(spark, sf).groupBy("qid", "method", "k").agg(*[F.max(x).alias(x) for x in METRICS], F.avg("f1").alias("mean_f1"))
    return per.groupBy("qid", "method").agg(*[_r(F.max(x), x) for x in [*METRICS, "mean_f1"]])


@query("m_best_f1_triple", "SELECT qid, method, f1, pf1, tau FROM (SELECT qid, method, k, max(f1) AS f1, max(pf1) AS pf1, max(tau) AS tau, row_number() OVER (PARTITION BY qid, method ORDER BY max(f1) DESC, k) AS r FROM ev GROUP BY 1, 2, 3) WHERE r = 1".replace("f1, pf1, tau FROM (", "round(f1, 6) AS f1, round(pf1, 6) AS pf1, round(tau, 6) AS tau FROM ("), NEED, ALL3)
def m_best_f1_triple(spark, sf):
    """All three metrics of the prediction with the best F1 (first one on ties)."""
    per = three(spark, sf).groupBy("qid", "method", "k").agg(*[F.max(x).alias(x) for x in METRICS])
    best = F.min(F.struct((-F.col("f1")).alias("o"), "k", *METRICS))
    return per.groupBy("qid", "method").agg(best.alias("b")).select("qid", "method", *[_r(f"b.{x}", x) for x in METRICS])


@query("m_summary", "SELECT method, count(*) AS n, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_pop({x}) / sqrt(count(*)), 6) AS {x}_se, sum((abs({x} - 1) < 1e-6)::INT)::BIGINT AS {x}_perfect" for x in METRICS) + " FROM best GROUP BY method", NEED, ALL3 + ", " + BEST)
def m_summary(spark, sf):
    b = best_of_k(three(spark, sf))
    aggs = [f for x in METRICS for f in (_r(F.avg(x), f"{x}_mean"), _r(F.stddev_pop(x) / F.sqrt(F.count("*")), f"{x}_se"), F.sum((F.abs(F.col(x) - 1) < 1e-6).cast("long")).alias(f"{x}_perfect"))]
    return b.groupBy("method").agg(F.count("*").alias("n"), *aggs)


@query("m_topk_short_long", "SELECT method, top, short, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(tau), 6) AS tau FROM (SELECT qid, method, t.top, (any_value(len) < 5)::INT AS short, max(f1) AS f1, max(tau) AS tau FROM ev JOIN (SELECT unnest(range(1, 11)) AS top) t ON k <= top GROUP BY qid, method, t.top) GROUP BY 1, 2, 3", NEED, ALL3)
def m_topk_short_long(spark, sf):
    """Metric by k = 1..10 and by short or long queries; a prediction counts for every k at or above its rank."""
    per = three(spark, sf).groupBy("qid", "method", "k", "len").agg(F.max("f1").alias("f1"), F.max("tau").alias("tau"))
    d = per.withColumn("top", F.explode(F.sequence(F.col("k"), F.lit(RANDOM)))).groupBy("qid", "method", "top", "len").agg(F.max("f1").alias("f1"), F.max("tau").alias("tau"))
    return d.groupBy("method", "top", (F.col("len") < 5).cast("int").alias("short")).agg(F.count("*").alias("n"), _r(F.avg("f1"), "f1"), _r(F.avg("tau"), "tau"))


@query("m_diff_to_baseline", "SELECT r.method, " + ", ".join(f"round(avg(r.{x} - b.{x}), 6) AS {x}_diff, round(stddev_pop(r.{x} - b.{x}) / sqrt(count(*)), 6) AS {x}_se" for x in METRICS) + " FROM best r JOIN best b ON r.qid = b.qid AND b.method = 'rand' AND r.method <> 'rand' GROUP BY r.method", NEED, ALL3 + ", " + BEST)
def m_diff_to_baseline(spark, sf):
    """Mean and standard error of the per-query difference to the random method."""
    b = share(best_of_k(three(spark, sf)))
    base = b.filter("method = 'rand'").select("qid", *[F.col(x).alias(f"b_{x}") for x in METRICS])
    d = b.filter("method <> 'rand'").join(base, "qid")
    diff = lambda x: F.col(x) - F.col(f"b_{x}")
    return d.groupBy("method").agg(*[f for x in METRICS for f in (_r(F.avg(diff(x)), f"{x}_diff"), _r(F.stddev_pop(diff(x)) / F.sqrt(F.count("*")), f"{x}_se"))])


@query("m_method_wins", "SELECT r.qid, round(r.f1 - p.f1, 6) AS gain FROM best r JOIN best p ON r.qid = p.qid AND r.method = 'rand' AND p.method = 'pop' WHERE r.len > 2 AND r.truths > 1 AND r.f1 > p.f1 AND r.pf1 > p.pf1 AND r.tau > p.tau", NEED, ALL3 + ", " + BEST)
def m_method_wins(spark, sf):
    """Queries longer than 2 with several truths in which the random group beats popularity in all three metrics."""
    ev = three(spark, sf)
    side = lambda m: [F.max(F.when(F.col("method") == m, F.col(x))).alias(f"{m}_{x}") for x in METRICS]
    g = ev.groupBy("qid", "len").agg(*side("rand"), *side("pop"), F.min("traj").alias("t0"), F.max("traj").alias("t1"))
    wins = F.lit(True)
    for x in METRICS:
        wins = wins & (F.col(f"rand_{x}") > F.col(f"pop_{x}"))
    return g.filter(wins & (F.col("len") > 2) & (F.col("t0") < F.col("t1"))).select("qid", F.round(F.col("rand_f1") - F.col("pop_f1"), 6).alias("gain"))


@query("m_loop_share", "SELECT len, count(*) AS n, round(avg((len > len(list_distinct(path)))::INT), 6) AS share FROM (SELECT q.len, arg_min(path, (-score, path)) AS path FROM cquery q JOIN vit ON vit.start = q.start AND vit.n = q.len GROUP BY qid, q.len) GROUP BY len", PATHS, EW + VIT, recursive=True)
def m_loop_share(spark, sf):
    """Share of predicted walks (the best by score, which may repeat POI) that do repeat one, by length."""
    q, st, store, _ = path_setup(spark, sf)
    d = wk.each_length(st, store, wk.best_walks).withColumn("loop", (F.size(F.array_distinct("path")) < F.size("path")).cast("int"))
    return q.join(d, ["start", "len"]).groupBy("len").agg(F.count("*").alias("n"), _r(F.avg("loop"), "share"))


def GRAMS(n):
    g = lambda p: f"unnest([array_to_string({p}[i:i + {n - 1}], ' ') FOR i IN range(1, len({p}) - {n - 2})])"
    return f"cg{n} AS (SELECT qid, g, count(*) AS h FROM (SELECT qid, {g('path')} AS g FROM pred WHERE method = 'pop') GROUP BY 1, 2), sg{n} AS (SELECT qid, traj, g, count(*) AS h FROM (SELECT qid, traj, {g('y')} AS g FROM truth) GROUP BY 1, 2, 3)"


def grams(d, key, path, n):
    return d.select(*key, F.explode(c.ngrams(F.col(path), n)).alias("g")).groupBy(*key, "g").agg(F.count("*").alias("h"))


def cand_refs(spark, sf):
    p = city_paths(spark, sf)
    pred = share(popularity_paths(spark, sf, p).select("qid", "start", "len", "path"))
    truth = share(p.select("traj", "start", "len", F.col("path").alias("y")).join(pred.select("qid", "start", "len"), ["start", "len"]).select("qid", "traj", "y"))
    return pred.select("qid", "path"), truth


@query("m_bleu", """SELECT round(bp * exp(0.5 * ln(c1) + 0.5 * ln(c2)), 6) AS bleu_2, round(c1, 6) AS cp_1, round(c2, 6) AS cp_2 FROM
    (SELECT (SELECT sum(least(c.h, m.h)) FROM cg1 c JOIN (SELECT qid, g, max(h) AS h FROM sg1 GROUP BY 1, 2) m USING (qid, g))::DOUBLE / (SELECT sum(h) FROM cg1) AS c1,
    (SELECT sum(least(c.h, m.h)) FROM cg2 c JOIN (SELECT qid, g, max(h) AS h FROM sg2 GROUP BY 1, 2) m USING (qid, g))::DOUBLE / (SELECT sum(h) FROM cg2) AS c2, 1.0 AS bp)""", NEED, PRED + ", " + GRAMS(1) + ", " + GRAMS(2))
def m_bleu(spark, sf):
    """Corpus BLEU with 1- and 2-grams: clipped precision and brevity penalty with the closest reference length."""
    pred, truth = cand_refs(spark, sf)
    cp = []
    for n in (1, 2):
        cand = grams(pred, ["qid"], "path", n)
        ref = grams(truth, ["qid", "traj"], "y", n).groupBy("qid", "g").agg(F.max("h").alias("m"))
        hit = cand.join(ref, ["qid", "g"], "left").agg((F.sum(F.least("h", F.coalesce("m", F.lit(0)))) / F.sum("h")).alias("x"))
        cp.append(hit.scalar())
    lens = pred.select("qid", F.size("path").alias("lc")).join(truth.select("qid", F.size("y").alias("ls")).distinct(), "qid")
    near = lens.groupBy("qid").agg(F.max("lc").alias("lc"), F.min(F.struct(F.abs(F.col("ls") - F.col("lc")).alias("a"), "ls")).alias("b"))
    one = near.agg(F.sum("lc").alias("lc"), F.sum("b.ls").alias("ls")).select("lc", "ls", cp[0].alias("c1"), cp[1].alias("c2"))
    bp = F.when(F.col("lc") > F.col("ls"), 1.0).otherwise(F.exp(1 - F.col("ls") / F.col("lc")))
    return one.select(_r(bp * F.exp((F.ln("c1") + F.ln("c2")) / 2), "bleu_2"), _r("c1", "cp_1"), _r("c2", "cp_2"))


ROUGE = lambda n: f"(SELECT qid, sum(least(coalesce(c.h, 0), s.h))::DOUBLE / sum(s.h) AS r FROM sg{n} s LEFT JOIN cg{n} c USING (qid, g) GROUP BY qid)"


@query("m_rouge", f"""SELECT a.qid, round(a.r, 6) AS rouge_1, round(b.r, 6) AS rouge_2, round(coalesce(s.f, 0), 6) AS rouge_s FROM {ROUGE(1)} a JOIN {ROUGE(2)} b USING (qid)
    JOIN (SELECT qid, CASE WHEN max(p) > 0 THEN 2.44 * max(p) * max(p) / (max(p) + 1.44 * max(p)) ELSE 0 END AS f FROM (SELECT pf.qid, pf1 AS p FROM pf WHERE method = 'pop') GROUP BY qid) s USING (qid)""", NEED, PRED + ", " + POS + ", " + GRAMS(1) + ", " + GRAMS(2))
def m_rouge(spark, sf):
    """ROUGE-1 and -2 recall over all references; ROUGE-S from ordered pairs with beta = 1.2."""
    pred, truth = cand_refs(spark, sf)
    out = None
    for n in (1, 2):
        cand = grams(pred, ["qid"], "path", n).withColumnRenamed("h", "hc")
        r = grams(truth, ["qid", "traj"], "y", n).join(cand, ["qid", "g"], "left").groupBy("qid").agg(
            _r(F.sum(F.least(F.coalesce("hc", F.lit(0)), F.col("h"))) / F.sum("h"), f"rouge_{n}"))
        out = r if out is None else out.join(r, "qid")
    sk = truth.join(pred, "qid").select("qid", c.pairs_of(F.col("path")).alias("a"), c.pairs_of(F.col("y")).alias("b"))
    hit = F.size(F.array_intersect("a", "b"))
    sk = sk.groupBy("qid").agg(F.max(hit / F.size("b")).alias("r"), F.max(hit / F.size("a")).alias("p"))
    return out.join(sk, "qid").select("qid", "rouge_1", "rouge_2", _r(f_beta(F.col("r"), F.col("p")), "rouge_s"))


def f_beta(r, p, beta=1.2):
    b2 = beta * beta
    return F.when(r + p > 0, (1 + b2) * r * p / (r + b2 * p)).otherwise(F.lit(0.0))


@query("m_rouge_l")
def m_rouge_l(spark, sf):
    """ROUGE-L: longest common subsequence against every reference, beta = 1.2."""
    pred, truth = cand_refs(spark, sf)
    d = truth.join(pred, "qid").select("qid", F.size("y").alias("ny"), F.size("path").alias("np"), c.lcs_length(F.col("path"), F.col("y")).alias("l"))
    g = d.groupBy("qid").agg(F.max(F.col("l") / F.col("ny")).alias("r"), F.max(F.col("l") / F.col("np")).alias("p"))
    return g.select("qid", _r(f_beta(F.col("r"), F.col("p")), "rouge_l"))


def CIDER(n):
    return f"""(SELECT m.qid, coalesce(sum(dot / (na * nb)), 0) / any_value(m.m) AS c FROM (SELECT qid, count(*) AS m FROM truth GROUP BY qid) m LEFT JOIN (
    SELECT c.qid, s.traj, sum(c.w * s.w) AS dot, any_value(c.nn) AS na, any_value(s.nn) AS nb FROM cw{n} c JOIN sw{n} s USING (qid, g) GROUP BY 1, 2) d ON d.qid = m.qid AND na > 0 AND nb > 0 GROUP BY m.qid)"""


def CIDW(n):
    return f"""idf{n} AS (SELECT g, ln((SELECT count(DISTINCT qid) FROM truth)::DOUBLE / count(DISTINCT qid)) AS idf FROM sg{n} GROUP BY g),
    cw{n} AS (SELECT qid, g, w, sqrt(sum(w * w) OVER (PARTITION BY qid)) AS nn FROM (SELECT qid, g, h / sum(h) OVER (PARTITION BY qid) * idf AS w FROM cg{n} LEFT JOIN idf{n} USING (g)) WHERE w IS NOT NULL),
    sw{n} AS (SELECT qid, traj, g, w, sqrt(sum(w * w) OVER (PARTITION BY qid, traj)) AS nn FROM (SELECT qid, traj, g, h / sum(h) OVER (PARTITION BY qid, traj) * idf AS w FROM sg{n} JOIN idf{n} USING (g)))"""


@query("m_cider", f"SELECT a.qid, round(a.c, 6) AS cider_1, round(b.c, 6) AS cider_2, round((a.c + b.c) / 2, 6) AS cider FROM {CIDER(1)} a JOIN {CIDER(2)} b USING (qid)", NEED, PRED + ", " + GRAMS(1) + ", " + GRAMS(2) + ", " + CIDW(1) + ", " + CIDW(2))
def m_cider(spark, sf):
    """tf-idf weighted n-gram cosine against every reference, averaged over references and n = 1, 2."""
    pred, truth = cand_refs(spark, sf)
    docs = truth.select("qid").distinct().agg(F.count("*")).scalar()
    refs = truth.groupBy("qid").agg(F.count("*").alias("m"))
    out = refs
    for n in (1, 2):
        cand, ref = grams(pred, ["qid"], "path", n), share(grams(truth, ["qid", "traj"], "y", n))
        df = ref.select("qid", "g").distinct().groupBy("g").agg(F.count("*").alias("df"))
        idf = df.select("g", F.ln(docs / F.col("df")).alias("idf"))

        def weighted(d, key, w):
            t = d.groupBy(*key).agg(F.sum("h").alias("t"))
            x = d.join(t, key).join(idf, "g").withColumn(w, F.col("h") / F.col("t") * F.col("idf")).drop("h", "t", "idf")
            return x.join(x.groupBy(*key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(f"n_{w}")), key)

        a, b = weighted(cand, ["qid"], "wa"), weighted(ref, ["qid", "traj"], "wb")
        dot = a.join(b, ["qid", "g"]).groupBy("qid", "traj").agg((F.sum(F.col("wa") * F.col("wb")) / (F.max("n_wa") * F.max("n_wb"))).alias("cos"))
        out = out.join(dot.groupBy("qid").agg(F.sum("cos").alias(f"s{n}")), "qid", "left").withColumn(f"c{n}", F.coalesce(f"s{n}", F.lit(0.0)) / F.col("m"))
    return out.select("qid", _r("c1", "cider_1"), _r("c2", "cider_2"), _r((F.col("c1") + F.col("c2")) / 2, "cider"))
