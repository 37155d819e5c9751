"""Ranking and beyond-accuracy metrics."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import metrics as m, ordering as o, rankers as rk
from recset.plans import query
from recset.plans.losses import CUM
from recset.plans.profiles import _r
from recset.plans.rankers import ART, POP, WS, rank_cagh_seed, seed_sql, train_entries
from recset.sources import views as v

RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, item) AS rank, sum(pos) OVER (PARTITION BY unit) AS p FROM scored)"
TOPS = [5, 10, 20, 50, 100, 200, 300, 500, 1000]  # fixed list lengths of the hit rate


@query("m_rprecision", "SELECT unit, round(sum(CASE WHEN rank <= p THEN pos ELSE 0 END)::DOUBLE / any_value(p), 6) AS rp FROM rk WHERE p > 0 GROUP BY unit", "scored", RANKED)
def m_rprecision(spark, sf):
    """Hits in the top n+; ranks are exact also where the cut falls into a long tie."""
    d = v.scored(spark, sf)
    r = o.ranked(d, ["unit"], "score", "item").join(m.totals(d).select("unit", "P"), "unit").filter("P > 0")
    return r.groupBy("unit").agg(_r(F.sum(F.when(F.col("rank") <= F.col("P"), F.col("pos")).otherwise(0)) / F.max("P"), "rp"))


def thr_sql(unit):
    return f"""SELECT '{unit}' AS per, {unit} AS id, round(sum(CASE WHEN score >= thr THEN pos ELSE 0 END)::DOUBLE / any_value(p), 6) AS rp FROM (
    SELECT s.*, p, min(CASE WHEN r <= p THEN score END) OVER (PARTITION BY {unit}) AS thr FROM (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY score DESC) AS r,
    sum(pos) OVER (PARTITION BY {unit}) AS p FROM scored) s WHERE p > 0) GROUP BY {unit}"""


@query("m_rprecision_thr", thr_sql("unit") + " UNION ALL " + thr_sql("item"), "scored")
def m_rprecision_thr(spark, sf):
    """Threshold at the n+-th score, ties included; per label and per example."""
    d = v.scored(spark, sf)
    out = None
    for unit in ("unit", "item"):
        t = m.tie_table(d, unit).join(m.totals(d, unit).select(unit, "P"), unit).filter("P > 0")
        # the tie group that holds the n+-th row is the last one that counts
        inside = F.col("cum_n") - F.col("n") < F.col("P")
        g = t.groupBy(unit).agg(_r(F.sum(F.when(inside, F.col("n_pos")).otherwise(0)) / F.max("P"), "rp"))
        g = g.select(F.lit(unit).alias("per"), F.col(unit).alias("id"), "rp")
        out = g if out is None else out.unionByName(g)
    return out


@query("m_hitrate", "SELECT unit, k, round(sum(CASE WHEN rank <= k THEN pos ELSE 0 END)::DOUBLE / any_value(p), 6) AS hitrate FROM rk, (SELECT unnest([5, 10, 20, 50, 100, 200, 300, 500, 1000]) AS k) WHERE p > 0 GROUP BY unit, k", "scored", RANKED)
def m_hitrate(spark, sf):
    h = m.hits_at(v.scored(spark, sf), TOPS).filter("P > 0")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit_{k}").alias("h")) for k in TOPS])
    return h.select("unit", "P", F.explode(pairs).alias("x")).select("unit", "x.k", _r(F.col("x.h") / F.col("P"), "hitrate"))


@query("m_precision_recall", "SELECT unit, round(sum(CASE WHEN rank <= 20 THEN pos ELSE 0 END)::DOUBLE / 20, 6) AS precision_20, round(sum(CASE WHEN rank <= 20 THEN pos ELSE 0 END)::DOUBLE / any_value(p), 6) AS recall_20 FROM rk WHERE p > 0 GROUP BY unit", "scored", RANKED)
def m_precision_recall(spark, sf):
    h = m.hits_at(v.scored(spark, sf), [20]).filter("P > 0")
    return h.select("unit", _r(F.col("hit_20") / 20, "precision_20"), _r(F.col("hit_20") / F.col("P"), "recall_20"))


@query("m_precision_at_k", "SELECT unit, round(sum(CASE WHEN rank <= 3 THEN pos ELSE 0 END)::DOUBLE / 3, 6) AS p3, round(sum(CASE WHEN rank <= 5 THEN pos ELSE 0 END)::DOUBLE / 5, 6) AS p5 FROM rk GROUP BY unit", "scored", RANKED)
def m_precision_at_k(spark, sf):
    h = m.hits_at(v.scored(spark, sf), [3, 5])
    return h.select("unit", _r(F.col("hit_3") / 3, "p3"), _r(F.col("hit_5") / 5, "p5"))


AUC_PAIRS = """auc AS (SELECT a.unit, count(*) AS pq, sum(CASE WHEN a.score > b.score THEN 0 WHEN a.score = b.score THEN 0.5 ELSE 1 END)::DOUBLE AS loss FROM scored a JOIN scored b ON a.unit = b.unit AND a.pos = 1 AND b.pos = 0 GROUP BY a.unit)"""


@query("m_auc", "SELECT 'unit' AS level, unit AS id, round(1 - loss / pq, 6) AS auc FROM auc UNION ALL SELECT 'macro', -1, round(avg(1 - loss / pq), 6) FROM auc", "scored", AUC_PAIRS)
def m_auc(spark, sf):
    """AUC per list and the macro average; lists without positives drop out. The twin counts pairs directly."""
    a = m.auc_and_loss(v.scored(spark, sf))
    one = a.select(F.lit("unit").alias("level"), F.col("unit").alias("id"), _r("auc", "auc"))
    return one.unionByName(a.agg(_r(F.avg("auc"), "auc")).select(F.lit("macro").alias("level"), F.lit(-1).cast("long").alias("id"), "auc"))


@query("m_auc_weighted", "SELECT round(sum((1 - loss / pq) * p) / sum(p), 6) AS auc, sum(p)::BIGINT AS n FROM auc JOIN (SELECT unit, sum(pos) AS p FROM scored GROUP BY unit) USING (unit)", "scored", AUC_PAIRS)
def m_auc_weighted(spark, sf):
    a = m.auc_and_loss(v.scored(spark, sf))
    return a.agg(_r(F.sum(F.col("auc") * F.col("P")) / F.sum("P"), "auc"), F.sum("P").alias("n"))


@query("m_ranking_loss", "SELECT unit, loss, round(loss / pq, 6) AS share FROM auc", "scored", AUC_PAIRS)
def m_ranking_loss(spark, sf):
    a = m.auc_and_loss(v.scored(spark, sf))
    return a.select("unit", "loss", _r(F.col("loss") / (F.col("P") * F.col("Q")), "share"))


@query("m_average_precision", "SELECT t.unit, round(sum(np * cp::DOUBLE / cn) / any_value(p), 6) AS ap FROM tie t JOIN tot USING (unit) WHERE p > 0 GROUP BY t.unit", "scored", CUM)
def m_average_precision(spark, sf):
    return m.average_precision(v.scored(spark, sf)).select("unit", _r("ap", "ap"))


@query("m_nrr", "SELECT unit, round(sum(pos / rank::DOUBLE) / (SELECT sum(1.0::DOUBLE / i) FROM (SELECT unnest(range(1, any_value(p)::BIGINT + 1)) AS i)), 6) AS nrr FROM rk WHERE p > 0 GROUP BY unit".replace("(SELECT sum(1.0::DOUBLE / i) FROM (SELECT unnest(range(1, any_value(p)::BIGINT + 1)) AS i))", "list_sum([1.0::DOUBLE / i FOR i IN range(1, any_value(p)::BIGINT + 1)])"), "scored", RANKED)
def m_nrr(spark, sf):
    """Sum of 1/rank over the positives, divided by its best value.

    The best value is the harmonic number of n+, by its asymptotic series at n+ + 16 less the 16 terms in between, which
    is exact to the last digits for every n+.
    """
    d = v.scored(spark, sf)
    r = o.ranked(d, ["unit"], "score", "item").filter("pos = 1")
    g = r.groupBy("unit").agg(F.count("*").alias("P"), F.sum(1.0 / F.col("rank")).alias("s"))
    p = F.col("P").cast("double")
    x = p + 16
    series = F.ln(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)  # Euler's constant
    harmonic = series - sum((1 / (p + k) for k in range(1, 17)), F.lit(0.0))
    return g.select("unit", _r(F.col("s") / harmonic, "nrr"))


@query("m_spread", "SELECT unit, round(-sum(p * ln(p)), 6) AS spread FROM (SELECT unit, e / sum(e) OVER (PARTITION BY unit) AS p FROM (SELECT unit, exp(score / 100 - max(score / 100) OVER (PARTITION BY unit)) AS e FROM scored)) GROUP BY unit", "scored")
def m_spread(spark, sf):
    """Entropy of the softmax of all scores: ln Z - sum(t e^t) / Z with t = score - max."""
    d = v.scored(spark, sf).withColumn("score", F.col("score") / 100)
    top = d.groupBy("unit").agg(F.max("score").alias("m"))
    t = F.col("score") - F.col("m")
    g = d.join(top, "unit").groupBy("unit").agg(F.sum(F.exp(t)).alias("z"), F.sum(t * F.exp(t)).alias("s"))
    return g.select("unit", _r(F.ln("z") - F.col("s") / F.col("z"), "spread"))


# Recommended songs of the held-out lists, and the novelty of the first 5 and 10 of each.
REC = ART + WS + ", rec AS (" + seed_sql("pop * w", "w JOIN song USING (artist) JOIN pop USING (song)") + ")"
NOV = REC + """, nov AS (SELECT k, pid, usr, avg(-log2(pop)) AS nov FROM rec JOIN pop USING (song) JOIN (SELECT DISTINCT pid, usr FROM pl) USING (pid), (SELECT unnest([5, 10]) AS k)
    WHERE rank <= k GROUP BY 1, 2, 3)"""
DEPTHS = [5, 10]


def novelty(spark, sf):
    """(pid, usr, k, nov): mean -log2(popularity) of the first k songs that are recommended for a held-out list."""
    pop = train_entries(spark, sf).groupBy("song").agg(F.count("*").alias("pop"))
    users = v.clean_entry(spark, sf).select("pid", "usr").distinct()
    d = rank_cagh_seed(spark, sf).join(pop, "song").join(users, "pid").withColumn("k", F.explode(F.array(*[F.lit(k) for k in DEPTHS])))
    return d.filter("rank <= k").groupBy("pid", "usr", "k").agg(F.avg(-F.log2("pop")).alias("nov"))


@query("m_novelty", "SELECT k, count(*) AS users, round(avg(u), 6) AS novelty FROM (SELECT k, usr, avg(nov) AS u FROM nov GROUP BY 1, 2) GROUP BY k", "pl song", NOV)
def m_novelty(spark, sf):
    """Mean -log2(popularity) of the first k recommended songs per list, averaged per user and then over users."""
    per = novelty(spark, sf).groupBy("k", "usr").agg(F.avg("nov").alias("u"))
    return per.groupBy("k").agg(F.count("*").alias("users"), _r(F.avg("u"), "novelty"))


PUSH = "lim AS (SELECT unit, max(CASE WHEN pos = 0 THEN score END) AS mn, min(CASE WHEN pos = 1 THEN score END) AS mp FROM scored GROUP BY unit HAVING sum(pos) > 0 AND sum(1 - pos) > 0)"


def pushed(spark, sf):
    d = v.scored(spark, sf)
    return d.join(m.totals(d).select("unit", "max_neg", "min_pos"), "unit").filter("max_neg is not null and min_pos is not null")


def share(cond, of):
    return F.avg(F.when(of, cond.cast("double")))


@query("m_ptop", "SELECT unit, round(avg(CASE WHEN pos = 1 THEN (score > mn)::INT END), 6) AS ptop FROM scored JOIN lim USING (unit) GROUP BY unit", "scored", PUSH)
def m_ptop(spark, sf):
    return pushed(spark, sf).groupBy("unit").agg(_r(share(F.col("score") > F.col("max_neg"), F.col("pos") == 1), "ptop"))


@query("m_toppush", "SELECT unit, round(avg(CASE WHEN pos = 1 THEN (score <= mn)::INT END), 6) AS toppush FROM scored JOIN lim USING (unit) GROUP BY unit", "scored", PUSH)
def m_toppush(spark, sf):
    return pushed(spark, sf).groupBy("unit").agg(_r(share(F.col("score") <= F.col("max_neg"), F.col("pos") == 1), "toppush"))


@query("m_bottompush", "SELECT unit, round(avg(CASE WHEN pos = 0 THEN (score >= mp)::INT END), 6) AS bottompush FROM scored JOIN lim USING (unit) GROUP BY unit", "scored", PUSH)
def m_bottompush(spark, sf):
    return pushed(spark, sf).groupBy("unit").agg(_r(share(F.col("score") >= F.col("min_pos"), F.col("pos") == 0), "bottompush"))


@query("m_subset01", "SELECT item, max((pos <> (score - 30 > 0)::INT)::INT) AS subset01 FROM scored GROUP BY item", "scored")
def m_subset01(spark, sf):
    """1 when any label of the example is wrong at threshold 0 (scores shifted by 30)."""
    wrong = (F.col("pos") != (F.col("score") - 30 > 0).cast("int")).cast("int")
    return v.scored(spark, sf).groupBy("item").agg(F.max(wrong).alias("subset01"))


@query("m_hamming", "SELECT item, round(avg((pos <> (score - 30 > 0)::INT)::INT), 6) AS hamming FROM scored GROUP BY item", "scored")
def m_hamming(spark, sf):
    wrong = (F.col("pos") != (F.col("score") - 30 > 0).cast("int")).cast("int")
    return v.scored(spark, sf).groupBy("item").agg(_r(F.avg(wrong), "hamming"))


@query("m_masked", "SELECT unit, round(1 - loss / pq, 6) AS auc FROM (SELECT a.unit, count(*) AS pq, sum(CASE WHEN a.score > b.score THEN 0 WHEN a.score = b.score THEN 0.5 ELSE 1 END)::DOUBLE AS loss FROM ms a JOIN ms b ON a.unit = b.unit AND a.pos = 1 AND b.pos = 0 GROUP BY a.unit)",
       "scored", "ms AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.unit AND l.l_partkey = s.item AND l.l_linenumber = 1))")
def m_masked(spark, sf):
    """AUC without the cells observed as seeds (first lines)."""
    seen = v.table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_linenumber").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("item"))
    d = v.scored(spark, sf).join(seen, ["unit", "item"], "left_anti")
    return m.auc_and_loss(d).select("unit", _r("auc", "auc"))


def f1_counts(d, by):
    pred = (F.col("score") > 30).cast("int")
    return d.groupBy(*by).agg(F.sum(F.col("pos") * pred).alias("tp"), F.sum("pos").alias("t"), F.sum(pred).alias("p"))


F1 = "CASE WHEN sum(pos) + sum((score > 30)::INT) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(pos * (score > 30)::INT) / (sum(pos) + sum((score > 30)::INT)) END"


def f1_of():
    return F.when(F.col("t") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)


@query("m_f1_examples", f"SELECT item, round({F1}, 6) AS f1 FROM scored GROUP BY item", "scored")
def m_f1_examples(spark, sf):
    return f1_counts(v.scored(spark, sf), ["item"]).select("item", _r(f1_of(), "f1"))


@query("m_f1_macro_micro", f"SELECT round(avg(f), 6) AS macro, (SELECT round({F1}, 6) FROM scored) AS micro FROM (SELECT unit, {F1} AS f FROM scored GROUP BY unit)", "scored")
def m_f1_macro_micro(spark, sf):
    g = f1_counts(v.scored(spark, sf), ["unit"])
    micro = g.agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")).select(f1_of()).scalar()
    return g.agg(F.avg(f1_of()).alias("a")).select(_r("a", "macro"), F.round(micro, 6).alias("micro"))


@query("m_diversity", """SELECT unit, round(1 - sum(n * (n - 1))::DOUBLE / (sum(n) * (sum(n) - 1)), 6) AS diversity FROM (SELECT unit, coalesce(genre, '?') AS g, count(*) AS n FROM rk JOIN song ON song = item WHERE rank <= 20 GROUP BY 1, 2) GROUP BY unit HAVING sum(n) > 1""", "scored song", RANKED)
def m_diversity(spark, sf):
    """Share of differing genre pairs among the top 20, from group sizes."""
    g = v.song(spark, sf).select(F.col("song").alias("item"), F.coalesce("genre", F.lit("?")).alias("g"))
    top = o.top_k(v.scored(spark, sf), ["unit"], [F.desc("score"), "item"], 20).join(g, "item")
    n = top.groupBy("unit", "g").agg(F.count("*").alias("n")).groupBy("unit").agg(F.sum("n").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    return n.filter("k > 1").select("unit", _r(1 - F.col("same") / (F.col("k") * (F.col("k") - 1)), "diversity"))


@query("m_hamming_rows", """SELECT count(*) AS pairs, round(avg(a.n + b.n - 2 * coalesce(k, 0)) / (SELECT count(DISTINCT item) FROM scored), 9) AS mean_distance FROM (SELECT unit, sum(pos) AS n FROM scored GROUP BY unit) a
    JOIN (SELECT unit, sum(pos) AS n FROM scored GROUP BY unit) b ON a.unit < b.unit LEFT JOIN (SELECT x.unit AS u1, y.unit AS u2, count(*) AS k FROM scored x JOIN scored y ON x.item = y.item AND x.pos = 1 AND y.pos = 1 GROUP BY 1, 2) c ON c.u1 = a.unit AND c.u2 = b.unit""", "scored")
def m_hamming_rows(spark, sf):
    """Mean normalised Hamming distance over all pairs of binary rows: a column with c ones differs in c * (n - c) pairs."""
    d = v.scored(spark, sf)
    n = d.select("unit").distinct().agg(F.count("*")).scalar()
    col = d.groupBy("item").agg(F.sum("pos").alias("c")).withColumn("n", n)
    g = col.agg(F.max("n").alias("n"), F.count("*").alias("items"), F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("s"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return g.select(pairs.cast("long").alias("pairs"), F.round(F.col("s") / pairs / F.col("items"), 9).alias("mean_distance"))


@query("m_per_user", "SELECT usr, round(avg(nov), 6) AS metric, any_value(n) AS n_lists FROM nov JOIN (SELECT usr, count(DISTINCT pid) AS n FROM train GROUP BY usr) USING (usr) WHERE k = 10 GROUP BY usr", "pl song", NOV)
def m_per_user(spark, sf):
    """Mean novelty of a user's ten recommended songs against the number of training lists."""
    n = train_entries(spark, sf).select("usr", "pid").distinct().groupBy("usr").agg(F.count("*").alias("n_lists"))
    return novelty(spark, sf).filter("k = 10").groupBy("usr").agg(_r(F.avg("nov"), "metric")).join(n, "usr")


@query("m_result_pivot", """SELECT unit % 4 AS method, round(100 * avg(CASE WHEN k = 5 THEN h END), 4) AS hr_5, round(100 * avg(CASE WHEN k = 20 THEN h END), 4) AS hr_20, round(100 * avg(CASE WHEN k = 100 THEN h END), 4) AS hr_100
    FROM (SELECT unit, k, sum(CASE WHEN rank <= k THEN pos ELSE 0 END)::DOUBLE / any_value(p) AS h FROM rk, (SELECT unnest([5, 20, 100]) AS k) WHERE p > 0 GROUP BY unit, k) GROUP BY 1""", "scored", RANKED)
def m_result_pivot(spark, sf):
    """Methods x metric table in percent; the method is a property of the unit here."""
    ks = [5, 20, 100]
    h = m.hits_at(v.scored(spark, sf), ks).filter("P > 0")
    long = h.select((F.col("unit") % 4).alias("method"), F.explode(F.array(*[F.struct(F.lit(f"hr_{k}").alias("metric"), (F.col(f"hit_{k}") / F.col("P")).alias("v")) for k in ks])).alias("x"))
    return long.groupBy("method").pivot("x.metric", [f"hr_{k}" for k in ks]).agg(F.round(100 * F.avg("x.v"), 4))


@query("playlist_evaluation", """SELECT count(*) AS lists, round(avg(hr), 6) AS hitrate_100, round(avg(auc), 6) AS auc FROM (
    SELECT h.pid, count(*) FILTER (WHERE g.rank <= 100)::DOUBLE / count(*) AS hr, 1 - sum(g.neg_above)::DOUBLE / (count(*) * (any_value(t.n) - count(*))) AS auc
    FROM (SELECT pid, song FROM pl WHERE md5(pid::VARCHAR || '|test') < '4') h JOIN (SELECT song, row_number() OVER (ORDER BY pop DESC, song) AS rank, 0 AS z FROM pop) r USING (song)
    JOIN (SELECT x.pid, x.song, r2.rank, r2.rank - 1 - (row_number() OVER (PARTITION BY x.pid ORDER BY r2.rank) - 1) AS neg_above FROM pl x JOIN (SELECT song, row_number() OVER (ORDER BY pop DESC, song) AS rank FROM pop) r2 USING (song) WHERE md5(x.pid::VARCHAR || '|test') < '4') g
    ON g.pid = h.pid AND g.song = h.song, (SELECT count(*) AS n FROM pop) t GROUP BY h.pid)""", "pl", POP)
def playlist_evaluation(spark, sf):
    """Flagship: clean lists, split, rank by training popularity, evaluate every held-out list.

    All lists share one ranking, so only the positives are joined; negatives above a positive follow from its rank.
    """
    t = train_entries(spark, sf)
    pop = t.groupBy("song").agg(F.count("*").alias("pop"))
    n = pop.agg(F.count("*")).scalar()
    r = o.ranked(pop, [], "pop", "song").select("song", "rank")
    held = v.clean_entry(spark, sf).filter(o.md5_of("pid", seed="test") < "4").select("pid", "song").join(r, "song")
    per = held.groupBy("pid").agg(F.count("*").alias("P"), F.sum((F.col("rank") <= 100).cast("long")).alias("h"), F.sum("rank").alias("s"))
    p = F.col("P")
    auc = 1 - (F.col("s") - p * (p + 1) / 2) / (p * (n - p))
    per = per.withColumn("auc", auc).withColumn("hr", F.col("h") / p)
    return per.agg(F.count("*").alias("lists"), _r(F.avg("hr"), "hitrate_100"), _r(F.avg("auc"), "auc"))
