"""Trajectories, transitions and discretised Markov tables."""
from pyspark.sql import functions as F, Window as W

from recset.functions import columns as c
from recset.operators import ordering as o, sequence as s
from recset.plans import query
from recset.plans.profiles import _r
from recset.session import share
from recset.sources import views as v

EDGES = "edges AS (SELECT a.poi AS src, b.poi AS dst, count(*) AS n FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1 GROUP BY 1, 2)"


def LOGBIN(col, far=False):
    last = f"pow(10.0, log10(max({col})) + 2)" if far else f"CASE WHEN pow(10.0, ceil(log10(max({col})))) < max({col}) THEN max({col}) + 1 ELSE pow(10.0, ceil(log10(max({col})))) END"
    step = lambda i: f"pow(10.0, floor(log10(greatest(1, min({col})))) + (ceil(log10(max({col}))) - floor(log10(greatest(1, min({col}))))) * {i}/5.0::DOUBLE)"
    return f"SELECT [0.0, {step(1)}, {step(2)}, {step(3)}, {step(4)}, {last}]::DOUBLE[] AS e FROM cinfo"


def CLASS(col, far=False):
    return f"SELECT poi, len(list_filter((SELECT e FROM ({LOGBIN(col, far)})), lambda x: x <= {col})) AS cls FROM cinfo"


def TRANS(cls, domain):
    return f"""cls AS ({cls}), dom AS ({domain}), cnt AS (SELECT x.cls AS c1, y.cls AS c2, sum(n) AS n FROM edges JOIN cls x ON src = x.poi JOIN cls y ON dst = y.poi GROUP BY 1, 2),
    tm AS (SELECT a.cls AS c1, b.cls AS c2, (coalesce(n, 0) + 1)::DOUBLE / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a.cls) AS p
    FROM dom a CROSS JOIN dom b LEFT JOIN cnt ON c1 = a.cls AND c2 = b.cls)"""


BINDOM = "SELECT unnest(range(1, 6)) AS cls"
# Fixed rule that stands in for the five location clusters, equal on both sides.
ZONE = "SELECT poi, (floor((lon - 144.9) / 0.0205) % 5)::BIGINT AS cls FROM cpoi"


def zones(spark, sf):
    return v.city_poi(spark, sf).select("poi", (F.floor((F.col("lon") - 144.9) / 0.0205) % 5).cast("long").alias("cls"))


def city(spark, sf):
    """Placed visits of the city, written once because most queries branch from them."""
    seq = share(s.place(v.city_visit(spark, sf)))
    return seq, seq


KINDS = ["cat", "pop", "visit", "duration", "neighbor"]
BINNED = ["pop", "visit", "duration"]


def poi_vectors(spark, sf, info):
    """The five classes of every POI in one row."""
    b = lambda col, far=False: c.digitize(F.col(col).cast("double"), s.bin_edges(info, col, far), s.BINS + 1).cast("long")
    zone = (F.floor((F.col("lon") - 144.9) / 0.0205) % 5).cast("long")
    p = v.city_poi(spark, sf).select("poi", "cat", zone.alias("neighbor"))
    return info.select("poi", b("pop").alias("pop"), b("nvisit").alias("visit"), b("dur", True).alias("duration")).join(p, "poi")


def matrices(spark, sf, seq):
    """Edge counts, POI class vectors and the long table of the five transition matrices; all three are small."""
    e = share(s.edge_counts(seq))
    vecs = share(poi_vectors(spark, sf, share(s.poi_info(seq))))
    return e, vecs, share(s.transition_matrices(e, vecs, KINDS, BINNED))


@query("trajectories", "SELECT traj, usr, len, start, array_to_string(path, ',') AS path FROM ctraj", "ctraj")
def trajectories(spark, sf):
    return s.paths(s.place(v.city_visit(spark, sf))).select("traj", "usr", "len", "start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("transition_pairs", """SELECT a.traj, a.ord, a.poi AS src, b.poi AS dst FROM tseq a JOIN tseq b ON a.traj = b.traj AND b.ord = a.ord + 1""", "tseq")
def transition_pairs(spark, sf):
    return s.steps(share(s.place(v.visit(spark, sf)))).select("traj", (F.col("ord") - 1).alias("ord"), "src", "dst")


def _tm(key, cls_sql, dom):
    def run(spark, sf):
        tm = matrices(spark, sf, city(spark, sf)[1])[2].filter(F.col("kind") == key)
        typed = lambda col: F.col(col) if key == "cat" else F.col(col).cast("long").alias(col)
        return tm.select(typed("c1"), typed("c2"), _r("p", "p"))
    run.__name__ = f"transmat_{key}"
    query(run.__name__, "SELECT c1, c2, round(p, 6) AS p FROM tm", "cseq cinfo cpoi", EDGES + ", " + TRANS(cls_sql, dom))(run)


_tm("cat", "SELECT poi, cat AS cls FROM cpoi", "SELECT DISTINCT cat AS cls FROM cpoi")
_tm("pop", CLASS("pop"), BINDOM)
_tm("visit", CLASS("nvisit"), BINDOM)
_tm("duration", CLASS("dur", True), BINDOM)
_tm("neighbor", ZONE, f"SELECT DISTINCT cls FROM ({ZONE})")


@query("log_bins", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, i AS i, round(e[i], 6) AS edge FROM ({LOGBIN(col, far)}), (SELECT unnest(range(1, 7)) AS i)"
    for n, col, far in (("pop", "pop", False), ("nvisit", "nvisit", False), ("dur", "dur", True))), "cinfo")
def log_bins(spark, sf):
    info = s.poi_info(v.city_visit(spark, sf))
    out = None
    for col in ("pop", "nvisit", "dur"):
        e = info.agg(c.log_edges(F.min(col), F.max(col), s.BINS, col == "dur").alias("e"))
        e = e.select(F.lit(col).alias("feature"), F.posexplode("e").alias("i", "edge")).select("feature", (F.col("i") + 1).cast("long").alias("i"), _r("edge", "edge"))
        out = e if out is None else out.unionByName(e)
    return out


@query("digitize", f"SELECT a.poi, a.cls AS pop_bin, b.cls AS visit_bin, d.cls AS dur_bin FROM ({CLASS('pop')}) a JOIN ({CLASS('nvisit')}) b USING (poi) JOIN ({CLASS('dur', True)}) d USING (poi)", "cinfo")
def digitize(spark, sf):
    info = share(s.poi_info(v.city_visit(spark, sf)))
    bins = {n: c.digitize(F.col(col).cast("double"), s.bin_edges(info, col, col == "dur"), s.BINS + 1).cast("long") for n, col in
            (("pop_bin", "pop"), ("visit_bin", "nvisit"), ("dur_bin", "dur"))}
    return info.select("poi", *[b.alias(n) for n, b in bins.items()])


@query("poi_bigram_freq", """SELECT 'given_last' AS kind, a.poi AS p1, -1 AS p2, b.poi AS poi, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a.poi), 6) AS freq
    FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1 GROUP BY a.poi, b.poi
    UNION ALL SELECT 'given_last_two', a.poi, z.poi, b.poi, count(*), round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a.poi, z.poi), 6)
    FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1 JOIN cseq z ON a.traj = z.traj AND z.ord = a.ord - 1 GROUP BY a.poi, z.poi, b.poi""", "cseq")
def poi_bigram_freq(spark, sf):
    """p1 is the last POI, p2 the one before it (-1 when not used)."""
    _, seq = city(spark, sf)
    two = s.steps(seq).select("traj", "ord", F.col("src").alias("p1"), F.col("dst").alias("poi"))
    z = seq.select("traj", (F.col("ord") + 2).alias("ord"), F.col("poi").alias("p2"))
    big = two.groupBy("p1", "poi").agg(F.count("*").alias("n")).select(F.lit("given_last").alias("kind"), "p1", F.lit(-1).cast("long").alias("p2"), "poi", "n")
    tri = two.join(z, ["traj", "ord"]).groupBy("p1", "p2", "poi").agg(F.count("*").alias("n")).select(F.lit("given_last_two").alias("kind"), "p1", "p2", "poi", "n")
    both = big.unionByName(tri)
    total = both.groupBy("kind", "p1", "p2").agg(F.sum("n").alias("t"))
    return both.join(total, ["kind", "p1", "p2"]).select("kind", "p1", "p2", "poi", "n", _r(F.col("n") / F.col("t"), "freq"))


@query("poi_position_probs", """SELECT poi, round(avg((ord = 1)::INT), 6) AS start_p, round(avg((ord = len)::INT), 6) AS stop_p,
    round(avg((ord > 1 AND ord < len)::INT), 6) AS middle_p FROM tseq GROUP BY poi""", "tseq")
def poi_position_probs(spark, sf):
    seq = share(s.place(v.visit(spark, sf)).select("traj", "poi", "ord"))
    lens = seq.groupBy("traj").agg(F.max("ord").alias("len"))
    part = lambda cond: F.avg(cond.cast("double"))
    return seq.join(lens, "traj").groupBy("poi").agg(
        _r(part(F.col("ord") == 1), "start_p"), _r(part(F.col("ord") == F.col("len")), "stop_p"),
        _r(part((F.col("ord") > 1) & (F.col("ord") < F.col("len"))), "middle_p"))


DIST = lambda a, b: f"2*6371.0088::DOUBLE*asin(sqrt(pow(sin((radians({a}.lat)-radians({b}.lat))/2), 2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin((radians({a}.lon)-radians({b}.lon))/2), 2)))"


@query("session_features", f"""SELECT t.traj, any_value(t.usr) AS usr, count(*) AS sess_len, sum(duration) AS sess_time, count(DISTINCT q.cat) AS uniq_cats, sum(photos)::BIGINT AS photos_tot,
    max(photos) AS photos_max, min(photos) AS photos_min, round(avg(photos), 6) AS photos_avg,
    round(avg(d), 6) AS dist_avg, round(max(d), 6) AS dist_max, round(min(d), 6) AS dist_min, round(sum(d), 6) AS dist_tot,
    any_value(u.avg_len) AS user_len_avg, any_value(u.max_len) AS user_len_max, any_value(u.min_len) AS user_len_min, any_value(u.tot_len) AS user_len_tot, any_value(u.ratio) AS user_ratio
    FROM (SELECT x.*, {DIST('p', 'pp')} AS d FROM tseq x JOIN poi p ON x.poi = p.poi LEFT JOIN tseq y ON y.traj = x.traj AND y.ord = x.ord - 1 LEFT JOIN poi pp ON pp.poi = y.poi) t
    JOIN poi q ON q.poi = t.poi
    JOIN (SELECT usr, round(avg(k), 6) AS avg_len, max(k) AS max_len, min(k) AS min_len, sum(k)::BIGINT AS tot_len, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS ratio
          FROM (SELECT usr, traj, count(*) AS k FROM tseq GROUP BY 1, 2) GROUP BY usr) u ON u.usr = t.usr GROUP BY t.traj""", "tseq poi")
def session_features(spark, sf):
    seq = share(s.place(v.visit(spark, sf)).join(v.poi(spark, sf), "poi"))
    prev = seq.select("traj", (F.col("ord") + 1).alias("ord"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    x = seq.join(prev, ["traj", "ord"], "left").withColumn("d", c.haversine_km(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")))
    per = x.groupBy("traj", "usr").agg(
        F.count("*").alias("sess_len"), F.sum("duration").alias("sess_time"), F.count_distinct("cat").alias("uniq_cats"),
        F.sum("photos").alias("photos_tot"), F.max("photos").alias("photos_max"), F.min("photos").alias("photos_min"), _r(F.avg("photos"), "photos_avg"),
        _r(F.avg("d"), "dist_avg"), _r(F.max("d"), "dist_max"), _r(F.min("d"), "dist_min"), _r(F.sum("d"), "dist_tot"))
    usr = seq.groupBy("usr", "traj").agg(F.count("*").alias("k")).groupBy("usr").agg(
        F.count("*").alias("n"), _r(F.avg("k"), "user_len_avg"), F.max("k").alias("user_len_max"), F.min("k").alias("user_len_min"), F.sum("k").alias("user_len_tot"))
    usr = usr.withColumn("user_ratio", F.round(F.col("n") / usr.agg(F.max("n")).scalar(), 6)).drop("n")
    return per.join(usr, "usr")


@query("poi_ratio_features", """SELECT poi, round(count(*)::DOUBLE / (SELECT count(DISTINCT traj) FROM visit), 6) AS sess_ratio,
    round(count(DISTINCT usr)::DOUBLE / (SELECT count(DISTINCT usr) FROM visit), 6) AS user_ratio,
    round(sum(photos)::DOUBLE / max(sum(photos)) OVER (), 6) AS photo_ratio, round(avg(duration), 6) AS time_avg, max(duration) AS time_max,
    min(duration) AS time_min, round(stddev_samp(duration), 6) AS time_std, sum(duration) AS time_tot FROM visit GROUP BY poi""", "visit")
def poi_ratio_features(spark, sf):
    vis = v.visit(spark, sf)
    n = lambda col: vis.select(col).distinct().agg(F.count("*")).scalar()
    users = vis.select("poi", "usr").distinct().groupBy("poi").agg(F.count("*").alias("u"))
    g = vis.groupBy("poi").agg(
        F.count("*").alias("k"), F.sum("photos").alias("ph"), _r(F.avg("duration"), "time_avg"), F.max("duration").alias("time_max"),
        F.min("duration").alias("time_min"), _r(F.stddev_samp("duration"), "time_std"), F.sum("duration").alias("time_tot")).join(users, "poi")
    return g.select("poi", F.round(F.col("k") / n("traj"), 6).alias("sess_ratio"), F.round(F.col("u") / n("usr"), 6).alias("user_ratio"),
                    F.round(F.col("ph") / g.agg(F.max("ph")).scalar(), 6).alias("photo_ratio"), "time_avg", "time_max", "time_min", "time_std", "time_tot")


# The five class tables and matrices of the SQL twins.
FIVE = {"cat": ("SELECT poi, cat AS cls FROM cpoi", "SELECT DISTINCT cat AS cls FROM cpoi"), "pop": (CLASS("pop"), BINDOM), "visit": (CLASS("nvisit"), BINDOM),
        "duration": (CLASS("dur", True), BINDOM), "neighbor": (ZONE, f"SELECT DISTINCT cls FROM ({ZONE})")}
FIVE_SQL = EDGES + ", " + ", ".join(
    TRANS(a, b).replace("cls AS (", f"cls_{k} AS (", 1).replace("dom AS (", f"dom_{k} AS (", 1).replace("cnt AS (", f"cnt_{k} AS (", 1).replace("tm AS (", f"tm_{k} AS (", 1)
    .replace("JOIN cls ", f"JOIN cls_{k} ").replace("FROM dom a CROSS JOIN dom b LEFT JOIN cnt", f"FROM dom_{k} a CROSS JOIN dom_{k} b LEFT JOIN cnt_{k}")
    for k, (a, b) in FIVE.items())
VEC_SQL = "vec AS (SELECT cinfo.poi, " + ", ".join(f"cls_{k}.cls AS {k}" for k in FIVE) + " FROM cinfo " + " ".join(f"JOIN cls_{k} ON cls_{k}.poi = cinfo.poi" for k in FIVE) + ")"


def five_values(pairs, tm, left="a_", right="b_"):
    """Add the five class transition values to rows that carry both class vectors."""
    for k in KINDS:
        m = tm.filter(F.col("kind") == k).select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("p").alias(f"p_{k}"))
        on = (F.col(f"{left}{k}").cast("string") == F.col("_c1")) & (F.col(f"{right}{k}").cast("string") == F.col("_c2"))
        pairs = pairs.join(F.broadcast(m), on).drop("_c1", "_c2")  # at most (number of classes)^2 rows; the grid checks it
    return pairs


def vec(df, pre, keep):
    return df.select(F.col("poi").alias(keep), *[F.col(k).alias(pre + k) for k in KINDS])


@query("edge_features", "SELECT src, dst, " + ", ".join(f"round(log10(tm_{k}.p), 6) AS log_{k}" for k in FIVE) + " FROM edges JOIN vec a ON a.poi = src JOIN vec b ON b.poi = dst "
       + " ".join(f"JOIN tm_{k} ON tm_{k}.c1 = a.{k} AND tm_{k}.c2 = b.{k}" for k in FIVE), "cseq cinfo cpoi", FIVE_SQL + ", " + VEC_SQL)
def edge_features(spark, sf):
    e, vecs, tm = matrices(spark, sf, city(spark, sf)[1])
    e = e.select("src", "dst").join(vec(vecs, "a_", "src"), "src").join(vec(vecs, "b_", "dst"), "dst")
    return five_values(e, tm).select("src", "dst", *[_r(F.log10(f"p_{k}"), f"log_{k}") for k in KINDS])


def class_pairs(vecs, tm):
    """Class vector to class vector: `w` is log10 of the transition value to one POI of the class; a_size and b_size count POI.

    Values depend on the class vectors only. There are few distinct vectors (the product of the class counts at
    most), so group-to-group values and the normaliser of a row are taken over vectors; POI pairs are never crossed.
    """
    groups = vecs.groupBy(*KINDS).agg(F.count("*").alias("size"))
    all_groups = groups.agg(F.collect_list(F.struct(*[F.col(k).alias(f"b_{k}") for k in KINDS], F.col("size").alias("b_size")))).scalar()
    g = groups.select(*[F.col(k).alias(f"a_{k}") for k in KINDS], F.col("size").alias("a_size"), all_groups.alias("all")).select("*", F.explode("all").alias("g")).select("*", "g.*").drop("g", "all")
    g = five_values(g, tm)
    same = F.lit(True)
    prod = F.lit(1.0)
    for k in KINDS:
        same = same & (F.col(f"a_{k}") == F.col(f"b_{k}"))
        prod = prod * F.col(f"p_{k}")
    g = g.withColumn("same", same).withColumn("val", prod)
    rows = g.groupBy(*[f"a_{k}" for k in KINDS]).agg(F.sum(F.when(F.col("same") & (F.col("a_size") == 1), 0.0).otherwise(F.col("val"))).alias("total"))
    each = F.when(F.col("same"), F.col("val") / F.greatest(F.col("a_size") - 1, F.lit(1))).otherwise(F.col("val") / F.col("b_size"))
    return g.join(rows, [f"a_{k}" for k in KINDS]).withColumn("w", F.log10(each) - F.log10("total"))


def factored(spark, sf, seq):
    """log10 transition value of every observed POI pair."""
    e, vecs, tm = matrices(spark, sf, seq)
    g = class_pairs(vecs, tm)
    e = e.join(vec(vecs, "a_", "src"), "src").join(vec(vecs, "b_", "dst"), "dst")
    keys = [f"{p}{k}" for p in ("a_", "b_") for k in KINDS]
    return e.join(g.select(*keys, "w"), keys).select("src", "dst", F.when(F.col("src") == F.col("dst"), c.LOG_ZERO).otherwise(F.col("w")).alias("w"))


FACTORED_SQL = FIVE_SQL + ", " + VEC_SQL + """, vn AS (SELECT *, count(*) OVER (PARTITION BY cat, pop, visit, duration, neighbor) AS size FROM vec),
    allp AS (SELECT a.poi AS src, b.poi AS dst, CASE WHEN a.poi = b.poi THEN 0 WHEN a.cat = b.cat AND a.pop = b.pop AND a.visit = b.visit AND a.duration = b.duration AND a.neighbor = b.neighbor
      THEN """ + " * ".join(f"tm_{k}.p" for k in FIVE) + " / (b.size - 1) ELSE " + " * ".join(f"tm_{k}.p" for k in FIVE) + """ / b.size END AS val
      FROM vn a CROSS JOIN vn b """ + " ".join(f"JOIN tm_{k} ON tm_{k}.c1 = a.{k} AND tm_{k}.c2 = b.{k}" for k in FIVE) + """),
    wts AS (SELECT src, dst, CASE WHEN src = dst THEN -1000 ELSE log10(val) - log10(total) END AS w FROM allp JOIN (SELECT src, sum(val) AS total FROM allp GROUP BY src) USING (src))"""


@query("poi_transition_factored", "SELECT src, dst, round(w, 6) AS w FROM wts JOIN edges USING (src, dst)", "cseq cinfo cpoi", FACTORED_SQL)
def poi_transition_factored(spark, sf):
    vis, seq = city(spark, sf)
    return factored(spark, sf, seq).select("src", "dst", _r("w", "w"))


@query("rank_in_array", """SELECT vec_id, sum(i * rk)::BIGINT AS check_desc, min(CASE WHEN rk = 1 THEN i END) AS top_i, min(CASE WHEN rk = 64 THEN i END) AS low_i FROM (
    SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY vec_id""")
def rank_in_array(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumn("rk", c.array_ranks(F.col("embedding")))
    weighted = F.aggregate(F.transform("rk", lambda r, i: (r * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return e.select("vec_id", weighted.alias("check_desc"), F.array_position("rk", 1).alias("top_i"), F.array_position("rk", 64).alias("low_i"))


@query("cum_reward", """SELECT run, event_id, sum(reward) OVER w AS cum_reward, round(row_number() OVER w * b.best - sum(reward) OVER w, 6) AS cum_regret
    FROM reward, (SELECT max(m) AS best FROM (SELECT avg(reward) AS m FROM reward GROUP BY arm)) b WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)""", "reward")
def cum_reward(spark, sf):
    r = v.reward(spark, sf)
    best = r.groupBy("arm").agg(F.avg("reward").alias("m")).agg(F.max("m")).scalar()
    x = o.running(r, ["run"], ["ts", "event_id"], o.id_bucket(r, "ts"), {"cum_reward": F.col("reward"), "t": F.lit(1).cast("long")})
    return x.select("run", "event_id", "cum_reward", F.round(F.col("t") * best - F.col("cum_reward"), 6).alias("cum_regret"))
