"""Rankers and scorers."""
from pyspark.sql import Window as W, functions as F

from recset.functions import columns as c
from recset.operators import features as ft, ordering as o, rankers as rk, sequence as s
from recset.plans import query
from recset.plans.cleaning import seeds
from recset.plans.features import ATTR, NODE_FROM, ZGRID, attributes, node_table, song_vec
from recset.plans.profiles import _r, city_queries
from recset.plans.sequences import DIST, EDGES
from recset.session import share
from recset.sources import views as v

TRAIN = "train AS (SELECT * FROM pl WHERE md5(pid::VARCHAR || '|test') >= '4')"
POP = TRAIN + ", pop AS (SELECT song, count(*) AS pop FROM train GROUP BY song)"


def train_entries(spark, sf):
    """Training lists with the artist of each song, written once."""
    e = v.clean_entry(spark, sf).filter(o.md5_of("pid", seed="test") >= "4")
    return share(e.join(v.song(spark, sf).select("song", "artist", "age"), "song"))


def song_base(t, form="ln"):
    pop = t.groupBy("song", "artist").agg(F.count("*").alias("pop")).filter("artist is not null")
    return pop.select("artist", "song", (F.ln("pop") if form == "ln" else F.col("pop").cast("double")).alias("base"))


def sim_of(t):
    return share(rk.artist_similarity(t.filter("artist is not null").select("pid", "artist")))


ART = POP + """, art AS (SELECT DISTINCT pid, usr, artist FROM train JOIN song USING (song) WHERE artist IS NOT NULL),
    cnt AS (SELECT x.artist AS a, y.artist AS b, count(*) AS n FROM art x JOIN art y ON x.pid = y.pid GROUP BY 1, 2),
    sim AS (SELECT c.a, c.b, c.n, c.n / sqrt(x.n * y.n) AS sim FROM cnt c JOIN cnt x ON x.a = c.a AND x.b = c.a JOIN cnt y ON y.a = c.b AND y.b = c.b)"""
TOPART = ", topart AS (SELECT artist FROM train JOIN song USING (song) WHERE artist IS NOT NULL GROUP BY artist ORDER BY count(*) DESC, artist LIMIT 10)"
APOP = ", apop AS (SELECT artist, count(*) AS n FROM train JOIN song USING (song) WHERE artist IS NOT NULL AND age > 10 GROUP BY artist)"


def ranked_sql(unit, score, source, k=10, where="TRUE"):
    return f"""SELECT {unit}, song, rank, score FROM (SELECT {unit}, song, score, row_number() OVER (PARTITION BY {unit} ORDER BY score DESC, song) AS rank
        FROM (SELECT {unit}, song, round({score}, 9) AS score FROM {source}) WHERE score > 0 AND {where}) WHERE rank <= {k}"""


def out(d, unit):
    return d.select(unit, "song", F.col("rank").cast("long").alias("rank"), "score")


@query("rank_popularity", "SELECT song, pop, row_number() OVER (ORDER BY pop DESC, song) AS rank FROM pop", "pl", POP)
def rank_popularity(spark, sf):
    pop = train_entries(spark, sf).groupBy("song").agg(F.count("*").alias("pop"))
    return o.ranked(pop, [], "pop", "song")


@query("rank_artist_popularity", "SELECT s.song, round(coalesce(ln(n), 0), 9) AS score, row_number() OVER (ORDER BY coalesce(n, 0) DESC, s.song) AS rank FROM song s LEFT JOIN apop USING (artist) WHERE age <= 10", "pl song", POP + APOP)
def rank_artist_popularity(spark, sf):
    """New songs by ln(artist popularity), counted over the older songs only; 0 for an unknown artist."""
    n = train_entries(spark, sf).filter("age > 10 and artist is not null").groupBy("artist").agg(F.count("*").alias("n"))
    new = v.song(spark, sf).filter("age <= 10").join(n, "artist", "left").select("song", F.coalesce("n", F.lit(0)).alias("n"))
    return o.ranked(new, [], "n", "song").select("song", F.round(F.when(F.col("n") > 0, F.ln("n")).otherwise(0.0), 9).alias("score"), "rank")


@query("artist_cooccurrence", "SELECT a, b, n, round(sim, 9) AS sim FROM sim WHERE a <= b", "pl song", ART)
def artist_cooccurrence(spark, sf):
    t = train_entries(spark, sf).filter("artist is not null")
    return rk.artist_similarity(t.select("pid", "artist")).select("a", "b", "n", F.round("sim", 9).alias("sim"))


WU = ", w AS (SELECT h.usr, s.a AS artist, sum(s.sim) AS w FROM (SELECT DISTINCT usr, artist FROM art) h JOIN sim s ON s.b = h.artist GROUP BY 1, 2)"


@query("rank_cagh_user", ranked_sql("usr", "ln(pop) * w", "w JOIN song USING (artist) JOIN pop USING (song)"), "pl song", ART + WU)
def rank_cagh_user(spark, sf):
    """ln(popularity) x similarity of the artist to the user's history."""
    t = train_entries(spark, sf)
    w = rk.artist_weights(t.filter("artist is not null"), sim_of(t), "usr")
    return out(rk.group_topk(w, song_base(t), "usr", 10), "usr")


def top_artists(t, k=10):
    return t.filter("artist is not null").groupBy("artist").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist").limit(k).select("artist")


@query("rank_cagh_cold_user", "SELECT song, round(ln(pop) * w, 9) AS score, row_number() OVER (ORDER BY round(ln(pop) * w, 9) DESC, song) AS rank FROM (SELECT a AS artist, sum(sim) AS w FROM sim WHERE b IN (SELECT artist FROM topart) GROUP BY a) JOIN song USING (artist) JOIN pop USING (song) QUALIFY rank <= 100", "pl song", ART + TOPART)
def rank_cagh_cold_user(spark, sf):
    """The same for unknown users: similarity to the ten most popular artists; one ranking for everybody."""
    t = train_entries(spark, sf)
    both = rk.both_ways(sim_of(t)).join(top_artists(t).select(F.col("artist").alias("b")), "b", "left_semi")
    w = both.groupBy(F.col("a").alias("artist")).agg(F.sum("sim").alias("w"))
    d = song_base(t).join(w, "artist").select("song", F.round(F.col("base") * F.col("w"), 9).alias("score")).orderBy(F.desc("score"), "song").limit(100)
    return o.top_k(d, [], [F.desc("score"), "song"], 100).select("song", "score", F.col("rank").cast("long").alias("rank"))


SEEDS = ", seed AS (SELECT pid, song FROM pl WHERE ord <= 3 AND md5(pid::VARCHAR || '|test') < '4')"


def seed_rows(spark, sf):
    """First three songs of the held-out lists."""
    held = v.clean_entry(spark, sf).filter(o.md5_of("pid", seed="test") < "4")
    return share(o.top_k(held, ["pid"], ["pos", "song"], 3).join(v.song(spark, sf).select("song", "artist"), "song").select("pid", "song", "artist"))


WS = SEEDS + ", w AS (SELECT h.pid, s.a AS artist, sum(s.sim) AS w FROM (SELECT DISTINCT pid, artist FROM seed JOIN song USING (song) WHERE artist IS NOT NULL) h JOIN sim s ON s.b = h.artist GROUP BY 1, 2)"
NOSEED = "NOT EXISTS (SELECT 1 FROM seed z WHERE z.pid = q.pid AND z.song = q.song)"


def seed_sql(score, source):
    return ranked_sql("pid", score, source).replace("FROM (SELECT pid, song, round", "FROM (SELECT q.pid, q.song, round").replace(f"FROM {source})", f"FROM (SELECT * FROM {source}) q WHERE {NOSEED})")


@query("rank_cagh_seed", seed_sql("pop * w", "w JOIN song USING (artist) JOIN pop USING (song)"), "pl song", ART + WS)
def rank_cagh_seed(spark, sf):
    """Popularity x similarity to the artists of the observed songs, which are not recommended again."""
    t, sd = train_entries(spark, sf), seed_rows(spark, sf)
    w = rk.artist_weights(sd.filter("artist is not null"), sim_of(t), "pid")
    return out(rk.group_topk(w, song_base(t, "pop"), "pid", 10, 3, sd.select("pid", "song")), "pid")


NEW = ART + APOP + ", w AS (SELECT h.pid, s.a AS artist, sum(s.sim) AS w FROM art h JOIN sim s ON s.b = h.artist GROUP BY 1, 2)"


def new_songs(spark, sf, t):
    n = t.filter("age > 10 and artist is not null").groupBy("artist").agg(F.count("*").alias("n"))
    return v.song(spark, sf).filter("age <= 10").join(n, "artist").select("artist", "song", F.ln("n").alias("base"))


@query("rank_cagh_newsong", ranked_sql("pid", "ln(n) * w", "w JOIN song USING (artist) JOIN apop USING (artist) WHERE age <= 10"), "pl song", NEW)
def rank_cagh_newsong(spark, sf):
    """New songs: ln(artist popularity) x similarity to the artists of the list."""
    t = train_entries(spark, sf)
    w = rk.artist_weights(t.filter("artist is not null"), sim_of(t), "pid")
    return out(rk.group_topk(w, new_songs(spark, sf, t), "pid", 10), "pid")


def own_artists(d, unit):
    return d.filter("artist is not null").select(unit, "artist").distinct().withColumn("w", F.lit(1.0))


@query("rank_sagh_user", ranked_sql("usr", "ln(pop)", "(SELECT DISTINCT usr, artist FROM art) h JOIN song USING (artist) JOIN pop USING (song)"), "pl song", ART)
def rank_sagh_user(spark, sf):
    t = train_entries(spark, sf)
    return out(rk.group_topk(own_artists(t, "usr"), song_base(t), "usr", 10), "usr")


@query("rank_sagh_cold_user", "SELECT song, round(ln(pop), 9) AS score, row_number() OVER (ORDER BY pop DESC, song) AS rank FROM pop JOIN song USING (song) WHERE artist IN (SELECT artist FROM topart) QUALIFY rank <= 100", "pl song", POP + TOPART)
def rank_sagh_cold_user(spark, sf):
    t = train_entries(spark, sf)
    d = song_base(t).join(top_artists(t), "artist", "left_semi").select("song", F.round("base", 9).alias("score")).orderBy(F.desc("score"), "song").limit(100)
    return o.top_k(d, [], [F.desc("score"), "song"], 100).select("song", "score", F.col("rank").cast("long").alias("rank"))


@query("rank_sagh_seed", seed_sql("pop", "(SELECT DISTINCT pid, artist FROM seed JOIN song USING (song) WHERE artist IS NOT NULL) h JOIN song USING (artist) JOIN pop USING (song)").replace("round(pop, 9)", "round(pop::DOUBLE, 9)"), "pl song", ART + SEEDS)
def rank_sagh_seed(spark, sf):
    t, sd = train_entries(spark, sf), seed_rows(spark, sf)
    return out(rk.group_topk(own_artists(sd, "pid"), song_base(t, "pop"), "pid", 10, 3, sd.select("pid", "song")), "pid")


@query("rank_sagh_newsong", ranked_sql("pid", "ln(n)", "(SELECT DISTINCT pid, artist FROM art) h JOIN song USING (artist) JOIN apop USING (artist) WHERE age <= 10"), "pl song", ART + APOP)
def rank_sagh_newsong(spark, sf):
    t = train_entries(spark, sf)
    return out(rk.group_topk(own_artists(t, "pid"), new_songs(spark, sf, t), "pid", 10), "pid")


# ---- trajectories: start + L-1 further POI ----

def with_places(q, pois):
    """Attach the sorted POI list of the city as an array."""
    return q.withColumn("all", ft.vocabulary(pois, "poi"))


def text(path):
    return F.array_join(path.cast("array<string>"), ",")


RANDOM = 10  # random predictions per query
DRAWS = f"(SELECT unnest(range(1, {RANDOM + 1})) AS draw)"


@query("rank_random", f"""SELECT qid, draw, start::VARCHAR || ',' || string_agg(poi::VARCHAR, ',' ORDER BY rn) AS path FROM (SELECT qid, draw, start, len, poi,
    row_number() OVER (PARTITION BY qid, draw ORDER BY md5(poi || '|' || start || '|' || len || '|' || draw || '|rnd'), poi) AS rn FROM cquery, cpoi, {DRAWS} WHERE poi <> start) WHERE rn < len GROUP BY qid, draw, start""", "cquery cpoi")
def rank_random(spark, sf):
    """Start and random other POI in hash order, RANDOM draws per query."""
    q = city_queries(share(s.paths(s.place(v.city_visit(spark, sf))).select("start", "len")))
    q = with_places(q, v.city_poi(spark, sf)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(RANDOM))))
    keyed = F.transform("all", lambda p: F.struct(F.md5(F.concat_ws("|", p.cast("string"), F.col("start").cast("string"), F.col("len").cast("string"), F.col("draw").cast("string"), F.lit("rnd"))).alias("h"), p.alias("p")))
    order = F.filter(F.transform(F.array_sort(keyed), lambda x: x["p"]), lambda p: p != F.col("start"))
    return q.select("qid", "draw", text(F.concat(F.array("start"), F.slice(order, 1, F.col("len") - 1))).alias("path"))


LOSS = """lossp AS (SELECT q.qid, x.poi, count(*) AS lost FROM (SELECT t.start, t.len, s.poi, s.usr, count(*) AS k FROM ctraj t JOIN cseq s USING (traj) GROUP BY 1, 2, 3, 4) x
    JOIN (SELECT poi, usr, count(*) AS k FROM cvisit GROUP BY 1, 2) a ON a.poi = x.poi AND a.usr = x.usr AND a.k = x.k JOIN cquery q ON q.start = x.start AND q.len = x.len GROUP BY 1, 2)"""


@query("rank_poi_popularity", """SELECT qid, start::VARCHAR || ',' || string_agg(poi::VARCHAR, ',' ORDER BY rn) AS path FROM (SELECT q.qid, q.start, q.len, i.poi,
    row_number() OVER (PARTITION BY q.qid ORDER BY i.pop - coalesce(lost, 0) DESC, i.poi) AS rn FROM cquery q JOIN cinfo i ON i.poi <> q.start LEFT JOIN lossp l ON l.qid = q.qid AND l.poi = i.poi) WHERE rn < len GROUP BY qid, start""",
       "cquery ctraj cseq cvisit cinfo", LOSS)
def rank_poi_popularity(spark, sf):
    """Start and the most popular other POI; popularity leaves out users seen only in the held-out query."""
    return popularity_paths(spark, sf).select("qid", text(F.col("path")).alias("path"))


def city_paths(spark, sf):
    """The paths of the city's trajectories, written once."""
    return share(spans(s.paths(v.city_stops(spark, sf).withColumnRenamed("start_ts", "ord"))))


def spans(p):
    """Add the range of start (s0, s1) and length (l0, l1) over the users of a trajectory and whether it has a path without a start."""
    w = W.partitionBy("traj")
    return p.select("*", F.min("start").over(w).alias("s0"), F.max("start").over(w).alias("s1"), F.min("len").over(w).alias("l0"), F.max("len").over(w).alias("l1"),
                    F.max(F.col("start").isNull()).over(w).alias("none"))


def popularity_paths(spark, sf, p=None):
    """Start and the most popular other POI of each query, from `city_paths`. A user whose visits of a POI all lie in trajectories of one
    query is lost to the POI there."""
    p = p if p is not None else city_paths(spark, sf)
    q = share(city_queries(p.select("start", "len")))
    of = p.select("usr", F.explode("path").alias("poi"), "s0", "s1", "l0", "l1", "none").groupBy("poi", "usr").agg(
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.max("none").alias("none"))
    one = F.expr("not none and s0 = s1 and l0 = l1 and poi is not null and usr is not null")
    users = share(of.groupBy("poi", F.when(one, F.col("s0")).alias("start"), F.when(one, F.col("l0")).alias("len")).agg(F.count("*").alias("n")))
    lost = users.filter("len is not null").select("start", "len", "poi", F.col("n").alias("lost"))
    # both maps are as long as the city has POI
    per_query = lost.groupBy("start", "len").agg(F.map_from_entries(F.collect_list(F.struct("poi", "lost"))).alias("lost"))
    pop = users.groupBy("poi").agg(F.sum("n").alias("pop")).agg(F.array_sort(F.collect_list(F.struct("poi", "pop")))).scalar()
    d = q.join(per_query, ["start", "len"], "left").withColumn("pop", pop)
    left = F.transform("pop", lambda x: F.struct((F.coalesce(F.try_element_at(F.col("lost"), x["poi"]), F.lit(0)) - x["pop"]).alias("k"), x["poi"].alias("poi")))
    order = F.filter(F.transform(F.array_sort(left), lambda x: x["poi"]), lambda p: p != F.col("start"))
    return d.select("qid", "start", "len", F.concat(F.array("start"), F.slice(order, 1, F.col("len") - 1)).alias("path"))


@query("rank_by_score", f"""SELECT qid, start::VARCHAR || coalesce(',' || string_agg(poi::VARCHAR, ',' ORDER BY rn), '') AS path FROM (SELECT qid, start, len, poi, row_number() OVER (PARTITION BY qid ORDER BY score DESC, poi) AS rn FROM (
    SELECT g.qid, g.start, g.len, g.poi, round(log10(i.pop) - 0.05 * {DIST('p', 'sp')}, 6) AS score {NODE_FROM} WHERE g.poi <> g.start)) WHERE rn < len GROUP BY qid, start""", "cquery ctraj cseq cpoi", ZGRID)
def rank_by_score(spark, sf):
    """Start and the best-scored other POI, for any score table (qid, poi, score)."""
    n = node_table(spark, sf)[2].withColumn("score", F.round(F.col("popularity") - 0.05 * F.col("distStart"), 6))
    return best_scored(n).select("qid", text(F.col("path")).alias("path"))


def best_scored(n):
    """Paths from (qid, start, len, poi, score); only the first len - 1 rows per query are kept before collecting."""
    longest = n.agg(F.max("len")).first()[0] or 1  # a literal bound becomes a group limit before the shuffle
    few = o.top_k(n.filter("poi <> start"), ["qid"], [F.desc("score"), "poi"], longest, "rn").filter("rn < len")
    g = few.groupBy("qid", "start", "len").agg(F.array_sort(F.collect_list(F.struct("rn", "poi"))).alias("a"))
    return g.select("qid", "start", "len", F.concat(F.array("start"), F.transform("a", lambda x: x["poi"])).alias("path"))


@query("nearest_truth", "SELECT qid, arg_min(traj, (md5(traj::VARCHAR || '|nt'), traj)) AS traj FROM ctraj JOIN cquery USING (start, len) WHERE md5(traj::VARCHAR || '|half') < '8' GROUP BY qid", "ctraj cquery")
def nearest_truth(spark, sf):
    """A random training trajectory of the same query (first in hash order)."""
    t = share(s.paths(s.place(v.city_visit(spark, sf))).select("traj", "start", "len"))
    tq = t.filter(o.md5_of("traj", seed="half") < "8").join(city_queries(t), ["start", "len"])
    return tq.groupBy("qid").agg(F.min(F.struct(o.md5_of("traj", seed="nt").alias("h"), F.col("traj"))).alias("b")).select("qid", "b.traj")


@query("softmax_scores", "SELECT unit, item, round(exp(score / 10 - max(score / 10) OVER (PARTITION BY unit)) / z, 9) AS p FROM scored JOIN (SELECT unit, sum(exp(score / 10 - m)) AS z FROM scored JOIN (SELECT unit, max(score / 10) AS m FROM scored GROUP BY unit) USING (unit) GROUP BY unit) USING (unit)", "scored")
def softmax_scores(spark, sf):
    d = v.scored(spark, sf).withColumn("score", F.col("score") / 10)
    return rk.softmax(d, "unit", "score").select("unit", "item", F.round("p", 9).alias("p"))


# ---- linear scores ----

def weights(spark, sf):
    """Weights derived from the tables: mu = mean song vector, v = mean vector of the user's songs, w = mean vector of the list's songs."""
    x = share(v.clean_entry(spark, sf).join(song_vec(spark, sf).select("song", "e"), "song"))
    mean = lambda unit: (x.select(unit, F.posexplode("e").alias("i", "z")).groupBy(unit, "i").agg(F.avg("z").alias("z"))
                         .groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("a")).select(unit, F.transform("a", lambda q: q["z"]).alias(f"w_{unit}")))
    mu = ft.as_array(ft.per_position(song_vec(spark, sf), "e", m=F.avg), "m")
    return x, mean("pid"), mean("usr"), mu


LIN = """vx AS (SELECT pid, usr, song, embedding::DOUBLE[] AS e FROM pl JOIN embeddings ON vec_id = song), ux AS (SELECT pid, usr, unnest(e) AS z, unnest(range(64)) AS i FROM vx),
    wl AS (SELECT pid, list(z ORDER BY i) AS w FROM (SELECT pid, i, avg(z) AS z FROM ux GROUP BY 1, 2) GROUP BY pid), wu AS (SELECT usr, list(z ORDER BY i) AS w FROM (SELECT usr, i, avg(z) AS z FROM ux GROUP BY 1, 2) GROUP BY usr),
    mu AS (SELECT list(z ORDER BY i) AS w FROM (SELECT i, avg(z) AS z FROM (SELECT unnest(embedding::DOUBLE[]) AS z, unnest(range(64)) AS i FROM embeddings) GROUP BY i))"""


@query("linear_score", """SELECT pid, song, round(list_dot_product(e, wl.w) + list_dot_product(e, wu.w) + list_dot_product(e, mu.w), 6) AS known_list,
    round(list_dot_product(e, wu.w) + list_dot_product(e, mu.w), 6) AS cold_list, round(list_dot_product(e, mu.w), 6) AS cold_user FROM vx JOIN wl USING (pid) JOIN wu USING (usr), mu""", "pl", LIN)
def linear_score(spark, sf):
    """x.(w_list + v_user + mu) for the entries; without w_list for a new list, mu alone for a new user."""
    x, wl, wu, mu = weights(spark, sf)
    d = x.join(wl, "pid").join(wu, "usr").withColumn("mu", mu)
    m, u, w = (c.dot(F.col("e"), F.col(k)) for k in ("mu", "w_usr", "w_pid"))
    return d.select("pid", "song", _r(w + u + m, "known_list"), _r(u + m, "cold_list"), _r(m, "cold_user"))


# ---- user neighbours ----

K_NEIGHBOURS = 10


def neighbours(spark, sf, k=K_NEIGHBOURS):
    """(usr, nb, cos, cos_sq, rank): exact k nearest training users of every other user by attribute cosine.

    Vectors are (z-scored age, one-hot country, one-hot subscriber), so a cosine depends on the number m of shared
    categories and on the ages. Training users are grouped by (shared columns, age), of which the k lowest ids are
    enough; three equi-joins bring the groups that share both, the country, or the subscriber. With nothing shared the
    cosine is monotone in the age, so the k lowest and k highest ages do. A user may be met with fewer shared
    categories than true, that is with a lower score; the best score per user counts, and users ahead of a candidate
    in one of the joins are ahead of it in truth too, so k per join are enough.
    """
    a = attributes(spark, sf).withColumn("a", F.when(F.col("age").isNull() | (F.col("age") < 1), 0.0).otherwise(F.col("age").cast("double")))
    st = a.filter("train").agg(F.struct(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"))).scalar()
    a = share(a.withColumn("z", (F.col("a") - st["m"]) / (st["s"] + 1e-6)).select("usr", "train", "z", "country", "subscriber"))
    tr, te = a.filter("train"), a.filter("not train")
    has = lambda col: F.array_contains(ft.vocabulary(tr, col), F.col(col)).cast("double")
    me = ["country", "subscriber", "z"]
    known = share(te.select(*me).distinct().withColumn("hc", has("country")).withColumn("hs", has("subscriber")))
    n1, n2 = F.col("z") * F.col("z") + F.col("hc") + F.col("hs"), F.col("z2") * F.col("z2") + 2.0
    found = None
    for shared in (["country", "subscriber"], ["country"], ["subscriber"], []):
        members = share(o.top_k(tr, [*shared, "z"], ["usr"], k, "r").select(*shared, F.col("z").alias("z2"), F.col("usr").alias("nb")))
        cell = members.groupBy(*shared, "z2").agg(F.min("nb").alias("first"))
        if shared:
            near = known.join(cell, shared)
        else:
            ends = cell.orderBy("z2").limit(k).unionByName(cell.orderBy(F.desc("z2")).limit(k)).distinct()
            few = ends.agg(F.collect_list(F.struct("z2", "first"))).scalar()  # 2k ages
            near = known.withColumn("e", few).withColumn("e", F.explode("e")).select(*known.columns, "e.z2", "e.first")
        num = float(len(shared)) + F.col("z") * F.col("z2")
        near = near.withColumn("cos", F.round(num / F.sqrt(n1 * n2), 9)).withColumn("cos_sq", F.round(num / (n1 * n2), 9))
        best = o.top_k(near, me, [F.desc("cos"), "first"], k, "r").select(*me, "z2", "cos", "cos_sq").join(members, [*shared, "z2"])
        found = best.select(*me, "nb", "cos", "cos_sq") if found is None else found.unionByName(best.select(*me, "nb", "cos", "cos_sq"))
    best = found.groupBy(*me, "nb").agg(F.max(F.struct("cos", "cos_sq")).alias("b")).select(*me, "nb", "b.cos", "b.cos_sq")
    best = o.top_k(best, me, [F.desc("cos"), "nb"], k, "rank")
    return te.select("usr", *me).join(best, me).select("usr", "nb", "cos", "cos_sq", F.col("rank").cast("long").alias("rank"))


KNN = ATTR + f""", knn AS (SELECT usr, nb, cos, cos_sq, row_number() OVER (PARTITION BY usr ORDER BY cos DESC, nb) AS rank FROM (SELECT t.usr, n.usr AS nb,
    round(list_dot_product(t.x, n.x) / sqrt(list_dot_product(t.x, t.x) * list_dot_product(n.x, n.x)), 9) AS cos,
    round(list_dot_product(t.x, n.x) / (list_dot_product(t.x, t.x) * list_dot_product(n.x, n.x)), 9) AS cos_sq
    FROM uvec t JOIN uvec n ON NOT t.train AND n.train) QUALIFY rank <= {K_NEIGHBOURS})"""


@query("user_cosine", "SELECT usr, nb, round(cos, 6) AS cos, round(cos_sq, 6) AS cos_sq FROM knn", extra=KNN)
def user_cosine(spark, sf):
    """Cosine to the nearest training users, in the true form and in the form divided by the squared norms."""
    return neighbours(spark, sf).select("usr", "nb", _r("cos", "cos"), _r("cos_sq", "cos_sq"))


@query("user_knn", "SELECT usr, rank, nb FROM knn", extra=KNN)
def user_knn(spark, sf):
    return neighbours(spark, sf).select("usr", "rank", "nb")


@query("knn_factor_mean", "SELECT usr, round(avg(c_acctbal), 6) AS f1, round(avg(c_nationkey), 6) AS f2, round(avg(c_custkey % 7), 6) AS f3, round(avg(c_acctbal) * 0.001 + avg(c_nationkey) * 0.1 - avg(c_custkey % 7), 6) AS score FROM knn JOIN customer ON c_custkey = nb GROUP BY usr", extra=KNN)
def knn_factor_mean(spark, sf):
    """Mean factor vector of the neighbours and its product with an item vector."""
    f = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("nb"), F.col("c_acctbal").alias("f1"), F.col("c_nationkey").alias("f2"), (F.col("c_custkey") % 7).alias("f3"))
    g = neighbours(spark, sf).join(f, "nb").groupBy("usr").agg(*[F.avg(k).alias(k) for k in ("f1", "f2", "f3")])
    vec, item = F.array("f1", "f2", "f3"), F.array(F.lit(0.001), F.lit(0.1), F.lit(-1.0))
    return g.select("usr", _r("f1", "f1"), _r("f2", "f2"), _r("f3", "f3"), _r(c.dot(vec, item), "score"))
