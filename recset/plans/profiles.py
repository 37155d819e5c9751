"""Aggregations and profiles."""
from pyspark.sql import functions as F, Window as W

from recset.functions import columns as c
from recset.operators import ordering as o, sequence as s
from recset.plans import query
from recset.session import share
from recset.sources import views as v


def _r(col, name=None, d=6):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, d).alias(name) if name else F.round(col, d)


@query("poi_info", """SELECT poi, cat, round(avg(duration), 6) AS dur, count(*) AS nvisit, count(DISTINCT usr) AS pop,
    round(any_value(lon), 6) AS lon, round(any_value(lat), 6) AS lat
    FROM visit JOIN poi USING (poi) GROUP BY poi, cat""", "visit poi")
def poi_info(spark, sf):
    return s.poi_info(v.visit(spark, sf)).join(v.poi(spark, sf), "poi").select(
        "poi", "cat", _r("dur", "dur"), "nvisit", "pop", _r("lon", "lon"), _r("lat", "lat"))


@query("poi_info_ext", """SELECT poi, count(*) AS photo_size, sum(photos)::BIGINT AS photo_sum, round(avg(photos), 6) AS photo_mean,
    round(quantile_cont(photos, 0.1), 6) AS photo_p10, round(quantile_cont(photos, 0.5), 6) AS photo_p50,
    round(quantile_cont(photos, 0.9), 6) AS photo_p90, sum(duration) AS dur_sum, round(avg(duration), 6) AS dur_mean,
    round(quantile_cont(duration, 0.1), 6) AS dur_p10, round(quantile_cont(duration, 0.5), 6) AS dur_p50,
    round(quantile_cont(duration, 0.9), 6) AS dur_p90 FROM visit GROUP BY poi""", "visit")
def poi_info_ext(spark, sf):
    vis = v.visit(spark, sf)
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    base = vis.groupBy("poi").agg(
        F.count("photos").alias("photo_size"), F.sum("photos").alias("photo_sum"), _r(F.avg("photos"), "photo_mean"),
        F.sum("duration").alias("dur_sum"), _r(F.avg("duration"), "dur_mean"))
    out = base
    for col, pre in (("photos", "photo"), ("duration", "dur")):
        p = o.percentiles(vis, ["poi"], col, qs).select("poi", *[_r(k, f"{pre}_{k}") for k in qs])
        out = out.join(p, "poi", "left")
    return out.fillna(0)


@query("item_popularity", "SELECT song, count(DISTINCT pid) AS pop FROM rawentry GROUP BY song", "rawentry")
def item_popularity(spark, sf):
    return v.entry(spark, sf).groupBy("song").agg(F.count("*").alias("pop"))


@query("item_popularity_train", """SELECT song, count(*) - sum(CASE WHEN h.pid IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS pop_train
    FROM pl LEFT JOIN (SELECT DISTINCT pid FROM pl WHERE md5(pid::VARCHAR || '|test') < '4') h USING (pid) GROUP BY song""", "pl")
def item_popularity_train(spark, sf):
    e = v.clean_entry(spark, sf)
    held = o.md5_of("pid", seed="test") < "4"
    return e.groupBy("song").agg((F.count("*") - F.sum(F.when(held, 1).otherwise(0))).alias("pop_train"))


@query("artist_popularity", """SELECT artist, count(*) AS pop FROM pl JOIN song USING (song)
    WHERE artist IS NOT NULL GROUP BY artist""", "pl song")
def artist_popularity(spark, sf):
    per_song = v.clean_entry(spark, sf).groupBy("song").agg(F.count("*").alias("n"))
    return per_song.join(v.song(spark, sf), "song").filter("artist is not null").groupBy("artist").agg(F.sum("n").alias("pop"))


@query("user_song_counts", """SELECT usr, song, count(*) AS n, sum(count(*)) OVER (PARTITION BY song)::BIGINT AS n_all
    FROM entry GROUP BY usr, song""", "entry")
def user_song_counts(spark, sf):
    own = v.entry(spark, sf).groupBy("usr", "song").agg(F.count("*").alias("n"))
    return own.join(own.groupBy("song").agg(F.sum("n").alias("n_all")), "song").select("usr", "song", "n", "n_all")


@query("user_history", """SELECT DISTINCT usr, song FROM pl WHERE md5(pid::VARCHAR || '|test') >= '4'""", "pl")
def user_history(spark, sf):
    return v.clean_entry(spark, sf).filter(o.md5_of("pid", seed="test") >= "4").select("usr", "song").distinct()


@query("user_profile_counts", """SELECT usr, count(DISTINCT pid) AS n_lists, count(DISTINCT song) AS n_songs FROM entry GROUP BY usr""", "entry")
def user_profile_counts(spark, sf):
    e = v.entry(spark, sf)
    lists = e.select("usr", "pid").distinct().groupBy("usr").agg(F.count("*").alias("n_lists"))
    songs = e.select("usr", "song").distinct().groupBy("usr").agg(F.count("*").alias("n_songs"))
    return lists.join(songs, "usr")


@query("dataset_profile", """SELECT count(DISTINCT usr) AS users, count(DISTINCT pid) AS lists, count(*) AS entries,
    count(DISTINCT song) AS songs, round(count(DISTINCT pid)::DOUBLE / count(DISTINCT usr), 6) AS lists_per_user,
    round(count(*)::DOUBLE / count(DISTINCT pid), 6) AS avg_len, count(DISTINCT artist) AS artists,
    round(count(DISTINCT CASE WHEN artist IS NOT NULL THEN song END)::DOUBLE / count(DISTINCT artist), 6) AS songs_per_artist
    FROM pl JOIN song USING (song)""", "pl song")
def dataset_profile(spark, sf):
    e = v.clean_entry(spark, sf)
    n = lambda col: e.select(col).distinct().agg(F.count("*")).scalar()
    known = e.select("song").distinct().join(v.song(spark, sf), "song").filter("artist is not null")
    per = known.groupBy("artist").agg(F.count("*").alias("k")).agg(F.count("*").alias("a"), F.sum("k").alias("s"))
    one = e.agg(F.count("*").alias("entries")).select(
        n("usr").alias("users"), n("pid").alias("lists"), "entries", n("song").alias("songs"),
        per.select("a").scalar().alias("artists"), per.select("s").scalar().alias("_s"))
    return one.select(
        "users", "lists", "entries", "songs", _r(F.col("lists") / F.col("users"), "lists_per_user"),
        _r(F.col("entries") / F.col("lists"), "avg_len"), "artists", _r(F.col("_s") / F.col("artists"), "songs_per_artist"))


@query("describe_lengths", """SELECT count(*) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k) AS lo,
    round(quantile_cont(k, 0.25), 6) AS p25, round(quantile_cont(k, 0.5), 6) AS p50, round(quantile_cont(k, 0.75), 6) AS p75,
    max(k) AS hi FROM (SELECT count(*) AS k FROM entry GROUP BY pid)""", "entry")
def describe_lengths(spark, sf):
    k = v.entry(spark, sf).groupBy("pid").agg(F.count("*").alias("k"))
    p = o.percentiles(k, [], "k", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    base = k.agg(F.count("*").alias("n"), _r(F.avg("k"), "mean"), _r(F.stddev_samp("k"), "std"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return base.select("n", "mean", "std", "lo", "hi", *[F.round(p.select(q).scalar(), 6).alias(q) for q in ("p25", "p50", "p75")])


@query("length_histogram", """SELECT CASE WHEN k = hi THEN 5 ELSE 1 + floor((k - lo) * 5.0::DOUBLE / (hi - lo))::BIGINT END AS bin, count(*) AS n
    FROM (SELECT k, min(k) OVER () AS lo, max(k) OVER () AS hi FROM (SELECT count(*) AS k FROM entry GROUP BY pid)) GROUP BY 1""", "entry")
def length_histogram(spark, sf):
    k = v.entry(spark, sf).groupBy("pid").agg(F.count("*").alias("k"))
    lo, hi = (k.agg(f("k")).scalar().cast("double") for f in (F.min, F.max))
    b = F.least(F.width_bucket(F.col("k").cast("double"), lo, hi, F.lit(5)), F.lit(5).cast("long"))
    return k.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("category_counts", """SELECT genre AS category, count(DISTINCT pid) AS n FROM rawentry JOIN song USING (song)
    WHERE genre IS NOT NULL GROUP BY genre ORDER BY n DESC, category""", "rawentry song")
def category_counts(spark, sf):
    e = v.entry(spark, sf).join(v.song(spark, sf).select("song", "genre"), "song").filter("genre is not null")
    return (e.select(F.col("genre").alias("category"), "pid").distinct().groupBy("category").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "category"))


@query("genre_coverage", "SELECT count(*) AS n_without FROM (SELECT DISTINCT song FROM entry) e JOIN song USING (song) WHERE genre IS NULL", "entry song")
def genre_coverage(spark, sf):
    tagged = v.song(spark, sf).filter("genre is not null").select("song")
    return v.entry(spark, sf).select("song").distinct().join(tagged, "song", "left_anti").agg(F.count("*").alias("n_without"))


@query("label_profile", """SELECT count(DISTINCT item) AS examples, count(DISTINCT unit) AS labels, sum(pos)::BIGINT AS positives,
    round(sum(pos)::DOUBLE / count(DISTINCT item), 6) AS avg_pos,
    round(100.0::DOUBLE * sum(pos) / (count(DISTINCT item) * count(DISTINCT unit)), 6) AS avg_pos_pct,
    round(100 - 100.0::DOUBLE * sum(pos) / (count(DISTINCT item) * count(DISTINCT unit)), 6) AS sparsity_pct FROM scored""", "scored")
def label_profile(spark, sf):
    sc = v.scored(spark, sf)
    n = lambda col: sc.select(col).distinct().agg(F.count("*")).scalar()
    one = sc.agg(F.sum("pos").alias("positives")).select(n("item").alias("examples"), n("unit").alias("labels"), "positives")
    pct = F.lit(100.0) * F.col("positives") / (F.col("examples") * F.col("labels"))
    return one.select("*", _r(F.col("positives") / F.col("examples"), "avg_pos"), _r(pct, "avg_pos_pct"), _r(100 - pct, "sparsity_pct"))


@query("query_groups", """SELECT start, len, count(*) AS n, min(traj) AS first_traj, sum(traj)::BIGINT AS traj_sum FROM ctraj
    WHERE len >= 2 GROUP BY start, len""", "ctraj")
def query_groups(spark, sf):
    """Members stay rows (traj, start, len); the group itself is summarised, never collected."""
    t = s.paths(s.place(v.city_visit(spark, sf)))
    return t.filter("len >= 2").groupBy("start", "len").agg(
        F.count("*").alias("n"), F.min("traj").alias("first_traj"), F.sum("traj").alias("traj_sum"))


def city_queries(trajs):
    """Distinct (start, len) with a 0-based id in sorted order."""
    d = share(trajs.filter("len >= 2").select("start", "len").distinct())
    return o.ordinal(d, [], ["start", "len"], o.id_bucket(d, "start"), "q").select("start", "len", (F.col("q") - 1).alias("qid"))


@query("query_ids", "SELECT start, len, qid FROM cquery", "cquery")
def query_ids(spark, sf):
    return city_queries(s.paths(s.place(v.city_visit(spark, sf))))


# The four ways of keying a query.
KEYS = {"start": ("start",), "start_len": ("start", "len"), "start_user": ("start", "usr"), "start_len_user": ("start", "len", "usr")}


@query("multi_truth_ratio", """SELECT CASE WHEN grouping(len) = 1 AND grouping(usr) = 1 THEN 'start' WHEN grouping(usr) = 1 THEN 'start_len'
    WHEN grouping(len) = 1 THEN 'start_user' ELSE 'start_len_user' END AS keying, start, len, usr, count(*) AS n
    FROM t GROUP BY GROUPING SETS ((start), (start, len), (start, usr), (start, len, usr))""".join(
    ["SELECT keying, count(*) AS queries, sum((n > 1)::INT)::BIGINT AS multi, round(sum((n > 1)::INT)::DOUBLE / count(*), 6) AS ratio FROM (", ") GROUP BY keying"]),
    "ctraj", "t AS (SELECT start, len, usr FROM ctraj WHERE len >= 2)")
def multi_truth_ratio(spark, sf):
    """One pass with grouping sets over trajectories pre-counted by the finest key."""
    t = s.paths(s.place(v.city_visit(spark, sf))).filter("len >= 2").groupBy("start", "len", "usr").agg(F.count("*").alias("n"))
    cols = [F.col("start"), F.col("len"), F.col("usr")]
    sets = [[F.col(x) for x in k] for k in KEYS.values()]
    g = t.groupingSets(sets, *cols).agg(F.sum("n").alias("n"), F.grouping("len").alias("gl"), F.grouping("usr").alias("gu"))
    name = F.when((F.col("gl") == 1) & (F.col("gu") == 1), "start").when(F.col("gu") == 1, "start_len").when(
        F.col("gl") == 1, "start_user").otherwise("start_len_user")
    multi = F.sum((F.col("n") > 1).cast("long"))
    return g.groupBy(name.alias("keying")).agg(F.count("*").alias("queries"), multi.alias("multi"), _r(multi / F.count("*"), "ratio"))


@query("truths_per_query_hist", """SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '>5' END AS bucket, count(*) AS queries,
    sum((len < 5)::INT)::BIGINT AS short_q, sum((len >= 5)::INT)::BIGINT AS long_q
    FROM (SELECT start, len, count(*) AS n FROM ctraj WHERE len >= 2 GROUP BY 1, 2) GROUP BY 1""", "ctraj")
def truths_per_query_hist(spark, sf):
    g = s.paths(s.place(v.city_visit(spark, sf))).filter("len >= 2").groupBy("start", "len").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").otherwise(">5")
    return g.groupBy(b.alias("bucket")).agg(
        F.count("*").alias("queries"), F.sum((F.col("len") < 5).cast("long")).alias("short_q"), F.sum((F.col("len") >= 5).cast("long")).alias("long_q"))


@query("length_by_start", "SELECT start, len, count(*) AS n FROM ctraj GROUP BY start, len", "ctraj")
def length_by_start(spark, sf):
    return s.paths(s.place(v.city_visit(spark, sf))).groupBy("start", "len").agg(F.count("*").alias("n"))


@query("array_percentiles", """SELECT vec_id, round(s[1]::DOUBLE, 6) AS p0, round(s[1 + round_even(63*0.25, 0)::INT]::DOUBLE, 6) AS p25,
    round(s[1 + round_even(63*0.5, 0)::INT]::DOUBLE, 6) AS p50, round(s[1 + round_even(63*0.75, 0)::INT]::DOUBLE, 6) AS p75, round(s[64]::DOUBLE, 6) AS p100
    FROM (SELECT vec_id, list_sort(embedding) AS s FROM embeddings)""")
def array_percentiles(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumn("p", c.nearest_rank(F.col("embedding").cast("array<double>"), [0, 25, 50, 75, 100]))
    return e.select("vec_id", *[_r(F.get("p", i), f"p{q}") for i, q in enumerate((0, 25, 50, 75, 100))])


@query("prune_best_trajectory", """SELECT start, len, arg_min(traj, (-score, traj)) AS traj, max(score)::BIGINT AS score FROM (
    SELECT traj, any_value(c.len) AS len, min(CASE WHEN ord = 1 THEN poi END) AS start, sum(pop) AS score
    FROM cseq c JOIN cinfo USING (poi) WHERE len >= 2 GROUP BY traj) GROUP BY start, len""", "cseq cinfo")
def prune_best_trajectory(spark, sf):
    vis = v.city_visit(spark, sf)
    info = s.poi_info(vis).select("poi", "pop")
    t = s.place(vis).join(info, "poi").groupBy("traj").agg(
        F.count("*").alias("len"), F.max(F.when(F.col("ord") == 1, F.col("poi"))).alias("start"), F.sum("pop").alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("k"), F.col("traj")))
    return t.filter("len >= 2").groupBy("start", "len").agg(best.alias("b")).select("start", "len", "b.traj", (-F.col("b.k")).alias("score"))


@query("traj_profile", """SELECT count(*) AS trajs, (SELECT count(DISTINCT poi) FROM cvisit) AS pois, count(DISTINCT usr) AS users,
    (SELECT count(*) FROM cquery) AS queries, round(avg(len), 6) AS avg_len, sum((len < 5)::INT)::BIGINT AS short_t, sum((len >= 5)::INT)::BIGINT AS long_t,
    (SELECT string_agg(len::VARCHAR || ':' || n, ',' ORDER BY len) FROM (SELECT len, count(*) AS n FROM ctraj GROUP BY len)) AS per_len, any_value(h.one) AS truths_1, any_value(h.few) AS truths_2_5, any_value(h.many) AS truths_6
    FROM ctraj, (SELECT sum((n = 1)::INT)::BIGINT AS one, sum((n BETWEEN 2 AND 5)::INT)::BIGINT AS few, sum((n >= 6)::INT)::BIGINT AS many FROM (SELECT count(*) AS n FROM ctraj WHERE len >= 2 GROUP BY start, len)) h""", "ctraj cquery")
def traj_profile(spark, sf):
    """Sizes, trajectories per length, and queries by their number of truths (1, 2 to 5, 6 and more)."""
    vis = share(s.place(v.city_visit(spark, sf)))
    t = share(s.paths(vis).select("traj", "usr", "start", "len"))
    base = t.agg(F.count("*").alias("trajs"), _r(F.avg("len"), "avg_len"), F.sum((F.col("len") < 5).cast("long")).alias("short_t"),
                 F.sum((F.col("len") >= 5).cast("long")).alias("long_t"))
    n = lambda d: d.distinct().agg(F.count("*")).scalar()
    truths = t.filter("len >= 2").groupBy("start", "len").agg(F.count("*").alias("n"))
    bins = {"truths_1": F.col("n") == 1, "truths_2_5": F.col("n").between(2, 5), "truths_6": F.col("n") >= 6}
    hist = truths.agg(F.struct(*[F.sum(x.cast("long")).alias(k) for k, x in bins.items()])).scalar()
    # As many entries as there are lengths, which the number of POI bounds.
    per = t.groupBy("len").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("len", "n"))).alias("a"))
    per = per.select(F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["len"].cast("string"), x["n"].cast("string"))), ",")).scalar()
    out = base.withColumn("pois", n(vis.select("poi"))).withColumn("users", n(vis.select("usr"))).withColumn("queries", n(t.filter("len >= 2").select("start", "len")))
    return out.withColumn("per_len", per).withColumn("h", hist).select("*", "h.*").drop("h")


@query("balanced_weights", """SELECT unit, pos, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY unit)::DOUBLE / (2 * count(*)), 6) AS weight
    FROM scored GROUP BY unit, pos""", "scored")
def balanced_weights(spark, sf):
    n = v.scored(spark, sf).groupBy("unit", "pos").agg(F.count("*").alias("n"))
    t = n.groupBy("unit").agg(F.sum("n").alias("t"))
    return n.join(t, "unit").select("unit", F.col("pos"), "n", _r(F.col("t") / (2 * F.col("n")), "weight"))
