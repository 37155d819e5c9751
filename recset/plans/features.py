"""Feature building."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import clean, features as ft, folds as fd, ordering as o, sequence as s
from recset.plans import query
from recset.plans.cleaning import TAGS, seeds, tags, tracks
from recset.plans.profiles import _r, city_queries, poi_info_ext
from recset.plans.sequences import DIST, ZONE, city, zones
from recset.session import share
from recset.sources import views as v


def rounded(col, n=6):
    """Text form of a vector with rounded numbers, for comparison."""
    return F.array_join(F.transform(col, lambda x: F.format_string("%.6f", F.round(x, n) + F.lit(0.0))), ",")


def SQLVEC(lst):
    return f"array_to_string([printf('%.6f', round(x, 6) + 0.0) FOR x IN {lst}], ',')"


def node_table(spark, sf, ext=False):
    """Features of every query's candidates, its own trajectories held out: they give neither statistics nor candidates."""
    _, seq = city(spark, sf)
    trajs = share(s.paths(seq).select("traj", "start", "len"))
    q = share(city_queries(trajs))
    folds = share(trajs.join(q, ["start", "len"]).select("traj", F.col("qid").alias("fold")))
    grid = share(fd.left_out_grid(q.withColumn("fold", F.col("qid")), seq, trajs, folds))
    return seq, trajs, held_features(spark, sf, seq, folds, grid, ext).drop("fold")


def held_features(spark, sf, seq, folds, grid, ext=False):
    """Features of grid(fold, qid, start, len, poi) from the visits that the fold leaves."""
    keys = grid.select("fold", "poi").distinct()
    info = fd.left_out_info(seq, folds, keys)
    if ext:
        info = info.join(held_ext(seq, folds, keys), ["fold", "poi"])
    city_poi, zone = v.city_poi(spark, sf), zones(spark, sf)
    info = share(info.join(city_poi, "poi"))
    return ft.node_features(grid, info, zone, ft.vocabulary(city_poi, "cat"), ft.vocabulary(zone, "cls"), EXT if ext else [], ["fold"])


NODE_SQL = f"""g.qid, g.poi, array_to_string([CASE WHEN x = p.cat THEN 1 ELSE -1 END FOR x IN (SELECT list(DISTINCT cat ORDER BY cat) FROM cpoi)], ',') AS category,
    array_to_string([CASE WHEN x = z.cls THEN 1 ELSE -1 END FOR x IN (SELECT list(DISTINCT cls ORDER BY cls) FROM zone)], ',') AS neighbourhood,
    round(CASE WHEN i.pop < 1 THEN -10 ELSE log10(i.pop) END, 6) AS popularity, round(CASE WHEN i.nvisit < 1 THEN -10 ELSE log10(i.nvisit) END, 6) AS nvisit,
    round(CASE WHEN i.dur < 1 THEN -10 ELSE log10(i.dur) END, 6) AS avgduration, len AS trajlen, CASE WHEN p.cat = sp.cat THEN 1 ELSE -1 END AS samecat,
    round({DIST('p', 'sp')}, 6) AS diststart, i.pop - si.pop AS diffpop, i.nvisit - si.nvisit AS diffvisit, round(i.dur - si.dur, 6) AS diffdur,
    CASE WHEN z.cls = sz.cls THEN 1 ELSE -1 END AS samezone"""
NODE_FROM = """FROM grid g JOIN cpoi p ON p.poi = g.poi JOIN cpoi sp ON sp.poi = g.start JOIN held i ON i.poi = g.poi AND i.qid = g.qid JOIN held si ON si.poi = g.start AND si.qid = g.qid
    JOIN zone z ON z.poi = g.poi JOIN zone sz ON sz.poi = g.start"""
# Statistics and candidates from all other trajectories, counted again for every query.
REST = "cquery q JOIN ctraj t ON t.start <> q.start OR t.len <> q.len JOIN cseq s ON s.traj = t.traj"
ZGRID = f"""grid AS (SELECT DISTINCT qid, q.start, q.len, s.poi FROM {REST} WHERE t.start = q.start),
    held AS (SELECT q.qid, s.poi, avg(s.duration) AS dur, count(*) AS nvisit, count(DISTINCT s.usr) AS pop FROM {REST} GROUP BY 1, 2), zone AS ({ZONE})"""


def _node_out(n):
    flags = lambda col: F.array_join(F.transform(col, lambda x: x.cast("int").cast("string")), ",")
    return n.select("qid", "poi", flags("category").alias("category"), flags("neighbourhood").alias("neighbourhood"), _r("popularity", "popularity"),
                    _r("nVisit", "nvisit"), _r("avgDuration", "avgduration"), F.col("len").alias("trajlen"), F.col("sameCatStart").cast("int").alias("samecat"),
                    _r("distStart", "diststart"), F.col("diffPopStart").cast("long").alias("diffpop"), F.col("diffNVisitStart").cast("long").alias("diffvisit"),
                    _r("diffDurationStart", "diffdur"), F.col("sameNeighbourhoodStart").cast("int").alias("samezone"), *[x for x in n.columns if x.startswith("x_")])


@query("node_features", f"SELECT {NODE_SQL} {NODE_FROM}", "cquery ctraj cseq cpoi", ZGRID)
def node_features(spark, sf):
    return _node_out(node_table(spark, sf)[2])


EXT = ["photo_size", "photo_sum", "photo_mean", "photo_p10", "photo_p50", "photo_p90", "dur_sum", "dur_p10", "dur_p50", "dur_p90"]
EXT_SQL = f"""ext AS (SELECT q.qid, s.poi, count(*) AS photo_size, sum(photos) AS photo_sum, avg(photos) AS photo_mean, quantile_cont(photos, 0.1) AS photo_p10,
    quantile_cont(photos, 0.5) AS photo_p50, quantile_cont(photos, 0.9) AS photo_p90, sum(duration) AS dur_sum, quantile_cont(duration, 0.1) AS dur_p10,
    quantile_cont(duration, 0.5) AS dur_p50, quantile_cont(duration, 0.9) AS dur_p90 FROM {REST} GROUP BY 1, 2)"""


def held_ext(seq, folds, keys):
    """Photo and duration statistics of (fold, poi) without the fold's visits."""
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = fd.left_out_sums(seq, folds, keys, {"photo_size": F.count("photos"), "photo_sum": F.sum("photos"), "dur_sum": F.sum("duration")})
    out = out.withColumn("photo_mean", F.col("photo_sum") / F.col("photo_size"))
    for col, pre in (("photos", "photo"), ("duration", "dur")):
        p = fd.left_out_percentiles(seq, folds, keys, col, qs)
        out = out.join(p.select("fold", "poi", *[F.col(k).alias(f"{pre}_{k}") for k in qs]), ["fold", "poi"], "left")
    return out.fillna(0)


@query("node_features_ext", f"SELECT {NODE_SQL}, {SQLVEC('[' + ', '.join(f'e.{x}::DOUBLE' for x in EXT) + ', ' + ', '.join(f'(e.{x} - se.{x})::DOUBLE' for x in EXT) + ']')} AS ext {NODE_FROM} JOIN ext e ON e.poi = g.poi AND e.qid = g.qid JOIN ext se ON se.poi = g.start AND se.qid = g.qid",
       "cquery ctraj cseq cpoi", ZGRID + ", " + EXT_SQL)
def node_features_ext(spark, sf):
    n = node_table(spark, sf, ext=True)[2]
    vec = F.array(*[F.col(x) for x in EXT], *[F.col(f"diff_{x}") for x in EXT])
    return _node_out(n.withColumn("x_ext", rounded(vec))).withColumnRenamed("x_ext", "ext")


@query("train_labels_count", "SELECT qid, poi, sum((s.ord > 1)::INT)::BIGINT AS label FROM cquery q JOIN ctraj t ON t.start = q.start AND t.len = q.len JOIN cseq s USING (traj) GROUP BY 1, 2", "cquery ctraj cseq")
def train_labels_count(spark, sf):
    """Occurrences of a POI in the trajectories of the query, start excluded. POI without a row have label 0."""
    _, seq = city(spark, sf)
    t = share(s.paths(seq).select("traj", "start", "len"))
    tq = t.join(city_queries(t), ["start", "len"]).select("traj", "qid")
    return seq.join(tq, "traj").groupBy("qid", "poi").agg(F.sum((F.col("ord") > 1).cast("long")).alias("label"))


@query("train_labels_rank", "SELECT traj, poi, 25 - (ord - 1) AS label FROM cseq WHERE len >= 2", "cseq")
def train_labels_rank(spark, sf):
    """label = M - position (0-based) for the M POI of the city."""
    seq = s.place(v.city_visit(spark, sf))
    keep = seq.filter("ord = 2").select("traj")
    m = v.city_poi(spark, sf).agg(F.count("*")).scalar()
    return seq.join(keep, "traj", "left_semi").select("traj", "poi", (m - F.col("ord") + 1).alias("label"))


@query("rank_labels", "SELECT traj, poi, round((25 - (ord - 1))::DOUBLE / 25, 6) AS label, CASE WHEN ord = 1 THEN 1 ELSE 0 END AS truncated, 1 AS sign FROM cseq", "cseq")
def rank_labels(spark, sf):
    """(P - position) / P; `truncated` is the integer form, `sign` the binary form. POI off the path: 0, 0 and -1."""
    m = v.city_poi(spark, sf).agg(F.count("*")).scalar()
    x = (m - F.col("ord") + 1) / m
    return s.place(v.city_visit(spark, sf)).select("traj", "poi", _r(x, "label"), F.floor(x).cast("int").alias("truncated"), F.lit(1).alias("sign"))


@query("onehot_genre", "SELECT song, array_to_string([CASE WHEN g = genre THEN 1 ELSE 0 END FOR g IN (SELECT list(DISTINCT genre ORDER BY genre) FROM song WHERE genre IS NOT NULL)], ',') AS hot FROM song WHERE genre IS NOT NULL", "song")
def onehot_genre(spark, sf):
    so = v.song(spark, sf).filter("genre is not null")
    hot = so.withColumn("g", ft.vocabulary(so, "genre")).withColumn("h", c.one_hot(F.col("genre"), F.col("g")))
    return hot.select("song", F.array_join(F.transform("h", lambda x: x.cast("int").cast("string")), ",").alias("hot"))


GENRE_LIST = "(SELECT list(DISTINCT genre ORDER BY genre) FROM song WHERE genre IS NOT NULL)"


def genre_vectors(spark, sf):
    """One-hot genre; songs without genre get the mean vector of the others."""
    so = v.song(spark, sf)
    known = so.filter("genre is not null")
    hot = so.withColumn("g", ft.vocabulary(known, "genre")).withColumn("h", F.when(F.col("genre").isNotNull(), c.one_hot(F.col("genre"), F.col("g"))))
    n = known.groupBy("genre").agg(F.count("*").alias("k"))
    counts = n.agg(F.array_sort(F.collect_list(F.struct("genre", F.col("k")))).alias("a"))
    mean = counts.select(F.transform("a", lambda x: x["k"] / F.aggregate(F.transform("a", lambda y: y["k"]), F.lit(0).cast("long"), lambda p, q: p + q)).alias("m")).scalar()
    return hot.withColumn("m", mean).select("song", F.coalesce("h", "m").alias("gvec"))


GVEC = f"gmean AS (SELECT list(k ORDER BY genre) AS m FROM (SELECT genre, count(*)::DOUBLE / (SELECT count(*) FROM song WHERE genre IS NOT NULL) AS k FROM song WHERE genre IS NOT NULL GROUP BY genre)), gv AS (SELECT song, CASE WHEN genre IS NULL THEN (SELECT m FROM gmean) ELSE [(g = genre)::INT::DOUBLE FOR g IN {GENRE_LIST}] END AS gvec FROM song)"


@query("impute_mean_onehot", f"SELECT song, {SQLVEC('gvec')} AS gvec FROM gv", "song", GVEC)
def impute_mean_onehot(spark, sf):
    return genre_vectors(spark, sf).select("song", rounded("gvec").alias("gvec"))


@query("onehot_tags", "SELECT song, array_to_string([CASE WHEN list_contains(ts, g) THEN 1 ELSE 0 END FOR g IN (SELECT list(DISTINCT tag ORDER BY tag) FROM tag)], ',') AS hot FROM (SELECT song, list(DISTINCT tag) AS ts FROM trk JOIN tag USING (track) GROUP BY song)", extra=TAGS)
def onehot_tags(spark, sf):
    tg = tags(spark, sf)
    st = tracks(spark, sf).join(tg, "track").groupBy("song").agg(F.collect_set("tag").alias("ts")).withColumn("g", ft.vocabulary(tg, "tag"))
    return st.select("song", F.array_join(F.transform("g", lambda t: F.array_contains(F.col("ts"), t).cast("int").cast("string")), ",").alias("hot"))


# The 17 picked positions of the feature array (0-based).
SLOTS = list(range(0, 34, 2))


def song_vec(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("song"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long").alias("label"))


@query("audio_slice", f"SELECT vec_id AS song, {SQLVEC('[embedding[i + 1]::DOUBLE FOR i IN range(0, 34, 2)]')} AS audio FROM embeddings")
def audio_slice(spark, sf):
    return song_vec(spark, sf).select("song", rounded(c.pick(F.col("e"), SLOTS)).alias("audio"))


@query("scalar_ratios", "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, round(CASE WHEN l_quantity - 1 = 0 THEN 0 ELSE l_discount / (l_quantity - 1) END, 6) AS fade_in, round(CASE WHEN l_quantity - 1 = 0 THEN 0 ELSE l_tax / (l_quantity - 1) END, 6) AS fade_out FROM lineitem")
def scalar_ratios(spark, sf):
    """Two ratios to a duration that may be 0; undefined ratios become 0."""
    d = F.col("l_quantity") - 1
    safe = lambda x: F.round(F.coalesce(F.nanvl(F.try_divide(F.col(x), d), F.lit(0.0)), F.lit(0.0)), 6)
    return v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
                                                 safe("l_discount").alias("fade_in"), safe("l_tax").alias("fade_out"))


@query("log_popularity", "SELECT song, round(log2(count(*) + 1), 6) AS log2_pop, round(ln(count(*) + 1), 6) AS ln_pop FROM pl GROUP BY song", "pl")
def log_popularity(spark, sf):
    pop = v.clean_entry(spark, sf).groupBy("song").agg(F.count("*").alias("n"))
    return pop.select("song", _r(F.log2(F.col("n") + 1), "log2_pop"), _r(F.ln(F.col("n") + 1), "ln_pop"))


@query("feature_concat", f"SELECT v.vec_id AS song, {SQLVEC('list_concat(list_concat([embedding[i + 1]::DOUBLE FOR i IN range(0, 34, 2)], gvec), [log2(coalesce(n, 0) + 1)])')} AS x FROM embeddings v JOIN gv ON gv.song = v.vec_id LEFT JOIN (SELECT song, count(*) AS n FROM pl GROUP BY song) p ON p.song = v.vec_id", "song pl", GVEC)
def feature_concat(spark, sf):
    return song_features(spark, sf).select("song", rounded("x").alias("x"))


def song_features(spark, sf):
    """Audio slots + genre vector + log popularity."""
    pop = v.clean_entry(spark, sf).groupBy("song").agg(F.count("*").alias("n"))
    d = song_vec(spark, sf).join(genre_vectors(spark, sf), "song").join(pop, "song", "left")
    return d.select("song", "label", F.concat(c.pick(F.col("e"), SLOTS), F.col("gvec"), F.array(F.log2(F.coalesce("n", F.lit(0)) + 1).cast("double"))).alias("x"))


POSITIONS = "ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings)"


def _scaled(key, body):
    return f"SELECT vec_id AS song, array_to_string(list(printf('%.6f', round({body}, 6) + 0.0) ORDER BY i), ',') AS x FROM ex JOIN st USING (i) GROUP BY vec_id"


@query("zscore", _scaled("z", "(x - m) / (sd + 1e-6)"), extra=POSITIONS + ", st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM ex WHERE label < 7 GROUP BY i)")
def zscore(spark, sf):
    d = song_vec(spark, sf)
    return ft.zscore(d, d.filter("label < 7"), "e", "x").select("song", rounded("x").alias("x"))


@query("minmax_scale", _scaled("m", "2 * (x - lo) / (hi - lo) - 1"), extra=POSITIONS + ", st AS (SELECT i, min(x) AS lo, max(x) AS hi FROM ex WHERE label < 7 GROUP BY i)")
def minmax_scale(spark, sf):
    d = song_vec(spark, sf)
    return ft.minmax(d, d.filter("label < 7"), "e", "x").select("song", rounded("x").alias("x"))


@query("maxabs_scale", _scaled("a", "x / ma"), extra=POSITIONS + ", st AS (SELECT i, max(abs(x)) AS ma FROM ex WHERE label < 7 GROUP BY i)")
def maxabs_scale(spark, sf):
    d = song_vec(spark, sf)
    return ft.maxabs(d, d.filter("label < 7"), "e", "x").select("song", rounded("x").alias("x"))


@query("label_matrix", "SELECT song, pid FROM pl WHERE song IN (SELECT song FROM song WHERE age > 10)", "pl song")
def label_matrix(spark, sf):
    return v.clean_entry(spark, sf).join(v.song(spark, sf).filter("age > 10").select("song"), "song", "left_semi").select("song", "pid")


@query("label_mask", """SELECT (SELECT count(DISTINCT song) FROM pl) AS songs, count(DISTINCT pid) AS held_lists, sum((ord <= 3)::INT)::BIGINT AS seeds,
    sum((ord <= 3)::INT)::BIGINT + (SELECT count(DISTINCT song) FROM pl) * ((SELECT count(DISTINCT pid) FROM pl) - count(DISTINCT pid)) AS known,
    count(DISTINCT pid) * (SELECT count(DISTINCT song) FROM pl) - sum((ord <= 3)::INT)::BIGINT AS unknown FROM pl WHERE md5(pid::VARCHAR || '|test') < '4'""", "pl")
def label_mask(spark, sf):
    """Known and unknown cells of the song x list matrix by arithmetic; the grid is never built."""
    e = v.clean_entry(spark, sf)
    held = o.md5_of("pid", seed="test") < "4"
    n = lambda col: e.select(col).distinct().agg(F.count("*")).scalar()
    per = e.filter(held).groupBy("pid").agg(F.least(F.count("*"), F.lit(3)).alias("k"))
    one = per.agg(F.count("*").alias("held_lists"), F.sum("k").alias("seeds")).withColumn("songs", n("song")).withColumn("lists", n("pid"))
    return one.select("songs", "held_lists", "seeds", (F.col("seeds") + F.col("songs") * (F.col("lists") - F.col("held_lists"))).alias("known"),
                      (F.col("held_lists") * F.col("songs") - F.col("seeds")).alias("unknown"))


def attributes(spark, sf):
    """User attributes with training flag; some values occur only among the other users."""
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("usr"), F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_acctbal") / 100)).alias("age"),
        F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("subscriber"), (o.md5_of("c_custkey", seed="u") >= "4").alias("train"))


ATTR = """att AS (SELECT c_custkey AS usr, CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal / 100) END AS age, c_nationkey::VARCHAR AS country, c_mktsegment AS subscriber,
    md5(c_custkey::VARCHAR || '|u') >= '4' AS train FROM customer), att1 AS (SELECT *, CASE WHEN age IS NULL OR age < 1 THEN 0 ELSE age END::DOUBLE AS a FROM att),
    ast AS (SELECT avg(a) AS m, stddev_pop(a) AS sd, list(DISTINCT country ORDER BY country) AS cs, list(DISTINCT subscriber ORDER BY subscriber) AS ss FROM att1 WHERE train),
    uvec AS (SELECT usr, train, list_concat(list_concat([(a - m) / (sd + 1e-6)], [(x = country)::INT::DOUBLE FOR x IN cs]), [(x = subscriber)::INT::DOUBLE FOR x IN ss]) AS x FROM att1, ast)"""


def user_vectors(spark, sf):
    a = attributes(spark, sf).withColumn("a", F.when(F.col("age").isNull() | (F.col("age") < 1), 0.0).otherwise(F.col("age").cast("double")))
    tr = a.filter("train")
    st = tr.agg(F.struct(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"))).scalar()
    a = a.withColumn("_c", ft.vocabulary(tr, "country")).withColumn("_s", ft.vocabulary(tr, "subscriber"))
    z = (F.col("a") - st["m"]) / (st["s"] + 1e-6)
    return a.select("usr", "train", F.concat(F.array(z), c.one_hot(F.col("country"), F.col("_c")), c.one_hot(F.col("subscriber"), F.col("_s"))).alias("x"))


@query("user_attr_features", f"SELECT usr, {SQLVEC('x')} AS x FROM uvec", extra=ATTR)
def user_attr_features(spark, sf):
    return user_vectors(spark, sf).select("usr", rounded("x").alias("x"))


@query("seed_features", f"SELECT p.pid, p.song AS seed, {SQLVEC('gvec')} AS x, n AS n_songs FROM pl p JOIN gv USING (song) JOIN (SELECT pid, count(*) AS n FROM pl GROUP BY pid) USING (pid) WHERE ord = 1", "pl song", GVEC)
def seed_features(spark, sf):
    """Features of a list are those of its first song; its labels are the songs of the list (kept as entries)."""
    e = v.clean_entry(spark, sf)
    n = e.groupBy("pid").agg(F.min(F.struct("pos", "song")).alias("f"), F.count("*").alias("n_songs"))
    return n.select("pid", F.col("f.song").alias("song"), "n_songs").join(genre_vectors(spark, sf), "song").select(
        "pid", F.col("song").alias("seed"), rounded("gvec").alias("x"), "n_songs")


@query("pair_differences", """SELECT a.unit, count(*) AS n_pairs, round(sum(a.score - b.score), 6) AS diff_sum, round(sum((a.score - b.score) * (a.score - b.score)), 6) AS diff_sq
    FROM scored a JOIN scored b ON a.unit = b.unit AND a.pos = 1 AND b.pos = 0 GROUP BY a.unit""", "scored")
def pair_differences(spark, sf):
    """Pairs with different labels, summed per query in closed form: count, sum of (x+ - x-) and sum of its square."""
    p, x = F.col("pos") == 1, F.col("score")
    m = lambda cond, e: F.coalesce(F.sum(F.when(cond, e)), F.lit(0.0))
    g = v.scored(spark, sf).groupBy("unit").agg(*[m(cond, e).alias(n) for n, cond, e in (
        ("n1", p, F.lit(1.0)), ("s1", p, x), ("q1", p, x * x), ("n0", ~p, F.lit(1.0)), ("s0", ~p, x), ("q0", ~p, x * x))])
    return g.filter("n1 > 0 and n0 > 0").selectExpr("unit", "cast(n1 * n0 as bigint) as n_pairs", "round(s1 * n0 - s0 * n1, 6) as diff_sum", "round(q1 * n0 - 2 * s1 * s0 + q0 * n1, 6) as diff_sq")
