"""Model fits on the given tables (rows-only checks; see the tests for objective and gradient checks)."""
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import clean, features as ft, folds as fd, models as md, ordering as o, sequence as s
from recset.plans import query
from recset.plans.features import held_features, song_features, song_vec
from recset.plans.profiles import _r, city_queries
from recset.plans.rankers import best_scored, text, train_entries
from recset.plans.sequences import city
from recset.session import share
from recset.sources import views as v


@query("location_clusters")
def location_clusters(spark, sf):
    return md.kmeans(v.poi(spark, sf), ["lon", "lat"]).select("poi", "cluster")


def corpus(spark, sf, item):
    e = v.placed(v.clean_entry(spark, sf))
    if item == "artist":
        known = v.song(spark, sf).filter("artist is not null").select("song", "artist")
        e = clean.left_default(e, known, "song", "artist", "$UNK$")
    e = e.withColumn(item, F.col(item).cast("string"))
    return clean.grouped_lists(e, ["pid"], item, F.col("ord"), 1000, "words")


@query("artist_embeddings")
def artist_embeddings(spark, sf):
    return md.embeddings(corpus(spark, sf, "artist"), "words", 30).select(F.col("word").alias("artist"), "vec")


@query("song_embeddings")
def song_embeddings(spark, sf):
    return md.embeddings(corpus(spark, sf, "song"), "words", 30).select(F.col("word").alias("song"), "vec")


def user_song(spark, sf):
    return share(v.entry(spark, sf).groupBy("usr", "song").agg(F.count("*").alias("r")))


@query("wmf")
def wmf(spark, sf):
    """Factors of users and songs; no user is scored against every song."""
    m = md.wmf(user_song(spark, sf), "usr", "song", "r", 10, 5)
    side = lambda d, name: d.select(F.lit(name).alias("side"), F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("vec"))
    return side(m.userFactors, "usr").unionByName(side(m.itemFactors, "song"))


@query("mf_ratings")
def mf_ratings(spark, sf):
    """Explicit factorisation of 5 (in the list) and 1 (sampled negative): the prediction of every cell."""
    from recset.plans.splits import hashed_negatives
    e = v.clean_entry(spark, sf).select("pid", "song")
    neg = hashed_negatives(e, 1, v.song(spark, sf).select("song"))
    cells = share(e.withColumn("rating", F.lit(5.0)).unionByName(neg.withColumn("rating", F.lit(1.0))))
    m = md.ratings_als(cells, "song", "pid", "rating", 10, 5)
    return m.transform(cells).select("pid", "song", "rating", F.col("prediction").cast("double").alias("prediction"))


@query("mf_dense")
def mf_dense(spark, sf):
    cells = share(train_entries(spark, sf).select("song", "pid").distinct())
    """Factors of songs and lists, next to the objective of the last sweep."""
    p, q, obj = md.dense_mf(cells, "song", "pid", 6, 3, 0.5)
    side = lambda d, key: d.select(F.lit(key).alias("side"), F.col(key).cast("long").alias("id"), "vec", F.lit(obj[-1]).alias("objective"))
    return side(p, "song").unionByName(side(q, "pid"))


@query("feature_to_factor")
def feature_to_factor(spark, sf):
    """Item factors regressed on item features, one linear model per dimension; new songs get predicted factors."""
    cells = share(train_entries(spark, sf).select("song", "pid").distinct())
    p, _, _ = md.dense_mf(cells, "song", "pid", 4, 2, 0.5)
    x = share(song_features(spark, sf).select("song", "x"))
    new = v.song(spark, sf).filter("age <= 10").select("song").join(x, "song")
    out = new
    for i in range(4):
        tr = p.join(x, "song").select("x", F.get("vec", i).alias("y"))
        out = md.linear(tr, out, F.col("x"), "y", regParam=0.01).withColumnRenamed("score", f"f{i}")
    return out.select("song", *[_r(f"f{i}", f"f{i}") for i in range(4)])


@query("binary_relevance")
def binary_relevance(spark, sf):
    """One logistic regression per label (the song's genre) from its vector, all in one job a step; the probability of every label for
    the songs that the fit has not seen."""
    d = song_vec(spark, sf).select("song", F.col("e").alias("x")).join(v.song(spark, sf).select("song", "genre"), "song")
    genres = d.select("genre").filter("genre IS NOT NULL").distinct()
    number = share(o.ordinal(genres, [], ["genre"], o.id_bucket(genres, "genre"), "at").select("genre", (F.col("at") - 1).alias("label")))
    labels = F.when(F.col("label").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("label"))
    d = share(d.join(number, "genre", "left").withColumn("labels", labels))
    held = o.md5_of("song", seed="labels") < "4"
    width = d.agg(F.max(F.size("x"))).first()[0] or 0
    weights, _ = fd.label_fit(d.filter(~held & F.col("genre").isNotNull()), number.count(), width, 0.1)
    table = spark.createDataFrame([(int(i), float(w[0]), [float(z) for z in w[1:]]) for i, w in weights.items()], "label long, b double, w array<double>")
    table = table.join(number, "label").agg(F.collect_list(F.struct("genre", "b", "w"))).scalar()  # a row a label
    out = d.filter(held).select("song", "x", F.col("genre").alias("truth"), F.explode(table).alias("t"))
    p = 1 / (1 + F.exp(-(c.dot(F.col("x"), F.col("t.w")) + F.col("t.b"))))
    return out.select("song", F.col("t.genre").alias("label"), _r(p, "p"), F.coalesce((F.col("truth") == F.col("t.genre")).cast("int"), F.lit(0)).alias("is_label"))


@query("lr_popularity")
def lr_popularity(spark, sf):
    """Membership from z-scored log popularity; scores are monotone in popularity, so one model serves all lists."""
    t = train_entries(spark, sf)
    pop = share(t.groupBy("song").agg(F.count("*").alias("n")))
    st = pop.agg(F.struct(F.avg(F.log2("n")).alias("m"), F.stddev_pop(F.log2("n")).alias("s"))).scalar()
    z = share(pop.select("song", ((F.log2("n") - st["m"]) / (st["s"] + 1e-6)).alias("z"), F.col("n").cast("double").alias("n")))
    total = t.select("pid").distinct().count()
    tr = z.select("z", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("n").alias("w")), F.struct(F.lit(0.0).alias("y"), (total - F.col("n")).alias("w")))).alias("k")).select("z", "k.y", "k.w")
    return md.logistic(tr, z, F.array("z"), "y", weightCol="w", maxIter=20).select("song", _r("score", "score"))


FOLDS = 10


def labelled(spark, sf):
    """(fold, test, qid, start, len, poi, occ, rank_label, x): candidates of all queries for each of FOLDS folds of queries, with the
    features that the fold's own trajectories take no part in. Rows with `test` are the fold's queries, the others train for them."""
    _, seq = city(spark, sf)
    trajs = share(s.paths(seq).select("traj", "start", "len"))
    q = share(city_queries(trajs))
    folds = share(trajs.join(q, ["start", "len"]).select("traj", (F.col("qid") % FOLDS).alias("fold")))
    each = q.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))))
    n = held_features(spark, sf, seq, folds, share(fd.left_out_grid(each, seq, trajs, folds)))
    n_poi = v.city_poi(spark, sf).agg(F.count("*")).first()[0]
    lab = seq.join(trajs.select("traj", "start", "len"), "traj").groupBy("start", "len", "poi").agg(
        F.sum((F.col("ord") > 1).cast("long")).alias("occ"), F.avg((F.lit(n_poi) - F.col("ord") + 1) / n_poi).alias("rank_label"))
    d = n.join(lab, ["start", "len", "poi"], "left").fillna(0, ["occ", "rank_label"])
    x = F.concat("category", "neighbourhood", F.array(*ft.scalars(n)))
    return share(d.select("fold", (F.col("qid") % FOLDS == F.col("fold")).alias("test"), "qid", "start", "len", "poi", "occ", "rank_label", x.alias("x")))


def held_out_paths(d, weights):
    """Start and the best candidates of each query by the fit that has not seen it."""
    return best_scored(fd.scored(d.filter("test"), weights)).select("qid", text(F.col("path")).alias("path"))


@query("poi_occurrence_lr")
def poi_occurrence_lr(spark, sf):
    d = labelled(spark, sf)
    rows = d.filter("not test").select("fold", "x", (F.col("occ") > 0).cast("double").alias("y"))
    return held_out_paths(d, fd.logistic(rows, fd.gram(rows), 0.01))


@query("poi_rank_linreg")
def poi_rank_linreg(spark, sf):
    d = labelled(spark, sf)
    return held_out_paths(d, fd.ridge(fd.gram(rank_targets(d)), 0.01))


def rank_targets(d):
    return d.filter("not test").select("fold", "x", F.col("rank_label").alias("y"))


def rank_rows(d):
    return d.filter("not test").select("fold", "qid", F.col("poi").alias("id"), (F.col("occ") > 0).cast("int").alias("pos"), "x")


def pair_ranked(spark, sf, kind, rate, reg):
    d = labelled(spark, sf)
    weights, _ = fd.pair_fit(rank_rows(d), fd.scales(fd.gram(rank_targets(d))), kind, rate, reg)
    return held_out_paths(d, weights)


@query("pairwise_rank")
def pairwise_rank(spark, sf):
    """Pairwise logistic loss over all pairs of a query, by series on cells of scores; then start + best scored."""
    return pair_ranked(spark, sf, "logistic", 1.0, 0.001)


@query("pairwise_rank_hinge")
def pairwise_rank_hinge(spark, sf):
    """The same with the pairwise squared hinge, by running sums."""
    return pair_ranked(spark, sf, "hinge", 0.3, 0.001)


@query("ranking_svm")
def ranking_svm(spark, sf):
    """Linear ranking with a wide margin: the exact pairwise squared hinge with the weight of the norm of an SVM (1 / C)."""
    return pair_ranked(spark, sf, "hinge", 0.3, 0.1)


@query("mtc_fit")
def mtc_fit(spark, sf):
    """Multitask classification on all audio slots; returns the objective per step."""
    x = share(song_vec(spark, sf).select("song", F.col("e").alias("x")))
    d = x.agg(F.max(F.size("x"))).first()[0] or 0
    e = share(train_entries(spark, sf).select("pid", "usr", "song").join(x.select("song"), "song", "left_semi"))
    _, _, _, losses = md.mtc_fit(x, e.select("pid", "song"), e.select("pid", "usr").distinct(), d, 1.0, 0.1, 0.0001, 4, 0.5)
    return spark.range(len(losses)).select(F.col("id").alias("step"), F.element_at(F.array(*[F.lit(float(k)) for k in losses]), (F.col("id") + 1).cast("int")).alias("objective"))
