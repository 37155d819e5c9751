"""Splits and sampling."""
import itertools
import math

from pyspark.sql import functions as F

from recset.operators import ordering as o, sequence as s, splits as sp
from recset.plans import SQL, query
from recset.plans.profiles import _r, city_queries
from recset.plans.sequences import city
from recset.session import dealt, dealt_join, parts, share
from recset.sources import views as v


def aged(spark, sf):
    """Songs by age, newest first, in hash order inside one age: `rn` is the position."""
    so = v.song(spark, sf).select("song", "age").withColumn("_h", o.md5_of("song", seed="age"))
    # hash text buckets inside an age: the bucket struct follows the sort order
    inner = o.ordinal(so, ["age"], ["_h", "song"], o.md5_bucket("_h"), "k")
    n = so.groupBy("age").agg(F.count("*").alias("n"))
    n = o.running(n, [], ["age"], F.col("age"), {"c": F.col("n")}).select("age", (F.col("c") - F.col("n")).alias("before"))
    return inner.join(n, "age").select("song", "age", (F.col("before") + F.col("k")).alias("rn"))


AGED = "aged AS (SELECT song, age, row_number() OVER (ORDER BY age, md5(song::VARCHAR || '|age'), song) AS rn FROM song)"


@query("songs_by_age", "SELECT song, age, rn FROM aged", "song", AGED)
def songs_by_age(spark, sf):
    return aged(spark, sf)


@query("split_cold_songs", """SELECT pid, count(*) FILTER (WHERE rn > 400) AS n_train, count(*) FILTER (WHERE rn <= 200) AS n_test, count(*) FILTER (WHERE rn > 200 AND rn <= 400) AS n_dev
    FROM pl JOIN aged USING (song) GROUP BY pid HAVING count(*) FILTER (WHERE rn > 400) > 0""", "song pl", AGED)
def split_cold_songs(spark, sf):
    """The 200 newest songs are test, the next 200 dev; lists without training songs are dropped."""
    songs = sp.by_position(aged(spark, sf), "rn", [("test", F.lit(200)), ("dev", F.lit(400))], "train").select("song", "split")
    g = v.clean_entry(spark, sf).join(songs, "song").groupBy("pid").agg(*[F.sum((F.col("split") == k).cast("long")).alias(f"n_{k}") for k in ("train", "test", "dev")])
    return g.filter("n_train > 0")


@query("split_latest_fraction", """SELECT song, CASE WHEN rn <= floor(0.2::DOUBLE * n) THEN 'dev' ELSE 'train' END AS split, CASE WHEN rn > floor(0.4::DOUBLE * n) THEN 'train'
    WHEN md5(song::VARCHAR || '|half') < '8' THEN 'dev' ELSE 'test' END AS split3 FROM aged, (SELECT count(*) AS n FROM song)""", "song", AGED)
def split_latest_fraction(spark, sf):
    """Newest 20 % to dev; and the variant with the newest 40 % shuffled into dev and test."""
    a = aged(spark, sf)
    n = v.song(spark, sf).agg(F.count("*")).scalar()
    half = F.when(o.md5_of("song", seed="half") < "8", "dev").otherwise("test")
    return a.select("song", F.when(F.col("rn") <= F.floor(F.lit(0.2) * n), "dev").otherwise("train").alias("split"),
                    F.when(F.col("rn") > F.floor(F.lit(0.4) * n), "train").otherwise(half).alias("split3"))


@query("split_stratified_popularity", """SELECT 'song' AS kind, song AS id, CASE WHEN rn % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM (
    SELECT song, row_number() OVER (ORDER BY n DESC, song) AS rn FROM (SELECT song, count(*) AS n FROM pl GROUP BY song))
    UNION ALL SELECT 'list', pid, CASE WHEN rn % 2 = 0 THEN 'dev' ELSE 'train' END FROM (SELECT pid, row_number() OVER (PARTITION BY usr ORDER BY n DESC, pid) AS rn
    FROM (SELECT usr, pid, count(*) AS n FROM pl GROUP BY 1, 2))""", "pl")
def split_stratified_popularity(spark, sf):
    """Every 5th song in popularity order; every 2nd list of a user in length order."""
    e = v.clean_entry(spark, sf)
    pick = lambda d, k: F.when(F.col("rn") % k == 0, "dev").otherwise("train").alias("split")
    songs = o.ranked(e.groupBy("song").agg(F.count("*").alias("n")), [], "n", "song", "rn")
    lists = o.ranked(e.groupBy("usr", "pid").agg(F.count("*").alias("n")), ["usr"], "n", "pid", "rn")
    return songs.select(F.lit("song").alias("kind"), F.col("song").alias("id"), pick(songs, 5)).unionByName(
        lists.select(F.lit("list").alias("kind"), F.col("pid").alias("id"), pick(lists, 2)))


CAND = "cand AS (SELECT pid, any_value(usr) AS usr, count(*) AS n FROM (SELECT pid, usr, count(*) OVER (PARTITION BY song) AS pop FROM pl) GROUP BY pid HAVING min(pop) >= 10)"


def candidates(e, least=10, n=0):
    """Lists whose songs all have at least `least` occurrences. `n` partitions are dealt out where a shuffle has fewer."""
    pop = e.groupBy("song").agg(F.count("*").alias("pop"))
    return dealt_join(e.select("pid", "usr", "song"), pop, "song", "pid", n).groupBy("pid", "usr").agg(F.min("pop").alias("lo"), F.count("*").alias("n")).filter(F.col("lo") >= least).select("pid", "usr", "n")


@query("split_candidates", "SELECT pid, usr, n FROM cand", "pl", CAND)
def split_candidates(spark, sf):
    return candidates(v.clean_entry(spark, sf), n=v.entry_parts(spark, sf))


@query("split_augment", """SELECT pid, CASE WHEN rn IS NULL THEN 'train' WHEN rn <= floor(0.2::DOUBLE * t) THEN 'test' WHEN rn <= floor(0.25::DOUBLE * t) THEN 'dev' ELSE 'train' END AS split FROM (SELECT DISTINCT pid FROM pl)
    LEFT JOIN (SELECT pid, row_number() OVER (ORDER BY md5(pid::VARCHAR || '|aug'), pid) AS rn FROM cand) USING (pid), (SELECT count(*) AS t FROM cand)""", "pl", CAND)
def split_augment(spark, sf):
    """20 % of the candidates to test and 5 % to dev in hash order; everything else is training."""
    e = v.clean_entry(spark, sf)
    c = candidates(e, n=v.entry_parts(spark, sf))
    total = c.agg(F.count("*")).scalar()
    rn = o.hash_ordinal(c, [], ["pid"], "aug", "rn").select("pid", "rn")
    j = e.select("pid").distinct().join(rn, "pid", "left")
    return sp.by_position(j, "rn", [("test", F.floor(F.lit(0.2) * total)), ("dev", F.floor(F.lit(0.25) * total))], "train").select("pid", "split")


@query("split_cold_playlists", """SELECT pid, usr FROM (SELECT c.pid, c.usr, row_number() OVER (PARTITION BY c.usr ORDER BY md5(c.pid::VARCHAR || '|cold'), c.pid) AS rn, u.n
    FROM cand c JOIN (SELECT usr, count(DISTINCT pid) AS n FROM pl GROUP BY usr) u ON u.usr = c.usr WHERE u.n >= 2) WHERE rn <= floor(0.2::DOUBLE * n)""", "pl", CAND)
def split_cold_playlists(spark, sf):
    """Per user with at least two lists: floor(0.2 n) candidate lists to test, or all candidates when fewer."""
    e = v.clean_entry(spark, sf)
    n = e.select("usr", "pid").distinct().groupBy("usr").agg(F.count("*").alias("total")).filter("total >= 2")
    c = o.hash_ordinal(candidates(e, n=v.entry_parts(spark, sf)).select("pid", "usr"), ["usr"], ["pid"], "cold", "rn")
    return c.join(n, "usr").filter(F.col("rn") <= F.floor(F.lit(0.2) * F.col("total"))).select("pid", "usr")


@query("user_removable", "SELECT DISTINCT usr FROM pl WHERE usr NOT IN (SELECT usr FROM (SELECT usr, song, count(*) AS n, sum(count(*)) OVER (PARTITION BY song) AS t FROM pl GROUP BY 1, 2) WHERE n = t)", "pl")
def user_removable(spark, sf):
    """Users whose songs all occur with somebody else too."""
    e = v.clean_entry(spark, sf)
    # One row per song is all that a shuffle keeps: a song is somebody's own when its least and its greatest user are the same.
    ends = e.filter("song is not null").groupBy("song").agg(F.min("usr").alias("usr"), F.max("usr").alias("last"), F.count("usr").alias("known"), F.count("*").alias("n"))
    sole = ends.filter("usr = last and known = n").select("usr").distinct()
    return e.select("usr").distinct().join(sole, "usr", "left_anti")


@query("split_cold_users", """SELECT usr, CASE WHEN rn <= floor(0.3::DOUBLE * t) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT usr FROM pl) LEFT JOIN (
    SELECT usr, row_number() OVER (ORDER BY md5(usr::VARCHAR || '|cu'), usr) AS rn FROM (SELECT DISTINCT usr FROM pl) WHERE usr NOT IN (
    SELECT usr FROM (SELECT usr, row_number() OVER (PARTITION BY song ORDER BY md5(usr::VARCHAR || '|cu') DESC, usr DESC) AS r FROM pl) WHERE r = 1)) USING (usr),
    (SELECT count(DISTINCT usr) AS t FROM pl)""", "pl")
def split_cold_users(spark, sf):
    """Up to 30 % of the users to test, in hash order, so that every song keeps a training user.

    The last holder of every song stays; all other users may go, in any number, without losing a song.
    """
    pairs = v.clean_entry(spark, sf).select("usr", "song")
    users = pairs.select("usr").distinct()
    free = users.join(sp.last_holders(pairs, "usr", "song", "cu", v.entry_parts(spark, sf)), "usr", "left_anti")
    rn = o.hash_ordinal(free, [], ["usr"], "cu", "rn")
    limit = F.floor(F.lit(0.3) * users.agg(F.count("*")).scalar())
    return sp.by_position(users.join(rn, "usr", "left"), "rn", [("test", limit)], "train").select("usr", "split")


@query("seed_split", """SELECT pid, count(*) FILTER (WHERE ord <= 3) AS n_seed, count(*) FILTER (WHERE ord > 3) AS n_held, count(*) FILTER (WHERE ord > n // 2) AS n_half_held,
    min(CASE WHEN ord = 3 THEN song END) AS last_seed FROM (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM pl) GROUP BY pid""", "pl")
def seed_split(spark, sf):
    """First three songs observed, the rest held; and the variant that holds the last half."""
    e = v.placed(v.clean_entry(spark, sf))
    n = e.groupBy("pid").agg(F.max("ord").alias("n"))
    cnt = lambda cond: F.sum(cond.cast("long"))
    return e.join(n, "pid").groupBy("pid").agg(
        cnt(F.col("ord") <= 3).alias("n_seed"), cnt(F.col("ord") > 3).alias("n_held"), cnt(F.col("ord") > F.floor(F.col("n") / 2)).alias("n_half_held"),
        F.max(F.when(F.col("ord") == 3, F.col("song"))).alias("last_seed"))


@query("random_split", "SELECT doc_id, CASE WHEN md5(doc_id::VARCHAR || '|rs') < '333' THEN 'dev' ELSE 'train' END AS split FROM documents")
def random_split(spark, sf):
    """About 20 % of the rows by a hash threshold; no shuffle."""
    return v.table(spark, sf, "documents", "doc_id").select("doc_id", F.when(o.md5_of("doc_id", seed="rs") < "333", "dev").otherwise("train").alias("split"))


@query("per_user_split", """SELECT pid, usr, CASE WHEN n >= 5 AND rn <= floor(0.2::DOUBLE * n) THEN 'dev' ELSE 'train' END AS split FROM (
    SELECT pid, usr, count(*) OVER (PARTITION BY usr) AS n, row_number() OVER (PARTITION BY usr ORDER BY md5(pid::VARCHAR || '|pu'), pid) AS rn FROM (SELECT DISTINCT pid, usr FROM pl))""", "pl")
def per_user_split(spark, sf):
    d = v.clean_entry(spark, sf).select("pid", "usr").distinct()
    n = d.groupBy("usr").agg(F.count("*").alias("n"))
    return o.hash_ordinal(d, ["usr"], ["pid"], "pu", "rn").join(n, "usr").select(
        "pid", "usr", F.when((F.col("n") >= 5) & (F.col("rn") <= F.floor(F.lit(0.2) * F.col("n"))), "dev").otherwise("train").alias("split"))


@query("per_query_split", """SELECT traj, qid, CASE WHEN rn <= floor(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM (SELECT traj, qid, count(*) OVER (PARTITION BY qid) AS n,
    row_number() OVER (PARTITION BY qid ORDER BY md5(traj::VARCHAR || '|pq'), traj) AS rn FROM ctraj JOIN cquery USING (start, len))""", "ctraj cquery")
def per_query_split(spark, sf):
    t = share(s.paths(s.place(v.city_visit(spark, sf))).select("traj", "start", "len"))
    tq = t.join(city_queries(t), ["start", "len"]).select("traj", "qid")
    n = tq.groupBy("qid").agg(F.count("*").alias("n"))
    return o.hash_ordinal(tq, ["qid"], ["traj"], "pq", "rn").join(n, "qid").select(
        "traj", "qid", F.when(F.col("rn") <= F.floor(F.lit(0.3) * F.col("n")), "test").otherwise("train").alias("split"))


@query("loo_queries", """SELECT q.qid AS fold, q.start, q.len, (SELECT count(*) FROM cvisit) - own AS n_train_visits FROM cquery q JOIN (SELECT start, c.len, count(*) AS own, sum((s.poi = start)::INT) AS own_start
    FROM ctraj c JOIN cseq s USING (traj) GROUP BY 1, 2) o ON o.start = q.start AND o.len = q.len JOIN (SELECT poi, count(*) AS total FROM cvisit GROUP BY poi) p ON p.poi = q.start
    WHERE total - own_start > 0""", "ctraj cquery cseq cvisit")
def loo_queries(spark, sf):
    """One fold per query; a query is skipped when its start POI is unseen in the remaining trajectories."""
    _, seq = city(spark, sf)
    t = share(s.paths(seq).select("traj", "start", "len"))
    own = seq.join(t, "traj").groupBy("start", "len").agg(F.count("*").alias("own"), F.sum((F.col("poi") == F.col("start")).cast("long")).alias("own_start"))
    total = seq.groupBy(F.col("poi").alias("start")).agg(F.count("*").alias("total"))
    q = city_queries(t).join(own, ["start", "len"]).join(total, "start").filter("total - own_start > 0")
    return q.select(F.col("qid").alias("fold"), "start", "len", (seq.agg(F.count("*")).scalar() - F.col("own")).alias("n_train_visits"))


@query("mc_cv_folds", """SELECT fold, attempt, qid FROM (SELECT *, min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY fold) AS first_ok FROM (
    SELECT *, min(CASE WHEN total - out_visits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY fold, attempt) = 1 AS ok FROM (
    SELECT d.fold, d.attempt, d.qid, d.start, p.total, coalesce(x.out_visits, 0) AS out_visits FROM drawn d JOIN (SELECT poi, count(*) AS total FROM cvisit GROUP BY poi) p ON p.poi = d.start
    LEFT JOIN (SELECT fold, attempt, s.poi, count(*) AS out_visits FROM drawn d JOIN ctraj t ON t.start = d.start AND t.len = d.len JOIN cseq s USING (traj) GROUP BY 1, 2, 3) x
    ON x.fold = d.fold AND x.attempt = d.attempt AND x.poi = d.start))) WHERE attempt = first_ok""", "ctraj cquery cseq cvisit",
       """drawn AS (SELECT * FROM (SELECT q.*, fold, attempt, row_number() OVER (PARTITION BY fold, attempt ORDER BY md5(qid || '|' || fold || '|' || attempt || '|mc'), qid) AS rn FROM cquery q,
    (SELECT unnest(range(1, 6)) AS fold), (SELECT unnest(range(1, 4)) AS attempt)) WHERE rn <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM cquery))""")
def mc_cv_folds(spark, sf):
    """Five Monte-Carlo folds of 10 % of the queries, each redrawn until every test start stays in training."""
    _, seq = city(spark, sf)
    t = share(s.paths(seq).select("traj", "start", "len"))
    q = share(city_queries(t))
    size = F.ceil(F.lit(0.1) * q.agg(F.count("*")).scalar())
    per = share(seq.join(t, "traj").groupBy("start", "len", F.col("poi").alias("p")).agg(F.count("*").alias("k")))
    total = per.groupBy(F.col("p").alias("start")).agg(F.sum("k").alias("total"))
    # A draw can only be valid if enough queries leave their start in training when they are drawn alone.
    alone = q.join(total, "start").join(per.filter("p = start").select("start", "len", F.col("k").alias("own")), ["start", "len"], "left")
    if alone.filter("total > coalesce(own, 0)").count() < math.ceil(0.1 * q.count()):
        raise ValueError("no draw leaves every test start in training")
    out, left = None, [1, 2, 3, 4, 5]
    for first in itertools.count(1, 3):
        attempts = F.sequence(F.lit(first), F.lit(first + 2))
        draws = q.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in left]))).withColumn("attempt", F.explode(attempts))
        keyed = draws.withColumn("_h", o.md5_of("qid", "fold", "attempt", seed="mc"))
        drawn = share(o.ordinal(keyed, ["fold", "attempt"], ["_h", "qid"], o.md5_bucket("_h"), "rn").filter(F.col("rn") <= size).select("fold", "attempt", "qid", "start", "len"))
        lost = drawn.join(per, ["start", "len"]).groupBy("fold", "attempt", F.col("p").alias("start")).agg(F.sum("k").alias("lost"))
        d = drawn.join(total, "start").join(lost, ["fold", "attempt", "start"], "left")
        ok = d.groupBy("fold", "attempt").agg(F.min((F.col("total") - F.coalesce("lost", F.lit(0)) > 0).cast("int")).alias("ok")).filter("ok = 1")
        found = ok.groupBy("fold").agg(F.min("attempt").alias("attempt")).collect()  # at most one row per fold
        for r in found:
            one = drawn.filter((F.col("fold") == r["fold"]) & (F.col("attempt") == r["attempt"]))
            out = one if out is None else out.unionByName(one)
        left = [f for f in left if f not in {r["fold"] for r in found}]
        if not left:
            return out.select("fold", "attempt", "qid")


@query("shuffle_rows", "SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '|sh'), vec_id) AS rn FROM embeddings")
def shuffle_rows(spark, sf):
    return o.hash_ordinal(v.table(spark, sf, "embeddings", "vec_id"), [], ["vec_id"], "sh", "rn")


def lowest_missing(e, ratio, songs):
    """The lowest song ids missing from each list, ratio x positives of them, without a list x song grid.

    The r-th missing id of a list lies among the first r + n song ids, n being its length; so the candidates are the
    first (ratio + 1) * n song numbers and the members are taken away.
    """
    e = share(e.select("pid", "song"))
    total = songs.agg(F.count("*")).scalar()
    # The low numbers are asked for by every list, so a number has its row in each part that lists ask it from.
    k = parts(e, (1 << 20) // (ratio + 1))
    n = dealt(e, k, "pid").groupBy("pid").agg(F.count("*").alias("n"))
    c = o.numbers(n, F.least((ratio + 1) * F.col("n"), total), "num").withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(k)))
    numbered = o.ordinal(songs, [], ["song"], o.id_bucket(songs, "song"), "num").join(c.select("num", "part").distinct(), "num")
    c = dealt(c, k, "num", "part").join(dealt(numbered, k, "num", "part"), ["num", "part"]).drop("part")
    c = dealt(c, k, "pid", "song").join(dealt(e, k, "pid", "song"), ["pid", "song"], "left_anti")
    if k > int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        c = share(c)  # read once for the offsets and once for the rows
    c = o.ordinal(c, ["pid"], ["song"], F.floor(F.col("num") / 4096), "r", k)
    return c.filter(F.col("r") <= ratio * F.col("n")).select("pid", "song")


NEG = "neg AS (SELECT pid, song FROM (SELECT p.pid, s.song, p.n, row_number() OVER (PARTITION BY p.pid ORDER BY s.song) AS r FROM (SELECT pid, count(*) AS n FROM pl GROUP BY pid) p, song s WHERE NOT EXISTS (SELECT 1 FROM pl x WHERE x.pid = p.pid AND x.song = s.song)) WHERE r <= 2 * n)"


@query("negative_sampling", "SELECT pid, song FROM neg", "pl song", NEG)
def negative_sampling(spark, sf):
    """Twice as many negatives as positives per list: the lowest ids that are not in the list."""
    return lowest_missing(v.clean_entry(spark, sf), 2, v.song(spark, sf).select("song"))


def hashed_negatives(e, ratio, songs):
    """Seeded negatives per list: hash draws over song numbers without the members, in draw order.

    A list gets 2 * (ratio + 1) * n draws. Repeated draws may leave it short; the lowest missing ids then fill it up, so
    every list gets ratio * n negatives as long as the catalogue has them.
    """
    e = share(e.select("pid", "song"))
    total = songs.agg(F.count("*")).scalar()
    numbered = o.ordinal(songs, [], ["song"], o.id_bucket(songs, "song"), "num")
    n = e.groupBy("pid").agg(F.count("*").alias("n"))
    c = o.numbers(n, F.col("n") * (2 * (ratio + 1)), "d").withColumn("num", F.pmod(F.xxhash64("pid", "d"), total) + 1)
    drawn = c.join(numbered, "num").join(e, ["pid", "song"], "left_anti").select("pid", "song", "d")
    fill = lowest_missing(e, ratio, songs).withColumn("d", F.lit(1 << 60) + F.col("song"))
    best = share(drawn.unionByName(fill).groupBy("pid", "song").agg(F.min("d").alias("d")))
    r = o.ordinal(best, ["pid"], ["d"], F.floor(F.least(F.col("d"), F.lit(1 << 40)) / 4096), "r")
    return r.join(n, "pid").filter(F.col("r") <= ratio * F.col("n")).select("pid", "song")


@query("negative_sampling_seeded")
def negative_sampling_seeded(spark, sf):
    return hashed_negatives(v.clean_entry(spark, sf), 2, v.song(spark, sf).select("song"))


def own(part):
    return f"SELECT song FROM pl JOIN ({SQL['split_cold_users']}) USING (usr) WHERE split = '{part}'"


@query("split_disjoint_check", f"""SELECT (SELECT count(*) FROM (SELECT usr FROM ({SQL['split_cold_users']}) GROUP BY usr HAVING count(*) > 1)) AS shared_users,
    (SELECT count(DISTINCT song) FROM ({own('test')}) WHERE song NOT IN ({own('train')})) AS songs_not_in_train,
    (SELECT count(*) FROM ({SQL['seed_split']}) s JOIN (SELECT pid, count(*) AS whole FROM pl GROUP BY pid) USING (pid) WHERE s.n_seed + s.n_held <> whole) AS lists_not_whole""", "pl")
def split_disjoint_check(spark, sf):
    """Counts of broken invariants of the cold-user and the seed split; all must be 0."""
    e = v.clean_entry(spark, sf)
    u = share(split_cold_users(spark, sf))
    test, train = (e.join(u.filter(F.col("split") == k).select("usr"), "usr", "left_semi") for k in ("test", "train"))
    n = lambda d: d.agg(F.count("*")).scalar()
    both = u.groupBy("usr").agg(F.count("*").alias("k")).filter("k > 1")
    lost = test.select("song").distinct().join(train.select("song"), "song", "left_anti")
    sizes = e.groupBy("pid").agg(F.count("*").alias("n"))
    broken = seed_split(spark, sf).join(sizes, "pid").filter("n_seed + n_held <> n")
    return spark.range(1).select(n(both).alias("shared_users"), n(lost).alias("songs_not_in_train"), n(broken).alias("lists_not_whole"))
