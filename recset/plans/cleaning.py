"""Filters, de-duplication and list cleaning; joins and id mapping."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import clean, ordering as o, sequence as s
from recset.plans import query
from recset.plans.profiles import _r, city_queries
from recset.plans.sequences import DIST
from recset.session import share
from recset.sources import views as v


def raw_rows(spark, sf):
    """Rows of one entity file with repeated ids: id = part key, file position, text and number columns."""
    return v.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber") * 10 + F.length("l_returnflag")).alias("pos"),
        F.concat_ws(" ", F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string")).alias("txt"), F.col("l_extendedprice").alias("num"))


RAW = """raw AS (SELECT l_partkey AS id, l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber * 10 + length(l_returnflag) AS pos,
    l_returnflag || ' ' || l_quantity::INT AS txt, l_extendedprice AS num FROM lineitem)"""


@query("dup_flag", "SELECT id, pos, (row_number() OVER (PARTITION BY id ORDER BY pos, txt, num) > 1)::INT AS is_dup FROM raw", extra=RAW)
def dup_flag(spark, sf):
    return clean.flag_duplicates(share(raw_rows(spark, sf)), "id", "pos", ["txt", "num"]).select("id", "pos", "is_dup")


@query("dup_merge_longest", "SELECT DISTINCT ON (id) id, txt, max(num) OVER (PARTITION BY id) AS num FROM raw ORDER BY id, length(txt) DESC, pos, txt", extra=RAW)
def dup_merge_longest(spark, sf):
    return clean.merge_longest(raw_rows(spark, sf), "id", ["txt"], ["num"], "pos")


@query("drop_empty_lists", """SELECT o_orderkey AS pid, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) > 0""")
def drop_empty_lists(spark, sf):
    n = v.table(spark, sf, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("pid")).agg(F.count("*").alias("n"))
    pl = v.table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("pid")).join(n, "pid", "left").fillna(0, ["n"])
    return pl.filter("n > 0")


def raw_lists(spark, sf):
    """Turn-ordered token lists of conversations: short arrays with null and repeated members."""
    t = v.table(spark, sf, "conversations", "conv_id", "turn", "text")
    words = F.slice(F.split("text", " "), 1, F.greatest(F.size(F.split("text", " ")), F.lit(1)))
    return t.select("conv_id", "turn", F.transform(words, lambda w: F.when(F.length(w) <= 2, F.lit(None)).otherwise(F.length(w))).alias("ids"))


LISTS = "lists AS (SELECT conv_id, turn, [CASE WHEN length(w) <= 2 THEN NULL ELSE length(w) END FOR w IN string_split(text, ' ')] AS ids FROM conversations)"
FIRSTS = "u AS (SELECT conv_id, turn, x, min(i) AS i FROM (SELECT conv_id, turn, unnest(ids) AS x, unnest(range(1, len(ids) + 1)) AS i FROM lists) WHERE x IS NOT NULL GROUP BY 1, 2, 3)"


@query("list_drop_null", "SELECT conv_id, turn, array_to_string(list_filter(ids, lambda x: x IS NOT NULL), ',') AS ids FROM lists", extra=LISTS)
def list_drop_null(spark, sf):
    return raw_lists(spark, sf).select("conv_id", "turn", F.array_join(F.array_compact("ids").cast("array<string>"), ",").alias("ids"))


@query("list_dedup_ordered", "SELECT l.conv_id, l.turn, coalesce(any_value(t.ids), '') AS ids FROM lists l LEFT JOIN (SELECT conv_id, turn, string_agg(x::VARCHAR, ',' ORDER BY i) AS ids FROM u GROUP BY 1, 2) t USING (conv_id, turn) GROUP BY 1, 2", extra=LISTS + ", " + FIRSTS)
def list_dedup_ordered(spark, sf):
    return raw_lists(spark, sf).select("conv_id", "turn", F.array_join(F.array_distinct(F.array_compact("ids")).cast("array<string>"), ",").alias("ids"))


@query("min_distinct_len", "SELECT conv_id, turn, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 5", extra=LISTS + ", " + FIRSTS)
def min_distinct_len(spark, sf):
    n = F.size(F.array_distinct(F.array_compact("ids"))).cast("long")
    return raw_lists(spark, sf).select("conv_id", "turn", n.alias("n")).filter("n >= 5")


@query("user_lists", """SELECT usr, (rn - 1) // 100 AS block, string_agg(pid::VARCHAR, ',' ORDER BY pid) AS pids FROM (
    SELECT usr, pid, row_number() OVER (PARTITION BY usr ORDER BY pid) AS rn FROM (SELECT DISTINCT usr, pid FROM pl)) GROUP BY 1, 2""", "pl")
def user_lists(spark, sf):
    """Lists of each user in blocks of 100, so that a very active user gives many rows and not one huge array."""
    d = share(v.clean_entry(spark, sf).select("usr", "pid").distinct())
    d = o.ordinal(d, ["usr"], ["pid"], o.id_bucket(d, "pid"), "rn")
    return clean.grouped_lists(d, ["usr"], "pid", F.col("rn"), 100, "p").select("usr", "block", F.array_join(F.col("p").cast("array<string>"), ",").alias("pids"))


def seeds(e):
    """First song of every list."""
    return e.groupBy("pid").agg(F.min(F.struct("pos", "song")).alias("s")).select("pid", F.col("s.song").alias("song"))


@query("seed_has_tag", "SELECT pid, song AS seed FROM pl JOIN song USING (song) WHERE ord = 1 AND genre IS NOT NULL", "pl song")
def seed_has_tag(spark, sf):
    tagged = v.song(spark, sf).filter("genre is not null").select("song")
    return seeds(v.clean_entry(spark, sf)).join(tagged, "song", "left_semi").select("pid", F.col("song").alias("seed"))


@query("drop_degenerate_examples", "SELECT item, sum(pos)::BIGINT AS n_pos, count(*) AS k FROM scored GROUP BY item HAVING sum(pos) > 0 AND sum(pos) < count(*)", "scored")
def drop_degenerate_examples(spark, sf):
    g = v.scored(spark, sf).groupBy("item").agg(F.sum("pos").alias("n_pos"), F.count("*").alias("k"))
    return g.filter("n_pos > 0 and n_pos < k")


TOP_ITEMS = "topi AS (SELECT song FROM entry GROUP BY song ORDER BY count(*) DESC, song LIMIT 200)"


@query("top_items_subset", """SELECT pid, count(*) AS n FROM entry e JOIN topi USING (song) WHERE pid IN (
    SELECT pid FROM (SELECT pid, song, row_number() OVER (PARTITION BY pid ORDER BY pos, song) AS r FROM entry) JOIN topi USING (song) WHERE r = 1)
    GROUP BY pid HAVING count(*) > 1""", "entry", TOP_ITEMS)
def top_items_subset(spark, sf):
    """Lists that start in one of the 200 most frequent songs and keep more than one of them."""
    e = v.entry(spark, sf)
    top = e.groupBy("song").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "song").limit(200).select("song")
    start = seeds(e).join(top, "song", "left_semi").select("pid")
    return e.join(top, "song", "left_semi").join(start, "pid", "left_semi").groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1")


@query("systematic_user_sample", """SELECT usr, n FROM (SELECT usr, n, row_number() OVER (ORDER BY n DESC, usr) AS rn FROM
    (SELECT usr, count(DISTINCT pid) AS n FROM entry GROUP BY usr)) WHERE (rn - 1) % 10 = 0""", "entry")
def systematic_user_sample(spark, sf):
    """Every 10th user in the order of the number of lists."""
    n = v.entry(spark, sf).select("usr", "pid").distinct().groupBy("usr").agg(F.count("*").alias("n"))
    return o.ranked(n, [], "n", "usr", "rn").filter((F.col("rn") - 1) % 10 == 0).select("usr", "n")


@query("users_with_n_lists", "SELECT usr FROM entry GROUP BY usr HAVING count(DISTINCT pid) = 10", "entry")
def users_with_n_lists(spark, sf):
    return v.entry(spark, sf).select("usr", "pid").distinct().groupBy("usr").agg(F.count("*").alias("n")).filter("n = 10").select("usr")


# Walks that may repeat a district: one row per step (traj, i, poi).
WALK = """walk AS (SELECT l_orderkey AS traj, s_nationkey::BIGINT AS poi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    seen AS (SELECT *, row_number() OVER (PARTITION BY traj, poi ORDER BY i) AS occ, count(*) OVER (PARTITION BY traj) AS len FROM walk), cutp AS (SELECT traj, min(i) AS cut FROM seen WHERE occ > 1 GROUP BY traj)"""


def walks(spark, sf):
    """Steps (traj, i, poi) of walks with possible repeats: the districts of the lines of an order. Steps stay rows."""
    sup = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("poi"))
    parts = v.table(spark, sf, "part")
    li = v.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumnRenamed("l_orderkey", "traj").join(sup, "l_suppkey")
    bucket = F.col("l_linenumber") * o.BUCKETS + o.id_bucket(parts, "p_partkey", of="l_partkey")
    return share(o.ordinal(li, ["traj"], ["l_linenumber", "l_partkey", "l_suppkey"], bucket, "i").select("traj", "i", "poi"))


def first_visits(w):
    """First step at which a walk reaches each POI."""
    return w.groupBy("traj", "poi").agg(F.min("i").alias("i"))


def loop_free_length(w):
    """(traj, len, keep): walk length and the length of the prefix before the first repeated POI."""
    again = w.join(first_visits(w).withColumnRenamed("i", "first"), ["traj", "poi"]).withColumn("again", F.when(F.col("i") > F.col("first"), F.col("i")))
    g = again.groupBy("traj").agg(F.max("i").alias("len"), F.min("again").alias("cut"))
    return g.select("traj", "len", F.coalesce(F.col("cut") - 1, F.col("len")).alias("keep"))


@query("path_remove_repeats", "SELECT traj, row_number() OVER (PARTITION BY traj ORDER BY i) AS ord, poi FROM seen WHERE occ = 1", extra=WALK)
def path_remove_repeats(spark, sf):
    """Walks without repeated POI, renumbered."""
    f = share(first_visits(walks(spark, sf)))
    return o.ordinal(f, ["traj"], ["i"], o.id_bucket(f, "i"), "ord").select("traj", "ord", "poi")


@query("path_cut_first_loop", "SELECT traj, i AS ord, poi FROM walk LEFT JOIN cutp USING (traj) WHERE cut IS NULL OR i < cut", extra=WALK)
def path_cut_first_loop(spark, sf):
    """The prefix before the first repeated POI."""
    w = walks(spark, sf)
    return w.join(loop_free_length(w), "traj").filter("i <= keep").select("traj", F.col("i").alias("ord"), "poi")


@query("path_cut_first_loop_closest", """SELECT start, want, arg_min(traj, (abs(keep - want), len, traj)) AS traj, arg_min(keep, (abs(keep - want), len, traj)) AS keep FROM (SELECT traj, any_value(len) AS len, coalesce(any_value(cut) - 1, any_value(len)) AS keep,
    min(CASE WHEN i = 1 THEN poi END) AS start FROM seen LEFT JOIN cutp USING (traj) GROUP BY traj), (SELECT unnest([3, 5, 7]) AS want) WHERE len >= want GROUP BY start, want""", extra=WALK)
def path_cut_first_loop_closest(spark, sf):
    """Among walks of length l' >= l from one start: the smallest l' whose cut length is closest to l."""
    w = walks(spark, sf)
    d = loop_free_length(w).join(w.filter("i = 1").select("traj", F.col("poi").alias("start")), "traj")
    d = d.withColumn("want", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7)))).filter("len >= want")
    best = F.min(F.struct(F.abs(F.col("keep") - F.col("want")).alias("a"), "len", "traj", "keep"))
    return d.groupBy("start", "want").agg(best.alias("b")).select("start", "want", "b.traj", "b.keep")


def cut_first_loop(path):
    """The same prefix for a short path held as an array."""
    n = F.size(path)
    repeat = F.filter(F.sequence(F.lit(1), n), lambda i: F.array_position(path, F.element_at(path, i)) < i)
    return F.slice(path, 1, F.when(F.size(repeat) > 0, F.array_min(repeat) - 1).otherwise(n))


# ---- joins and id mapping ----

# Fixed rule: a song has 1 to 3 tracks (id*10 + 0..2); a track is in the feature store when its number is not divisible by 3.
TRACKS = "trk AS (SELECT p_partkey AS song, p_partkey * 10 + k AS track, k AS pos FROM part, (SELECT unnest(range(3)) AS k) WHERE k <= p_partkey % 3)"


def tracks(spark, sf):
    p = v.table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("song"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 3)).alias("pos"))
    return p.select("song", (F.col("song") * 10 + F.col("pos")).alias("track"), "pos")


@query("map_song_artist", "SELECT p_partkey AS song, p_brand AS artist FROM part WHERE p_partkey % 17 <> 0")
def map_song_artist(spark, sf):
    blank = v.table(spark, sf, "part").select(F.col("p_partkey").alias("song"), F.when(F.col("p_partkey") % 17 == 0, "  ").otherwise(F.col("p_brand")).alias("artist"))
    return blank.filter(F.trim("artist") != "")


@query("map_song_tracks", "SELECT song, n_tracks, tracks, count(*) OVER (PARTITION BY n_tracks) AS songs FROM (SELECT song, count(*) AS n_tracks, string_agg(track::VARCHAR, ',' ORDER BY pos) AS tracks FROM trk GROUP BY song)", extra=TRACKS)
def map_song_tracks(spark, sf):
    """Song to its tracks in order, and the number of songs with as many."""
    lists = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "track"))), lambda x: x["track"].cast("string")), ",")
    n = share(tracks(spark, sf).groupBy("song").agg(F.count("*").alias("n_tracks"), lists.alias("tracks")))
    return n.join(n.groupBy("n_tracks").agg(F.count("*").alias("songs")), "n_tracks").select("song", "n_tracks", "tracks", "songs")


@query("first_available_track", "SELECT song, arg_min(track, pos) AS track FROM trk WHERE track % 3 <> 0 GROUP BY song", extra=TRACKS)
def first_available_track(spark, sf):
    t = tracks(spark, sf)
    store = t.select("track").filter("track % 3 <> 0").distinct()
    return t.join(store, "track", "left_semi").groupBy("song").agg(F.min_by("track", "pos").alias("track"))


TAGS = TRACKS + ", tag AS (SELECT track, ['rock','pop','jazz','folk','metal'][1 + track % 5] AS tag FROM trk WHERE track % 4 <> 0)"
# Fixed tag words of the derived tag file.
TAG_WORDS = ["rock", "pop", "jazz", "folk", "metal"]


def tags(spark, sf):
    words = F.array(*[F.lit(w) for w in TAG_WORDS])
    return tracks(spark, sf).filter("track % 4 <> 0").select("track", F.element_at(words, (F.col("track") % 5 + 1).cast("int")).alias("tag"))


@query("song_tags", "SELECT song, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT song, tag FROM trk JOIN tag USING (track)) GROUP BY song", extra=TAGS)
def song_tags(spark, sf):
    return tracks(spark, sf).join(tags(spark, sf), "track").groupBy("song").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("lookup_default_unk", "SELECT coalesce(artist, '$UNK$') AS artist, count(*) AS n FROM entry LEFT JOIN song USING (song) GROUP BY 1", "entry song")
def lookup_default_unk(spark, sf):
    known = v.song(spark, sf).filter("artist is not null").select("song", "artist")
    per_song = v.entry(spark, sf).groupBy("song").agg(F.count("*").alias("k"))
    return clean.left_default(per_song, known, "song", "artist", "$UNK$").groupBy("artist").agg(F.sum("k").alias("n"))


CATALOGUES = """ca AS (SELECT title, artist, song AS id FROM song WHERE artist IS NOT NULL AND song % 2 = 0), cb AS (SELECT title, artist, song AS id FROM song WHERE artist IS NOT NULL AND song % 3 = 0)"""


@query("match_title_artist", """SELECT a.title, a.artist, a.n AS n_a, b.n AS n_b, a.lo AS first_a, b.lo AS first_b, (SELECT count(*) FROM (SELECT DISTINCT title, artist FROM ca)) AS keys_a,
    (SELECT count(*) FROM (SELECT DISTINCT title, artist FROM cb)) AS keys_b FROM (SELECT title, artist, count(*) AS n, min(id) AS lo FROM ca GROUP BY 1, 2) a
    JOIN (SELECT title, artist, count(*) AS n, min(id) AS lo FROM cb GROUP BY 1, 2) b USING (title, artist)""", "song", CATALOGUES)
def match_title_artist(spark, sf):
    """Match two catalogues on (title, artist): each side is grouped first, so a popular key never multiplies out."""
    so = v.song(spark, sf).filter("artist is not null")
    side = lambda k, n: so.filter(F.col("song") % k == 0).groupBy("title", "artist").agg(F.count("*").alias(f"n_{n}"), F.min("song").alias(f"first_{n}"))
    a, b = side(2, "a"), side(3, "b")
    size = lambda d: d.agg(F.count("*")).scalar()
    return a.join(b, ["title", "artist"]).select("*", size(a).alias("keys_a"), size(b).alias("keys_b"))


@query("artist_songs", """SELECT artist, (rn - 1) // 1000 AS block, count(*) AS n, string_agg(song::VARCHAR, ',' ORDER BY song) AS songs FROM (
    SELECT artist, song, row_number() OVER (PARTITION BY artist ORDER BY song) AS rn FROM song WHERE artist IS NOT NULL) GROUP BY 1, 2""", "song")
def artist_songs(spark, sf):
    d = v.song(spark, sf).filter("artist is not null").select("artist", "song")
    d = o.ordinal(d, ["artist"], ["song"], o.id_bucket(d, "song"), "rn")
    return clean.grouped_lists(d, ["artist"], "song", F.col("rn"), 1000, "s").select(
        "artist", "block", F.size("s").cast("long").alias("n"), F.array_join(F.col("s").cast("array<string>"), ",").alias("songs"))


@query("poi_distance", f"SELECT DISTINCT a.poi AS src, b.poi AS dst, round({DIST('p', 'q')}, 6) AS km FROM tseq a JOIN tseq b ON a.traj = b.traj AND b.ord = a.ord + 1 JOIN poi p ON p.poi = a.poi JOIN poi q ON q.poi = b.poi", "tseq poi")
def poi_distance(spark, sf):
    """Distance of the POI pairs that occur as steps; the full pair table is never built."""
    p = v.poi(spark, sf)
    e = s.edge_counts(share(s.place(v.visit(spark, sf)).select("traj", "poi", "ord"))).select("src", "dst")
    side = lambda name, n: p.select(F.col("poi").alias(name), F.col("lon").alias(f"lon{n}"), F.col("lat").alias(f"lat{n}"))
    e = e.join(side("src", 0), "src").join(side("dst", 1), "dst")
    return e.select("src", "dst", _r(c.haversine_km(*[F.col(x) for x in ("lon0", "lat0", "lon1", "lat1")]), "km"))


def candidate_grid(seq, trajs):
    """(qid, poi) for every POI seen in a trajectory with the start of the query: an equi-join on the start."""
    q = city_queries(trajs)
    seen = seq.join(trajs.select("traj", "start"), "traj").select("start", "poi").distinct()
    return q.join(seen, "start")


GRID = "grid AS (SELECT DISTINCT qid, q.start, q.len, s.poi FROM cquery q JOIN ctraj t ON t.start = q.start JOIN cseq s ON s.traj = t.traj)"


@query("query_poi_grid", "SELECT qid, start, len, poi FROM grid", "cquery cseq ctraj", GRID)
def query_poi_grid(spark, sf):
    seq = share(s.place(v.city_visit(spark, sf)))
    return candidate_grid(seq, share(s.paths(seq).select("traj", "start", "len"))).select("qid", "start", "len", "poi")


# Fixed rule of the test song set: the newest songs.
TEST_SONG = "age <= 10"


@query("playlists_touching_test", f"SELECT pid, sum(({TEST_SONG})::INT)::BIGINT AS n_test, count(*) AS n FROM pl JOIN song USING (song) GROUP BY pid HAVING sum(({TEST_SONG})::INT) > 0 AND sum(({TEST_SONG})::INT) < count(*)", "pl song")
def playlists_touching_test(spark, sf):
    test = v.song(spark, sf).filter(TEST_SONG).select("song", F.lit(1).alias("t"))
    return v.clean_entry(spark, sf).join(test, "song", "left").groupBy("pid").agg(
        F.sum(F.coalesce("t", F.lit(0))).cast("long").alias("n_test"), F.count("*").alias("n")).filter("n_test > 0 and n_test < n")


@query("train_minus_query", """SELECT q.qid, (SELECT count(*) FROM ctraj t WHERE NOT (t.start = q.start AND t.len = q.len)) AS n_train_traj,
    (SELECT sum(t.len)::BIGINT FROM ctraj t WHERE NOT (t.start = q.start AND t.len = q.len)) AS n_train_visits FROM cquery q""", "cquery ctraj")
def train_minus_query(spark, sf):
    """Training volume of each leave-one-query-out fold: the whole minus the share of the query."""
    t = share(s.paths(s.place(v.city_visit(spark, sf))).select("traj", "start", "len"))
    own = t.groupBy("start", "len").agg(F.count("*").alias("n"), F.sum("len").alias("k"))
    return city_queries(t).join(own, ["start", "len"]).select(
        "qid", (t.agg(F.count("*")).scalar() - F.col("n")).alias("n_train_traj"), (t.agg(F.sum("len")).scalar() - F.col("k")).alias("n_train_visits"))


@query("candidates_minus_seeds", """SELECT pid, rank, song FROM (SELECT p.pid, t.song, row_number() OVER (PARTITION BY p.pid ORDER BY t.n DESC, t.song) AS rank
    FROM (SELECT DISTINCT pid FROM pl) p, (SELECT song, count(*) AS n FROM pl GROUP BY song ORDER BY n DESC, song LIMIT 50) t
    WHERE NOT EXISTS (SELECT 1 FROM pl o WHERE o.pid = p.pid AND o.song = t.song AND o.ord <= 3)) WHERE rank <= 10""", "pl")
def candidates_minus_seeds(spark, sf):
    """The 10 most popular songs that are not among the three observed songs of a list.

    At most three songs are taken away, so the 13 most popular songs hold the answer of every list exactly.
    """
    e = v.clean_entry(spark, sf)
    k, n_seed = 10, 3
    seen = o.top_k(e, ["pid"], ["pos", "song"], n_seed).groupBy("pid").agg(F.collect_list("song").alias("seen"))
    pop = e.groupBy("song").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "song").limit(k + n_seed)
    top = pop.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "song"))), lambda x: x["song"]).alias("t")).scalar()
    rest = seen.withColumn("t", top).select("pid", F.slice(F.array_except("t", "seen"), 1, k).alias("c"))
    return rest.select("pid", F.posexplode("c").alias("i", "song")).select("pid", (F.col("i") + 1).cast("long").alias("rank"), "song")


@query("common_queries", """SELECT start, len FROM (SELECT start, len, usr % 3 AS method FROM ctraj WHERE len >= 2 GROUP BY ALL) GROUP BY 1, 2 HAVING count(DISTINCT method) = 3""", "ctraj")
def common_queries(spark, sf):
    t = share(s.paths(s.place(v.city_visit(spark, sf))).filter("len >= 2").select("start", "len", (F.col("usr") % 3).alias("m")).distinct())
    one = lambda m: t.filter(F.col("m") == m).select("start", "len")
    return one(0).intersect(one(1)).intersect(one(2))


@query("unknown_users", "SELECT DISTINCT usr FROM entry WHERE usr IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "entry")
def unknown_users(spark, sf):
    known = v.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("usr"))
    return v.entry(spark, sf).select("usr").distinct().join(known, "usr", "left_semi")
