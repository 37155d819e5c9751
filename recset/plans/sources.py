"""Scans, sources and sinks. Raw files are made by Spark from the given tables in the shared folder, then read back."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.operators import clean, ordering as o, sequence as s
from recset.plans import query
from recset.plans.cleaning import TAGS, tags
from recset.plans.features import NODE_FROM, ZGRID, node_table
from recset.plans.profiles import _r
from recset.plans.splits import NEG, lowest_missing
from recset.session import dealt, fresh_path, share
from recset.sources import readers as rd, sinks as sk, views as v


@query("src_visits_csv", "SELECT usr AS \"userID\", traj AS \"trajID\", v.poi AS \"poiID\", start_ts AS \"startTime\", photos, duration AS \"poiDuration\", cat AS \"poiCat\" FROM visit v JOIN poi p ON p.poi = v.poi", "visit poi")
def src_visits_csv(spark, sf):
    path = fresh_path(spark, "csv")
    vis = v.visit(spark, sf).select(F.col("usr").alias("userID"), F.col("traj").alias("trajID"), F.col("poi").alias("poiID"), F.col("start_ts").alias("startTime"), "photos", F.lit(0).alias("trajLen"), F.col("duration").alias("poiDuration"))
    vis.write.option("header", True).csv(f"{path}/traj-town")
    p = v.poi(spark, sf).select(F.col("poi").alias("poiID"), F.col("cat").alias("poiCat"), F.col("lon").alias("poiLon"), F.col("lat").alias("poiLat"))
    p.write.option("header", True).csv(f"{path}/poi-town")
    poi, traj = rd.visits_csv(spark, path, "town")
    return traj.join(poi.select("poiID", "poiCat"), "poiID").drop("trajLen")


@query("src_entity_tsv", "SELECT 'track' AS type, p_partkey AS id, p_size * 1000::BIGINT AS ts, '{\"name\":\"' || p_name || '\"}' AS properties, '{\"tags\":[{\"id\":' || p_partkey % 9 || '}]}' AS linked FROM part")
def src_entity_tsv(spark, sf):
    path = fresh_path(spark, "tsv")
    line = F.concat_ws("\t", F.lit("track"), F.col("p_partkey").cast("string"), (F.col("p_size") * 1000).cast("string"),
                       F.format_string('{"name":"%s"}', "p_name"), F.format_string('{"tags":[{"id":%d}]}', F.col("p_partkey") % 9))
    v.table(spark, sf, "part").select(line).write.text(path)
    return rd.entity_tsv(spark, path)


PREFIX = '-1 {"value":"love"}'  # fixed text before the JSON of a preference row


@query("src_mixed_tsv", "SELECT 'preference' AS type, o_orderkey AS id, '{\"subjects\":[{\"id\":' || o_custkey || '}]}' AS linked, o_custkey::VARCHAR AS user_ids FROM orders")
def src_mixed_tsv(spark, sf):
    path = fresh_path(spark, "mixed")
    line = F.concat_ws("\t", F.lit("preference"), F.col("o_orderkey").cast("string"), F.concat(F.lit(PREFIX + " "), F.format_string('{"subjects":[{"id":%d}]}', "o_custkey")))
    v.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(line).write.text(path)
    d = rd.mixed_tsv(spark, path, PREFIX)
    return d.withColumn("user_ids", c.id_list(c.json_struct(F.col("linked"), "subjects array<struct<id:long>>")["subjects"]))


@query("src_nested_json", "SELECT o_orderpriority AS category, 'u' || o_custkey AS name, sum(n)::BIGINT AS songs, sum(nulls)::BIGINT AS nulls FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum((l_partkey % 17 = 0)::INT) AS nulls FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2")
def src_nested_json(spark, sf):
    """Gzip JSON arrays of playlists (up to a hundred per array) with nullable song ids.

    A playlist of more than a thousand entries is written in parts, each in an array of its own.
    """
    path = fresh_path(spark, "json")
    li = v.table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    n = li.groupBy("l_orderkey").agg(F.ceil(F.count("*") / 1000).alias("parts"))
    li = li.join(n, "l_orderkey").withColumn("part", F.pmod(F.xxhash64("l_partkey", "l_suppkey", "l_linenumber"), F.col("parts")))
    li = li.groupBy("l_orderkey", "part").agg(F.collect_list(F.struct(
        F.lit("a").alias("artist"), F.lit("t").alias("title"), F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey")).alias("song"))).alias("playlist"))
    od = v.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    obj = F.struct(F.col("o_orderpriority").alias("category"), F.struct(F.concat(F.lit("u"), "o_custkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("member_since")).alias("user"), "playlist")
    arrays = li.join(od, "l_orderkey").groupBy(F.floor(F.col("l_orderkey") / 100), "part").agg(F.to_json(F.collect_list(obj)).alias("value"))
    arrays.select("value").write.option("compression", "gzip").text(path)
    d = rd.nested_json(spark, path)
    k = lambda x: F.sum(x).cast("long")
    return d.groupBy("category", F.col("user.name").alias("name")).agg(k(F.size("playlist")).alias("songs"), k(F.size(F.filter("playlist", lambda x: x["song"].isNull()))).alias("nulls"))


@query("src_commented_tags", "SELECT track, tag FROM tag", extra=TAGS)
def src_commented_tags(spark, sf):
    path = fresh_path(spark, "tags")
    t = tags(spark, sf)
    lines = t.select(F.concat_ws("\t", F.col("track").cast("string"), "tag").alias("value"))
    lines.unionByName(t.filter("track % 50 = 1").select(F.format_string("# note on %d", "track").alias("value"))).write.text(path)
    return rd.commented_tags(spark, path)


@query("src_song_db", "SELECT 'TR' || p_partkey AS track_id, p_partkey AS song_id, p_brand AS artist_mbid FROM part")
def src_song_db(spark, sf):
    path = fresh_path(spark, "songdb")
    v.table(spark, sf, "part").select(F.concat(F.lit("TR"), "p_partkey").alias("track_id"), F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist_mbid"), "p_name", "p_retailprice").write.parquet(path)
    return rd.song_db(spark, path)


@query("sink_csv_semicolon", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv_semicolon(spark, sf):
    path = fresh_path(spark, "semi")
    d = v.table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    sk.csv_semicolon(d, path)
    return spark.read.schema(d.schema).option("sep", ";").option("header", True).csv(path)


@query("sink_dataset", "SELECT song, pid FROM pl WHERE md5(pid::VARCHAR || '|test') < '4'", "pl")
def sink_dataset(spark, sf):
    """Writes train and test partitions; reading the test split touches its folder only."""
    path = fresh_path(spark, "dataset")
    e = v.clean_entry(spark, sf).select("song", "pid", F.when(o.md5_of("pid", seed="test") < "4", "test").otherwise("train").alias("split"))
    sk.dataset(e.withColumn("dataset", F.lit("lists")).withColumn("setting", F.lit("cold")), path)
    return spark.read.parquet(path).filter("dataset = 'lists' and setting = 'cold' and split = 'test'").select("song", "pid")


@query("sink_rank_rows", f"SELECT coalesce(label, 0) || ' qid:' || qid || ' 1:' || printf('%.6f', round(popularity, 6) + 0.0) || ' 2:' || printf('%.6f', round(trajlen, 6) + 0.0) || ' 3:' || printf('%.6f', round(diffdur, 6) + 0.0) AS value FROM (SELECT g.qid, g.poi, CASE WHEN i.pop < 1 THEN -10 ELSE log10(i.pop) END AS popularity, g.len::DOUBLE AS trajlen, i.dur - si.dur AS diffdur {NODE_FROM}) LEFT JOIN (SELECT qid, poi, sum((s.ord > 1)::INT)::BIGINT AS label FROM cquery q JOIN ctraj t ON t.start = q.start AND t.len = q.len JOIN cseq s USING (traj) GROUP BY 1, 2) USING (qid, poi)", "cquery ctraj cseq cpoi", ZGRID)
def sink_rank_rows(spark, sf):
    path = fresh_path(spark, "rankrows")
    seq, trajs, n = node_table(spark, sf)
    lab = seq.join(trajs.select("traj", "start", "len"), "traj").groupBy("start", "len", "poi").agg(F.sum((F.col("ord") > 1).cast("long")).alias("label"))
    d = n.join(lab, ["start", "len", "poi"], "left").fillna(0, ["label"])
    d.select(sk.rank_row(F.col("label"), F.col("qid"), F.array("popularity", "trajLen", "diffDurationStart")).alias("value")).write.text(path)
    return spark.read.text(path)


@query("sink_mf_triples", "SELECT 'U' || song || ',P' || pid || ',5' AS value FROM pl UNION ALL SELECT 'U' || song || ',P' || pid || ',1' FROM neg", "pl song", NEG)
def sink_mf_triples(spark, sf):
    """Positives as 5, the lowest missing ids as 1 (twice as many)."""
    path = fresh_path(spark, "triples")
    e = v.clean_entry(spark, sf).select("pid", "song")
    neg = lowest_missing(e, 2, v.song(spark, sf).select("song"))
    line = lambda d, x: d.select(F.format_string(f"U%d,P%d,{x}", "song", "pid").alias("value"))
    line(e, 5).unionByName(line(neg, 1)).write.text(path)
    return spark.read.text(path)


@query("sink_item_corpus", "SELECT string_agg(coalesce(artist, '$UNK$'), ' ' ORDER BY ord) AS value FROM pl JOIN song USING (song) GROUP BY pid, (ord - 1) // 1000", "pl song")
def sink_item_corpus(spark, sf):
    """Artists of a list in order, one line per list; a list longer than 1000 continues on further lines."""
    path = fresh_path(spark, "corpus")
    known = v.song(spark, sf).filter("artist is not null").select("song", "artist")
    e = clean.left_default(v.placed(v.clean_entry(spark, sf)), known, "song", "artist", "$UNK$")
    clean.grouped_lists(e, ["pid"], "artist", F.col("ord"), 1000, "a").select(F.array_join("a", " ").alias("value")).write.text(path)
    return spark.read.text(path)


@query("merge_partials", "SELECT q, c, round(tau, 6) AS tau, n FROM (SELECT q, c, avg(tau) AS tau, count(*) AS n, row_number() OVER (PARTITION BY q ORDER BY round(avg(tau), 9) DESC, c) AS r FROM (SELECT l_suppkey AS q, l_linenumber AS c, l_discount * 10 AS tau FROM lineitem) GROUP BY 1, 2) WHERE r = 1")
def merge_partials(spark, sf):
    """Union of two partial result files; per query the configuration with the best mean tau (smallest one on ties)."""
    path = fresh_path(spark, "partials")
    d = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_linenumber").alias("c"), (F.col("l_discount") * 10).alias("tau"))
    for i in (0, 1):
        d.filter(F.col("c") % 2 == i).write.parquet(f"{path}/part{i}")
    u = spark.read.parquet(f"{path}/part0").unionByName(spark.read.parquet(f"{path}/part1"))
    g = u.groupBy("q", "c").agg(F.avg("tau").alias("tau"), F.count("*").alias("n"))
    best = F.max_by(F.struct("c", "tau", "n"), F.struct(F.round("tau", 9), -F.col("c")))
    return g.groupBy("q").agg(best.alias("b")).select("q", "b.c", _r("b.tau", "tau"), "b.n")


@query("label_shards", "SELECT idx // 1000 AS shard, min(idx) AS lo, max(idx) + 1 AS hi FROM (SELECT row_number() OVER (ORDER BY pid) - 1 AS idx FROM (SELECT DISTINCT pid FROM pl)) GROUP BY 1", "pl")
def label_shards(spark, sf):
    """Blocks of 1000 labels; the last one is partial."""
    d = share(v.clean_entry(spark, sf).select("pid").distinct())
    d = o.ordinal(d, [], ["pid"], o.id_bucket(d, "pid"), "rn").select((F.col("rn") - 1).alias("idx"))
    return d.groupBy(F.floor(F.col("idx") / 1000).alias("shard")).agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"))


@query("check_equal", """SELECT count(*) AS rows_a, count(*) FILTER (song % 13 <> 0) + count(*) FILTER (song % 19 = 0) AS rows_b,
    count(*) FILTER (song % 13 = 0) AS only_a, count(*) FILTER (song % 19 = 0) AS only_b, count(*) FILTER (song % 13 <> 0 AND song % 17 = 0) AS far_apart FROM pl""", "pl")
def check_equal(spark, sf):
    """Two materialised data sets: exact columns by multiset difference, features within a tolerance.

    The second set lacks every 13th song, has other lists for every 19th, and moved features for every 17th, so that each
    count has something to find.
    """
    path = fresh_path(spark, "equal")
    a = v.clean_entry(spark, sf).withColumn("x", F.log2(F.col("song") + 1))
    moved = F.col("x") + F.when(F.col("song") % 17 == 0, 0.001).otherwise(0.0)
    other = a.filter("song % 13 <> 0").withColumn("x", moved).unionByName(a.filter("song % 19 = 0").withColumn("pid", -F.col("pid")))
    other.write.parquet(path)
    b = spark.read.parquet(path)
    keys = ["pid", "usr", "song", "pos"]
    n = lambda d: d.agg(F.count("*")).scalar()
    k = v.entry_parts(spark, sf)
    # Multiset difference both ways in one pass: how much oftener a row is in the first set than in the second.
    side = lambda d, by: d.select(*keys, F.lit(by).cast("long").alias("by"))
    more = dealt(side(a, 1).unionByName(side(b, -1)), k, *keys).groupBy(*keys).agg(F.sum("by").alias("by"))
    only = lambda by: more.agg(F.coalesce(F.sum(F.greatest(by, F.lit(0).cast("long"))), F.lit(0).cast("long"))).scalar()
    feature = lambda d, name: dealt(d.select(*keys, F.col("x").alias(name)), k, *keys)
    diff = feature(a, "xa").join(feature(b, "xb"), keys).filter("abs(xa - xb) > 1e-6")
    return spark.range(1).select(n(a).alias("rows_a"), n(b).alias("rows_b"), only(F.col("by")).alias("only_a"), only(-F.col("by")).alias("only_b"),
                                 n(diff).alias("far_apart"))
