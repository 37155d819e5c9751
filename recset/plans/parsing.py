"""Parsing, text, JSON and date scalars. Raw text is derived from the given tables."""
from pyspark.sql import functions as F

from recset.functions import columns as c
from recset.plans import query
from recset.plans.profiles import _r
from recset.sources import views as v

Q = "chr(34)"


def _raw(spark, sf, expr):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(expr).alias("props"))


# Raw album text: every 7th title has stray quotes, every 5th a semicolon, every 11th row is no JSON at all.
ALBUM = """CASE WHEN p_partkey % 11 = 3 THEN concat('broken ', p_name) ELSE concat('{"MBID":"m', cast(p_partkey as string), '", "title":"',
    CASE WHEN p_partkey % 7 = 0 THEN concat('a "quoted" ', p_name) WHEN p_partkey % 5 = 0 THEN concat(p_name, ';x') ELSE p_name END, '"}') END"""


@query("json_props_repair", """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE 'm' || p_partkey END AS mbid,
    CASE WHEN p_partkey % 11 = 3 THEN NULL WHEN p_partkey % 7 = 0 THEN 'a quoted ' || p_name WHEN p_partkey % 5 = 0 THEN p_name || ',x' ELSE p_name END AS title,
    (p_partkey % 11 = 3)::INT AS corrupt FROM part""")
def json_props_repair(spark, sf):
    t = _raw(spark, sf, ALBUM).withColumn("t", c.semicolon_to_comma(F.col("props")))
    fixed = F.when(F.col("t").startswith("{"), c.rebuild_two_keys(F.col("t"), "MBID", "title"))
    s = t.withColumn("s", c.json_repaired(F.col("t"), "MBID string, title string", fixed))
    return s.select("id", F.col("s.MBID").alias("mbid"), F.col("s.title").alias("title"), F.col("s").isNull().cast("int").alias("corrupt"))


USER = """concat('{"lastfm_username":"', c_name, '","gender":', CASE WHEN c_custkey % 3 = 0 THEN '"f"' WHEN c_custkey % 3 = 1 THEN '"m"' ELSE '""' END,
    ',"age":', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE cast(c_custkey % 70 as string) END, ',"country":"', cast(c_nationkey as string),
    '","playcount":', cast(c_custkey * 3 as string), ',"playlists":', cast(c_custkey % 5 as string), ',"subscribertype":"', lower(c_mktsegment), '"}')"""


@query("json_user_props", """SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M'
    WHEN c_custkey % 4 = 0 THEN NULL ELSE '' END AS gender, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 70 END AS age, c_nationkey::VARCHAR AS country,
    c_custkey * 3 AS playcount, c_custkey % 5 AS playlists, lower(c_mktsegment) AS subscribertype FROM customer""")
def json_user_props(spark, sf):
    """Empty values become null only in rows that do not parse as they are."""
    t = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), c.semicolon_to_comma(F.expr(USER)).alias("t"))
    schema = "lastfm_username string, gender string, age long, country string, playcount long, playlists long, subscribertype string"
    fixed = F.replace(F.replace(F.col("t"), F.lit('""'), F.lit("null")), F.lit(":,"), F.lit(":null,"))
    s = t.withColumn("s", c.json_repaired(F.col("t"), schema, fixed))
    return s.select("id", F.col("s.lastfm_username").alias("username"), F.upper("s.gender").alias("gender"),
                    *[F.col(f"s.{k}") for k in ("age", "country", "playcount", "playlists", "subscribertype")])


@query("json_tag_props", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_type || ' ' || p_brand ELSE p_type || '-' || p_brand END AS value, 'u/' || p_partkey AS url FROM part""")
def json_tag_props(spark, sf):
    """Tag text; line breaks inside the value are removed."""
    t = _raw(spark, sf, """concat('{"value":"', p_type, CASE WHEN p_partkey % 7 = 0 THEN concat('\\n', ' ') ELSE '-' END, p_brand, '","url":"u/', cast(p_partkey as string), '"}')""")
    t = t.withColumn("t", F.replace(c.semicolon_to_comma(F.col("props")), F.lit("\n"), F.lit("")))
    s = t.withColumn("s", c.json_struct(F.col("t"), "value string, url string"))
    return s.select("id", "s.value", "s.url")


@query("json_track_props", """SELECT p_partkey AS id, p_size * 1000::BIGINT AS duration, p_partkey % 97 AS playcount, 'm' || p_partkey AS mbid, p_name AS name,
    CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS artist_name FROM part""")
def json_track_props(spark, sf):
    t = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.to_json(F.struct((F.col("p_size") * 1000).alias("duration"), (F.col("p_partkey") % 97).alias("playcount"),
                           F.concat(F.lit("m"), "p_partkey").alias("MBID"), F.col("p_name").alias("name"))).alias("t"),
        F.to_json(F.struct(F.concat(F.lit("a"), "p_partkey").alias("MBID"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("name"))).alias("a"))
    s = t.withColumn("s", c.json_struct(c.semicolon_to_comma(F.col("t")), "duration long, playcount long, MBID string, name string")).withColumn(
        "x", c.json_struct(c.semicolon_to_comma(F.col("a")), "MBID string, name string"))
    return s.select("id", "s.duration", "s.playcount", F.col("s.MBID").alias("mbid"), "s.name", F.col("x.name").alias("artist_name"))


@query("json_playlist_props", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'my mix ' || o_orderpriority ELSE o_orderpriority END AS title,
    o_orderkey % 30 AS numtracks, o_orderkey * 7 AS duration FROM orders""")
def json_playlist_props(spark, sf):
    """`{"ID":..,"Title":..,"numtracks":..,"duration":..}` with stray quotes in some titles."""
    raw = """concat('{"ID":', cast(o_orderkey as string), ',"Title":"', CASE WHEN o_orderkey % 6 = 0 THEN concat('my "mix" ', o_orderpriority) ELSE o_orderpriority END,
        '","numtracks":', cast(o_orderkey % 30 as string), ',"duration":', cast(o_orderkey * 7 as string), '}')"""
    t = v.table(spark, sf, "orders").select(c.semicolon_to_comma(F.expr(raw)).alias("t"))
    bare = F.regexp_replace("t", r'["\\]', "")
    part = lambda i: F.regexp_extract(bare, r"^\{ID:(.*?),Title:(.*),numtracks:(.*?),duration:(.*?)\}$", i)
    fixed = F.to_json(F.struct(part(1).cast("long").alias("ID"), part(2).alias("Title"), part(3).cast("long").alias("numtracks"), part(4).cast("long").alias("duration")))
    s = t.select(c.json_repaired(F.col("t"), "ID long, Title string, numtracks long, duration long", fixed).alias("s"))
    return s.select(F.col("s.ID").alias("id"), F.col("s.Title").alias("title"), "s.numtracks", "s.duration")


@query("json_linked_ids", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 13) || ',' || (p_partkey % 17) END AS artists,
    p_partkey::VARCHAR AS albums, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 7)::VARCHAR END AS objects FROM part""")
def json_linked_ids(spark, sf):
    raw = """concat('{"artists":', CASE WHEN p_partkey % 5 = 0 THEN '[]' ELSE concat('[{"id":', p_partkey % 13, '},{"id":', p_partkey % 17, '}]') END,
        ',"albums":[{"id":', p_partkey, '}],"objects":', CASE WHEN p_partkey % 3 = 0 THEN '[[]]' ELSE concat('[{"id":', p_partkey % 7, '}]') END, '}')"""
    t = _raw(spark, sf, raw).withColumn("t", F.replace(c.semicolon_to_comma(F.col("props")), F.lit("[[]]"), F.lit("[]")))
    ids = "array<struct<id:long>>"
    s = t.withColumn("s", c.json_struct(F.col("t"), f"artists {ids}, albums {ids}, objects {ids}"))
    return s.select("id", *[c.id_list(F.col(f"s.{k}")).alias(k) for k in ("artists", "albums", "objects")])


@query("semicolon_escape", "SELECT doc_id, sum((ch = ',')::INT)::BIGINT AS commas FROM (SELECT doc_id, unnest(string_split(replace(text, ';', ','), '')) AS ch FROM documents) GROUP BY doc_id")
def semicolon_escape(spark, sf):
    t = c.semicolon_to_comma(F.col("text"))
    n = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    return v.table(spark, sf, "documents", "doc_id", "text").select("doc_id", n.cast("long").alias("commas"))


@query("url_name_clean", """SELECT page_id, trim(string_split(string_split(string_split(u, '/')[-1], '_')[-1], '!')[-1]) AS name
    FROM (SELECT page_id, url_decode(replace(url, '+', ' ')) AS u FROM pages)""")
def url_name_clean(spark, sf):
    return v.table(spark, sf, "pages", "page_id", "url").select("page_id", c.url_name(F.col("url")).alias("name"))


@query("lower_distinct_names", "SELECT DISTINCT lower(artist) AS name FROM song WHERE artist IS NOT NULL ORDER BY name", "song")
def lower_distinct_names(spark, sf):
    return v.song(spark, sf).filter("artist is not null").select(F.lower("artist").alias("name")).distinct().orderBy("name")


@query("user_key", """SELECT o_orderkey AS pid, (epoch(o_orderdate)::BIGINT)::VARCHAR || '_' || trim('  user ' || o_custkey || ' ') AS user_key FROM orders""")
def user_key(spark, sf):
    o = v.table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    since = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    epoch = F.unix_timestamp(F.to_timestamp(since, "yyyy-MM-dd HH:mm:ss"))
    name = F.trim(F.concat(F.lit("  user "), F.col("o_custkey").cast("string"), F.lit(" ")))
    return o.select(F.col("o_orderkey").alias("pid"), F.concat_ws("_", epoch.cast("string"), name).alias("user_key"))


@query("numeric_or_default", "SELECT p_partkey AS id, coalesce(try_cast(CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN '' ELSE p_size::VARCHAR END AS INT), -1) AS x FROM part")
def numeric_or_default(spark, sf):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 4 == 1, F.lit("")).otherwise(F.col("p_size").cast("string"))
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.coalesce(raw.try_cast("int"), F.lit(-1)).alias("x"))


@query("item_age", "SELECT o_orderkey AS id, 2018 - year(o_orderdate) AS age FROM orders")
def item_age(spark, sf):
    return v.table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        F.col("o_orderkey").alias("id"), (F.year(F.to_date(F.lit("2018-01-01"))) - F.year("o_orderdate")).cast("long").alias("age"))


@query("hash_path", "SELECT p_partkey AS id, upper(substr(h, 3, 1) || '/' || substr(h, 4, 1) || '/' || substr(h, 5, 1)) || '/TR' || upper(h) || '.h5' AS path FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS h FROM part)")
def hash_path(spark, sf):
    h = F.upper(F.md5(F.col("p_partkey").cast("string")))
    return v.table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("id"), F.concat(
        F.concat_ws("/", *[F.substring(h, i, 1) for i in (3, 4, 5)], F.concat(F.lit("TR"), h)), F.lit(".h5")).alias("path"))
