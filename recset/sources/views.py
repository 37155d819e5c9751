"""Logical views (visits, POI, playlists, songs, rewards, scores) over the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from recset.operators import ordering as o
from recset.session import dealt, parts, share


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def visit(spark, sf) -> DataFrame:
    """One row per (trajectory, POI)."""
    li = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("traj"), F.col("l_suppkey").alias("poi"))
        .agg(
            F.min("l_linenumber").cast("long").alias("start_ts"),
            F.sum("l_quantity").alias("duration"),
            F.sum("l_linenumber").alias("photos"),
        )
    )
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("traj"), F.col("o_custkey").alias("usr"))
    return li.join(od, "traj")


def poi(spark, sf) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("poi"),
        F.col("r_name").alias("cat"),
        (F.lit(144.9) + (F.col("s_suppkey") * 37 % 101) / F.lit(1000.0)).alias("lon"),
        (F.lit(-37.8) + (F.col("s_suppkey") * 53 % 97) / F.lit(1000.0)).alias("lat"),
    )


def city_visit(spark, sf) -> DataFrame:
    """Visits of one city: the POI is the district of the supplier, so there are few POI."""
    sup = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("poi"), F.col("s_nationkey").cast("long").alias("district")
    )
    v = visit(spark, sf).join(sup, "poi")
    return v.groupBy("usr", "traj", F.col("district").alias("poi")).agg(
        F.min("start_ts").alias("start_ts"), F.sum("duration").alias("duration"), F.sum("photos").alias("photos")
    )


def city_stops(spark, sf) -> DataFrame:
    """What orders a trajectory of the city: (usr, traj, poi, start_ts) of `city_visit`, with one shuffle of the lines, by trajectory."""
    sup = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("poi"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("traj"), "l_suppkey", F.col("l_linenumber").cast("long").alias("at"))
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("traj"), F.col("o_custkey").alias("usr"))
    n = entry_parts(spark, sf)
    li = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("traj", "poi", "at")
    return dealt(li, n, "traj").join(dealt(od, n, "traj"), "traj").groupBy("usr", "traj", "poi").agg(F.min("at").alias("start_ts"))


def city_poi(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("poi"),
        F.col("r_name").alias("cat"),
        (F.lit(144.9) + (F.col("n_nationkey") * 37 % 101) / F.lit(1000.0)).alias("lon"),
        (F.lit(-37.8) + (F.col("n_nationkey") * 53 % 97) / F.lit(1000.0)).alias("lat"),
    )


def lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pid"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("song")
    )


def entry_parts(spark, sf) -> int:
    """How many partitions the entries ask for."""
    return parts(lines(spark, sf))


def raw_entry(spark, sf) -> DataFrame:
    """Lines with the user of their list, dealt by list into partitions whose number grows with the table."""
    li = lines(spark, sf)
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("usr"))
    n = entry_parts(spark, sf)
    return dealt(li, n, "pid").join(dealt(od, n, "pid"), "pid")


def entry(spark, sf) -> DataFrame:
    """Playlist entries, repeats removed; the first occurrence keeps its position."""
    return raw_entry(spark, sf).groupBy("pid", "usr", "song").agg(F.min("pos").alias("pos"))


def clean_entry(spark, sf, least: int = 5) -> DataFrame:
    """Entries of lists with at least `least` distinct songs, in one pass: the entries lie by list already."""
    n = F.count("*").over(W.partitionBy("pid"))
    return entry(spark, sf).withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def placed(df: DataFrame, unit: str = "pid", item: str = "song", pos: str = "pos") -> DataFrame:
    """Dense 1-based `ord` inside each list; the entries are written once and read three times."""
    df = share(df)
    return o.ordinal(df, [unit], [pos, item], o.id_bucket(df, pos), "ord")


def song(spark, sf) -> DataFrame:
    known = F.col("p_partkey") % 17 != 0
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("song"),
        F.when(known, F.col("p_brand")).alias("artist"),
        F.when(known, F.col("p_type")).alias("genre"),
        F.col("p_size").cast("long").alias("age"),
        F.col("p_name").alias("title"),
    )


def reward(spark, sf) -> DataFrame:
    """Reward log: one run per user, arm = event type, reward 1 when the value is above 50."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("arm"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "event_id",
        (F.col("value") > 50).cast("double").alias("reward"),
    )


def prob(spark, sf) -> DataFrame:
    """Class probabilities of committee members: softmax over fixed slots of the embedding."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cand"), F.col("embedding").alias("e"))
    member = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("member")
    s = e.select("cand", member, "e").select(
        "cand", "member",
        F.transform(F.sequence(F.lit(0), F.lit(4)),
                    lambda c: F.exp(F.lit(5.0) * F.element_at("e", (c + F.col("member") * 5 + 1).cast("int")).cast("double"))).alias("x"),
    )
    z = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return s.select("cand", "member", F.posexplode(F.transform("x", lambda v: v / z)).alias("cls", "p"))


def scored(spark, sf) -> DataFrame:
    """Score table (unit, item, score, pos) with many ties."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("item"))
        .agg(F.sum("l_quantity").alias("score"),
             F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("pos"))
    )
