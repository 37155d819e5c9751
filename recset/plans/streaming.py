"""Streaming queries; their twins are batch statements on the same events."""
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from recset.plans import query
from recset.session import fresh_path
from recset.sources import views as v
from recset.streaming import streams as st


def events(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def feed(spark, sf):
    """The event table as a folder of files."""
    path = fresh_path(spark, "feed")
    events(spark, sf).write.parquet(path)
    return path


def late_parts(spark, sf):
    """The events in the order in which they come: the first half of the time span, the second half, and every 50th event, late."""
    e = events(spark, sf).withColumn("us", F.unix_micros("ts"))
    mid = e.agg((F.min("us") + F.max("us")) / 2).scalar()
    is_late = F.col("event_id") % 50 == 0
    return [e.filter(part).drop("us") for part in (~is_late & (F.col("us") < mid), ~is_late & (F.col("us") >= mid), is_late)]


SESS = """ss AS (SELECT user_id, grp, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
    SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 8 HOUR)::INT AS new FROM events)) GROUP BY 1, 2)"""


@query("st_sessionize", "SELECT user_id, n, epoch_us(first_ts)::BIGINT AS first_us, epoch_us(last_ts)::BIGINT AS last_us FROM ss WHERE last_ts + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)", extra=SESS)
def st_sessionize(spark, sf):
    """Sessions closed by the watermark at the end of the input."""
    d = st.run_to_table(st.sessions(st.read_events(spark, feed(spark, sf))), "sessions")
    return d.select("user_id", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("st_arm_state", "SELECT arm, count(*) AS draws, sum(reward) AS cum_reward FROM reward GROUP BY arm", "reward")
def st_arm_state(spark, sf):
    """Each batch writes the arms it changed; the newest row of an arm is its state."""
    upd = st.arm_updates(st.read_events(spark, feed(spark, sf)))
    path = st.run_batches(upd, "arms", lambda b, i, p: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{p}/arms/b{i}"), "update")
    d = spark.read.schema(StructType([*upd.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", True).parquet(f"{path}/arms")
    return d.groupBy("arm").agg(F.max_by(F.struct("draws", "cum_reward"), "batch").alias("s")).select("arm", "s.draws", "s.cum_reward")


CLOSED = "e <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("st_popularity", f"""SELECT 'tumbling' AS kind, event_type, epoch(s)::BIGINT AS start, n FROM (SELECT event_type, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS e, count(*) AS n FROM events GROUP BY 1, 2) WHERE {CLOSED}
    UNION ALL SELECT 'sliding', event_type, epoch(s)::BIGINT, n FROM (SELECT event_type, s, s + INTERVAL 1 DAY AS e, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) + k * INTERVAL 12 HOUR AS s, ts FROM events, (SELECT unnest([-1, 0, 1]) AS k)) WHERE ts >= s AND ts < s + INTERVAL 1 DAY GROUP BY 1, 2) WHERE {CLOSED}""")
def st_popularity(spark, sf):
    """Visits per item in tumbling days and in days sliding by 12 hours."""
    path = feed(spark, sf)
    out = None
    for kind, slide in (("tumbling", None), ("sliding", "12 hours")):
        d = st.run_to_table(st.popularity(st.read_events(spark, path), "1 day", slide), f"pop-{kind}")
        d = d.select(F.lit(kind).alias("kind"), "event_type", F.unix_timestamp("start").alias("start"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("st_popularity_users")
def st_popularity_users(spark, sf):
    """Approximate distinct users per item and day (a sketch, so there is no exact twin)."""
    d = st.run_to_table(st.popularity(st.read_events(spark, feed(spark, sf)), "1 day", None), "pop-users")
    return d.select("event_type", F.unix_timestamp("start").alias("start"), "users")


@query("st_transitions", """SELECT user_id, event_id, src, dst FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, grp) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
    SELECT user_id, event_id, ts, event_type AS dst, lag(event_type) OVER w AS src, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 8 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))))
    WHERE new = 0 AND last_ts + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def st_transitions(spark, sf):
    """Consecutive pairs of the sessions that are closed by the watermark at the end of the input."""
    path = st.run_batches(st.read_events(spark, feed(spark, sf)), "transitions", st.transition_batches())
    d = spark.read.schema("user_id long, event_id long, src string, dst string").option("recursiveFileLookup", True).parquet(f"{path}/pairs")
    return d.select("user_id", "event_id", "src", "dst")


LATE = "el AS (SELECT *, event_id % 50 = 0 AS late, epoch_us(ts) AS us FROM events), wm AS (SELECT floor(max(us) / 1000) - 86400000 AS ms FROM el WHERE NOT late AND us < (SELECT (min(us) + max(us)) / 2 FROM el))"


@query("st_late", "SELECT count(*) AS total, sum((NOT late OR us / 1000 > ms)::INT)::BIGINT AS kept, sum((late AND us / 1000 <= ms)::INT)::BIGINT AS dropped FROM el, wm", extra=LATE)
def st_late(spark, sf):
    """Events that come after the watermark has passed them are dropped, and counted by the engine.

    Each part, of as many files as Spark writes, is one run of the same stream. Lateness is judged by the watermark of the batch
    before the previous one, here that of the first part, as no batch without data comes between.
    """
    feed, path = fresh_path(spark, "late-feed"), fresh_path(spark, "late")
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    old, dropped = spark.conf.get(key), 0
    spark.conf.set(key, "false")
    try:
        for part in late_parts(spark, sf):
            part.write.mode("append").parquet(feed)
            kept = st.read_events(spark, feed).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
            dropped += st.run_on(kept, path)
    finally:
        spark.conf.set(key, old)
    n = lambda folder: spark.read.schema(st.EVENTS).parquet(folder).agg(F.count("*")).scalar()
    return spark.range(1).select(n(feed).alias("total"), n(f"{path}/data").alias("kept"), F.lit(dropped).cast("long").alias("dropped"))
