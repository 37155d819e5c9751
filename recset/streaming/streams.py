"""Structured Streaming operators over an event stream (event_id, ts, user_id, event_type, value).

State and results live in the shared folder. Streams run with `availableNow`, so the same code serves replays and tests.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.operators import ordering as o
from recset.session import fresh_path, share

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over all available input into a Parquet table and read the table."""
    path = fresh_path(df.sparkSession, name)
    run_on(df, path, mode)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def run_on(df: DataFrame, path: str, mode: str = "append") -> int:
    """Run the stream over what has come since the last run with this path. Returns the rows that the engine's state operators dropped
    because the watermark had passed them, by the engine's own count."""
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])


def run_batches(df: DataFrame, name: str, handle, mode: str = "append") -> str:
    """Run the stream through foreachBatch; `handle(batch, id, path)` must be repeatable for one id."""
    path = fresh_path(df.sparkSession, name)
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
         .foreachBatch(lambda b, i: handle(b, i, path)).start())
    q.awaitTermination()
    return path


def sessions(events: DataFrame, gap: str = "8 hours", delay: str = "10 minutes") -> DataFrame:
    """Trajectories of a user: events no more than `gap` apart. Only counts and bounds are kept as state."""
    w = F.session_window("ts", gap)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("user_id", "n", "first_ts", "last_ts")


def arm_updates(events: DataFrame) -> DataFrame:
    """Draws and rewards per arm, updated with every batch."""
    r = (F.col("value") > 50).cast("double")
    return events.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("draws"), F.sum(r).alias("cum_reward"))


def popularity(events: DataFrame, length: str, slide: str | None, delay: str = "10 minutes") -> DataFrame:
    """Visits and approximate distinct users per item and window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "users")


def transition_batches(gap_seconds: int = 8 * 3600, delay_seconds: int = 600):
    """Handler that emits the consecutive pairs of a user's session when the session closes.

    A session is closed when the watermark (latest time seen, less the delay) is a gap or more behind its last event: no event that
    is still accepted can join it. Until then all of its events are state, so an event that comes late by some batches finds its
    place. Events at or below the watermark are dropped and counted. State of closed sessions goes. Neighbours are found by
    position and sessions by running sums, both bucketed, so a hot user is spread over tasks. A batch reads what the batch before
    it wrote and overwrites its own folders, so it can be repeated.
    """
    unit = 1_000_000

    def handle(batch: DataFrame, i: int, path: str) -> None:
        spark = batch.sparkSession
        rows = share(batch.select("user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type"))
        mark = spark.read.schema("us long").parquet(f"{path}/mark/{i - 1}").first()[0] if i > 0 else None
        latest = rows.agg(F.max("us")).first()[0]
        now = max((x for x in (mark, latest - delay_seconds * unit if latest is not None else None) if x is not None), default=None)
        late = F.lit(False) if mark is None else F.col("us") <= mark
        rows.filter(late).agg(F.count("*").alias("dropped")).write.mode("overwrite").parquet(f"{path}/late/batch={i}")
        rows = rows.filter(~late)
        if i > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/open/{i - 1}"))
        rows = share(rows)
        placed = share(o.ordinal(rows, ["user_id"], ["us", "event_id"], o.id_bucket(rows, "us"), "pos"))
        before = placed.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("event_type").alias("src"), F.col("us").alias("us0"))
        steps = o.join_same(placed, before, ["user_id", "pos"], "left")
        first = F.coalesce(F.col("us") - F.col("us0") >= gap_seconds * unit, F.lit(True))
        steps = share(steps.withColumn("first", first))
        steps = o.running(steps, ["user_id"], ["pos"], F.floor(F.col("pos") / 4096).cast("long"), {"session": F.col("first").cast("long")})
        ends = steps.groupBy("user_id", "session").agg(F.max("us").alias("last_us"))
        steps = share(o.join_same(steps, ends, ["user_id", "session"]))
        closed = F.lit(False) if now is None else F.col("last_us") + gap_seconds * unit <= now
        pairs = steps.filter(closed & ~F.col("first")).select("user_id", "event_id", "src", F.col("event_type").alias("dst"))
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch={i}")
        steps.filter(~closed).select("user_id", "us", "event_id", "event_type").write.mode("overwrite").parquet(f"{path}/open/{i}")
        spark.range(1).select(F.lit(now).cast("long").alias("us")).write.mode("overwrite").parquet(f"{path}/mark/{i}")

    return handle
