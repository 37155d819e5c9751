"""Readers with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VISIT = "userID long, trajID long, poiID long, startTime long, photos long, trajLen long, poiDuration double"
POI = "poiID long, poiCat string, poiLon double, poiLat double"
ENTITY = "type string, id long, ts long, properties string, linked string"
PLAYLIST = "category string, user struct<name: string, member_since: string>, playlist array<struct<artist: string, title: string, song: long>>"


def visits_csv(spark: SparkSession, folder: str, city: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}-{city}")
    return read("poi", POI), read("traj", VISIT)


def entity_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Five columns without header; JSON text stays as it is, so quoting is off."""
    return spark.read.schema(ENTITY).option("sep", "\t").option("quote", "").csv(path)


def mixed_tsv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """type, id and a last field that starts with a literal prefix; the rest of the line is JSON and may hold tabs."""
    p = F.split("value", "\t", 3)
    return spark.read.text(path).select(p[0].alias("type"), p[1].cast("long").alias("id"), F.trim(F.replace(p[2], F.lit(prefix), F.lit(""))).alias("linked"))


def nested_json(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """Playlists from JSON arrays, gzip by extension. One array per line is read in parallel; one_document reads whole files."""
    return spark.read.schema(PLAYLIST).option("multiLine", one_document).json(path)


def commented_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("track long, tag string").option("sep", "\t").option("comment", "#").csv(path)


def song_db(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """track_id, song_id, artist of the song table: JDBC options or Parquet. The projection is pushed to the source."""
    src = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return src.select("track_id", "song_id", "artist_mbid")
