"""Scorers. Score grids of users x items are never built: only rows that can reach the top are made."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recset.operators import clean, ordering as o


def artist_similarity(pairs: DataFrame, group: str = "pid", artist: str = "artist") -> DataFrame:
    """sim(a, b) = groups with both / sqrt(groups with a * groups with b), for co-occurring a <= b."""
    n = clean.pair_counts(pairs, group, artist)
    own = n.filter("a = b").select(F.col("a").alias("k"), F.col("n").alias("own"))
    d = n.join(own.select(F.col("k").alias("a"), F.col("own").alias("na")), "a").join(own.select(F.col("k").alias("b"), F.col("own").alias("nb")), "b")
    return d.select("a", "b", "n", (F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).alias("sim"))


def both_ways(sim: DataFrame) -> DataFrame:
    flipped = sim.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    return sim.select("a", "b", "sim").unionByName(flipped)


def artist_weights(history: DataFrame, sim: DataFrame, unit: str) -> DataFrame:
    """(unit, artist, w): summed similarity of an artist to the artists in the history of the unit."""
    h = history.select(unit, F.col("artist").alias("b")).distinct()
    return h.join(both_ways(sim), "b").groupBy(unit, F.col("a").alias("artist")).agg(F.sum("sim").alias("w"))


def group_topk(weights: DataFrame, songs: DataFrame, unit: str, k: int, spare: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """Top k songs per unit where score = w(unit, artist) * base(song), base >= 0; exact, and free of the full grid.

    Inside one artist all units agree on the order of the songs. A song in the top m of a unit therefore is in the
    top m of its artist, and its artist is in the top m of the unit when artists are ordered by their best song. So
    m x m candidates per unit hold the answer, with m = k plus the number of songs that may be excluded.
    """
    m = k + spare
    best = o.top_k(songs.select("artist", "song", "base"), ["artist"], [F.desc("base"), "song"], m, "r")
    lead = best.filter("r = 1").select("artist", F.col("base").alias("lead"), F.col("song").alias("lead_song"))
    score = lambda b: F.round(F.col("w") * F.col(b), 9)
    few = o.top_k(weights.join(lead, "artist").withColumn("_l", score("lead")), [unit], [F.desc("_l"), "lead_song"], m, "r").select(unit, "artist", "w")
    c = few.join(best.select("artist", "song", "base"), "artist").withColumn("score", score("base")).filter("score > 0").select(unit, "song", "score")
    if exclude is not None:
        c = c.join(exclude, [unit, "song"], "left_anti")
    return o.top_k(c, [unit], [F.desc("score"), "song"], k, "rank")


def softmax(df: DataFrame, unit: str, score: str, out: str = "p") -> DataFrame:
    top = df.groupBy(unit).agg(F.max(score).alias("_m"))
    e = df.join(top, unit).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    z = e.groupBy(unit).agg(F.sum("_e").alias("_z"))
    return e.join(z, unit).withColumn(out, F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")
