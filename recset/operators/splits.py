"""Leakage-free splits. Random order is a seeded hash, so a split is the same on every run and engine."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recset.operators import ordering as o
from recset.session import SHARES, dealt


def by_position(df: DataFrame, pos: str, cuts: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Label rows by position: the first rows up to each cumulative bound, then `rest`."""
    label = None
    for name, bound in cuts:
        cond = F.col(pos) <= bound
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return df.withColumn("split", label.otherwise(rest))


def last_holders(pairs: DataFrame, user: str, song: str, seed: str, n: int = 0) -> DataFrame:
    """Users that must stay in training: for every song the last of its users in hash order. Pairs may repeat. `n` partitions
    are dealt out where a shuffle has fewer; a song's users are then compared in shares first, so that a hot song is not one task."""
    rows, hashed = pairs.select(user, song), lambda d: d.withColumn("_h", o.md5_of(user, seed=seed))
    last = F.max_by(user, F.struct("_h", user)).alias(user)
    if n > int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = dealt(rows.withColumn("_share", F.pmod(F.xxhash64(user), F.lit(SHARES))), n, song, "_share")
        rows = dealt(hashed(rows).groupBy(song, "_share").agg(last).select(user, song), n, song)
    return hashed(rows).groupBy(song).agg(last).select(user).distinct()
