"""Trajectories, transitions and discretised Markov tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recset.functions import columns as c

BINS = 5


def place(visits: DataFrame) -> DataFrame:
    """Add `ord` (1-based position by start time, then POI) to visits(traj, poi, start_ts).

    A trajectory visits a POI once, so its rows are bounded by the number of POI and one window, which costs one shuffle,
    numbers them.
    """
    return visits.withColumn("ord", F.row_number().over(W.partitionBy("traj").orderBy("start_ts", "poi")).cast("long"))


def paths(seq: DataFrame) -> DataFrame:
    """One array per trajectory with start and length; a trajectory visits a POI once, so M bounds the array."""
    return (
        seq.groupBy("traj", "usr")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "poi"))).alias("s"))
        .select("traj", "usr", F.transform("s", lambda x: x["poi"]).alias("path"))
        .withColumn("len", F.size("path").cast("long"))
        .withColumn("start", F.element_at("path", 1))
    )


def steps(seq: DataFrame, back: int = 1, *carry: str) -> DataFrame:
    """Pairs (src, dst) `back` positions apart: an equi-join on (traj, position), so a long trajectory is spread."""
    src = seq.select("traj", (F.col("ord") + back).alias("ord"), F.col("poi").alias("src"))
    dst = seq.select("traj", "ord", F.col("poi").alias("dst"), *carry)
    return dst.join(src, ["traj", "ord"])


def edge_counts(seq: DataFrame) -> DataFrame:
    return steps(seq).groupBy("src", "dst").agg(F.count("*").alias("n"))


def poi_info(visits: DataFrame) -> DataFrame:
    """Mean duration, visits and popularity (distinct users) per POI; distinct users are counted in two steps."""
    per_user = visits.groupBy("poi", "usr").agg(F.sum("duration").alias("d"), F.count("*").alias("n"))
    return per_user.groupBy("poi").agg(
        (F.sum("d") / F.sum("n")).alias("dur"), F.sum("n").alias("nvisit"), F.count("*").alias("pop")
    )


def bin_edges(info: DataFrame, col: str, far: bool = False) -> Column:
    """Scalar subquery with the log-spaced edges of one POI property."""
    return info.agg(c.log_edges(F.min(col), F.max(col), BINS, far).alias("e")).scalar()


def long_classes(vecs: DataFrame, kinds: list[str]) -> Column:
    """Array of (kind, class as text) of one POI vector."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("cls")) for k in kinds])


def class_grid(vecs: DataFrame, kinds: list[str], binned: list[str]) -> DataFrame:
    """All ordered class pairs per kind: the cells of the matrices that are asked for."""
    seen = vecs.select(F.explode(long_classes(vecs, kinds)).alias("x")).select("x.*").filter(~F.col("kind").isin(binned))
    bins = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda b: b.cast("string"))
    fixed = vecs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in binned])).alias("kind"), bins.alias("all")) if binned else None
    d = seen.distinct().groupBy("kind").agg(F.collect_list("cls").alias("all"))
    d = d.unionByName(fixed) if fixed is not None else d
    return d.select("kind", F.explode("all").alias("c1"), "all").select("kind", "c1", F.explode("all").alias("c2"))


def transition_matrices(edges: DataFrame, vecs: DataFrame, kinds: list[str], binned: list[str]) -> DataFrame:
    """(kind, c1, c2, p): class transition probabilities with add-one smoothing, all kinds in one pass over the edges."""
    side = lambda poi, n: vecs.select(F.col("poi").alias(poi), long_classes(vecs, kinds).alias(n))
    both = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    both = both.select("n", F.explode(F.arrays_zip("a", "b")).alias("z"))
    n = both.groupBy(F.col("z.a.kind").alias("kind"), F.col("z.a.cls").alias("c1"), F.col("z.b.cls").alias("c2")).agg(F.sum("n").alias("n"))
    full = class_grid(vecs, kinds, binned).join(n, ["kind", "c1", "c2"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    total = W.partitionBy("kind", "c1")  # as many rows as there are classes
    return full.select("kind", "c1", "c2", (F.col("n") / F.sum("n").over(total)).alias("p"))
