"""Feature tables: scaling, one-hot, labels. Vectors are arrays; statistics are pre-aggregated."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recset.functions import columns as c


def per_position(df: DataFrame, vec: str, **aggs) -> DataFrame:
    """Statistics per vector position; one row per position."""
    return df.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(*[f("x").alias(n) for n, f in aggs.items()])


def as_array(stats: DataFrame, col: str) -> Column:
    """Scalar subquery: one array ordered by position (as long as the vector, not the data)."""
    s = F.array_sort(F.collect_list(F.struct("i", F.col(col).alias("s"))))
    return stats.agg(F.transform(s, lambda x: x["s"]).alias("a")).scalar()


def zscore(df: DataFrame, train: DataFrame, vec: str, out: str) -> DataFrame:
    st = per_position(train, vec, m=F.avg, sd=F.stddev_pop)
    d = df.withColumn("_m", as_array(st, "m")).withColumn("_s", as_array(st, "sd"))
    centred = F.zip_with(vec, "_m", lambda x, m: x - m)
    return d.withColumn(out, F.zip_with(centred, "_s", lambda x, s: x / (s + F.lit(1e-6)))).drop("_m", "_s")


def minmax(df: DataFrame, train: DataFrame, vec: str, out: str) -> DataFrame:
    """Linear map of the training range to [-1, 1]; constant positions become 0."""
    st = per_position(train, vec, lo=F.min, hi=F.max)
    d = df.withColumn("_l", as_array(st, "lo")).withColumn("_h", as_array(st, "hi"))
    span = F.zip_with("_l", "_h", lambda l, h: F.struct(l.alias("l"), h.alias("h")))
    f = lambda x, s: F.when(s["h"] > s["l"], 2 * (x - s["l"]) / (s["h"] - s["l"]) - 1).otherwise(F.lit(0.0))
    return d.withColumn(out, F.zip_with(vec, span, f)).drop("_l", "_h")


def maxabs(df: DataFrame, train: DataFrame, vec: str, out: str) -> DataFrame:
    st = per_position(train, vec, m=lambda x: F.max(F.abs(x)))
    d = df.withColumn("_m", as_array(st, "m"))
    return d.withColumn(out, F.zip_with(vec, "_m", lambda x, m: F.when(m > 0, x / m).otherwise(x))).drop("_m")


def vocabulary(df: DataFrame, col: str) -> Column:
    """Scalar subquery: sorted distinct values, as long as the dense vectors that are made of them."""
    d = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return d.agg(F.array_sort(F.collect_list(col)).alias("v")).scalar()


def node_features(grid: DataFrame, info: DataFrame, zones: DataFrame, cats: Column, zone_ids: Column, extra: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Features of (query, POI) rows: POI properties, query length and relations to the start POI. `info` may differ by further
    keys of the grid (`by`), which stay in the result."""
    p = info.join(zones.select("poi", F.col("cls").alias("zone")), "poi")
    own = p.select(*by, "poi", "cat", "zone", "lon", "lat", "pop", "nvisit", "dur", *extra)
    st = own.select(*[F.col(x).alias(x if x in by else "start" if x == "poi" else f"s_{x}") for x in own.columns])
    g = grid.join(own, [*by, "poi"]).join(st, [*by, "start"]).withColumn("_c", cats).withColumn("_z", zone_ids)
    log = lambda x: c.log10_or_small(F.col(x))
    return g.select(
        *by, "qid", "poi", "start", "len",
        c.one_hot(F.col("cat"), F.col("_c"), 1.0, -1.0).alias("category"),
        c.one_hot(F.col("zone"), F.col("_z"), 1.0, -1.0).alias("neighbourhood"),
        log("pop").alias("popularity"), log("nvisit").alias("nVisit"), log("dur").alias("avgDuration"),
        F.col("len").cast("double").alias("trajLen"),
        c.sign_flag(F.col("cat") == F.col("s_cat")).alias("sameCatStart"),
        c.haversine_km(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat")).alias("distStart"),
        (F.col("pop") - F.col("s_pop")).cast("double").alias("diffPopStart"),
        (F.col("nvisit") - F.col("s_nvisit")).cast("double").alias("diffNVisitStart"),
        (F.col("dur") - F.col("s_dur")).alias("diffDurationStart"),
        c.sign_flag(F.col("zone") == F.col("s_zone")).alias("sameNeighbourhoodStart"),
        *[F.col(x).cast("double").alias(x) for x in extra],
        *[(F.col(x) - F.col(f"s_{x}")).cast("double").alias(f"diff_{x}") for x in extra],
    )


def scalars(nodes: DataFrame) -> list[str]:
    """The number columns of node_features, in its order."""
    return [n for n, t in nodes.dtypes if t in ("double", "int") and n not in ("qid", "len", "fold")]
