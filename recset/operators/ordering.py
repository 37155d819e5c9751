"""Order-dependent operators that hold up when one unit has a large share of all rows.

A window partitioned by a hot unit runs in one task. Here the unit is cut into buckets that
follow the sort order; rows are numbered inside (unit, bucket), and the offset of each bucket
comes from a small pre-aggregated table, so the largest task is one bucket, not one unit.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recset.session import dealt, share

BUCKETS = 1024


FIRST = -1  # bucket of null, which sorts before everything
SMALL = 32 << 20  # bytes, by the optimiser's estimate, up to which all rows may be in one bucket


def small(df: DataFrame) -> bool:
    """Whether one task can hold all rows. The estimate never falls short of the files that are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def sort_number(df: DataFrame, col: str, of: str | None = None) -> Column:
    """A number that grows with any orderable column: the value itself, or for text the six bytes behind the prefix that
    all values share (text sorts by its bytes). Equal numbers only mean the same bucket."""
    kind, x = dict(df.dtypes)[col], F.col(of or col)
    if kind == "string":
        ends = df.agg(F.min(col), F.max(col)).first()
        same = len(os.path.commonprefix([e or "" for e in ends]))
        part = F.rpad(F.hex(F.encode(F.substring(x, same + 1, 6), "utf-8")), 12, "0")
        return F.conv(F.substring(part, 1, 12), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(x.cast("timestamp")).cast("double")
    return x.cast("double")


def id_bucket(df: DataFrame, col: str, n: int = BUCKETS, of: str | None = None) -> Column:
    """Bucket number 0..n-1 that grows with a column of any orderable type; null is in a bucket of its own, FIRST.

    Edges are approximate quantiles of `col` in df (n numbers, which one small job brings to the driver), so buckets hold
    about equally many rows however the values are spread; they steer balance only, never the result. `of` names the
    column to bucket when it differs from the one that gives the edges, as when a dimension table knows the values. A small
    table is one bucket and needs no job.
    """
    if of is None and small(df):
        return F.lit(0).cast("long")
    wide = max(2, round(n**0.5))
    number = sort_number(df, col)
    cuts = F.percentile_approx(number, F.array(*[F.lit(k / wide**2) for k in range(1, wide**2)]), F.lit(10 * wide**2))
    edges = df.agg(cuts.alias("e")).first()["e"]
    x = sort_number(df, col, of)
    if not edges:
        return F.when(x.isNull(), FIRST).otherwise(0).cast("long")
    # Two levels, so that a row is compared with twice the root of the number of edges.
    array = F.array(*[F.lit(float(e)) for e in edges])
    coarse = F.array(*[F.lit(float(e)) for e in edges[wide - 1 :: wide]])
    k = F.size(F.filter(coarse, lambda e: e <= x))
    fine = F.size(F.filter(F.slice(array, k * wide + 1, F.lit(wide - 1)), lambda e: e <= x))
    return F.when(x.isNull(), FIRST).otherwise(k * wide + fine).cast("long")


def md5_of(*cols: str, seed: str = "") -> Column:
    """Deterministic pseudo-random text key; equal in every engine that has md5."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(seed)))


def md5_bucket(col: str) -> Column:
    """The first three hex digits of a hash text: 4096 even buckets in the order of the text."""
    return F.substring(F.col(col), 1, 3)


def join_same(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null equals null; `other` is unique in them and adds its other columns."""
    if not keys:
        return rows.crossJoin(other)  # one row
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    other = other.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in names.items()]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(other, on, how).drop(*names.values())


def running(df: DataFrame, unit: list[str], order: list, bucket: Column, sums: dict[str, Column], n: int = 0) -> DataFrame:
    """Inclusive running sums per unit in the given order. `bucket` must be monotone in the order; a null unit is a unit,
    and a null order value has its place where the order puts it. `n` partitions are dealt out where a shuffle has fewer; units
    and buckets must not be null then."""
    names = list(sums)
    rows = df.withColumn("_b", bucket)
    if more := n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = dealt(rows, n, *unit, "_b")
    for i, c in enumerate(sums.values()):
        rows = rows.withColumn(f"_x{i}", c)
    key = [*unit, "_b"]
    totals = rows.groupBy(*key).agg(*[F.sum(f"_x{i}").alias(f"_t{i}") for i in range(len(names))])
    before = W.partitionBy(*unit).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *key, *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(names))]
    )
    inside = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(dealt(offsets, n, *key), key) if more else join_same(rows, offsets, key)
    for i, name in enumerate(names):
        joined = joined.withColumn(name, F.col(f"_o{i}") + F.sum(f"_x{i}").over(inside))
    return joined.drop("_b", *[f"_{p}{i}" for p in "xo" for i in range(len(names))])


def ordinal(df: DataFrame, unit: list[str], order: list, bucket: Column, out: str = "pos", n: int = 0) -> DataFrame:
    """Exact 1-based position of every row within its unit."""
    return running(df, unit, order, bucket, {out: F.lit(1).cast("long")}, n)


def hash_ordinal(df: DataFrame, unit: list[str], ids: list[str], seed: str, out: str = "pos") -> DataFrame:
    """1-based position in a seeded shuffle of each unit. The keyed rows are shared."""
    keyed = share(df.withColumn("_h", md5_of(*ids, seed=seed)))
    return ordinal(keyed, unit, ["_h", *ids], md5_bucket("_h"), out).drop("_h")


def numbers(df: DataFrame, n: Column, out: str, block: int = 65536) -> DataFrame:
    """One row per number 1..n; the numbers are made in blocks, so n may exceed what one array can hold."""
    d = df.withColumn("_n", n.cast("long")).filter("_n > 0")
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))
    return d.withColumn(out, F.explode(F.sequence(F.col("_k") * block + 1, F.least((F.col("_k") + 1) * block, F.col("_n"))))).drop("_n", "_k")


def top_k(df: DataFrame, unit: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First k rows per unit. The literal bound becomes a group limit before the shuffle."""
    w = W.partitionBy(*unit).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= F.lit(k))


def ranked(df: DataFrame, unit: list[str], score: str, item: str, out: str = "rank") -> DataFrame:
    """Unique rank per unit by (score descending, item ascending), safe for hot units and long ties.

    The input is read several times, so it is shared.
    """
    df = share(df)
    ties = df.groupBy(*unit, score).agg(F.count("*").alias("_n"))
    ties = running(ties, unit, [F.desc(score)], -id_bucket(df, score), {"_cum": F.col("_n")})
    inner = ordinal(df, [*unit, score], [item], id_bucket(df, item), "_i")
    return (
        join_same(inner, ties, [*unit, score])
        .withColumn(out, F.col("_cum") - F.col("_n") + F.col("_i"))
        .drop("_cum", "_n", "_i")
    )


def percentiles(df: DataFrame, unit: list[str], value: str, qs: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, from counts of distinct values. `count` says how often a row counts."""
    d = df.filter(F.col(value).isNotNull())
    hist = share(d.groupBy(*unit, value).agg((F.sum(count) if count else F.count("*")).alias("_n")))
    total = hist.groupBy(*unit).agg(F.sum("_n").alias("_tot"))
    hist = running(hist, unit, [value], id_bucket(hist, value), {"_c": F.col("_n")})
    if unit:
        hist = join_same(hist, total, unit)
    else:
        hist = hist.withColumn("_tot", total.select("_tot").scalar())
    aggs = []
    for name, q in qs.items():
        at = (F.col("_tot") - 1) * F.lit(q)
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_c") > idx) & (F.col("_c") - F.col("_n") <= idx)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    agg = hist.groupBy(*unit).agg(F.max("_tot").alias("_tot"), *aggs)
    outs = []
    for name, q in qs.items():
        at = (F.col("_tot") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return agg.select(*unit, *outs)
