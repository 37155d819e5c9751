"""Order-dependent operators against pandas, on data where one unit holds most rows."""
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from recset.operators import clean, ordering as o


def skewed(n=3000, seed=0):
    r = random.Random(seed)
    return pd.DataFrame({"u": [0 if r.random() < 0.6 else r.randint(1, 20) for _ in range(n)],
                         "t": [r.randint(0, 400) for _ in range(n)], "id": range(n), "x": [r.randint(-5, 9) for _ in range(n)]})


def test_running_and_ordinal(spark):
    p = skewed()
    d = spark.createDataFrame(p)
    got = o.running(d, ["u"], ["t", "id"], o.id_bucket(d, "t", 16), {"s": F.col("x"), "k": F.lit(1).cast("long")}).toPandas().sort_values("id")
    q = p.sort_values(["u", "t", "id"])
    q["s"], q["k"] = q.groupby("u").x.cumsum(), q.groupby("u").cumcount() + 1
    q = q.sort_values("id")
    assert got.s.tolist() == q.s.tolist() and got.k.tolist() == q.k.tolist()


def test_ranked_with_long_ties(spark):
    p = skewed()
    got = o.ranked(spark.createDataFrame(p), ["u"], "x", "id").toPandas().sort_values("id")
    q = p.sort_values(["u", "x", "id"], ascending=[True, False, True])
    q["r"] = q.groupby("u").cumcount() + 1
    assert got["rank"].tolist() == q.sort_values("id").r.tolist()


def test_global_hash_order(spark):
    d = spark.range(500).withColumnRenamed("id", "k")
    got = o.hash_ordinal(d, [], ["k"], "s").toPandas()
    import hashlib
    want = sorted(range(500), key=lambda k: (hashlib.md5(f"{k}|s".encode()).hexdigest(), k))
    assert got.sort_values("pos").k.tolist() == want


def test_percentiles_match_linear_interpolation(spark):
    p = skewed()
    got = o.percentiles(spark.createDataFrame(p), ["u"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).toPandas().set_index("u")
    for u, g in p.groupby("u"):
        assert np.allclose(got.loc[u, ["a", "b", "c"]].astype(float), np.percentile(g.x, [10, 50, 90]))


def test_numbers_in_blocks(spark):
    d = spark.createDataFrame([(1, 10), (2, 0), (3, 4)], "k int, n int")
    got = o.numbers(d, F.col("n"), "i", block=3).toPandas()
    assert sorted(map(tuple, got[["k", "i"]].values)) == [(1, i) for i in range(1, 11)] + [(3, i) for i in range(1, 5)]


def test_top_k_is_limited_before_the_shuffle(spark):
    d = spark.createDataFrame(skewed())
    plan = o.top_k(d, ["u"], [F.desc("x"), "id"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_pair_counts_spreads_a_huge_group(spark):
    rows = [(0, i) for i in range(60)] * 2 + [(g, (g * 7 + i) % 60) for g in range(1, 30) for i in range(5)]
    got = {(r.a, r.b): r.n for r in clean.pair_counts(spark.createDataFrame(rows, "g int, i int"), "g", "i", block=8).collect()}
    want = {}
    sets = {}
    for g, i in rows:
        sets.setdefault(g, set()).add(i)
    for s in sets.values():
        for a in s:
            for b in s:
                if a <= b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_null_units_null_order_and_text_ids(spark):
    rows = [("a", 3, "song-2"), ("a", None, "song-10"), (None, 1, "song-1"), (None, None, "song-0"), ("a", 1, "é"), ("b", 2, None), ("a", 3, "song-1")]
    df = spark.createDataFrame(rows, "u string, x long, s string")
    got = sorted(((r.u, r.x, r.s, r.pos) for r in o.ordinal(df, ["u"], ["x", "s"], o.id_bucket(df, "x")).collect()), key=str)
    low = lambda v: (v is not None, v if v is not None else 0)
    want = []
    for u in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == u), key=lambda r: (low(r[1]), (r[2] is not None, (r[2] or "").encode())))
        want += [(*r, i + 1) for i, r in enumerate(own)]
    assert got == sorted(want, key=str)
    got = {r.s: r["rank"] for r in o.ranked(df.filter("u = 'a'"), ["u"], "x", "s").collect()}
    assert got == {"song-1": 1, "song-2": 2, "é": 3, "song-10": 4}


def test_buckets_of_spread_out_values_are_even(spark, monkeypatch):
    monkeypatch.setattr(o, "SMALL", 0)
    df = spark.range(20000).selectExpr("pow(10, id % 1000 / 111.0) + id / 1e6 AS x", "concat('song-', lpad(id, 7, '0')) AS s")
    for c in ("x", "s"):
        d = df.withColumn("b", o.id_bucket(df, c))
        assert d.groupBy("b").count().agg({"count": "max"}).first()[0] <= 0.02 * 20000
        assert d.groupBy("b").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy("b").select(
            (F.col("lo") > F.coalesce(F.lag("hi").over(W.orderBy("b")), F.lit("" if c == "s" else -1))).alias("ok")).filter("NOT ok").count() == 0


def test_a_small_table_is_one_bucket(spark, tmp_path):
    """Files below the limit need no job for edges, and positions are the same."""
    spark.range(500).selectExpr("id % 3 AS u", "(id * 7919) % 1009 AS x").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert o.small(df) and not o.small(spark.createDataFrame([(1,)], "x long"))
    one = o.ordinal(df, ["u"], ["x"], o.id_bucket(df, "x"))
    many = o.ordinal(df, ["u"], ["x"], o.id_bucket(df, "x", of="x"))
    rows = lambda d: sorted((r.u, r.x, r.pos) for r in d.collect())
    assert rows(one) == rows(many) and len(rows(one)) == 500
