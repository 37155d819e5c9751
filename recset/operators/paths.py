"""Path construction for all queries at once, over a graph that is given by its edges (see `walks` for classes of POI).

A walk depends on the start only, so one state per start serves every length. Scores are whole micro-units (long), so
sums are exact and ties are real ties. The state holds at most starts x POI (Viterbi), one row per start (greedy) or
`beam` rows per start; each step is written out, which keeps the lineage short.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recset.operators import ordering as o
from recset.session import cut


def _first(starts: DataFrame) -> DataFrame:
    return starts.select("start", F.col("start").alias("poi"), F.lit(0).cast("long").alias("score"), F.array("start").alias("path"))


def _extend(state: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("poi"), "dst", "w")
    return state.join(e, "poi").filter("dst <> poi").select(
        "start", F.col("dst").alias("poi"), (F.col("score") + F.col("w")).alias("score"), "path")


def viterbi(starts: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """(start, len, path, score): best walk of every length; never back to the start, repeats of other POI allowed."""
    state, out = cut(_first(starts), "walk"), None
    for n in range(2, longest + 1):
        ext = _extend(state, edges).filter("poi <> start").withColumn("path", F.concat("path", F.array("poi")))
        best = F.min(F.struct((-F.col("score")).alias("k"), F.col("path")))
        state = cut(ext.groupBy("start", "poi").agg(best.alias("b")).select("start", "poi", (-F.col("b.k")).alias("score"), "b.path"), "walk")
        end = state.groupBy("start").agg(best.alias("b")).select("start", F.lit(n).cast("long").alias("len"), F.col("b.path").alias("path"), (-F.col("b.k")).alias("score"))
        out = end if out is None else out.unionByName(end)
    return out


def beam(starts: DataFrame, edges: DataFrame, longest: int, width: int) -> DataFrame:
    """(start, len, rank, path, score): best loop-free paths of every length that a beam of `width` keeps; width 1 is the
    greedy path. `walks.top_paths` gives the exact ones."""
    state, out = cut(_first(starts), "beam"), None
    for n in range(2, longest + 1):
        ext = _extend(state, edges).filter(~F.array_contains(F.col("path"), F.col("poi"))).withColumn("path", F.concat("path", F.array("poi")))
        state = cut(o.top_k(ext, ["start"], [F.desc("score"), "path"], width), "beam")
        one = state.select("start", F.lit(n).cast("long").alias("len"), F.col("rank").cast("long").alias("rank"), "path", "score")
        state = state.drop("rank")
        out = one if out is None else out.unionByName(one)
    return out


def keep_diverse(results: DataFrame) -> DataFrame:
    """Drop a result without any POI that is new against the last kept one. `paths` is a short ordered array per query."""
    step = lambda acc, p: F.when((F.size(acc) == 0) | (F.size(F.array_except(p, F.element_at(acc, -1))) > 0), F.concat(acc, F.array(p))).otherwise(acc)
    return results.withColumn("paths", F.aggregate("paths", F.array().cast("array<array<long>>"), step))
