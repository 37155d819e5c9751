"""The multitask fit on a catalogue in blocks, against the gradient with the matrix at hand."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recset.operators import models as md


def test_block_gradients_equal_matrix(spark, monkeypatch):
    monkeypatch.setattr(md, "SONGS", 9)
    monkeypatch.setattr(md, "LISTS", 2)
    rng, r = np.random.default_rng(4), random.Random(4)
    X, T = rng.normal(size=(50, 3)), rng.normal(size=(5, 3)) * 0.3
    ix = [r.sample(range(50), k) for k in (1, 4, 9, 2, 7)]
    lists = [(p, p % 2, len(ix[p]), [0.0] * 3, T[p].tolist(), ix[p]) for p in range(5)]
    rows = spark.createDataFrame(lists, "pid long, usr long, n long, w array<double>, t array<double>, ix array<int>")
    songs = spark.createDataFrame([(k, X[k].tolist()) for k in range(50)], "song long, x array<double>")
    pos = rows.select("pid", F.explode("ix").alias("song")).join(songs, "song").select("pid", "x")
    got = {x.pid: x for x in md.block_gradients(md.blocks(songs, "song", 9, x=F.col("x")), pos, rows.drop("ix"), 3, 2.0, 50, 5).collect()}
    want = md.list_gradients(spark, rows, X, 3, 2.0, 5).collect()
    assert len(want) == len(got) == 5
    for x in want:
        assert got[x.pid].risk == pytest.approx(x.risk) and got[x.pid].g == pytest.approx(x.g)


def test_catalogue_has_no_cap():
    assert not hasattr(md, "MOST_SONGS")


def test_vectors_are_not_broadcast(spark):
    """Zero vectors take no room in a file, so estimates say little: no plan of a step takes a table of vectors to the driver."""
    zero = F.array(*[F.lit(0.0)] * 3)
    rows = spark.range(200).select(F.col("id").alias("pid"), F.lit(0).cast("long").alias("usr"), F.lit(1).cast("long").alias("n"), zero.alias("w"), zero.alias("t"))
    songs = spark.range(40).select(F.col("id").alias("song"), zero.alias("x"))
    pos = spark.range(200).select(F.col("id").alias("pid"), zero.alias("x"))
    plan = md.block_gradients(md.blocks(songs, "song", 9, x=F.col("x")), pos, rows, 3, 2.0, 40, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan
    assert "Broadcast" not in md.dealt_join(rows, songs.withColumnRenamed("song", "pid"), "pid")._jdf.queryExecution().executedPlan().toString()
