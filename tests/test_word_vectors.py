"""Word vectors whose words, pairs and vectors lie in blocks."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recset.operators import models as md, word_vectors as wv
from recset.session import cut


def topics(n, lists, seed=5):
    """Lists of words of one of two topics each, a word on its own, an empty list and a null word."""
    r = random.Random(seed)
    out = [([f"{t}{r.randrange(n)}" for _ in range(8)],) for t in "ab" for _ in range(lists)]
    return out + [(["alone"],), ([],), (["a0", None, "a1"],)]


@pytest.mark.parametrize("words, pairs", [(1 << 17, 1 << 20), (6, 1 << 20), (1 << 17, 20_000)])
def test_vectors_tell_topics_apart(spark, monkeypatch, words, pairs):
    monkeypatch.setattr(wv, "WORDS", words)
    monkeypatch.setattr(wv, "PAIRS", pairs)
    monkeypatch.setattr(wv, "CHUNK", 4096)
    docs = spark.createDataFrame(topics(8, 700), "words array<string>")
    got = {r.word: np.array(r.vec) for r in md.embeddings(docs, "words", 10).collect()}
    assert sorted(got) == sorted([f"{t}{k}" for t in "ab" for k in range(8)] + ["alone"])
    assert all(v.shape == (10,) and np.isfinite(v).all() for v in got.values())
    names = [w for w in got if w != "alone"]
    x = np.array([got[w] for w in names])
    x -= x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = np.array([[a[0] == b[0] for b in names] for a in names])
    assert (x @ x.T)[alike].mean() > 0.5 and (x @ x.T)[~alike].mean() < -0.5


def test_pairs_are_those_of_the_windows(spark, monkeypatch):
    monkeypatch.setattr(wv, "WORDS", 3)
    monkeypatch.setattr(wv, "FLUSH", 100)
    monkeypatch.setattr(wv, "CHUNK", 7)
    lists = [x for x, in topics(5, 30)]
    docs = cut(spark.createDataFrame([(x,) for x in lists], "words array<string>"))
    vocab, blocks = wv.vocabulary(docs, "words")
    word = {(r.block, r.slot): r.word for r in vocab.collect()}
    assert blocks == 4
    got = []
    for r in wv.pair_chunks(docs, "words", vocab, blocks, 3).collect():
        j = (r.i + r.stratum) % blocks
        a, b, k = np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.int32), np.frombuffer(r.k, np.int8)
        assert len(a) == len(b) == len(k) == r.n <= 7
        got += [(word[r.i, x], word[j, y], z) for x, y, z in zip(a.tolist(), b.tolist(), k.tolist())]
    want = []
    for x in lists:
        x = [w for w in x if w is not None]
        want += [(x[s], x[t], abs(s - t)) for s in range(len(x)) for t in range(len(x)) if 0 < abs(s - t) <= 3]
    assert sorted(got) == sorted(want)


def test_no_words(spark):
    docs = spark.createDataFrame([([],), (None,)], "words array<string>")
    assert md.embeddings(docs, "words", 4).collect() == []


def test_vectors_do_not_go_through_the_driver(spark):
    docs = spark.range(3000).select(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("words"))
    assert md.embeddings(docs, "words", 3).count() == 3001
    assert not hasattr(md, "Word2Vec")


def test_vectors_move_by_their_summed_gradient():
    """Repeated and single vectors alike; more weight than MOST counts as MOST."""
    rng = np.random.default_rng(3)
    vecs, grad = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(120, 4)).astype(np.float32)
    at, weight = np.append(rng.integers(0, 45, 119), 49), rng.choice([1, 9, 40], 120).astype(np.float32)
    want = vecs.astype(float)
    for k in np.unique(at):
        of = at == k
        want[k] -= 0.1 * grad[of].sum(axis=0) / max(1, weight[of].sum() / wv.MOST)
    wv.moved(vecs, at, grad, weight, 0.1)
    assert vecs == pytest.approx(want, abs=1e-5)


def test_cells_of_one_task_are_not_dealt_again(spark, monkeypatch):
    """A cell's only task has the vectors of its blocks, so a stratum is one shuffle; several tasks take a second one."""
    monkeypatch.setattr(wv, "WORDS", 6)
    docs = cut(spark.createDataFrame(topics(8, 50), "words array<string>"))
    vocab, blocks = wv.vocabulary(docs, "words")
    chunks = wv.pair_chunks(docs, "words", vocab, blocks, 10)
    for tasks in (1, 2):
        out = wv.stratum(wv.first_vectors(vocab, 5), chunks.filter("stratum = 1"), 1, blocks, tasks, 5, 10, 0, 0.025)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == tasks
        got = {(r.kind, r.block): len(r.vecs) for r in out.collect()}
        assert len(got) == 2 * blocks and got == {(r.kind, r.block): len(r.vecs) for r in wv.first_vectors(vocab, 5).collect()}
