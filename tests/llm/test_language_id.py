"""Mixture inference against a plain version, and held-out accuracy."""
import math
import random

import numpy as np
import pyarrow as pa

from recset.llm import language_id as li
from tests.llm import edge


def corpus(n=40):
    rng = random.Random(2)
    rows = [(i, edge.prose(lang, rng.randint(5, 60), rng), lang) for i, lang in enumerate(["en", "de", "fr"] * n)]
    half = [(1000 + i, edge.prose("en", 30, rng) + ". " + edge.prose("fr", 10 + 40 * (i % 2), rng), None) for i in range(6)]
    return rows, half


def test_accuracy_and_mixtures(spark):
    rows, half = corpus()
    docs = spark.createDataFrame(rows + half, "doc_id long, text string, lang string")
    model = li.learn(li.training_rows(docs))
    assert model.names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in li.predict(docs.withColumn("score_", li.F.lit(1)), model, shares="shares").collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    for i, _, _ in half:
        assert set(got[i].shares) == {"en", "fr"} and got[i].lang_pred == ("fr" if i % 2 else "en")
    for r in got.values():
        assert abs(sum(r.shares.values()) - 1) < 1e-4 and abs(r.score - max(r.shares.values())) < 1e-6


def plain_mixture(like):
    """One document, pure Python; the same start, rounds and order of removal."""
    n, n_lang = len(like), len(like[0])

    def em(share):
        for _ in range(li.ROUNDS):
            new = [0.0] * n_lang
            for row in like:
                total = sum(s * x for s, x in zip(share, row))
                for k in range(n_lang):
                    new[k] += share[k] * row[k] / total / n
            share = new
        return share, sum(math.log(sum(s * x for s, x in zip(share, row))) for row in like)

    share, ll = em([1 / n_lang] * n_lang)
    while sum(s > 0 for s in share) > 1:
        active = [k for k in range(n_lang) if share[k] > 0]
        low = min(active, key=lambda k: (share[k], -k))
        keep = [k for k in active if k != low and not (share[k] * n < 0.5 and share[k] < max(share))]
        total = sum(share[k] for k in keep)
        share2, ll2 = em([share[k] / total if k in keep else 0.0 for k in range(n_lang)])
        if ll2 - 0.5 * math.log(n) * len(keep) < ll - 0.5 * math.log(n) * len(active):
            break
        share, ll = share2, ll2
    return share


def test_shares_equal_a_plain_version():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 25, 30)
    like = rng.random((n.sum(), 4)) ** 3 + 1e-3
    off = np.concatenate([[0], np.cumsum(n)])
    got = li.mixtures(like, off)
    for k in range(len(n)):
        assert np.allclose(got[k], plain_mixture(like[off[k] : off[k + 1]].tolist()), atol=2e-3)
    assert li.mixtures(like[:0], np.array([0, 0])).tolist() == [[0] * 4]


def test_awkward_rows(spark):
    docs = edge.documents(spark, extra=True)
    model = li.learn(li.training_rows(docs))
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in li.predict(docs.select("doc_id", "text", "start"), model).collect()), key=str)
    assert len(got) == len(edge.rows())
    for i, lang, score in got:
        if i in (100, 101, 102, 103):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in model.names and 0 < score <= 1
    assert li.predict(edge.documents(spark, empty=True), model).count() == 0
    nothing = li.learn(edge.documents(spark, empty=True))
    assert {r.lang_pred for r in li.predict(docs.select("text"), nothing).collect()} == {"und"}


def test_trigrams_of_words():
    gram, off = li.trigrams(pa.array([b"ab", b"ab", b"c"], pa.large_binary()), 16)
    assert off.tolist() == [0, 2, 4, 5] and gram[:2].tolist() == gram[2:4].tolist()
    assert li.bits_for(4) == 16 and li.bits_for(10**6) == 8
