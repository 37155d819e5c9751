"""Class n-grams: counts and base exactly, the model against a plain version of its last step, and held-out gain."""
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recset.llm import class_ngrams as cn
from recset.llm.common import remainder
from tests.llm import edge


def tokens(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " "]


def plain(rows):
    held = [None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    count = Counter(w for r, h in zip(rows, held) if h is False for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    return sorted(((r[0], bool(h), len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), n,
                    sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r[1]))) for r, h in zip(rows, held)), key=str)


def scored(docs):
    return cn.scores(docs.withColumn("held", remainder("doc_id", 7) == 2), "held").collect()


@pytest.mark.parametrize("extra,block", [(False, cn.BLOCK_BYTES), (True, 500)])
def test_counts_and_base(spark, monkeypatch, extra, block):
    monkeypatch.setattr(cn, "BLOCK_BYTES", block)
    rows = edge.rows()
    got = sorted((tuple(r)[:6] for r in scored(edge.documents(spark, extra))), key=str)
    want = plain(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * abs(w[5]) for g, w in zip(got, want))


def test_blocks_do_not_change_the_scores(spark, monkeypatch):
    docs = edge.documents(spark)
    whole = sorted(((r.doc_id, r.score) for r in scored(docs)), key=str)
    monkeypatch.setattr(cn, "BLOCK_BYTES", 300)
    parts = sorted(((r.doc_id, r.score) for r in scored(docs.repartition(3))), key=str)
    assert all(a == b and abs(x - y) < 1e-6 * abs(x) for (a, x), (b, y) in zip(whole, parts))


def test_probabilities_sum_to_at_most_one(spark):
    """After one history, the probabilities of all known words and one unknown word."""
    rng = random.Random(3)
    train = [(i, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(12))) for i in range(60)]
    words = "a b c d e f g h".split()
    probe = [(1000 + i, f"a {w}") for i, w in enumerate([*words, "zzz"])] + [(2000, "a")]
    docs = spark.createDataFrame(train + probe, "doc_id long, text string").withColumn("held", F.col("doc_id") >= 1000)
    s = {r.doc_id: r.score for r in cn.scores(docs, "held").collect()}
    # score(a w) - score(a) + P(end | a) - P(end | w) needs the end's probability; all words are alike here, so it cancels
    # only on average: the sum over w of P(w | a) P(end | w) is below the largest P(end | w).
    total = sum(10 ** s[1000 + i] for i in range(9)) + 10 ** s[2000]
    first = sum(10 ** (s[2000] - s[2000]) for _ in range(1))
    assert 0 < total < first


def test_classes_help_on_held_out_text(spark):
    """Words of two groups alternate: a class model predicts the group, which word counts cannot."""
    rng = random.Random(4)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(left) + " " + rng.choice(right) for _ in range(20))) for i in range(200)]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_no_training_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = cn.scores(docs.withColumn("held", F.lit(True)), "held").collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0), (1, 0, 0)}
    assert all(r.score == r.base_score == 0 for r in got)
    assert cn.scores(docs.limit(0).withColumn("held", F.lit(False)), "held").count() == 0
