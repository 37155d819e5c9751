"""Spelling variants against word-by-word searches."""
import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from recset.llm import spelling as sp
from recset.llm.common import texts
from tests.llm import edge

ALPHABET = [chr(x) for x in [*range(97, 123), *range(0xC0, 0x100)]]
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows):
    out = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def plain_near(w, words):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for a in ALPHABET for k in (0, 1)}
    return [x for x in out if x in words and x != w]


def plain_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        found = plain_near(w, words)
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()}


def found_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_runs_of_any_text():
    ts = ["", None, "Été-àß x×÷y", "日本 aC3Ã é", "A" * 70, "¿ÀÿĀz"]
    words = sp.word_runs(*texts(pa.array(ts, pa.string())))
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert got == [w.translate(LOWER) for t in ts for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    assert words.doc.tolist() == np.cumsum([0] + [len(re.findall("[A-Za-zÀ-ÿ]+", t or "")) for t in ts]).tolist()


@given(st.lists(st.tuples(st.integers(-(10**12), 10**12), st.text(alphabet="aé", min_size=1, max_size=9)), min_size=1, max_size=20))
def test_hashes_of_joined_strings(rows):
    ids = [str(i).encode() for i, _ in rows]
    words = [w.encode() for _, w in rows]
    got = sp.occurrence_hashes(words, np.arange(len(words)), np.arange(len(words)), ids)
    assert got.tolist() == [zlib.crc32(i + b":" + w) for i, w in zip(ids, words)]
    assert sp.occurrence_hashes(words[:1], np.zeros(1, np.int64), np.zeros(1, np.int64), [None]).tolist() == [-1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=6, max_size=14), min_size=1, max_size=25))
def test_deep_nodes_are_prefixes(words):
    """Equal numbers stand for equal prefixes, and every shared prefix has one."""
    words = sorted(words)
    own = sp.letters(pa.array(words))
    by_number, by_prefix = collections.defaultdict(set), collections.defaultdict(set)
    prefixes = collections.Counter(w[:i] for w in words for i in range(len(w) + 1))
    # Words that differ in their first letters may lie in different tasks; within one all nodes are seen.
    for (w,), path in sp.deep_nodes(iter([((w,), x) for w, x in zip(words, own)]), 3):
        for i, number in enumerate(path.tolist()):
            by_number[number].add(w[: sp.SHALLOW + 1 + i])
            by_prefix[w[: sp.SHALLOW + 1 + i]].add(number)
        for i in range(sp.SHALLOW + 1 + len(path), len(w) + 1):
            assert prefixes[w[:i]] == 1
        for i, number in enumerate(sp.shallow_nodes(sp.letters(pa.array([w]))[0])):
            by_number[number].add(w[:i])
    assert all(len(s) == 1 for s in by_number.values()) and all(len(s) == 1 for s in by_prefix.values())


def test_near_words_and_forms(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(60):  # families of near words: short, long, with runs of equal letters, of one letter only
        w = "".join(rng.choice("abcéß") for _ in range(rng.choice([6, 7, 9, 10, 17, 30])))
        for _ in range(8):
            words[w] = rng.choice([5, 5, 6, 25, 30, 125, 700])
            i, a = rng.randrange(len(w) + 1), rng.choice("abcéÿ")
            w = max(rng.choice([w[:i] + w[i + 1 :], w[:i] + a + w[i:], w[:i] + a + w[i + 1 :]]), "abcabc")
            if len(w) < 6:
                break
    words |= {"a" * n: n for n in range(6, 24)} | {"x" * 3000: 5, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1500: 6, "y" + "x" * 2999: 200}
    words |= {"shared" + a + "ending": 7 for a in ALPHABET}  # one pair with the whole alphabet
    got = sp.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5))
    assert found_variants(got) == plain_variants(words)


def test_other_letters_are_refused(spark):
    with pytest.raises(Exception, match="alphabet"):
        sp.variants(spark.createDataFrame([("straßeŒ", 9)], "word string, n long")).collect()


@pytest.mark.parametrize("extra", [False, True])
def test_words_of_a_table(spark, extra, monkeypatch):
    monkeypatch.setattr(sp, "HELD", 50)
    counted = {r.word: r.n for r in sp.word_counts(edge.documents(spark, extra)).collect()}
    assert counted == plain_counts([(r[0], r[1]) for r in edge.rows()])
    assert found_variants(sp.spelling_variants(edge.documents(spark, extra))) == plain_variants(counted)


def test_empty_and_long(spark):
    assert sp.spelling_variants(edge.documents(spark, empty=True)).count() == 0
    rows = [(1, "Abcdefgh" * 400_000 + " " + "wordy " * 300_000 + "worded " * 9), (2, None), (None, "worded " * 3)]
    got = {r.word: r.n for r in sp.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_counts(rows)


def test_whole_query(spark):
    from tests import harness as h

    sf = "/root/testdata/sf0.001"
    assert h.spark_rows(sp.op13_spelling(spark, sf)) == h.duck_rows(h.connect(sf), sp.ORACLE)
