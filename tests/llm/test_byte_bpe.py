"""Byte-level BPE against the library called on whole texts, and exact round trips."""
import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from recset.llm import byte_bpe as bb
from tests.llm import edge

TEXT = st.text(alphabet=st.one_of(st.sampled_from("  \n\t　 'stdmre.,!ßÉ12٣x漢。«́"), st.characters(codec="utf-8")), max_size=80)


def whole(t):
    return bb.encoder().library.encode_ordinary(t)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_parts_of_any_text(t, size):
    cut = list(bb.parts(t, size))
    assert "".join(cut) == t and all(len(p) >= size for p in cut[:-1])
    assert [i for p in cut for i in whole(p)] == whole(t)
    assert bb.encoder().bytes(whole(t)) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\t", "\n", "　", "\x1c", "​", "a", "'s", "!", "1"]), st.integers(1, 12)), max_size=8))
def test_runs_of_space(runs):
    t = "".join(c * n for c, n in runs)
    old = bb.LONG_SPACE, bb.SPACES
    try:
        bb.LONG_SPACE, bb.SPACES = 3, bb.re.compile(f"[{bb.SPACE}]{{3,}}")
        assert bb.encoder().ids(t) == whole(t)
    finally:
        bb.LONG_SPACE, bb.SPACES = old


def test_long_texts():
    rng = random.Random(3)
    prose = edge.prose("fr", 60_000, rng)
    for t in (prose, "don't1st " * 30_000, "x" * 200_000, "-=" * 90_000 + "'s", " " * 90_000, "\n" * 70_000 + "a" + " " * 50_000 + "b", "漢字。" * 40_000):
        ids = bb.encoder().ids(t)
        assert ids == whole(t)
        n, names, raw = bb.encoder().digest(t)
        assert (n, names, raw) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(list(bb.parts(prose))) > 3


def test_space_that_the_library_cannot_look_over():
    t = " " * 3_000_000 + "word"
    assert bb.encoder().bytes(bb.encoder().ids(t)) == t.encode()


@pytest.mark.parametrize("extra", [False, True])
def test_table(spark, extra):
    docs = edge.documents(spark, extra)
    want = sorted(((r[0], whole(r[1] or "")) for r in edge.rows()), key=str)
    got = bb.encoded(docs)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == want
    assert all(r.n_tokens == len(r.ids) for r in got.collect())
    back = bb.decoded(got).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back), key=str) == sorted(((r[0], (r[1] or "").encode()) for r in edge.rows()), key=str)
    digest = sorted((tuple(r) for r in bb.digests(docs).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digest == sorted(((r[0], len(whole(r[1] or "")), sha(",".join(map(str, whole(r[1] or ""))).encode()), sha((r[1] or "").encode())) for r in edge.rows()), key=str)


def test_empty_table_and_odd_ids(spark):
    assert bb.digests(edge.documents(spark, empty=True)).count() == bb.encoded(edge.documents(spark, empty=True)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [60_000]), (4, [-1]), (5, [None]), (6, [72, 0])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in bb.decoded(rows).collect()}
    assert got[1] is got[3] is got[4] is got[5] is None and bytes(got[2]) == b"" and len(got[6])


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text")
    assert [r.ids for r in bb.encoded(df).collect()] == [whole("a�b")]
