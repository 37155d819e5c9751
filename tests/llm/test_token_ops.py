"""Token counts, id files and packing against the tokenizer libraries called on whole texts."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recset.llm import bit_planes as bp, packing as pk, token_counts as tc, word_ids as wi
from recset.llm.common import texts, work_path, written
from tests.llm import edge

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.NAME))
WORDS = Tokenizer.from_file(public_tokenizers.path(wi.NAME))
TEXT = st.text(alphabet=st.one_of(st.sampled_from("  \n\t▁aethinr.,'ß12ÉÞ×÷ÿÀ<|>"), st.characters(codec="utf-8")), max_size=60)


def word_ids(t):
    return [*WORDS.encode(t or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_any_text(ts):
    assert tc.merger().counts(pa.array(ts, pa.string())).tolist() == [len(PIECES.encode(t)) for t in ts]
    ids, off = wi.word_ids().encode(*texts(pa.array(ts, pa.string())), 1)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [word_ids(t) for t in ts]


def test_long_runs():
    ts = [" " * 3000 + "x", "ab" * 4000, "=" * 5000, "-=" * 999 + "\n" * 50, "é" * 999]
    assert tc.merger().counts(pa.array(ts)).tolist() == [len(PIECES.encode(t)) for t in ts]


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tc.Merger, "MOST", 20)
    monkeypatch.setattr(wi.WordIds, "MOST", 10)
    m, w = tc.Merger(public_tokenizers.path(tc.NAME)), wi.WordIds(public_tokenizers.path(wi.NAME))
    rng = random.Random(1)
    for _ in range(5):
        ts = [edge.prose("en", 20, rng) for _ in range(5)]
        assert m.counts(pa.array(ts)).tolist() == [len(PIECES.encode(t)) for t in ts]
        ids, off = w.encode(*texts(pa.array(ts)), None)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [word_ids(t)[:-1] for t in ts]


@pytest.mark.parametrize("extra", [False, True])
def test_counts_of_a_table(spark, extra):
    got = sorted(map(tuple, tc.token_counts(edge.documents(spark, extra)).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), len(PIECES.encode(r[1] or ""))) for r in edge.rows()), key=str)
    assert tc.token_counts(edge.documents(spark, empty=True)).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    ids = np.array(ids, "<u4")
    assert (bp.join_planes(bp.split_planes(ids, bits), len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 0, 700, 64, 3, 0)]
    with pa.OSFile(str(tmp_path / "x"), "wb") as out:
        w = bp.Writer(out, bits, block=64)
        w.add(np.concatenate(docs[:3]), np.array([1, 0, 700]))
        w.add(np.concatenate(docs[3:]), np.array([64, 3, 0]))
        w.close()
    with pa.OSFile(str(tmp_path / "x")) as f:
        r = bp.Reader(f)
        assert r.docs.tolist() == [len(d) for d in docs]
        whole = np.concatenate(docs)
        assert (np.concatenate([r.read_block(k) for k in range(len(r.blocks))]) == whole).all()
        assert (r.ids(60, 300) == whole[60:360]).all() and len(r.ids(5, 0)) == 0


@pytest.mark.parametrize("extra", [False, True])
def test_files_of_a_table(spark, extra):
    path = work_path(spark, "t")
    got = [tuple(r) for r in bp.read(path, bp.write(edge.documents(spark, extra), path)).orderBy("start").collect()]
    want, at = [], 0
    for r in sorted(edge.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = word_ids(r[1])
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    path = work_path(spark, "t")
    assert bp.read(path, bp.write(edge.documents(spark, empty=True), path)).count() == 0


def plain_best_fit(lengths, window):
    """Best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    used, items = defaultdict(list), defaultdict(set)
    for n, first, k, window, offset in pk.best_fit_decreasing(counts, 40):
        for i in range(k):
            used[window + i].append((offset, n))
            items[n].add(first + i)
    assert {n: len(s) for n, s in items.items()} == counts
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 40
    assert sorted(40 - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, 40)
    assert sorted(used) == list(range(len(used)))


@pytest.mark.parametrize("extra", [False, True])
def test_packing_of_a_table(spark, extra):
    items = written(pk.pieces(edge.documents(spark, extra), with_ids=True), "p")
    packed = written(pk.pack(items, ["doc_id", "start", "ids_crc32"]), "p")
    rows = packed.collect()
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in own.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= pk.WINDOW
    assert sum(r.length for r in rows) == sum(len(word_ids(r[1])) for r in edge.rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start) for r in rows) == sorted(
        (r[0] is None, r[0] or 0, s) for r in edge.rows() for s in range(0, len(word_ids(r[1])), pk.WINDOW))
    whole = {r.sequence_id: r for r in pk.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert pk.packed_documents(edge.documents(spark, empty=True)).count() == 0
