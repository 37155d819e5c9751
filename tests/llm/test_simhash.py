"""SimHash operator against brute force."""
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from recset.llm import simhash as s
from recset.llm.components import components, unite
from tests.llm import edge


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, most=3):
    root = list(range(len(ids)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[up(i)] = up(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[up(i)] = min(least.get(up(i), x), x)
    return [least.get(up(i)) for i in range(len(ids))]


@pytest.mark.parametrize("extra", [False, True])
def test_table(spark, extra):
    rows = edge.rows()
    # Near copies: one word of a long text changed.
    words = rows[8][1].split() * 12
    rows += [(200 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :]), "fr", "a", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    if extra:
        docs = docs.selectExpr("*", "1 AS fp", "2 AS mask", "'x' AS id", "3 AS component_id", "4 AS root")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in s.near_duplicates(docs).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, plain_components([r[0] for r in rows], fps)), key=str)
    assert got == want
    assert s.near_duplicates(edge.documents(spark, empty=True)).count() == 0


def dense(n, rng):
    base = rng.integers(0, 2**64, max(1, n // 20), dtype=np.uint64)
    x = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6)
    return np.unique(x)


@given(st.integers(1, 600), st.integers(0, 99))
@settings(max_examples=25, deadline=None)
def test_index_finds_all_pairs(n, seed):
    index = s.HierarchicalIndex(dense(n, np.random.default_rng(seed)))
    i, j = index.near(0, len(index.fps), 3)
    d = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :])
    assert set(zip(i.tolist(), j.tolist())) == set(map(tuple, np.argwhere(np.triu(d <= 3, 1)).tolist()))


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    codes = codes ^ (codes >> np.uint64(1))
    assert s.gray_rank(codes).tolist() == list(range(64))


@pytest.mark.parametrize("group", [12, 60])
def test_groups_that_are_dealt_again_lose_no_link(spark, monkeypatch, group):
    monkeypatch.setattr(s, "GROUP", group)
    monkeypatch.setattr(s, "TARGET", 30)
    fps = dense(150, np.random.default_rng(3))
    frame = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    links = {(r.a, r.b) for r in s.near_links(frame).collect()}
    place = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    root = np.arange(len(fps))
    unite(root, np.array([place[a] for a, _ in links], np.int64), np.array([place[b] for _, b in links], np.int64))
    want = plain_components(list(range(len(fps))), [int(x) for x in fps])
    assert root.tolist() == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
