"""Positional index against a plain scan of all windows."""
import re

import pytest

from recset.llm import decontamination as d
from tests.llm import edge


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, window=10):
    wins = []
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        wins += [(item, w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    out = []
    for doc, t in docs:
        w, hit, own = words(t), set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    own |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


def digest(rows):
    return sorted(((r.id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), list(r["items"])) for r in rows), key=str)


def fixture():
    rows = edge.rows()
    long = rows[4][1].split()
    passage = " ".join((long * 5)[:25])
    items = [(1, passage), (2, rows[9][1]), (3, "x y"), (12, "x y"), (4, None), (5, " .. "), (6, "le le le le le le le le le le le le"), (None, "null item"), (1, passage), (7, "日本語 テキスト")]
    docs = [(r[0], r[1]) for r in rows] + [
        (300, "before " + passage.upper() + " after"), (301, "X, y! x-y. x"), (302, "le " * 40), (303, " ".join(passage.split()[:9])),
        (304, " ".join(passage.split()[3:14])), (305, "a null ITEM here"), (306, passage + " " + passage), (307, "x"), (308, "y"),
    ]
    return docs, items


@pytest.mark.parametrize("part,terms", [(16 << 20, 64 << 20), (200, 64 << 20), (200, 1)])
def test_exact_matches(spark, monkeypatch, part, terms):
    monkeypatch.setattr(d, "PART_BYTES", part)
    monkeypatch.setattr(d, "VOCABULARY_BYTES", terms)
    docs, items = fixture()
    frame = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, id int, shard string")
    bench = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, term int")
    assert digest(d.contaminated(frame, bench).collect()) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.contaminated(frame.limit(0), bench).count() == 0
    assert digest(d.contaminated(frame, bench.limit(0)).collect()) == plain(docs, [])


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item.replace("five", "five extra"), item.replace("five ", ""), item.replace("five", "other"), "ten nine eight seven six five four three two one",
             item.replace("five", "a b c five")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = {r.id for r in d.contaminated(frame, bench, slop=2).collect() if r["items"]}
    assert near == {0, 1}  # a word added is within two places; a missing or foreign word is no match
    assert {r.id for r in d.contaminated(frame, bench).collect() if r["items"]} == {0}


def test_many_candidates_in_steps(spark, monkeypatch):
    monkeypatch.setattr(d, "STEP", 3)
    docs, items = fixture()
    rows = [(i, t) for i, t in items]
    windows = d.Windows(rows, 10)
    assert sum(len(x) for _, x in [(k, own) for k, (own, _) in windows.by_length.items()]) > 10
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest(d.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()) == plain(docs, items)
