"""URL rules against a direct reading of the contract."""
import random

import numpy as np

from recset.llm import url_rules as u


def expected(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        stop = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
        path = rest[stop:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rules = u.RULES + [("a.com", "", "block"), ("b.a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("org", "/", "block")]
    urls = [None, "", "no url", "://", "http://", "http://COM/", "http://.com/", "http://a.com", "x://a://b/c", "http://a.com?x/y", "http://É.example.com/en/1\n2#q"]
    urls += ["http" + rng.choice(["", "s"]) + "://" + rng.choice(["", "www.", "m.", "b."]) + rng.choice(["example.com", "Example.COM", "a.com", "aa.com", "z.net", "net", "x.org", "com"])
             + rng.choice(["", "/", "/en/", "/es/1", "/fr/", "/x", "/x/y/z", "/en"]) + rng.choice(["", "?a=/en/", "#/es/"]) for _ in range(300)]
    urls += urls[-5:] + ["http://" + "a." * 3000 + "example.com/en/" + "p" * 20000]
    pages = spark.createDataFrame([(i if i else None, x, "own") for i, x in enumerate(urls)], "page_id long, url string, verdict string")
    frame = spark.createDataFrame(rules + [rules[0], (None, "/", "block"), ("q", None, "block")], "host string, path string, verdict string")
    got = [tuple(r) for r in u.judge(pages, frame).collect()]
    want = [(i if i else None, *expected(x, rules)) for i, x in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert u.judge(pages.limit(0), frame).count() == 0
    assert u.judge(pages, frame.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_rules_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/1"), (2, "http://q.net/es/"), (3, "http://example.com/en/")], "page_id long, url string")
    frame = spark.createDataFrame(u.RULES, "host string, path string, verdict string")
    whole = sorted(map(tuple, u.judge(pages, frame).collect()))
    monkeypatch.setattr(u, "PART_BYTES", 300)
    assert sorted(map(tuple, u.judge(pages, frame).collect())) == whole


def test_equal_digests_are_told_apart():
    same = lambda host, path: 7  # every string collides
    index = u.DigestArray.mapped(u.DigestArray.pack([(h, p, 0) for h, p, _ in u.RULES], key=same))
    pairs = sorted({(len(h), len(p)) for h, p, _ in u.RULES}, key=lambda x: (-x[0] - x[1], -x[0]))
    best = u.best_rules(index, pairs, ["www.example.com", "q.net", "q.net", "q.org"], ["/en/", "/fr/", "/de/", "/"], key=same)
    names = [bytes(index.strings[int(index.off[j]) : int(index.off[j + 1])]) if j >= 0 else None for j in best]
    assert names == [b"www.example.com\0/en/", b"net\0/fr/", None, None]
    assert (np.diff(index.keys.astype(np.int64)) == 0).all()
