"""Base spans against Python's regular expressions, the label model, and redaction."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from recset.llm import private_data as p
from tests.llm import edge

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, rx in RX.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail a.b+c@x.com_y@z.org, then é😀 q@w.e.r.t. end@x", "a@b a@b.c@d.e @x.y %@-.-", "x" * 300 + "@y.com", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111-1 x 4111 1111  1111 1111 378282246310005", "1" * 40 + " 5500-0000-0000-0004 7",
    "+1 (603) 555-8791 or +44 20 7946 0958, +1 2, ++49(0)30.123456-, +1 (843) 555-2077 170.106.47.218 +123456789012345678",
    "call (603) 555-8791 or 603-555-8791; order 603-555-8791-22", "write to jane [at] site [dot] org or jane(at)site.com", "fe80:0:0:0:1:2:3:4 is a host",
    " ".join(f"{i}.1.2.3 u{i}@h{i}.net +1 (2{i % 90 + 10}) 555-{1000 + i}" for i in range(700)), "", None,
]


@pytest.mark.parametrize("extra", [False, True])
def test_base_spans(spark, extra):
    rows = edge.rows() + [(300 + i, t, "en", "a", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    if extra:
        docs = docs.selectExpr("*", "1 AS base", "2 AS spans", "3 AS base_part", "4 AS candidates", "5 AS c", "6 AS body", "7 AS m_ip_base", "8 AS doc")
    found = p.candidates(docs, out="found")
    done = p.spans(found, p.fit(found, "found"), "found", "base_", "spans_")
    got = sorted(((r.doc_id, [(p.KINDS[c.kind], c.start, c.end) for c in r.base_]) for r in done.collect()), key=str)
    order = {k: i for i, k in enumerate(RX)}
    want = sorted(((r[0], sorted(plain(r[1]), key=lambda s: (order[s[0]], s[1]))) for r in rows), key=str)
    assert got == want
    for r in done.collect():
        assert set(map(tuple, r.base_)) <= set(map(tuple, r.spans_))
    empty = p.candidates(edge.documents(spark, empty=True))
    assert p.spans(empty, p.fit(empty)).count() == 0


def test_added_spans_and_redaction(spark):
    """Loose forms with support from other labelers are added; numbers without it stay."""
    rows = [(i, f"please call me by phone at +1 (603) 555-{1000 + i} or mail u{i}@site.com") for i in range(60)]
    rows += [(100 + i, f"serial token = 41111111111111{i:02d}, order 999.12.13.{i}") for i in range(40)]
    rows += [(300 + i, f"pay by card {n} now") for i, n in enumerate(["4111111111111111", "5500000000000004"] * 15)]
    rows += [(203, "see +1 (045) 555-2077 170.106.47.218 and 555-1234 4111111111111111 there")]
    rows += [(200, "phone me: (603) 555-8791 ok"), (201, "contact: jane [at] site [dot] org, thanks"), (202, "clean words, 1999 and 12 of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = p.candidates(docs)
    model = p.fit(found)
    done = p.spans(found, model).withColumn("out", F.expr(p.redacted("text", "spans")))
    got = {r.doc_id: r for r in done.collect()}
    assert got[200].out == "phone me: <PHONE> ok" and got[201].out == "contact: <EMAIL>, thanks"
    assert got[3].out == "please call me by phone at <PHONE> or mail <EMAIL>" and got[202].out == rows[-1][1]
    assert got[203].out == "see <PHONE> <IP> and 555-1234 <CARD> there"
    # Numbers that fail their check are not added, whatever the rest of the corpus holds.
    assert all(got[100 + i].spans == got[100 + i].base for i in range(40))
    assert model.posterior(3, [1, 1, 1, 0]) > 0.9 > 0.5 > model.posterior(2, [-1, 1, -1, 0])


def test_digest(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    found = p.candidates(docs)
    r = p.spans(found, p.fit(found)).selectExpr(f"{p.listed('base')} AS s").first()
    assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(TEXTS[0]))
    assert hashlib.sha256(r.s.encode()).hexdigest()


def test_plan_is_native(spark):
    plan = p.candidates(edge.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
