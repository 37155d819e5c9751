"""The entry views: one pass over the lines, in as many partitions as the table asks for."""
import random
import re

from recset import session
from recset.sources import views as v


def tables(spark, tmp_path, songs=9):
    rng = random.Random(4)
    lines = [(rng.choice([None, *range(40)]), rng.choice([None, *range(songs)]), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    users = [(k, k % 7 if k % 5 else None) for k in range(38)] + [(3, 99), (None, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(users, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return lines, users


def plain(lines, users, least):
    out = {}
    for pid, song, pos in lines:
        for k, usr in users:
            if pid is not None and k == pid:
                out.setdefault(pid, {}).setdefault((usr, song), []).append(pos)
    first = lambda ps: min((p for p in ps if p is not None), default=None)
    return {(pid, u, s, first(ps)) for pid, es in out.items() if len(es) >= least for (u, s), ps in es.items()}


def test_clean_entry(spark, tmp_path, monkeypatch):
    lines, users = tables(spark, tmp_path)
    for n in (1, 64):  # as Spark deals, and dealt into more partitions
        monkeypatch.setattr(v, "parts", lambda df: n)
        e = v.clean_entry(spark, str(tmp_path), 8)
        rows = [(r.pid, r.usr, r.song, r.pos) for r in e.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain(lines, users, 8)
        assert n == 1 or e.rdd.getNumPartitions() == 64
        # The lines are read once, and the users once.
        assert e._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_parts_grow(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "xxhash64(id) AS h").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert session.parts(t) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.parts(t, 1 << 15) >= 40


def test_negatives_in_many_parts(spark, monkeypatch):
    """The lowest missing songs, also where lists and numbers are dealt into more partitions than a shuffle has."""
    from recset.plans import splits

    rng = random.Random(8)
    entries = sorted({(p, rng.randrange(60)) for p in range(30) for _ in range(rng.choice([1, 5, 25]))})
    songs = sorted({rng.randrange(80) for _ in range(90)})
    e, s = spark.createDataFrame(entries, "pid long, song long"), spark.createDataFrame([(x,) for x in songs], "song long")
    want = set()
    for p in range(30):
        own = {x for q, x in entries if q == p}
        want |= {(p, x) for x in [x for x in songs if x not in own][: 2 * len(own)]}
    for n in (1, 32):
        monkeypatch.setattr(splits, "parts", lambda df, size: n)
        got = splits.lowest_missing(e, 2, s)
        assert sorted((r.pid, r.song) for r in got.collect()) == sorted(want)
        assert n == 1 or got.rdd.getNumPartitions() == n


def test_user_removable(spark, tmp_path, monkeypatch):
    """Users without a song of their own; no step keeps a row for each user and song."""
    from recset.plans import splits

    tables(spark, tmp_path, 400)
    for n in (1, 64):
        monkeypatch.setattr(v, "parts", lambda df: n)
        rows = [(r.pid, r.usr, r.song) for r in v.clean_entry(spark, str(tmp_path)).collect()]
        holders = {}
        for _, u, s in rows:
            holders.setdefault(s, set()).add(u)
        own = {next(iter(us)) for s, us in holders.items() if s is not None and len(us) == 1} - {None}
        assert own and own < {u for _, u, _ in rows}
        got = splits.user_removable(spark, str(tmp_path))
        assert sorted(str(r.usr) for r in got.collect()) == sorted(str(u) for u in {u for _, u, _ in rows} - own)
        assert not re.search(r"Aggregate \[usr#\w+, song#\w+\]", got._jdf.queryExecution().optimizedPlan().toString())


def test_last_holders_in_many_parts(spark, tmp_path):
    """The last user of each song in hash order, null users and songs included, also where rows are dealt into shares."""
    from hashlib import md5

    from recset.operators import splits as sp

    rng = random.Random(3)
    pairs = [(rng.choice([None, *range(30)]), rng.choice([None, 1, 1, 1, *range(60)])) for _ in range(500)]
    last = {}
    for u, s in pairs:
        key = (md5((f"{u}|" if u is not None else "").encode() + b"cu").hexdigest(), u if u is not None else -1)
        last[s] = max(last.get(s, ("", -1)), key)
    want = {u if u != -1 else None for _, u in last.values()}
    d = spark.createDataFrame(pairs, "usr long, song long")
    for n in (0, 32):
        got = sp.last_holders(d, "usr", "song", "cu", n)
        assert sorted(str(r.usr) for r in got.collect()) == sorted(str(u) for u in want)
        assert n == 0 or re.search(r"hashpartitioning\(song#\w+, _share#\w+, 32\)", got._jdf.queryExecution().executedPlan().toString())


def test_candidates_in_many_parts(spark):
    """Lists whose songs all occur often enough, also where a song's rows are dealt into shares."""
    from collections import Counter

    from recset.plans import splits

    rng = random.Random(5)
    rows = [(p, p % 5 or None, rng.choice([None, *range(14)] if p % 7 == 0 else [1, 2, 3, 4, *range(20)])) for p in range(80) for _ in range(4)]
    pop = Counter(s for _, _, s in rows)
    lists = {}
    for p, u, s in rows:
        if s is not None:
            lists.setdefault((p, u), []).append(pop[s])
    want = {(p, u, len(ns)) for (p, u), ns in lists.items() if min(ns) >= 14}
    assert 0 < len(want) < 80
    e = spark.createDataFrame(rows, "pid long, usr long, song long")
    for n in (0, 32):
        got = splits.candidates(e, 14, n)
        out = [(r.pid, r.usr, r.n) for r in got.collect()]
        assert len(out) == len(want) and set(out) == want
        assert n == 0 or len(set(re.findall(r"hashpartitioning\(song#\w+, _share#\w+, 32\)", got._jdf.queryExecution().executedPlan().toString()))) == 2


def test_check_equal_in_many_parts(spark, tmp_path, monkeypatch):
    """Multiset difference and moved features, nulls included, also where rows are dealt into more partitions."""
    from collections import Counter

    from recset.plans import sources

    tables(spark, tmp_path, 400)
    for n in (1, 64):
        monkeypatch.setattr(v, "parts", lambda df: n)
        a = [(r.pid, r.usr, r.song, r.pos) for r in v.clean_entry(spark, str(tmp_path)).collect()]
        kept = [r for r in a if r[2] is not None and r[2] % 13]
        b = kept + [(-r[0], *r[1:]) for r in a if r[2] is not None and r[2] % 19 == 0]
        far = [r for r in kept if r[2] % 17 == 0 and None not in r]
        ca, cb = Counter(a), Counter(b)
        got = sources.check_equal(spark, str(tmp_path))
        assert tuple(got.first()) == (len(a), len(b), sum((ca - cb).values()), sum((cb - ca).values()), len(far))
        assert far and (n == 1 or re.search(r"RepartitionByExpression \[pid#\w+, usr#\w+, song#\w+, pos#\w+\], 64", got._jdf.queryExecution().analyzed().toString()))
