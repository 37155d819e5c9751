"""Registered queries: each binds operators to the given tables and names its SQL twin."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# Shared CTEs of the SQL twins, in dependency order.
CTES = {
    "visit": """SELECT o_custkey AS usr, l_orderkey AS traj, l_suppkey AS poi, min(l_linenumber)::BIGINT AS start_ts,
        sum(l_quantity) AS duration, sum(l_linenumber)::BIGINT AS photos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "poi": """SELECT s_suppkey AS poi, r_name AS cat, 144.9::DOUBLE + (s_suppkey*37 % 101)::DOUBLE/1000 AS lon,
        -37.8::DOUBLE + (s_suppkey*53 % 97)::DOUBLE/1000 AS lat
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tseq": """SELECT *, row_number() OVER (PARTITION BY traj ORDER BY start_ts, poi) AS ord,
        count(*) OVER (PARTITION BY traj) AS len FROM visit""",
    "cvisit": """SELECT usr, traj, s_nationkey::BIGINT AS poi, min(start_ts) AS start_ts, sum(duration) AS duration,
        sum(photos)::BIGINT AS photos FROM visit JOIN supplier ON poi = s_suppkey GROUP BY 1, 2, 3""",
    "cpoi": """SELECT n_nationkey::BIGINT AS poi, r_name AS cat, 144.9::DOUBLE + (n_nationkey*37 % 101)::DOUBLE/1000 AS lon,
        -37.8::DOUBLE + (n_nationkey*53 % 97)::DOUBLE/1000 AS lat FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cseq": """SELECT *, row_number() OVER (PARTITION BY traj ORDER BY start_ts, poi) AS ord,
        count(*) OVER (PARTITION BY traj) AS len FROM cvisit""",
    "ctraj": """SELECT traj, any_value(usr) AS usr, list(poi ORDER BY ord) AS path, count(*) AS len,
        min(CASE WHEN ord = 1 THEN poi END) AS start FROM cseq GROUP BY traj""",
    "cquery": """SELECT start, len, dense_rank() OVER (ORDER BY start, len) - 1 AS qid
        FROM (SELECT DISTINCT start, len FROM ctraj WHERE len >= 2)""",
    "cinfo": """SELECT poi, avg(duration) AS dur, count(*) AS nvisit, count(DISTINCT usr) AS pop FROM cvisit GROUP BY poi""",
    "rawentry": """SELECT l_orderkey AS pid, o_custkey AS usr, l_linenumber::BIGINT AS pos, l_partkey AS song
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "entry": """SELECT pid, usr, song, min(pos) AS pos FROM rawentry GROUP BY 1, 2, 3""",
    "pl": """SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, song) AS ord FROM entry
        WHERE pid IN (SELECT pid FROM entry GROUP BY pid HAVING count(*) >= 5)""",
    "song": """SELECT p_partkey AS song, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS artist,
        CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS genre, p_size::BIGINT AS age, p_name AS title FROM part""",
    "reward": """SELECT user_id AS run, event_type AS arm, ts, event_id, (value > 50)::INT::DOUBLE AS reward FROM events""",
    "prob0": """SELECT vec_id AS cand, m.member, c.cls, exp(5.0::DOUBLE * embedding[c.cls + m.member*5 + 1]::DOUBLE) AS x
        FROM embeddings, (SELECT unnest(range(3))::INT AS member) m, (SELECT unnest(range(5))::INT AS cls) c""",
    "prob": """SELECT cand, member, cls, x / sum(x) OVER (PARTITION BY cand, member) AS p FROM prob0""",
    "scored": """SELECT l_suppkey AS unit, l_partkey AS item, sum(l_quantity) AS score,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos FROM lineitem GROUP BY 1, 2""",
}
NEEDS = {
    "tseq": ["visit"], "cvisit": ["visit"], "cseq": ["cvisit"], "ctraj": ["cseq"], "cquery": ["ctraj"], "cinfo": ["cvisit"],
    "entry": ["rawentry"], "pl": ["entry"], "prob": ["prob0"],
}


def with_ctes(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    want: set[str] = set()

    def add(n):
        for d in NEEDS.get(n, []):
            add(d)
        want.add(n)

    for n in names.split():
        add(n)
    parts = [f"{k} AS ({v})" for k, v in CTES.items() if k in want]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(key: str, sql: str | None = None, ctes: str = "", extra: str = "", recursive: bool = False):
    """Register fn(spark, sf_dir) under `key` together with its SQL twin."""

    def deco(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_ctes(ctes, sql, extra, recursive)
        return fn

    return deco


def load_all() -> None:
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
