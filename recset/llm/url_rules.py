"""URL rules by a sorted digest array.

Rules (host, path, verdict) become 64-bit xxhash keys in one sorted array that every worker maps into memory. A url
gives one candidate key for each (host length, path length) that rules have; all keys of a batch are searched at once by
binary search, and each hit is confirmed against the stored full strings, so equal digests of different strings do no
harm. The rule with the longest text wins, then the one with the longer host.

Defined results: a null url and one without `://` have an empty host and path; they, and urls that no rule fits, get a
null rule and the default verdict. Repeated rules count once (of equal host and path with different verdicts `block`
stays). Repeated rows stay repeated. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import table
from recset.llm.queries import query

PART_BYTES = 128 << 20  # rules are searched in parts of at most about this size, each of them broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted keys, and in the same order the strings they stand for.

    File: number of rules and bytes of strings (two 64-bit numbers), keys, string offsets, verdict numbers, strings.
    """

    def __init__(self, file):
        n, size = np.memmap(file, np.uint64, "r", 0, (2,)).tolist()
        self.keys = np.memmap(file, np.uint64, "r", 16, (n,)) if n else np.zeros(0, np.uint64)
        self.off = np.memmap(file, np.uint64, "r", 16 + 8 * n, (n + 1,))
        self.verdicts = np.memmap(file, np.uint8, "r", 24 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        self.strings = np.memmap(file, np.uint8, "r", 24 + 17 * n, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def pack(rules: list[tuple[str, str, int]], key=digest) -> bytes:
        rows = sorted((key(h, p), f"{h}\0{p}".encode(), v) for h, p, v in rules)
        off = np.zeros(len(rows) + 1, np.uint64)
        off[1:] = np.cumsum([len(r[1]) for r in rows], dtype=np.uint64) if rows else 0
        head = np.array([len(rows), int(off[-1])], np.uint64)
        keys = np.array([r[0] for r in rows], np.uint64)
        verdicts = np.array([r[2] for r in rows], np.uint8)
        return b"".join([head.tobytes(), keys.tobytes(), off.tobytes(), verdicts.tobytes(), *[r[1] for r in rows]])

    @classmethod
    def mapped(cls, data: bytes) -> DigestArray:
        """Map the bytes through a file that has no name, so that nothing stays behind when a worker ends."""
        file = tempfile.TemporaryFile()
        file.write(data)
        file.flush()
        return cls(file)

    def find(self, digests: np.ndarray, strings: list[str]) -> np.ndarray:
        """Rule number of each candidate, or -1. All digests go through one binary search."""
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(digests), -1, np.int64)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == digests[ok]
        for i in np.flatnonzero(ok).tolist():
            want, j = strings[i].encode(), int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # a run of equal digests: collisions
                if bytes(self.strings[int(self.off[j]) : int(self.off[j + 1])]) == want:
                    found[i] = j
                    break
                j += 1
        return found


def best_rules(index: DigestArray, pairs: list[tuple[int, int]], hosts: list[str], paths: list[str], key=digest) -> np.ndarray:
    """Number of the rule that wins for each url, or -1. `pairs`: the (host, path) lengths of rules, best first."""
    rows, strings, digests = [], [], []
    by_host: dict[int, list[int]] = {}
    for rank, (h, _) in enumerate(pairs):
        by_host.setdefault(h, []).append(rank)
    ranks = []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        n = len(host)
        for h, own in by_host.items():
            if h > n or (h < n and host[n - h - 1] != "."):
                continue
            end = host[n - h :]
            for r in own:
                if pairs[r][1] <= len(path):
                    start = path[: pairs[r][1]]
                    rows.append(i)
                    ranks.append(r)
                    strings.append(f"{end}\0{start}")
                    digests.append(key(end, start))
    best = np.full(len(hosts), -1, np.int64)
    if not rows:
        return best
    found = index.find(np.array(digests, np.uint64), strings)
    rows, ranks, hit = np.array(rows), np.array(ranks), found >= 0
    order = np.lexsort((ranks[hit], rows[hit]))
    r, f = rows[hit][order], found[hit][order]
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]
    best[r[first]] = f[first]
    return best


def with_host_path(df: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """Host (A-Z lower-cased) and path of a url; see the module text for urls without them."""
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumn("__h", F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER)).withColumn(
        "__p", F.regexp_extract(text, parts, 2)).withColumnsRenamed({"__h": host, "__p": path})


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `urls`; rules(host, path, verdict: allow or block).

    Rules are cut into parts by a hash so that each part stays below PART_BYTES; a url keeps the best rule of all parts.
    """
    clean = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict"))
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 200)).first()[0] or 0
    n_parts = size // PART_BYTES + 1
    out = with_host_path(urls.select(F.col(id_col).alias("id"), F.col(url).alias("url")), "url").select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"),
        F.lit(None).cast("string").alias("verdict"))
    sc = urls.sparkSession.sparkContext
    for k in range(n_parts):
        part = clean.filter(F.pmod(F.xxhash64("host", "path"), F.lit(n_parts)) == k)
        rows = [(r.host, r.path, int(r.verdict == "block")) for r in part.toLocalIterator()]
        pairs = sorted({(len(h), len(p)) for h, p, _ in rows}, key=lambda x: (-x[0] - x[1], -x[0]))
        shared = sc.broadcast(DigestArray.pack(rows))
        out = out.mapInArrow(_probe(shared, pairs), out.schema)
    rule = F.concat("rule_host", "rule_path")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _probe(shared, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or DigestArray.mapped(shared.value)
            cols = {n: batch.column(n).to_pylist() for n in ("host", "path", "rule_host", "rule_path", "verdict")}
            best = best_rules(index, pairs, cols["host"], cols["path"])
            for i in np.flatnonzero(best >= 0).tolist():
                j = int(best[i])
                h, p = bytes(index.strings[int(index.off[j]) : int(index.off[j + 1])]).decode().split("\0")
                old = (len(cols["rule_host"][i]) + len(cols["rule_path"][i]), len(cols["rule_host"][i])) if cols["verdict"][i] else (-1, -1)
                if (len(h) + len(p), len(h)) > old:
                    cols["rule_host"][i], cols["rule_path"][i] = h, p
                    cols["verdict"][i] = "block" if index.verdicts[j] else "allow"
            arrays = [batch.column("id")] + [pa.array(cols[n], pa.string()) for n in ("host", "path", "rule_host", "rule_path", "verdict")]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "host", "path", "rule_host", "rule_path", "verdict"])

    return run


# The rules of the registered query (fixed values).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE = """
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT n, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


@query("op9_url_rules", ORACLE)
def op9_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf, "pages"), rules)
