"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are a sample of the vectors. A vector is described by its NEAREST nearest pivots in order;
two vectors are candidates if their lists share at least SHARED pivots. The inverted lists are kept by combination of
SHARED pivots (and label), so a list holds only vectors that share so many. The pairs of a list are verified by cosine in
double precision, and a pair that meets in several lists is counted in the one of its lowest shared pivots only.

Equal vectors are one entry with a count. A list of more than BLOCK entries is cut into blocks, and each pair of blocks is
verified by itself, so no list is one task. Pairs never leave a task: it returns each entry's number of partners, and
links that join entries to classes. The sample is bounded (MOST_PIVOTS) and only describes; every vector is indexed.
Pairs whose lists share fewer pivots are missed: at cosine 0.93 about one in a thousand with 1,024 pivots.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers, and those with a null label,
link with nothing; vectors of different length never link. Repeated rows are vectors of their own. A null id counts as a
partner but names a component only if all its ids are null, and is never kept. An empty table gives an empty result.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import ragged_index, table, written
from recset.llm.components import components, unite
from recset.llm.queries import query

LEAST = 0.93
NEAREST = 10
SHARED = 2
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
BLOCK = 2048
TASK_ROWS = 40_000  # list entries that a verifying task should have
STEP = 1_000_000  # pairs of entries whose cosines it holds at a time
PAIRS = 1 << 16  # pairs whose vectors it holds side by side


def entries(vectors: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, key null where it cannot link; and the distinct vectors (entry, label, vec, n, first)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = (F.coalesce(F.size(v), F.lit(0)) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull()
    text = F.concat_ws(",", F.transform(v, lambda x: (x + F.lit(0.0)).cast("string")))
    key = F.when(F.coalesce(good, F.lit(False)), F.sha2(F.concat_ws("|", F.col(label).cast("string"), text), 256))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), v.alias("vec"), key.alias("key"))
    rows = written(rows, "vectors")
    distinct = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return rows.select("id", "key"), written(distinct.withColumn("entry", F.xxhash64("key")), "entries")


def units(column: pa.ListArray) -> np.ndarray:
    """Unit vectors of a list column whose lists have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(distinct: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Pivots by vector length, and their number, which grows with the root of the entries. The sample is the first rows
    in hash order; pivots that are nearly equal are left out, and what is missing is drawn at random from a fixed seed."""
    n = distinct.count()
    n_pivots = int(np.clip(1 << int(np.ceil(np.log2(4 * np.sqrt(max(n, 1))))), LEAST_PIVOTS, MOST_PIVOTS))
    sample = [r.vec for r in distinct.select("vec", "entry").orderBy("entry").limit(2 * n_pivots).collect()]
    out = {}
    for size in sorted({len(v) for v in sample}):
        x = units(pa.array([v for v in sample if len(v) == size], pa.list_(pa.float64())))
        near = np.triu(x @ x.T > 0.9, 1)
        out[size] = filled(x[~near.any(axis=0)][:n_pivots], n_pivots)
    return out, n_pivots


def filled(x: np.ndarray, n: int) -> np.ndarray:
    more = np.random.default_rng(n).normal(size=(n - len(x), x.shape[1]))
    return np.concatenate([x, more / np.linalg.norm(more, axis=1, keepdims=True)])


def described(distinct: DataFrame, pivots: dict[int, np.ndarray], n_pivots: int) -> DataFrame:
    """(entry, label, size, near): the numbers of the nearest pivots, nearest first."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(shared.value)
        for batch in batches:
            size = batch.column("size").to_numpy()
            for s in np.unique(size).tolist():
                part = batch.filter(pa.array(size == s))
                if s not in known:
                    known[s] = filled(np.zeros((0, s)), n_pivots)
                for at in range(0, part.num_rows, 4096):
                    own = part.slice(at, 4096)
                    far = -(units(own.column("vec")) @ known[s].T)
                    near = np.argpartition(far, NEAREST, axis=1)[:, :NEAREST]
                    near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, NEAREST), pa.int32()), pa.array(near.reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([own.column("entry"), own.column("label"), own.column("size"), lists], ["entry", "label", "size", "near"])

    return distinct.select("entry", "label", F.size("vec").alias("size"), "vec").mapInArrow(run, "entry long, label string, size int, near array<int>")


def inverted(desc: DataFrame) -> DataFrame:
    """(list, entry, a, b, ...): one row per entry and combination of SHARED of its pivots, for lists of two or more;
    `job` numbers the verifying task and `side` tells the block."""
    combos = list(itertools.combinations(range(NEAREST), SHARED))
    near = F.array_sort("near")
    keys = F.array(*[F.array(*[near[i] for i in c]) for c in combos])
    rows = desc.select("entry", near.alias("near"), "label", "size", F.explode(keys).alias("own"))
    rows = rows.select("entry", "near", "own", F.xxhash64("label", "size", "own").alias("list"))
    counts = rows.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(counts, "list").withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    part = F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("entry", "near", "own", "list", part.alias("part"), each.alias("other"))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    return rows.select("entry", "near", "own", F.xxhash64("list", lo, hi).alias("job"), (F.col("part") == lo).alias("low"), (lo == hi).alias("alone"))


def verify(lists: DataFrame, distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, n): with b null, n vectors are partners of entry a (within the task); else a and b are in one component."""
    rows = lists.join(distinct.select("entry", "label", "vec", "n"), "entry")
    n_jobs = max(1, lists.count() // TASK_ROWS)
    rows = rows.withColumn("task", F.pmod(F.xxhash64("job"), F.lit(n_jobs)))
    return rows.select("task", "job", "low", "alone", "entry", "near", "own", "label", "vec", "n").groupBy("task").applyInArrow(
        lambda tab: _verify(tab, least), "a long, b long, n long")


def _verify(tab: pa.Table, least: float) -> pa.Table:
    tab = tab.combine_chunks()
    col = {n: tab.column(n).combine_chunks() if isinstance(tab.column(n), pa.ChunkedArray) else tab.column(n) for n in tab.column_names}
    job, low, alone = (col[n].to_numpy(zero_copy_only=False) for n in ("job", "low", "alone"))
    entry, weight = col["entry"].to_numpy(), col["n"].to_numpy()
    label = col["label"].dictionary_encode().indices.to_numpy()
    near = col["near"].flatten().to_numpy().reshape(-1, NEAREST)
    own = col["own"].flatten().to_numpy().reshape(-1, SHARED)
    size = np.diff(col["vec"].offsets.to_numpy())
    # Rows by job, and within a job the low block first; hashes that collide are told apart by label, size and pivots.
    names, place = np.unique(entry, return_inverse=True)
    partners, root = np.zeros(len(names), np.int64), np.arange(len(names))
    order = np.lexsort((~low, size, label, *own.T, job))
    key = np.stack([job, label, size, *own.T], axis=1)[order]
    cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    stops = np.append(cut[1:], len(order))
    lens = stops - cut
    n_low = np.add.reduceat(low[order].astype(np.int64), cut)
    by_size = {s: (np.flatnonzero(size == s), None) for s in np.unique(size).tolist()}
    x = {}
    at = np.empty(len(size), np.int64)
    for s, (rows, _) in by_size.items():
        x[s] = units(col["vec"].take(pa.array(rows)))
        at[rows] = np.arange(len(rows))

    def count(i: np.ndarray, j: np.ndarray) -> None:
        """Rows i and j are pairs at or above the limit: keep those that this list is to count."""
        both = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
        nth = np.cumsum(both, axis=1)
        mine = np.ones(len(i), bool)
        for k in range(SHARED):  # the lowest shared pivots must be the list's own; `near` is sorted here
            mine &= near[i, (nth > k).argmax(axis=1)] == own[i, k]
        i, j = i[mine], j[mine]
        np.add.at(partners, place[i], weight[j])
        np.add.at(partners, place[j], weight[i])
        unite(root, place[i], place[j])

    single = alone[order][cut]
    small = np.flatnonzero(single & (lens <= 32) & (lens > 1))
    # Small lists together: all pairs (p, q), p < q, of each.
    part = np.cumsum(lens[small] ** 2) // PAIRS
    for own_lists in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else []:
        n = lens[own_lists]
        first = np.repeat(cut[own_lists], n * n)
        k = ragged_index(np.zeros(len(n), np.int64), n * n)
        wide = np.repeat(n, n * n)
        p, q = k // wide, k % wide
        keep = p < q
        i, j = order[(first + p)[keep]], order[(first + q)[keep]]
        for s in x:
            m = size[i] == s
            a, b = i[m], j[m]
            hit = np.einsum("ij,ij->i", x[s][at[a]], x[s][at[b]]) >= least
            count(a[hit], b[hit])
    for k in np.flatnonzero(~(single & (lens <= 32))).tolist():
        rows = order[cut[k] : stops[k]]
        left, right = (rows, rows) if single[k] else (rows[: n_low[k]], rows[n_low[k] :])
        if not len(left) or not len(right):
            continue
        s = int(size[rows[0]])
        step = max(1, STEP // max(1, len(right)))
        for a in range(0, len(left), step):
            hit = x[s][at[left[a : a + step]]] @ x[s][at[right]].T >= least
            if single[k]:
                hit &= np.arange(len(right))[None, :] > np.arange(a, min(a + step, len(left)))[:, None]
            i, j = np.nonzero(hit)
            for z in range(0, len(i), PAIRS):
                count(left[a + i[z : z + PAIRS]], right[j[z : z + PAIRS]])
    some, far = np.flatnonzero(partners), np.flatnonzero(root != np.arange(len(root)))
    return pa.table([
        pa.array(np.concatenate([names[some], names[far]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[root[far]])]),
        pa.concat_arrays([pa.array(partners[some]), pa.nulls(len(far), pa.int64())])], names=["a", "b", "n"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows, distinct = entries(vectors, id_col, vector, label)
    pivots, n_pivots = choose_pivots(distinct)
    lists = written(inverted(described(distinct, pivots, n_pivots)), "lists")
    found = written(verify(lists, distinct, least), "found")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("more"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("entry"), "root")
    known = distinct.select("key", "entry", "first", "n").join(links, "entry", "left").join(roots, "entry", "left")
    known = known.withColumn("root", F.coalesce("root", "entry"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(names, "root").select("key", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "key", "left").select(
        F.col("id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
  AND len(list_filter(x, lambda e: e <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS vb FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(r, t, vt) AS (SELECT r, r, vec_id FROM v UNION SELECT reach.r, link.b, link.vb FROM reach JOIN link ON reach.t = link.a),
comp AS (SELECT r, min(vt) AS c FROM reach GROUP BY r),
cnt AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN cnt USING (r)
"""


@query("op10_pivots", ORACLE)
def op10_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))
