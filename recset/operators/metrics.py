"""Ranking metrics over a score table (unit, item, score, pos).

Ties are folded first: one row per (unit, score) with counts. All rank-sum metrics come from running totals over that
table, so neither pairs nor whole units are brought together.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recset.operators import ordering as o
from recset.session import share


def tie_table(df: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, score, n, n_pos, cum_n, cum_pos): running totals in descending score order, both inclusive."""
    g = share(df.groupBy(unit, "score").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("n_pos")))
    return o.running(g, [unit], [F.desc("score")], -o.id_bucket(g, "score"), {"cum_n": F.col("n"), "cum_pos": F.col("n_pos")})


def totals(df: DataFrame, unit: str = "unit") -> DataFrame:
    p = F.col("pos") == 1
    return df.groupBy(unit).agg(
        F.count("*").alias("N"), F.sum("pos").cast("long").alias("P"), F.max(F.when(~p, F.col("score"))).alias("max_neg"),
        F.min(F.when(p, F.col("score"))).alias("min_pos"), F.max("score").alias("top"))


def auc_and_loss(df: DataFrame, unit: str = "unit") -> DataFrame:
    """ROC AUC with averaged ties and the number of inverted pairs (ties 0.5); units without both classes drop out."""
    t = tie_table(df, unit)
    neg = F.col("n") - F.col("n_pos")
    above_neg = F.col("cum_n") - F.col("cum_pos") - neg  # negatives with a higher score
    g = t.groupBy(unit).agg(
        F.sum("n_pos").alias("P"), F.sum(neg).alias("Q"), F.sum(F.col("n_pos") * (above_neg + neg / 2)).alias("loss"))
    g = g.filter("P > 0 and Q > 0")
    return g.withColumn("auc", 1 - F.col("loss") / (F.col("P") * F.col("Q")))


def average_precision(df: DataFrame, unit: str = "unit") -> DataFrame:
    """AP with ties taken as one step."""
    t = tie_table(df, unit)
    g = t.groupBy(unit).agg(F.sum("n_pos").alias("P"), F.sum(F.col("n_pos") * F.col("cum_pos") / F.col("cum_n")).alias("s"))
    return g.filter("P > 0").select(unit, (F.col("s") / F.col("P")).alias("ap"))


def hits_at(df: DataFrame, ks: list[int], unit: str = "unit") -> DataFrame:
    """Hits in the top k for each k, with the number of positives; order is (score desc, item asc)."""
    top = o.top_k(df, [unit], [F.desc("score"), "item"], max(ks))
    hits = top.groupBy(unit).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("pos")).otherwise(0)).cast("long").alias(f"hit_{k}") for k in ks])
    return hits.join(totals(df, unit).select(unit, "N", "P"), unit)


CELLS = 1 << 22  # pairs of POI that are compared together


def _padded(column) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one matrix, with a mask of what is there."""
    n = np.array([len(x) for x in column], np.int64)
    there = np.arange(max(1, n.max(initial=0)))[None, :] < n[:, None]
    out = np.zeros(there.shape, np.int64)
    if n.sum():
        out[there] = np.concatenate([np.asarray(x) for x in column])
    return out, there


def agreement(path, truth, m) -> np.ndarray:
    """F1 on points, F1 on ordered pairs and tau-b of paths without repeats against truths, of m items that all else tie last."""
    a, in_a = _padded(path)
    b, in_b = _padded(truth)
    na, nb = in_a.sum(axis=1), in_b.sum(axis=1)
    out = np.zeros((len(a), 3))
    step = max(1, CELLS // (a.shape[1] + b.shape[1]) ** 2)
    for k in range(0, len(a), step):
        r = slice(k, k + step)
        same = (a[r, :, None] == b[r, None, :]) & in_a[r, :, None] & in_b[r, None, :]
        both = same.any(axis=2)
        hits = both.sum(axis=1)
        far = 1 << 30  # place of an item that a path lacks
        wide = np.arange(b.shape[1])
        p = np.concatenate([np.where(in_a[r], np.arange(a.shape[1]), far), np.full((len(hits), b.shape[1]), far)], axis=1)
        q = np.concatenate([np.where(both, same.argmax(axis=2), far), np.where(in_b[r], wide, far)], axis=1)
        item = np.concatenate([in_a[r], in_b[r] & ~same.any(axis=1)], axis=1)
        pair = np.triu(np.ones((p.shape[1],) * 2, bool), 1) & item[:, :, None] & item[:, None, :]
        order = np.sign(p[:, :, None] - p[:, None, :]) * np.sign(q[:, :, None] - q[:, None, :])
        known = both[:, :, None] & both[:, None, :] & np.triu(np.ones((a.shape[1],) * 2, bool), 1)
        pairs = (known & (order[:, : a.shape[1], : a.shape[1]] > 0)).sum(axis=(1, 2))
        n1, n2, mm = na[r], nb[r], m[r]
        s = (order * pair).sum(axis=(1, 2)) + hits * (mm - (n1 + n2 - hits))
        untied = lambda n: mm * (mm - 1) / 2 - (mm - n) * (mm - n - 1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            out[r, 0] = np.where(hits > 0, 2.0 * hits / (n1 + n2), 0.0)
            out[r, 1] = np.where(pairs > 0, 2.0 * pairs / (n1 * (n1 - 1) // 2 + n2 * (n2 - 1) // 2), 0.0)
            out[r, 2] = s / np.sqrt(untied(n1) * untied(n2))
    return out


def path_agreement(path: Column | str, truth: Column | str, m: Column | str) -> Column:
    """`agreement` row by row in batches, as a struct. The array functions of `columns` say the same, item by item and slower."""

    def run(path: pd.Series, truth: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(agreement(path, truth, m.to_numpy(np.int64)), columns=["f1", "pf1", "tau"])

    return F.pandas_udf(run, "f1 double, pf1 double, tau double")(path, truth, m)


TRUTHS = 1 << 17  # that a task sorts by query at a time


def truths_by_query(truth: DataFrame) -> DataFrame:
    """truth(traj, start, len, y) with len items in y -> (start, len, trajs, y, known): truths of one query in a row, as a matrix of 64-bit
    items and one of bytes that are 0 for nulls. Truths without a start are left out."""
    kind = truth.schema["traj"].dataType.simpleString()

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        start, n, y = t["start"].to_numpy(), t["len"].to_numpy(), t["y"].combine_chunks()
        first, items = y.offsets.to_numpy(), y.values
        known, items = items.is_valid().to_numpy(zero_copy_only=False), items.fill_null(0).to_numpy()
        by = np.lexsort((start, n))
        heads = np.flatnonzero(np.append(True, (start[by][1:] != start[by][:-1]) | (n[by][1:] != n[by][:-1])))
        at = [first[of][:, None] + np.arange(n[of[0]]) for of in np.split(by, heads[1:])]
        trajs = pa.ListArray.from_arrays(pa.array(np.append(heads, len(by)).astype(np.int32)), t["traj"].combine_chunks().take(pa.array(by)))
        cells = [pa.array([m[k].tobytes() for k in at], pa.binary()) for m in (items, known)]
        return pa.RecordBatch.from_arrays([pa.array(start[by][heads]), pa.array(n[by][heads]), trajs, *cells], ["start", "len", "trajs", "y", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TRUTHS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return truth.select("traj", "start", "len", "y").filter("start is not null").mapInArrow(run, f"start long, len long, trajs array<{kind}>, y binary, known binary")


def pair_hits(path: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many distinct ordered pairs (earlier, later) of the path each row of y has. A row has no item twice, so two of its items are a
    pair of the path if the first place of one lies before the last place of the other."""
    items, first = np.unique(path, return_index=True)
    last = len(path) - 1 - np.unique(path[::-1], return_index=True)[1]
    k = np.minimum(np.searchsorted(items, y), len(items) - 1)
    found = known & (items[k] == y)
    first, last = np.where(found, first[k], len(path)), np.where(found, last[k], -1)
    out = np.zeros(len(y), np.int64)
    for i in range(y.shape[1] - 1):
        out += (first[:, i, None] < last[:, i + 1:]).sum(1)
    return out


def pair_values(truth: DataFrame, pred: DataFrame, value: Callable[[Column, Column, Column], Column], name: str) -> DataFrame:
    """(qid, method, k, traj, name) for every truth(traj, start, len, y) and every pred(qid, start, len, method, k, path) of its query:
    value of the pairs that both share, the pairs of the truth and those of the path, taken once for each number of shared pairs."""
    n = lambda k: k * (k - 1) / 2
    by_hits = F.transform(F.sequence(F.lit(0).cast("long"), n(F.col("len")).cast("long")), lambda h: value(h, n(F.col("len")), n(F.size("path"))))
    preds = pred.groupBy("qid", "start", "len").agg(F.collect_list(F.struct("method", "k", "path", by_hits.alias("value"))).alias("preds"))
    kind = truth.schema["traj"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qid, preds, m = (batch.column(c)[r].as_py() for c in ("qid", "preds", "len"))
                y, known = (np.frombuffer(batch.column(c)[r].as_buffer(), t).reshape(-1, m) for c, t in (("y", np.int64), ("known", bool)))
                rows, every = len(y), np.repeat(np.arange(len(preds)), len(y))
                values = [np.array(p["value"])[pair_hits(np.array(p["path"], np.int64), y, known)] for p in preds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows * len(preds), qid)), pa.array([p["method"] for p in preds]).take(pa.array(every)), pa.array(np.array([p["k"] for p in preds], np.int32)[every]),
                     pa.concat_arrays([batch.column("trajs")[r].values] * len(preds)), pa.array(np.concatenate(values))], ["qid", "method", "k", "traj", name])

    met = truths_by_query(truth).join(preds, ["start", "len"]).select("qid", "len", "trajs", "y", "known", "preds")
    return met.mapInArrow(run, f"qid long, method string, k int, traj {kind}, {name} double")
