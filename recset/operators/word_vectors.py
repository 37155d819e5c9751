"""Word vectors over item sequences: skip-gram with negative sampling; words, pairs and vectors are dealt into blocks.

Words lie in blocks by hash, and pairs (centre, neighbour) in cells by the blocks of both. A pass over the pairs has as many strata
as there are blocks: in stratum s a task takes centre vectors of block i, neighbour vectors of block i + s and the pairs of that
cell, so tasks of a stratum change different vectors. Noise comes from the neighbour's block, by count to the power of 0.75. A cell of
very many pairs is dealt to several tasks; a vector then moves by the mean change of those that had pairs of it. The driver sees
numbers of words and pairs only. As in word2vec, a centre's window has a random width up to the full one, anew in each pass, and
steps shrink over the passes. In a mini-batch a vector moves by its summed gradient, of MOST pairs' weight at most, so a very
frequent word does not diverge.

A word of lists of its own keeps its first, random vector; null words are left out; without words the result is empty.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from recset.session import cut, dealt, discard, fresh_path, parts

WORDS = 1 << 17  # of a block, about
PAIRS = 1 << 20  # that a task trains in a stratum, about
CHUNK = 1 << 16  # pairs of a row, at most
FLUSH = 1 << 21  # pairs that a task gathers before it writes rows
BATCH, MOST = 1024, 16
NOISE, DRAWN = 5, 64  # noise words for each pair; drawn for a mini-batch, which shares them
RATE, LAST = 0.025, 1e-4


def vocabulary(sentences: DataFrame, words: str) -> tuple[DataFrame, int]:
    """(word, n, block, slot) and the number of blocks."""
    counts = cut(sentences.select(F.explode(words).alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("n")), "words")
    blocks = max(1, -(-counts.count() // WORDS))
    slot = F.row_number().over(W.partitionBy("block").orderBy("word")) - 1
    return cut(counts.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")).withColumn("slot", slot), "words"), blocks


def neighbours(at: np.ndarray, block: np.ndarray, slot: np.ndarray, window: int) -> list[np.ndarray]:
    """Blocks and slots of centre and neighbour and their distance, for all pairs of the same list `at` within the window."""
    out = []
    for k in range(1, min(window, len(at) - 1) + 1):
        t = np.flatnonzero(at[k:] == at[:-k])
        for a, b in ((t, t + k), (t + k, t)):
            out.append((block[a], slot[a], block[b], slot[b], np.full(len(t), k, np.int8)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int32)] * 4 + [np.zeros(0, np.int8)]


def pair_chunks(sentences: DataFrame, words: str, vocab: DataFrame, blocks: int, window: int) -> DataFrame:
    """(stratum, i, no, n, a, b, k): n pairs of one cell as packed slots of centres (a) and neighbours (b) and distances (k)."""
    n = parts(sentences)
    tokens = sentences.select(F.monotonically_increasing_id().alias("sid"), words).select("sid", F.posexplode(words).alias("pos", "word"))
    known = vocab.select("word", "block", "slot")
    tokens = dealt(tokens, n, "word").join(dealt(known, n, "word"), "word") if blocks > 1 else tokens.join(known.hint("broadcast"), "word")
    lists = dealt(tokens, n, "sid").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "block", "slot"))).alias("w"))

    def rows(held: list, no: int) -> pa.RecordBatch:
        i, a, j, b, k = (np.concatenate(x) for x in zip(*held))
        cell = ((j - i) % blocks) * blocks + i
        by = np.argsort(cell, kind="stable")
        cell, i, a, b, k = cell[by], i[by], a[by].astype(np.int32), b[by].astype(np.int32), k[by]
        heads = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
        cuts = [(x, min(x + CHUNK, to)) for at, to in zip(heads, heads[1:]) for x in range(at, to, CHUNK)]
        first = [x for x, _ in cuts]
        packed = [pa.array([v[x:y].tobytes() for x, y in cuts], pa.binary()) for v in (a, b, k)]
        return pa.RecordBatch.from_arrays(
            [pa.array((cell[first] // blocks).astype(np.int32)), pa.array(i[first].astype(np.int32)), pa.array(no + np.arange(len(cuts))), pa.array([y - x for x, y in cuts], pa.int64()), *packed],
            ["stratum", "i", "no", "n", "a", "b", "k"])

    def run(batches):
        held, size, no = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            w = batch.column("w")
            off, w = w.offsets.to_numpy().astype(np.int64), w.values
            block, slot = (w.field(c).to_numpy() for c in ("block", "slot"))
            x = 0
            while x < batch.num_rows:
                y = max(x + 1, int(np.searchsorted(off, off[x] + FLUSH // (2 * window), "right")) - 1)
                here = slice(off[x], off[y])
                held.append(neighbours(np.repeat(np.arange(y - x), np.diff(off[x:y + 1])), block[here], slot[here], window))
                size += len(held[-1][0])
                if size >= FLUSH:
                    out = rows(held, no)
                    no += out.num_rows
                    held, size = [], 0
                    yield out
                x = y
        if size:
            yield rows(held, no)

    return lists.select("w").mapInArrow(run, "stratum int, i int, no long, n long, a binary, b binary, k binary")


def first_vectors(vocab: DataFrame, d: int) -> DataFrame:
    """(kind, block, vecs, noise): random centre vectors (kind 0), zero neighbour vectors (1) with the noise's running shares."""

    def run(batches):
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n")):
                share = np.cumsum(n.values.to_numpy() ** 0.75)
                x = ((np.random.default_rng([block, 0]).random((len(n), d)) - 0.5) / d).astype(np.float32)
                vecs, noise = [x.tobytes(), np.zeros_like(x).tobytes()], [b"", (share / share[-1]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([block] * 2, pa.int32()), pa.array(vecs, pa.binary()), pa.array(noise, pa.binary())], ["kind", "block", "vecs", "noise"])

    counts = F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda x: x["n"].cast("double"))
    return vocab.groupBy("block").agg(counts.alias("n")).mapInArrow(run, "kind int, block int, vecs binary, noise binary")


def moved(vecs: np.ndarray, at: np.ndarray, grad: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """Move each vector by its summed gradient; rows of more weight than MOST count as MOST. Only rows of repeated vectors are summed."""
    by = np.argsort(at, kind="stable")
    at = at[by]
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    k = np.diff(np.append(heads, len(at)))
    one = k == 1
    alone, several = by[heads[one]], by[np.repeat(~one, k)]
    vecs[at[heads[one]]] -= rate * grad[alone] / np.maximum(1, weight[alone] / MOST)[:, None]
    if len(several):
        first = np.cumsum(k[~one]) - k[~one]
        total = np.add.reduceat(weight[several], first)
        vecs[at[heads[~one]]] -= rate * np.add.reduceat(grad[several], first) / np.maximum(1, total / MOST)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, noise: np.ndarray, a: np.ndarray, b: np.ndarray, rng, rate: float) -> None:
    """One pass over the pairs (a, b) on centre vectors x and neighbour vectors y, in place."""
    size = min(BATCH, max(64, MOST * min(len(x), len(y))))
    for lo in range(0, len(a), size):
        c, o = a[lo:lo + size], b[lo:lo + size]
        z = np.minimum(np.searchsorted(noise, rng.random(DRAWN), "right"), len(noise) - 1).astype(np.int32)
        xc, yo, yz = x.take(c, 0), y.take(o, 0), y.take(z, 0)
        hit = (sigmoid(np.einsum("nd,nd->n", xc, yo)) - 1).astype(np.float32)[:, None]
        miss = xc @ -yz.T
        np.exp(np.clip(miss, -30, 30, out=miss), out=miss)
        miss += 1
        np.reciprocal(miss, out=miss)
        miss *= NOISE / DRAWN
        miss[z == o[:, None]] = 0
        one = np.ones(len(c), np.float32)
        moved(x, c, hit * yo + miss @ yz, one, rate)
        moved(y, np.append(o, z), np.vstack([hit * xc, miss.T @ xc]), np.append(one, np.full(DRAWN, len(c) * NOISE / DRAWN, np.float32)), rate)


def stratum(state: DataFrame, chunks: DataFrame, s: int, blocks: int, tasks: int, d: int, window: int, seed: int, rate: float) -> DataFrame:
    """The vectors after the pairs of stratum s, whose cells are dealt to `tasks` tasks each. One task of a cell has its vectors at once;
    the changes of several are brought together."""
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("r")
    none = F.lit(None).cast("binary")
    i = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - s, F.lit(blocks))).cast("int")
    vectors = state.select(i.alias("i"), each, "kind", F.lit(0).cast("long").alias("no"), F.col("vecs").alias("a"), F.col("noise").alias("b"), none.alias("k"))
    pairs = chunks.select("i", F.pmod("no", F.lit(tasks)).cast("int").alias("r"), F.lit(2).alias("kind"), "no", "a", "b", "k")

    def rows(key, x, y, old, hit, noise):
        block = [key[0], (key[0] + s) % blocks]
        if tasks == 1:
            new = [(v.astype(np.float64) + (to - v)).astype(np.float32).tobytes() for v, to in zip(old, (x, y))]  # as changes of several tasks are added
            cols = [pa.array([0, 1], pa.int32()), pa.array(block, pa.int32()), pa.array(new, pa.binary()), pa.array([b"", noise.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["kind", "block", "vecs", "noise"])
        base = [v.tobytes() if key[1] == 0 else b"" for v in old]
        cols = [pa.array([0, 1], pa.int32()), pa.array(block, pa.int32()), *[pa.array(c, pa.binary()) for c in (base, [(x - old[0]).tobytes(), (y - old[1]).tobytes()], [h.tobytes() for h in hit], [b"", noise.tobytes() if key[1] == 0 else b""])]]
        return pa.RecordBatch.from_arrays(cols, ["kind", "block", "vecs", "change", "hit", "noise"])

    def run(batches):
        key = None
        for batch in batches:
            for k in range(batch.num_rows):
                i, r, kind = (batch.column(c)[k].as_py() for c in ("i", "r", "kind"))
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), t) if kind == 2 or c == "a" else None for c, t in (("a", np.int32 if kind == 2 else np.float32), ("b", np.int32)))
                if kind == 0:
                    if key is not None:
                        yield rows(key, x, y, old, hit, noise)
                    key, old, rng = (i, r), [a.reshape(-1, d)], np.random.default_rng([seed, s, i, r])
                    x = old[0].copy()
                elif kind == 1:
                    old.append(a.reshape(-1, d))
                    y, noise = old[1].copy(), np.frombuffer(batch.column("b")[k].as_buffer(), np.float64)
                    hit = [np.zeros(len(v), bool) for v in old]
                else:
                    keep = rng.permutation(np.flatnonzero(rng.integers(0, window, len(a)) <= window - np.frombuffer(batch.column("k")[k].as_buffer(), np.int8)))
                    a, b = a[keep], b[keep]
                    hit[0][a], hit[1][b] = True, True
                    train(x, y, noise, a, b, rng, rate)
        if key is not None:
            yield rows(key, x, y, old, hit, noise)

    def merge(batches):
        key = None
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([(base + change / np.maximum(1, hits)[:, None]).astype(np.float32).tobytes()], pa.binary()), pa.array([noise], pa.binary())], ["kind", "block", "vecs", "noise"])
        for batch in batches:
            for k in range(batch.num_rows):
                at = (batch.column("kind")[k].as_py(), batch.column("block")[k].as_py())
                if at != key:
                    if key is not None:
                        yield row()
                    key, change, hits, base, noise = at, 0, 0, None, None
                change = change + np.frombuffer(batch.column("change")[k].as_buffer(), np.float32).reshape(-1, d)
                hits = hits + np.frombuffer(batch.column("hit")[k].as_buffer(), bool).astype(np.int32)
                if len(v := np.frombuffer(batch.column("vecs")[k].as_buffer(), np.float32)):
                    base, noise = v.reshape(-1, d).copy(), batch.column("noise")[k].as_py()
        if key is not None:
            yield row()

    n = 2 * blocks * tasks  # by hash, so some get none
    met = vectors.unionByName(pairs).repartition(n, "i", "r").sortWithinPartitions("i", "r", "kind", "no")
    if tasks == 1:
        return met.mapInArrow(run, "kind int, block int, vecs binary, noise binary")
    changes = met.mapInArrow(run, "kind int, block int, vecs binary, change binary, hit binary, noise binary")
    return changes.repartition(4 * blocks, "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(merge, "kind int, block int, vecs binary, noise binary")


def skip_gram(sentences: DataFrame, words: str, d: int, window: int, passes: int) -> DataFrame:
    """(word, vec) of every word in the lists of the column `words`; the lists are written once."""
    spark = sentences.sparkSession
    sentences = cut(sentences.select(words), "lists")
    vocab, blocks = vocabulary(sentences, words)
    pairs = pair_chunks(sentences, words, vocab, blocks, window)
    path = fresh_path(spark, "pairs")
    (pairs.repartition(parts(sentences), "stratum", "i") if blocks > 1 else pairs).write.partitionBy("stratum").parquet(path)
    chunks = spark.read.schema(pairs.schema).parquet(path)
    cells = chunks.groupBy("stratum", "i").agg(F.sum("n").alias("n")).groupBy("stratum").agg(F.max("n").alias("n")).collect()
    tasks = {r.stratum: -(-r.n // PAIRS) for r in cells}
    state = cut(first_vectors(vocab, d), "vectors")
    steps = [(p, s) for p in range(passes) for s in sorted(tasks)]
    for k, (p, s) in enumerate(steps):
        rate = max(LAST, RATE * (1 - k / len(steps)))
        old, state = state, cut(stratum(state, chunks.filter(F.col("stratum") == s), s, blocks, tasks[s], d, window, p, rate), "vectors")
        discard(old)
        spark.sparkContext._jvm.System.gc()  # files of shuffles go when the driver's objects do

    def run(batches):
        for batch in batches:
            for block, vecs in zip(batch.column("block").to_pylist(), batch.column("vecs")):
                x = np.frombuffer(vecs.as_buffer(), np.float32).astype(np.float64)
                for lo in range(0, len(x) // d, 8192):
                    n = min(8192, len(x) // d - lo)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(x[lo * d:(lo + n) * d]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(lo, lo + n, dtype=np.int32)), vec], ["block", "slot", "vec"])

    vecs = state.filter("kind = 0").select("block", "vecs").mapInArrow(run, "block int, slot int, vec array<double>")
    return vocab.select("word", "block", "slot").join(vecs.hint("merge"), ["block", "slot"]).select("word", "vec")
