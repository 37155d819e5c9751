"""Language-model scoring with Brown classes.

Every training word belongs to one of CLASSES classes. Classes start from the most frequent words, one each, and all
other words in the last class. In each exchange step every word goes to the class whose neighbours (the classes of the
words before and after) fit its own neighbours best; all words are exchanged in a batch, and the next step counts the
neighbours by the new classes. A token's probability is the class transition from the word before (classes of the last
step but one) times the word's emission from its class (classes of the last step), mixed with the add-one base; the
weight of the base is the share of words seen once, which estimates how much of new text is new.

Documents are cut into blocks of tokens; a block knows its own distinct words. Words are dealt by a hash into buckets, in
which each word's numbers from all blocks meet. So steps move one packed row for each block and bucket: words and counts,
then neighbour counts by class to the words, and classes back to the blocks. Only class tables (CLASSES squared) and sums
reach the driver. The vocabulary and all counts grow with the input and stay distributed.

Defined results: null text is empty, its only token is the end. A null id does not teach and is not held out. Without
training documents every probability is the base. Repeated rows stay repeated and count as often; an empty table gives
an empty result. Other columns are not read.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.bit_planes import join_planes, split_planes
from recset.llm.common import SPACES, byte_table, float_sums, remainder, slices, split_words, sums_between, table, texts, written
from recset.llm.queries import query

CLASSES = 64  # at most 128
STEPS = 2  # of exchange
SMOOTHING = 0.1  # of a class transition
BLOCK_BYTES = 6 << 20
END = b" "  # no word holds a space
KINDS = byte_table(lambda b: b not in SPACES, lower=True)
# Kinds of rows between the steps.
TOKENS, WORDS, CLASS, TOTALS, TOP, PAIRS = range(6)
ROW = "kind int, block string, bucket int, data binary, x long, y long, z long, pairs array<long>"


def pack(*parts) -> bytes:
    """Whole numbers as byte planes, everything else as it is."""
    out = [(split_planes(p.astype("<u4"), False), len(p)) if isinstance(p, np.ndarray) and p.dtype.kind in "iu" else p for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out, 5))


def unpack(data: bytes) -> list:
    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [join_planes(p[0], p[1], False).astype(np.int64) if isinstance(p, tuple) else p for p in parts]


def rows_of(*rows) -> pa.Table:
    """Rows of 7 fields, or 8 with class pairs."""
    cols = list(zip(*[(*r, None)[:8] for r in rows])) if rows else [[]] * 8
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "block", "bucket", "data", "x", "y", "z", "pairs"])


def pair_rows(pairs: np.ndarray) -> list[tuple]:
    """One PAIRS row for each class before that occurs, with the counts of all classes after it."""
    return [(PAIRS, None, None, None, int(k), None, None, pairs[k].tolist()) for k in np.flatnonzero(pairs.any(axis=1))]


def to_blocks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs(id, held, text): a TOKENS row for each block and a WORDS row for each block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", BLOCK_BYTES):
            words = split_words(*texts(part.column("text")), KINDS)
            uniq, code = words.encoded()
            names = [*uniq.to_pylist(), END]
            code = np.insert(code, words.doc[1:], len(names) - 1)
            doc = words.doc + np.arange(len(words.doc))
            of = np.array([xxhash.xxh64_intdigest(w) % n_buckets for w in names])
            order = np.argsort(of, kind="stable")  # words of a bucket side by side
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[code]
            held = part.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)  # 0 teaches, 1 held out, 2 neither
            n = np.bincount(code[np.repeat(held == 0, np.diff(doc))], minlength=len(names))
            sink = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([part.column("id")], ["id"])
            with pa.ipc.new_stream(sink, ids.schema) as s:
                s.write_batch(ids)
            block = f"{task}-{k}"
            k += 1
            cut = np.searchsorted(of[order], np.arange(n_buckets + 1))
            out = [(TOKENS, block, -1, pack(sink.getvalue().to_pybytes(), held, np.diff(doc), code, cut), None, None, None)]
            for b in range(n_buckets):
                if cut[b] < cut[b + 1]:
                    own = [names[i] for i in order[cut[b] : cut[b + 1]]]
                    out.append((WORDS, block, b, pack(own, n[cut[b] : cut[b + 1]]), None, None, None))
            yield from rows_of(*out).to_batches()

    return docs.mapInArrow(run, ROW)


def count_words(tab: pa.Table) -> pa.Table:
    """Bucket: total counts of its words. Back to each block go its words' numbers in the bucket and their counts."""
    bucket = tab.column("bucket")[0].as_py()
    parts = [unpack(d) for d in tab.column("data").to_pylist()]
    d = pa.chunked_array([pa.array(p[0], pa.large_binary()) for p in parts]).combine_chunks().dictionary_encode()
    code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.bincount(code, np.concatenate([p[1] for p in parts])).astype(np.int64)
    out, at = [], 0
    for block, p in zip(tab.column("block").to_pylist(), parts):
        own = code[at : at + len(p[0])]
        at += len(p[0])
        out.append((WORDS, block, bucket, pack(own, n[own]), None, None, None))
    out.append((TOTALS, None, bucket, None, int(n.sum()), int((n > 0).sum()), int((n == 1).sum())))
    names = d.dictionary.to_pylist()
    low = np.partition(n, max(0, len(n) - CLASSES))[max(0, len(n) - CLASSES)]
    for i in sorted(np.flatnonzero((n >= low) & (n > 0)).tolist(), key=lambda i: (-n[i], names[i]))[:CLASSES]:
        out.append((TOP, None, bucket, names[i], int(n[i]), i, None))
    return rows_of(*out)


class Block:
    """A block's tokens, with what the buckets have told about its words."""

    def __init__(self, tab: pa.Table):
        kinds, buckets, data = (tab.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        self.name = tab.column("block")[0].as_py()
        self.ids, self.held, self.n, self.code, self.cut = unpack(data[kinds.index(TOKENS)])
        size = int(self.cut[-1])
        self.word, self.count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.classes: dict[int, np.ndarray] = {}
        steps = tab.column("x").to_pylist()
        for kind, b, d, step in zip(kinds, buckets, data, steps):
            if kind == WORDS:
                self.word[self.cut[b] : self.cut[b + 1]], self.count[self.cut[b] : self.cut[b + 1]] = unpack(d)
            elif kind == CLASS:
                self.classes.setdefault(step, np.zeros(size, np.int64))[self.cut[b] : self.cut[b + 1]] = unpack(d)[0]

    def seeded(self, seeds: dict[tuple[int, int], int]) -> np.ndarray:
        """First classes: each of the most frequent words has its own, all others have the last."""
        out = np.full(len(self.word), CLASSES - 1)
        for (b, word), c in seeds.items():
            own = slice(int(self.cut[b]), int(self.cut[b + 1]))
            out[own][self.word[own] == word] = c
        return out


def neighbours(step: int, seeds: dict):
    """Block: counts of each word's neighbours by class to the buckets, and counts of class pairs."""

    def run(tab: pa.Table) -> pa.Table:
        block = Block(tab)
        cls = block.seeded(seeds) if step == 0 else block.classes[step]
        code = block.code[np.repeat(block.held == 0, block.n)]
        end = np.zeros(len(block.code), bool)
        end[np.cumsum(block.n) - 1] = True
        end = end[np.repeat(block.held == 0, block.n)]
        out, key = [], np.zeros(0, np.int64)
        if len(code):
            of = cls[code]
            before = np.append(cls[code[-1]], of[:-1])  # before a text stands the end of another
            key = np.concatenate([code * 2 * CLASSES + before, (code[:-1] * 2 * CLASSES + CLASSES + of[1:])[~end[:-1]]])
            pairs = np.bincount(before * CLASSES + of, minlength=CLASSES**2)
            out += pair_rows(pairs.reshape(CLASSES, CLASSES))
        key, n = np.unique(key, return_counts=True)
        word, slot = key // (2 * CLASSES), key % (2 * CLASSES)
        stops = np.searchsorted(word, block.cut)
        for b in np.flatnonzero(np.diff(block.cut)).tolist():
            a, z, first = int(stops[b]), int(stops[b + 1]), int(block.cut[b])
            steps = np.diff(word[a:z] - first, prepend=0)
            out.append((WORDS, block.name, b, pack(block.word[first : int(block.cut[b + 1])], steps, slot[a:z], n[a:z]), None, None, None))
        return rows_of(*out)

    return run


def exchange(step: int, fit: np.ndarray):
    """Bucket: each word's new class by the fit (slot, class) of its neighbours. Back go the classes, and the counts of
    (class before, new class)."""

    def run(tab: pa.Table) -> pa.Table:
        bucket = tab.column("bucket")[0].as_py()
        parts = [unpack(d) for d in tab.column("data").to_pylist()]
        word = np.concatenate([p[0][np.cumsum(p[1])] for p in parts])
        slot, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        size = max(int(p[0].max()) for p in parts) + 1
        new = np.full(size, CLASSES - 1)
        pairs = np.zeros((CLASSES, CLASSES), np.int64)
        order = np.argsort(word, kind="stable")
        word, slot, n = word[order], slot[order], n[order]
        for first in range(0, size, 1 << 15):  # words at a time, so that the table of their neighbours stays small
            a, z = np.searchsorted(word, [first, first + (1 << 15)])
            if a == z:
                continue
            m = min(1 << 15, size - first)
            table_ = np.bincount((word[a:z] - first) * 2 * CLASSES + slot[a:z], n[a:z], m * 2 * CLASSES).reshape(m, -1)
            seen = table_.any(axis=1)
            best = np.where(seen, (table_ @ fit).argmax(axis=1), CLASSES - 1)
            new[first : first + m] = best
            for c in range(CLASSES):
                pairs[:, c] += table_[best == c, :CLASSES].sum(axis=0).astype(np.int64)
        out = [(CLASS, block, bucket, pack(new[p[0]]), step + 1, None, None) for block, p in zip(tab.column("block").to_pylist(), parts)]
        return rows_of(*out, *pair_rows(pairs))

    return run


def class_table(rows: DataFrame) -> np.ndarray:
    """Sum of the PAIRS rows: CLASSES squared numbers."""
    out = np.zeros((CLASSES, CLASSES), np.int64)
    sums = F.array(*[F.sum(F.col("pairs")[k]) for k in range(CLASSES)])
    for r in rows.filter(F.col("kind") == PAIRS).groupBy("x").agg(sums.alias("n")).collect():
        out[r.x] = r.n
    return out


def context_fit(pairs: np.ndarray) -> np.ndarray:
    """Log-probability of a neighbour's class (before: first half, after: second half) given a word's class."""
    before = pairs + SMOOTHING
    after = pairs.T + SMOOTHING
    fit = np.concatenate([np.log(before / before.sum(axis=0)), np.log(after / after.sum(axis=0))])
    fit[:, pairs.sum(axis=0) == 0] = -1e9  # an empty class takes no word
    return fit


def score_block(pairs: np.ndarray, n_all: int, n_distinct: int, n_once: int, id_type: str):
    emitted = pairs.sum(axis=0)
    weight = 1 - n_once / n_all if n_all else 0.0
    before = pairs.sum(axis=1, keepdims=True)
    step = (pairs + SMOOTHING) / (before + SMOOTHING * CLASSES)

    def run(tab: pa.Table) -> pa.Table:
        block = Block(tab)
        after, own = (block.classes.get(k, np.zeros(len(block.word), np.int64)) for k in (STEPS - 1, STEPS))
        if STEPS == 1:
            raise ValueError("two steps at least")
        base = (block.count + 1) / (n_all + n_distinct + 1)
        emit = block.count / np.maximum(emitted[own], 1)
        doc = np.concatenate([[0], np.cumsum(block.n)])
        end = block.code[doc[1:] - 1][:1]
        previous = np.append(end, block.code[:-1])  # before a text stands the end, as at the end of the one before
        p = weight * step[after[previous], own[block.code]] * emit[block.code] + (1 - weight) * base[block.code]
        with pa.ipc.open_stream(block.ids) as s:
            ids = s.read_all().column("id")
        known = sums_between((block.count > 0)[block.code].astype(np.int64), doc)
        columns = [ids, pa.array(block.held == 1), pa.array(block.n), pa.array(known), pa.array(np.full(len(block.n), n_all)),
                   pa.array(float_sums(np.log10(base)[block.code], doc)), pa.array(float_sums(np.log10(p), doc))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document. `held` names a column that is
    true for held-out documents, false for those that teach, and null for those that do neither."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    mark = F.when(F.col(held).isNull(), 2).otherwise(F.col(held).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("held"), F.col(text).alias("text"))
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(to_blocks(rows, n_buckets), "blocks")
    tokens = blocks.filter(F.col("kind") == TOKENS)
    counted = written(blocks.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(count_words, ROW), "counted")
    sums = counted.filter(F.col("kind") == TOTALS).agg(F.sum("x"), F.sum("y"), F.sum("z")).first()
    n_all, n_distinct, n_once = (int(x or 0) for x in sums)
    top = counted.filter(F.col("kind") == TOP).orderBy(F.desc("x"), "data").limit(CLASSES - 1).collect()
    seeds = {(r.bucket, r.y): c for c, r in enumerate(top)}
    base = tokens.unionByName(counted.filter(F.col("kind") == WORDS))
    known, kept = base, []
    pairs = np.zeros((CLASSES, CLASSES), np.int64)
    for step in range(STEPS):
        around = written(known.groupBy("block").applyInArrow(neighbours(step, seeds), ROW), "around")
        fit = context_fit(class_table(around))
        moved = written(around.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(exchange(step, fit), ROW), "moved")
        pairs = class_table(moved)
        kept.append(moved.filter(F.col("kind") == CLASS))
        known = base.unionByName(kept[-1])
    for k in kept[-2:-1]:
        known = known.unionByName(k)
    run, schema = score_block(pairs, n_all, n_distinct, n_once, id_type)
    return known.groupBy("block").applyInArrow(run, schema).withColumnRenamed("id", id_col)


@query("op4_class_ngrams")
def op4_class_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return scores(docs.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held")), "held").withColumn(
        "held_out", F.coalesce("held_out", F.lit(False)))
