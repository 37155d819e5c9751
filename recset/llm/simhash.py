"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64 bits from the hashes of word shingles. Two are linked if they differ in at most `most` bits.

Distinct fingerprints are dealt into groups by (mask, value): each of four masks takes bits of one quarter of the
fingerprint, and as three differences cannot touch all four quarters, a linked pair agrees under at least one mask. A
group that is larger than GROUP is dealt again, with four wider masks over the bits that are still free, for the same
reason without losing a pair; as fingerprints are distinct this ends. Nothing is capped.

Within a group the fingerprints are sorted by Gray rank. Runs of neighbours form leaves; a node holds the bits in which
all that is below it agree, with the pattern of those bits, and a parent takes over what its children share. A query
adds up its differences from the masked patterns on its way down and leaves a node, with all that is below it, as soon as
they exceed the limit. Each group returns only links that join its members to classes, not all pairs.

Defined results: null and empty texts have no shingle and fingerprint zero, which is linked like any other. Fewer words
than a shingle has are one shingle. Repeated rows stay repeated; a null id takes part but is never a component's name
unless all ids of it are null. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import SPACES, byte_table, slices, split_words, table, texts, written
from recset.llm.components import components, unite
from recset.llm.queries import query

MOST = 3
SHINGLE = 3
SEED = 42
TARGET = 4096  # fingerprints that a group should have
GROUP = 32_768  # beyond this a group is dealt again
LEAF, FAN = 16, 8
STEP = 1_000_000  # query and node pairs that a task holds at a time
KINDS = byte_table(lambda b: b not in SPACES, lower=True)


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and offsets by text."""
    words = split_words(data, off, KINDS)
    inside = KINDS[0][data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # of the white space after a word one byte stays
    place = np.cumsum(keep) - keep
    line = np.where(inside, words.data, 0x20).astype(np.uint8)[keep].tobytes()
    n = np.diff(words.doc)
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=doc[1:])
    first = np.repeat(words.doc[:-1], per) + np.arange(doc[-1]) - np.repeat(doc[:-1], per)
    last = np.minimum(first + width, np.repeat(words.doc[1:], per)) - 1
    if not len(first):
        return np.zeros(0, np.uint64), doc
    a = place[words.start[first]].tolist()
    b = (place[words.end[last] - 1] + 1).tolist()
    h = xxhash.xxh64_intdigest
    # White space that touches the end of one text and the start of the next never lies inside a shingle.
    return np.fromiter((h(line[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a)), doc


def fingerprint(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bit k is set if over half of the text's hashes have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(off) - 1, 64), np.int64)
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        ones[k] = bits[a:b].sum(axis=0, dtype=np.int32)  # by document, which is much faster than one reduceat
    return np.packbits(2 * ones > np.diff(off)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp) of every document; fp is the fingerprint as a signed 64-bit number."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            fp = fingerprint(*shingle_hashes(*texts(part.column("text")), width))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class HierarchicalIndex:
    """Levels of nodes over fingerprints in Gray order, from the leaves up."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ands, ors, fan = self.fps, self.fps, LEAF
        while not self.levels or len(ands) > FAN:
            cut = np.arange(0, len(ands), fan)
            ands, ors, fan = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut), FAN
            self.levels.append((~(ands ^ ors), ands))
        # A node keeps the bits that its parent does not have already.
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for (m, _), (up, _) in zip(self.levels, self.levels[1:])]
        self.own.append(self.levels[-1][0])

    def near(self, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of places in Gray order with first <= i < last and at most `most` differences."""
        top = len(self.levels) - 1
        q = np.repeat(np.arange(first, last), len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), last - first)
        acc = np.zeros(len(q), np.uint8)
        width = LEAF * FAN**top
        for level in range(top, -1, -1):
            ahead = (node + 1) * width > q + 1  # what lies before the query has searched for it
            q, node, acc = q[ahead], node[ahead], acc[ahead]
            acc = acc + np.bitwise_count((self.fps[q] ^ self.levels[level][1][node]) & self.own[level][node])
            stay = acc <= most
            q, node, acc = q[stay], node[stay], acc[stay]
            fan, below = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(self.fps))
            node = (node[:, None] * fan + np.arange(fan)).reshape(-1)
            q, acc = np.repeat(q, fan), np.repeat(acc, fan)
            there = node < below
            q, node, acc = q[there], node[there], acc[there]
            width //= fan
        hit = (node > q) & (np.bitwise_count(self.fps[q] ^ self.fps[node]) <= most)
        return q[hit], node[hit]

    def classes(self, most: int) -> np.ndarray:
        """For each place in Gray order the first place of its class."""
        root = np.arange(len(self.fps))
        step = max(1, STEP // max(len(self.fps), 1))
        for first in range(0, len(self.fps), step):
            unite(root, *self.near(first, min(first + step, len(self.fps)), most))
        return root


def masks_within(mask: int, parts: int) -> list[int]:
    """`mask` with each of `parts` runs of its free bits added."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def groups(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(mask, value, fp): the groups that together hold every linked pair of the distinct fingerprints `fps`."""
    n = fps.count()
    bits = min(64 // (most + 1), max(0, (n // TARGET).bit_length()))
    quarter = 64 // (most + 1)
    first = [((1 << bits) - 1) << (64 - quarter * k - bits) for k in range(most + 1)] if bits else [0]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in first])).alias("mask"))
    done = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        big = written(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("mask", "value"), "big")
        n_big = big.count()
        keep = rows.join(big, ["mask", "value"], "left_anti") if n_big else rows
        keep = keep.select("mask", "value", "fp")
        done = keep if done is None else done.unionByName(keep)
        if not n_big:
            return done
        masks = {r.mask % (1 << 64) for r in big.select("mask").distinct().toLocalIterator()}  # (most + 1) ** level at most
        wider = {m: masks_within(m, most + 1) for m in masks}
        lookup = F.create_map(*[x for m, own in wider.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(w)) for w in own]))])
        rows = written(rows.join(big, ["mask", "value"], "left_semi").select("fp", F.explode(lookup[F.col("mask")]).alias("mask")), "wider")


def near_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs with at most `most` differing bits."""

    def run(tab: pa.Table) -> pa.Table:
        index = HierarchicalIndex(tab.column("fp").to_numpy().view(np.uint64))
        root = index.classes(most)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(index.fps[far].view(np.int64)), pa.array(index.fps[root[far]].view(np.int64))], names=["a", "b"])

    return groups(fps, most).groupBy("mask", "value").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(id, fp, component_id) of every document."""
    own = written(fingerprints(docs, id_col, text, width), "fps")
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(near_links(nodes.select("fp"), most)).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
