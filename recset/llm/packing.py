"""Packing token runs into windows by best-fit decreasing.

Overlong documents are first cut into full windows. What is left goes, longest first, into the open window with the
tightest room, which a segment tree indexed by remaining capacity finds. Items of one length are alike, so the plan is
made for lengths and numbers of items: windows with equal contents so far are one entry with a count. The histogram of
lengths has at most `window` rows at any size of the corpus; it alone reaches the driver. Spark numbers the items within
each length, in buckets so that a frequent length is not one task, and the plan then tells each item's window and place.

Defined results: null text is an empty text (one piece, the end id). Every document gives at least one piece; repeated
rows give pieces of their own. An empty table gives an empty result. Other columns are carried by `pack`.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from recset.llm.common import lengths_to_offsets, slices, table, texts, written
from recset.llm.queries import query
from recset.llm.word_ids import word_ids

WINDOW = 2048
END = 1
BUCKETS = 1024  # parts in which the items of one length are numbered


class RoomTree:
    """Segment tree over remaining capacities 0..size: finds the smallest capacity >= x that an open window has."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.some = np.zeros(2 * self.n, bool)

    def set(self, room: int, some: bool) -> None:
        i = room + self.n
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int:
        """-1 if there is none."""
        i = least + self.n
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first item, items, first window, offset): the items of a length, numbered from 0, go in order to
    windows that are numbered in a row. At most three entries are made for each length, and every other step lowers the
    room of an entry, so the number of rows depends on the window and not on the number of items."""
    tree = RoomTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, next_window = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            open_.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            # A window that takes an item is then the tightest one, so it takes as many of this length as it holds.
            room = tree.tightest(length)
            if room < 0:
                room, first, n = window, next_window, -(-(total - done) // (window // length))
                next_window += n
            else:
                first, n = open_[room].pop()
            each = room // length
            full, rest = divmod(min(total - done, n * each), each)
            for n_in, k in ((each, full), (rest, 1 if rest else 0)):
                for i in range(n_in if k else 0):
                    rows.append((length, done + i * k, k, first, window - room + i * length))
                if k:
                    done += n_in * k
                    put(room - n_in * length, first, k)
                    first, n = first + k, n - k
            put(room, first, n)
            if room in open_ and not open_[room]:
                tree.set(room, False)
    return rows


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END,
           vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids into full windows and a rest: (id, start, length, ids_crc32, doc_tokens, ids).
    `ids` (32-bit little-endian) is null unless asked for."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, off = word_ids(vocabulary).encode(*texts(part.column("text")), end)
            n = np.diff(off)
            per = np.maximum(1, -(-n // window))
            doc = np.repeat(np.arange(len(n)), per)
            start = (np.arange(len(doc)) - np.repeat(lengths_to_offsets(per)[:-1], per)) * window
            length = np.minimum(window, n[doc] - start)
            at = off[:-1][doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            cut = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(n[doc], pa.int64()),
                 pa.array([bytes(c) for c in cut], pa.binary()) if with_ids else pa.nulls(len(doc), pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def pack(items: DataFrame, order: list[str], length: str = "length", window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to items of 1..window tokens. `order` tells equal lengths apart; items that are alike
    in it are interchangeable. `items` is read twice, so it should be a written table."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS))
    keyed = items.withColumn("__b", bucket)
    sizes = keyed.groupBy(length, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(length).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = sizes.select(length, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # `window` rows at most
    rows = np.array(best_fit_decreasing(counts, window), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    plan = items.sparkSession.sparkContext.broadcast(((rows[:, 0] << 44) + rows[:, 1], rows))
    inside = W.partitionBy(length, "__b").orderBy(*order)
    numbered = keyed.withColumn("__i", F.row_number().over(inside).cast("long")).join(starts, [length, "__b"])
    placed = numbered.withColumn("__i", F.col("__i") - 1 + F.col("__o")).drop("__b", "__o")
    out = placed.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = plan.value
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False)
            item = batch.column("__i").to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(keys, (size << 44) + item, "right") - 1] if len(size) else rows[:0]
            new = {"sequence_id": row[:, 3] + item - row[:, 1], "offset": row[:, 4]}
            arrays = [pa.array(new[n], pa.int64()) if n in new else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return out.mapInArrow(run, out.schema).drop("__i")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, from packed pieces that carry `ids`: (sequence_id, length, ids, padding). A sequence
    is padded to the window unless its length is a power of two."""
    runs = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = runs.select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    n = F.octet_length("ids") / 4
    whole = F.log2(n) == F.round(F.log2(n))
    return ids.select("sequence_id", n.cast("long").alias("length"), "ids", F.when(whole, 0).otherwise(WINDOW - n).cast("long").alias("padding"))


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    cut = written(pieces(docs, id_col, text).drop("ids"), "pieces")
    return pack(cut, [id_col, "start", "ids_crc32"])


@query("op8_packing")
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents"))
