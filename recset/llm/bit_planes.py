"""Token ids in files of shuffled planes.

A file holds the ids of a run of documents in order, in blocks of a fixed number of ids. Each block is transposed into
byte planes (or bit planes), each plane is compressed by itself with zstandard, and an index at the end tells where each
block is and how long its planes are. A block is decoded by itself, so a reader can start at any id.

Layout, all numbers little-endian: magic | planes of the blocks | index | index length (8 bytes) | magic.
The index is zstandard-compressed JSON-free binary: see `Writer.close` and `Reader`.

Defined results: null text is an empty text, so its document holds the end id only. Rows are ordered by (id, text), null
ids first; repeated rows stay. An empty table gives no file and an empty result. Other columns are not read.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from recset.llm.common import slices, table, texts, work_path
from recset.llm.queries import query
from recset.llm.word_ids import word_ids

MAGIC = b"PLANES01"
BLOCK = 1 << 16
END = 1


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block, lowest first; planes above the highest used one are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if bits:
        rows = np.unpackbits(raw, axis=1, bitorder="little")[:, : max(1, top.bit_length())]
        return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(rows.shape[1])]
    return [raw[:, k].tobytes() for k in range(max(1, (top.bit_length() + 7) // 8))]


def join_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if bits:
        rows = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            rows[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(rows, axis=1, bitorder="little")
    else:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.out, self.bits, self.block = out, bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = 0
        self.blocks: list[tuple[int, int, list[int]]] = []  # place, ids, bytes of each plane
        self.docs: list[np.ndarray] = []
        self.at = out.write(MAGIC)

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Ids of some documents, and how many each of them has."""
        self.docs.append(np.asarray(n, "<i8"))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block:
            ids = np.concatenate(self.rest)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._block(ids[i : i + self.block])
            self.rest, self.n_rest = [ids[full:].copy()], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in split_planes(ids, self.bits)]
        self.blocks.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.at += self.out.write(p)
        self.n_ids += len(ids)

    def close(self) -> None:
        """Index: block size, bits flag, numbers of blocks and documents; of each block its place, ids, planes and their
        sizes (32 at most, then zeros); the ids of each document."""
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        blocks = np.zeros((len(self.blocks), 35), "<i8")
        for row, (at, n, sizes) in zip(blocks, self.blocks):
            row[:3] = at, n, len(sizes)
            row[3 : 3 + len(sizes)] = sizes
        head = np.array([self.block, self.bits, len(blocks), len(docs)], "<i8")
        index = self.zip.compress(head.tobytes() + blocks.tobytes() + docs.tobytes())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 16)
        n, magic = int.from_bytes(file.read(8), "little"), file.read(8)
        if magic != MAGIC:
            raise ValueError("not a file of planes")
        file.seek(size - 16 - n)
        index = np.frombuffer(self.unzip.decompress(file.read(n)), "<i8")
        self.block, self.bits, n_blocks, n_docs = index[:4].tolist()
        self.blocks = index[4 : 4 + 35 * n_blocks].reshape(-1, 35)
        self.docs = index[4 + 35 * n_blocks :]
        assert len(self.docs) == n_docs

    def read_block(self, k: int) -> np.ndarray:
        at, n, planes, *sizes = self.blocks[k].tolist()
        self.file.seek(at)
        return join_planes([self.unzip.decompress(self.file.read(s)) for s in sizes[:planes]], n, bool(self.bits))

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1; only the blocks that hold them are read."""
        first, last = start // self.block, (start + n - 1) // self.block
        ids = np.concatenate([self.read_block(k) for k in range(first, last + 1)]) if n else np.zeros(0, "<u4")
        return ids[start - first * self.block :][:n]


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", bits: bool = False,
          vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Encode and write all documents in ascending id order below `path`; returns the list of files in order:
    (shard, file, n_docs, n_ids, start), where start counts the ids in the files before.

    The list is written too. A file gets a name of its own from each attempt and counts only once it is in the list,
    so a lost or repeated task leaves nothing that is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = rows.select("id", "text", F.spark_partition_id().alias("shard"))
    files = files.mapInArrow(_write_shard(path, bits, vocabulary, end), "shard int, file string, n_docs long, n_ids long, ids binary")
    place, name = _open(f"{path}/shards")
    place.create_dir(name, recursive=True)
    files.write.parquet(f"{path}/list")
    listed = spark.read.parquet(f"{path}/list")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one small row per file
    starts = listed.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return listed.join(starts, "shard")


def _write_shard(path, bits, vocabulary, end):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, doc_ids, shard = None, [], -1
        for part in slices(batches, "text"):
            if writer is None:
                shard = part.column("shard")[0].as_py()
                name = f"shards/{shard:06d}-{uuid.uuid4().hex}.planes"
                place, full = _open(f"{path}/{name}")
                out = place.open_output_stream(full)
                writer = Writer(out, bits)
            ids, off = word_ids(vocabulary).encode(*texts(part.column("text")), end)
            writer.add(ids.astype("<u4"), np.diff(off))
            doc_ids.append(part.column("id"))
        if writer is None:
            return
        writer.close()
        out.close()
        names = pa.chunked_array(doc_ids).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", names.type)])) as s:
            s.write_batch(pa.RecordBatch.from_arrays([names], ["id"]))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": pa.array([len(names)], pa.int64()),
            "n_ids": pa.array([writer.n_ids], pa.int64()), "ids": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return run


def read(path: str, files: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; blocks are decoded one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, full = _open(f"{path}/{row['file']}")
                with place.open_input_file(full) as file:
                    reader = Reader(file)
                    n, crc = reader.docs, np.zeros(len(reader.docs), np.int64)
                    off = np.concatenate([[0], np.cumsum(n)])
                    at = 0
                    for k in range(len(reader.blocks)):
                        ids = reader.read_block(k)
                        first = int(np.searchsorted(off, at, "right")) - 1
                        last = int(np.searchsorted(off, at + len(ids), "left"))
                        raw = ids.tobytes()
                        for d in range(first, last):
                            lo, hi = max(int(off[d]), at) - at, min(int(off[d + 1]), at + len(ids)) - at
                            crc[d] = zlib.crc32(raw[4 * lo : 4 * hi], int(crc[d]))
                        at += len(ids)
                with pa.ipc.open_stream(row["ids"]) as s:
                    names = s.read_all().column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(off[:-1] + row["start"], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("file", "ids", "start").repartition(F.col("file"))
    out = spread.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


@query("op6_bit_planes")
def op6_bit_planes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = work_path(spark, "planes")
    return read(path, write(docs, path), dict(docs.dtypes)["doc_id"])
