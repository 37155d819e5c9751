"""Helpers of the operators: table access, bounded slices of Arrow batches, vectorised word splitting, ragged arrays."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recset.session import shared_dir

SLICE_BYTES = 4 << 20  # text handled at a time inside a task; one longer text is a slice of its own


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and several readers scan one table."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts have about `size` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = texts(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers live on and serve other tasks


def byte_table(is_word, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 256 bytes: whether it belongs to a word, and the byte itself (A-Z lower-cased if asked)."""
    word = np.array([bool(is_word(b)) for b in range(256)])
    return word, np.array([b + 32 if lower and 65 <= b <= 90 else b for b in range(256)], np.uint8)


SPACES = frozenset([0x20, *range(0x09, 0x0E)])


@dataclass
class Words:
    """Words of a run of texts: `data` bytes, word i is data[start[i]:end[i]], text t has words doc[t]:doc[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.Array:
        """All words as one binary array."""
        n = len(self.start)
        if not n:
            return pa.array([], pa.large_binary())
        off = np.empty(2 * n, np.int64)
        off[0::2], off[1::2] = self.start, self.end
        whole = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(off), pa.py_buffer(self.data)])
        return whole.take(pa.array(np.arange(0, 2 * n - 1, 2)))

    def encoded(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words, and the index of each word among them."""
        d = self.array().dictionary_encode()
        return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def split_words(data: np.ndarray, off: np.ndarray, kinds: tuple[np.ndarray, np.ndarray]) -> Words:
    """Maximal runs of word bytes by `kinds` (see byte_table) within each text."""
    inside, data = kinds[0][data], kinds[1][data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]  # first byte of each text that is not empty
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def lengths_to_offsets(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def ragged_index(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ...: positions that gather ragged rows."""
    to = np.cumsum(n)
    total = int(to[-1]) if len(to) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - (to - n), n)


def sums_between(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each i, exact for whole numbers; empty runs give 0."""
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[off[1:]] - acc[off[:-1]]


def float_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Like sums_between for floating point values, each run summed by itself (rows of a matrix along axis 0)."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), np.float64)
    some = off[:-1] < off[1:]
    if some.any():
        out[some] = np.add.reduceat(values, off[:-1][some], axis=0)
    return out
