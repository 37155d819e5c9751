"""Byte-level BPE ids by the tiktoken library with a local rank file, and raw-byte decoding.

`encoded` gives the ids of every whole text, `decoded` turns ids back into bytes, and `digests` does both in one pass for
texts of any length, holding one part of a text at a time.

Long texts go to the library in parts. They are cut only at safe boundaries, where a match of the vocabulary's pattern ends
whatever stands around it: behind a letter that is followed by a sign, a digit or white space, behind a digit that is followed
by a letter, a sign or white space, and behind any ASCII sign that is followed by white space. No match runs on behind
such a place, and no look-ahead reaches over it. The characters that count are fixed, so different versions of Unicode in
Python and in the library cannot disagree about a cut. A run of white space that is too long for the library's look-ahead (it
overflows its stack) is merged as one piece: all of the run if the text ends there, else all but its last character.

Defined results: null is an empty text, an empty text has no ids; repeated rows stay repeated, null ids too, and other columns
are not looked at; an empty table gives an empty table. A text without a safe boundary is one part. Bytes that are no UTF-8
count as U+FFFD. Decoding gives null for null ids and for rows with an id that the vocabulary lacks.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import slices, table
from recset.llm.queries import query

NAME = "byte_bpe_multi_50k.tiktoken"
PART = 1 << 16  # code points after which a text is cut at the next safe boundary
LONG_SPACE = 4096  # code points from which a run of white space is merged by itself

# Characters with the White_Space property, and letters and signs that are such in every Unicode version.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SIGN = r"!-/:-@\[-`{-~、。「」，．！？：；"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-яぁ-んァ-ン一-龥가-힣"

BOUNDARY = re.compile(f"[{LETTER}](?=[{SIGN}0-9{SPACE}])|[0-9](?=[{SIGN}A-Za-z{SPACE}])|[!-~](?=[{SPACE}])")
SPACES = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that end at safe boundaries, each at least `size` long but for the last."""
    at = 0
    while len(text) - at > size:
        cut = BOUNDARY.search(text, at + size - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class Encoder:
    """The library's encoding for one rank file without special tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = frozenset(ranks.values())
        self.digits = [str(i) for i in range(max(ranks.values()) + 1)]

    def part_ids(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return self.library.encode_ordinary(text)
        ids, at = [], 0
        for run in SPACES.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.library.encode_ordinary(text[at : run.start()])
            ids += self.library._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self.library.encode_ordinary(text[at:] if at else text)

    def runs(self, text: str) -> Iterator[list[int]]:
        """Ids of the text, part by part."""
        if len(text) <= PART:
            yield self.part_ids(text)
        else:
            yield from map(self.part_ids, parts(text))

    def ids(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for i in run]

    def bytes(self, ids: list[int] | None) -> bytes | None:
        if ids is None or not self.known.issuperset(ids):
            return None
        return self.library.decode_bytes(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        n, names, raw, digits = 0, hashlib.sha256(), hashlib.sha256(), self.digits
        for run in self.runs(text):
            if run:
                names.update(("," * (n > 0) + ",".join([digits[i] for i in run])).encode())
                raw.update(self.library.decode_bytes(run))
                n += len(run)
        return n, names.hexdigest(), raw.hexdigest()


_KEPT: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker and rank file."""
    path = path or public_tokenizers.path(NAME)
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def strings(column: pa.Array) -> Iterator[str]:
    """Each text by itself; null counts as empty, bytes that are no UTF-8 as U+FFFD."""
    for value in column.cast(pa.large_string()).cast(pa.large_binary()):
        raw = value.as_buffer()
        yield "" if raw is None else str(raw, "utf-8", "replace")


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids array<int>) of every document."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches, "text"):
            ids = [enc.ids(s) for s in strings(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "n_tokens", "ids"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes) of rows with an array of ids: the raw bytes, which need not be UTF-8."""
    own = rows.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            found = [enc.bytes(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "bytes"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document: ids and decoded bytes are hashed part by part."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches, "text"):
            found = [enc.digest(s) for s in strings(part.column("text"))]
            n, names, raw = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(raw, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return digests(table(spark, sf, "documents"))
