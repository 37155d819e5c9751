"""Benchmark decontamination by a distributed positional inverted index.

`build_index` cuts the training documents into shards of a few megabytes of text and stores, for each shard and term, the
sorted word positions (the postings), plus one row with the shard's documents. `search` counts how often each test term
occurs in all shards, orders the terms of every test window by that, and intersects offset-adjusted postings within each
shard, starting from the window's rarest term: a window starts at s if each of its terms has a posting at s + its place.
With a slop, a term may be up to that many words away from its place: a proximity match.

A test item's windows are its runs of `window` words; an item of fewer words is one window. Test items are broadcast in
parts of a checked size. Documents stay in their shards, so nothing depends on how often a term or passage occurs.

Defined results: null and empty texts have no words and no hits. An item without words has no window; an item with a null
id marks words but is not listed. Repeated documents and items stay repeated in the result, respectively count once. An
empty table gives an empty result, an empty benchmark gives no hits. Other columns are not read.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import byte_table, ragged_index, slices, split_words, table, texts, written
from recset.llm.queries import query

WINDOW = 10
GAP = 1 << 10  # unused positions between documents; more than any window and slop
PART_BYTES = 16 << 20  # test text that is broadcast at once
VOCABULARY_BYTES = 64 << 20  # beyond this the index keeps the postings of all terms
STEP = 4_000_000  # candidates that a task holds at a time
KINDS = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lower=True)


def words_of(column: pa.Array):
    return split_words(*texts(column), KINDS)


def vocabulary(items: DataFrame, text: str = "text") -> pa.Array | None:
    """Distinct terms of the test items; None if they exceed VOCABULARY_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            terms, _ = words_of(part.column("text")).encoded()
            yield pa.RecordBatch.from_arrays([terms.cast(pa.binary())], ["term"])

    terms = items.select(F.col(text).alias("text")).mapInArrow(run, "term binary").distinct()
    terms = written(terms, "terms")
    if (terms.agg(F.sum(F.octet_length("term") + 20)).first()[0] or 0) > VOCABULARY_BYTES:
        return None
    return pa.array([r[0] for r in terms.toLocalIterator()], pa.large_binary())


def build_index(docs: DataFrame, terms: pa.Array | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (shard, term, n, data), written to the shared folder. Only terms that can ever be asked for are kept if
    `terms` is given. A null term marks the row with a shard's documents: their ids and numbers of words."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            n_words = np.diff(words.doc)
            place = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(1, len(n_words) + 1) * GAP, n_words)
            if shared.value is None:
                kept, code = words.encoded()
            else:
                kept = shared.value
                code = pc.index_in(words.array(), value_set=kept).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                place, code = place[code >= 0], code[code >= 0]
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            runs = [_pack(p) for p in np.split(place, cut[1:])] if len(cut) else []
            names = kept.take(pa.array(code[cut])).cast(pa.binary())
            sizes = np.diff(np.append(cut, len(code)))
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64())], ["id", "n_words"])
            with pa.ipc.new_stream(sink, head.schema) as s:
                s.write_batch(head)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{k}"] * (len(cut) + 1)), pa.concat_arrays([names, pa.nulls(1, pa.binary())]),
                 pa.array(np.append(sizes, len(n_words)), pa.int64()), pa.array([*runs, sink.getvalue().to_pybytes()], pa.binary())],
                ["shard", "term", "n", "data"])
            k += 1

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, "shard string, term binary, n long, data binary"), "postings")


def _pack(places: np.ndarray) -> bytes:
    """First place, then the steps in the smallest number type that holds them all."""
    steps = np.diff(places)
    top = int(steps.max()) if len(steps) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(k[2])))
    return kind[2].encode() + places[:1].astype("<i8").tobytes() + steps.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, f"<u{data[:1].decode()}", offset=9)
    out = np.empty(len(steps) + 1, np.int64)
    out[0] = int.from_bytes(data[1:9], "little")
    np.cumsum(steps, out=out[1:])
    out[1:] += out[0]
    return out


class Windows:
    """Distinct windows of some test items, by length: term numbers, places of the terms from rare to frequent, items."""

    def __init__(self, rows: list[tuple], window: int):
        words = words_of(pa.array([t for _, t in rows], pa.string()))
        self.terms, code = words.encoded()
        owners: dict[tuple, set] = defaultdict(set)
        for (item, _), a, b in zip(rows, words.doc[:-1].tolist(), words.doc[1:].tolist()):
            own = code[a:b].tolist()
            k = min(window, len(own))
            for i in range(len(own) - k + 1 if own else 0):
                owners[tuple(own[i : i + k])].add(None if item is None else str(item))
        self.by_length = {}
        for k in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == k]
            self.by_length[k] = (np.array(own, np.int64).reshape(-1, k), [sorted(x for x in owners[w] if x is not None) for w in own])
        self.order: dict[int, np.ndarray] = {}

    def rank(self, counts: dict[bytes, int]) -> None:
        n = np.array([counts.get(t, 0) for t in self.terms.to_pylist()], np.int64)
        self.order = {k: np.argsort(n[w], axis=1, kind="stable") for k, (w, _) in self.by_length.items()}


def find(windows: Windows, postings: dict[bytes, np.ndarray], slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Matches (length, window numbers, start places) in one shard."""
    lists = [postings.get(t) for t in windows.terms.to_pylist()]
    n = np.array([0 if p is None else len(p) for p in lists], np.int64)
    if not n.any():
        return
    at = np.cumsum(n) - n
    places = np.concatenate([p for p in lists if p is not None])
    keys = (np.repeat(np.arange(len(n)), n) << 40) + places  # all lists one after another, so one search serves them all
    for k, (terms, _) in windows.by_length.items():
        alive = np.flatnonzero(n[terms].min(axis=1) > 0)
        order = windows.order[k]
        rare = order[alive, 0]
        size = n[terms[alive, rare]]
        part = (np.cumsum(size) - size) // STEP
        for own in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(part)) + 1) if len(alive) else []:
            w, first = alive[own], terms[alive[own], rare[own]]
            cand = np.repeat(w, size[own])
            start = places[ragged_index(at[first], size[own])] - np.repeat(rare[own], size[own])
            for j in range(1, k):
                place = order[cand, j]
                low = (terms[cand, place] << 40) + start + place
                hit = np.searchsorted(keys, low - slop)
                ok = hit < len(keys)
                ok[ok] = keys[hit[ok]] <= low[ok] + slop
                cand, start = cand[ok], start[ok]
            if len(cand):
                yield k, cand, start


def search(index: DataFrame, items: DataFrame, id_type: str, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: (shard, doc, id, n_words, starts, ends, items): the hit runs of words and the items that hit."""
    spark = index.sparkSession
    counts = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    size = items.agg(F.sum(F.octet_length(text) + 50)).first()[0] or 0
    n_parts = size // PART_BYTES + 1
    out_schema = f"shard string, doc int, id {id_type}, n_words long, starts array<long>, ends array<long>, items array<string>"
    found = None
    for k in range(n_parts):
        part = items.filter(F.pmod(F.xxhash64(item_col, text), F.lit(n_parts)) == k)
        windows = Windows([tuple(r) for r in part.select(item_col, text).toLocalIterator()], window)
        own = spark.createDataFrame([(bytearray(t),) for t in windows.terms.to_pylist()], "term binary")
        windows.rank({bytes(r.term): r.n for r in counts.join(F.broadcast(own), "term").toLocalIterator()})
        shared = spark.sparkContext.broadcast(windows)
        rows = index.groupBy("shard").applyInArrow(_searcher(shared, slop), out_schema)
        found = rows if found is None else found.unionByName(rows)
    return found if n_parts == 1 else found.groupBy("shard").applyInPandas(_merge, out_schema)


def _searcher(shared, slop: int):
    def run(tab: pa.Table) -> pa.Table:
        windows, postings, docs = shared.value, {}, None
        shard = tab.column("shard")[0].as_py()
        wanted = set(windows.terms.to_pylist())
        for term, data in zip(tab.column("term").to_pylist(), tab.column("data").to_pylist()):
            if term is None:
                with pa.ipc.open_stream(data) as s:
                    docs = s.read_all()
            elif term in wanted:
                postings[term] = _unpack(data)
        n_words = docs.column("n_words").to_numpy()
        base = np.cumsum(n_words) - n_words + np.arange(1, len(n_words) + 1) * GAP
        starts, ends, items = ([[] for _ in n_words] for _ in range(3))
        runs, owners = [], defaultdict(set)
        for k, cand, start in find(windows, postings, slop):
            doc = np.searchsorted(base, start + windows.order[k][cand, 0], "right") - 1  # by the rarest term's place
            runs.append((doc, np.maximum(start, base[doc]), np.minimum(start + k, base[doc] + n_words[doc])))
            both = np.unique((doc << 32) + cand)
            for d, w in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist()):
                owners[d].update(windows.by_length[k][1][w])
        if runs:
            doc, lo, hi = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(lo, kind="stable")
            doc, lo, hi = doc[order], lo[order], np.maximum.accumulate(hi[order])
            new = np.append(True, lo[1:] > hi[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)
            for d, a, b in zip(doc[new].tolist(), lo[new].tolist(), hi[last].tolist()):
                starts[d].append(a - int(base[d]))
                ends[d].append(b - int(base[d]))
        for d, own in owners.items():
            items[d] = sorted(own)
        n = len(n_words)
        return pa.table([pa.array([shard] * n), pa.array(np.arange(n), pa.int32()), docs.column("id"), pa.array(n_words, pa.int64()),
                         pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                        names=["shard", "doc", "id", "n_words", "starts", "ends", "items"])

    return run


def _merge(rows):
    """Results of the parts of a benchmark, for the documents of one shard."""

    def one(g):
        out = g.iloc[0].copy()
        runs = sorted((a, b) for s, e in zip(g.starts, g.ends) for a, b in zip(s, e))
        starts, ends = [], []
        for a, b in runs:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        out["starts"], out["ends"] = starts, ends
        out["items"] = sorted({x for own in g["items"] for x in own})
        return out

    return rows.groupby("doc", group_keys=False).apply(one, include_groups=True) if len(rows) else rows


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index the documents and search the items: (shard, doc, id, n_words, starts, ends, items)."""
    index = build_index(docs, vocabulary(items, item_text), id_col, text)
    return search(index, items, dict(docs.dtypes)[id_col], window, slop, item_col, item_text)


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM ip),
dp AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp),
m AS (SELECT DISTINCT r, k, i, item_id FROM grams JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


@query("op1_decontamination", ORACLE)
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
