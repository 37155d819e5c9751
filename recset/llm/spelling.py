"""Spelling variant grouping by a dictionary of trie-node pairs.

`word_counts` counts the words of whole texts. `neighbours` finds, for every word, how many words differ from it by exactly one
inserted, deleted or replaced code point, and the most frequent of them. `forms` picks each word's form and follows forms to
the root.

The nodes of a trie of the words and of a trie of the reversed words are numbered. A word that is cut at place i is the pair
(node of the letters before i, node of the letters from i on), a word without its letter i is the pair (node before i, node
behind i). Two words that share a pair without a letter differ by that letter; a pair without a letter that is a cut of another
word is an insertion. Nodes have exact numbers, so equal pairs are equal strings and nothing has to be checked again.

* Numbers. A node of up to 8 letters is its letters, 7 bits each. Deeper nodes lie in one task with all words that
  share the first 9 letters, sorted; a word's new nodes, those beyond what it has in common with the word before, get the
  next numbers of the task. The words are streamed: a task holds one batch and the path of one word.
* Pruning. A deep node of one word only can be in no pair that matches, so a word shows deep nodes only as far as it has them in
  common with the word before or after it. A long word of its own shows a few pairs, not one for each letter.
* No pairs are built. A pair without a letter has at most one word for each letter of the alphabet (90), a cut exactly one
  word, so a group of equal pairs is a short list; each member needs the group's size and its two most frequent words.
  A deletion within a run of equal letters gives the same word at each place and counts at the last one only.

Defined results: a null text has no words; a null id changes no word; repeated rows count again; texts of any length
are taken in slices and words of any length are allowed; an empty table gives an empty table. Ties between equally frequent
near words go to the smallest in code-point order. Other columns are not looked at.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import Words, byte_table, ragged_index, slices, table, texts, work_path, written
from recset.llm.queries import query

LEAST_LENGTH = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word
RATIO = 5  # a form has at least so many times the occurrences
CHANGED = 199  # a run changes where this divides its hash
SHALLOW = 8  # letters of a node that is its own number
HELD = 400_000  # distinct words that a task adds up before it hands them on
PAIRS = 200_000  # node pairs in a batch
WORDS = 20_000  # words that a task numbers the nodes of
# The alphabet is a to z and U+00C0 to U+00FF, in the order of its code points; letter 0 means none.
LETTERS = np.zeros(256, np.int64)
LETTERS[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(1, 91)
DEEP = 1 << 62  # above all numbers of shallow nodes; task and count below it


def word_runs(data: np.ndarray, off: np.ndarray) -> Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF), A-Z lower-cased, as words of the texts."""
    kinds, lower = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122, lower=True)
    inside = kinds[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF))
    inside[lead] = inside[lead + 1] = True
    data = lower[data]
    heads = off[:-1][off[:-1] < off[1:]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last[:-1] &= ~inside[1:]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def without_letter(word: bytes, h: int) -> bytes:
    s = word.decode("utf-8")
    at = h % len(s)
    return (s[:at] + s[at + 1 :]).encode("utf-8")


def occurrence_hashes(uniq: list[bytes], code: np.ndarray, owner: np.ndarray, ids: list[bytes | None]) -> np.ndarray:
    """crc32 of '<id>:<word>' for each occurrence (word code, row of its id), -1 for a null id.

    crc32 is affine: the hash of a joined string is that of the first part moved on over as many zeros as the second part
    has bytes, combined with that of the second part, so words and ids are each hashed once.
    """
    own = np.array([zlib.crc32(w) for w in uniq], np.int64)
    size = np.array([len(w) for w in uniq], np.int64)
    lens, kind = np.unique(size, return_inverse=True)
    zeros = [bytes(n) for n in lens.tolist()]
    plain = [zlib.crc32(z) for z in zeros]
    both, at = np.unique(owner * len(lens) + kind[code], return_inverse=True)
    heads = [None if i is None else zlib.crc32(i + b":") for i in ids]
    moved = np.array([-1 if heads[b // len(lens)] is None else zlib.crc32(zeros[b % len(lens)], heads[b // len(lens)]) ^ plain[b % len(lens)]
                      for b in both.tolist()], np.int64)[at]
    return np.where(moved < 0, -1, moved ^ own[code])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least `length` code points and `least` occurrences. A run whose hash with the id is
    divisible by CHANGED loses the code point at place hash % length first."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for part in slices(batches, "text"):
            words = word_runs(*texts(part.column("text")))
            if not len(words):
                continue
            found, code = words.encoded()
            uniq = found.to_pylist()
            owner = np.repeat(np.arange(part.num_rows), np.diff(words.doc))
            ids = [None if i is None else i.encode("utf-8") for i in part.column("id").to_pylist()]
            h = occurrence_hashes(uniq, code, owner, ids)
            other = (h >= 0) & (h % CHANGED == 0)
            n = np.bincount(code[~other], minlength=len(uniq))
            size = np.array([len(w) - w.count(b"\xc3") for w in uniq], np.int64)
            for k in np.flatnonzero((n > 0) & (size >= length)).tolist():
                held[uniq[k]] = held.get(uniq[k], 0) + int(n[k])
            for k, x in zip(code[other].tolist(), h[other].tolist()):
                if size[k] > length:
                    w = without_letter(uniq[k], x)
                    held[w] = held.get(w, 0) + 1
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    counted = own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def letters(column: pa.Array) -> list[np.ndarray]:
    """Each word as numbers of letters."""
    out = []
    for w in column.cast(pa.large_string()).to_pylist():
        raw = np.frombuffer(w.encode("utf-32-le"), "<u4")
        own = LETTERS[raw] if raw.max(initial=0) < 256 else np.zeros(1, np.int64)
        if not own.all():
            raise ValueError(f"a word outside the alphabet: {w[:50]!r}")
        out.append(own)
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def deep_nodes(rows: Iterator[tuple[tuple, np.ndarray]], task: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Adds to (row, letters), sorted by letters, the numbers of the word's nodes of SHALLOW + 1, SHALLOW + 2 ... letters, as
    far as the word before or after has them as well. A node's number never depends on how far others show it."""
    path = np.zeros(0, np.int64)  # numbers of the present word's deep nodes
    count = DEEP + (task << 36)
    before: tuple | None = None  # row, letters, letters in common with the word before it
    for row, own in rows:
        same = 0
        if before is not None:
            same = common_length(before[1], own)
            yield before[0], path[: max(0, max(same, before[2]) - SHALLOW)]
        kept = path[: max(0, same - SHALLOW)]
        new = max(0, len(own) - SHALLOW) - len(kept)
        path = np.concatenate([kept, np.arange(count, count + new)])
        count += new
        before = row, own, same
    if before is not None:
        yield before[0], path[: max(0, before[2] - SHALLOW)]


def shallow_nodes(own: np.ndarray) -> list[int]:
    """Numbers of the word's nodes of 0 to SHALLOW letters."""
    out = [0]
    for x in own[:SHALLOW].tolist():
        out.append(out[-1] * 128 + x)
    return out


def with_front(words: DataFrame, parts: int) -> DataFrame:
    """words(word, wid, n) with `front`: the deep nodes of the forward trie that each word shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(zip(*(batch.column(c).to_pylist() for c in ("word", "wid", "n"))), letters(batch.column("word")))

        yield from _batches(deep_nodes(rows(), TaskContext.get().partitionId()), "front")

    dealt = words.select("word", "wid", "n").repartition(parts, F.substring("word", 1, SHALLOW + 1)).sortWithinPartitions("word")
    return dealt.mapInArrow(run, "word string, wid long, n long, front array<long>")


def _batches(rows: Iterator[tuple[tuple, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        word, wid, n = zip(*(r for r, _ in held))
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(wid, pa.int64()), pa.array(n, pa.int64()), pa.array([x for _, x in held], pa.list_(pa.int64()))],
            ["word", "wid", "n", name])

    for row in rows:
        held.append(row)
        size += len(row[0][0]) + 8 * len(row[1])
        if len(held) >= 10_000 or size > 4 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def node_pairs(words: DataFrame, parts: int) -> DataFrame:
    """(p, s, kind, wid, n) of with_front(words): kind 0 is a cut, 1 a word without a letter, 2 the same at a place that counts
    for deletions too (the last one of a run of equal letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = zip(*(batch.column(c).to_pylist() for c in ("wid", "n")), batch.column("front"))
                for (wid, n, front), own in zip(cols, letters(batch.column("word"))):
                    yield (wid, n, np.asarray(front.values), own), own[::-1]

        held, size = [], 0
        for (wid, n, front, own), back in deep_nodes(rows(), TaskContext.get().partitionId()):
            last = len(own)
            p = np.concatenate([np.array(shallow_nodes(own), np.int64), front])  # node of the first i letters
            s = np.concatenate([np.array(shallow_nodes(own[::-1]), np.int64), back])  # node of the last j letters
            cut = np.arange(max(0, last - len(s) + 1), min(last, len(p) - 1) + 1)
            skip = np.arange(max(0, last - len(s)), min(last, len(p)))
            end = np.append(own[1:], 0) != own
            held.append((np.concatenate([p[cut], p[skip]]), np.concatenate([s[last - cut], s[last - skip - 1]]),
                         np.concatenate([np.zeros(len(cut), np.int8), 1 + end[skip].astype(np.int8)]), wid, n))
            size += len(cut) + len(skip)
            if size > PAIRS:
                yield _pair_batch(held)
                held, size = [], 0
        if held:
            yield _pair_batch(held)

    turned = F.reverse("word")
    dealt = words.repartition(parts, F.substring(turned, 1, SHALLOW + 1)).sortWithinPartitions(turned)
    return dealt.mapInArrow(run, "p long, s long, kind byte, wid long, n long")


def _pair_batch(held: list[tuple]) -> pa.RecordBatch:
    p, s, kind, wid, n = zip(*held)
    k = [len(x) for x in p]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(p)), pa.array(np.concatenate(s)), pa.array(np.concatenate(kind)), pa.array(np.repeat(wid, k)), pa.array(np.repeat(n, k))],
        ["p", "s", "kind", "wid", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """(wid, n_near, near_n, near) of words(word, wid, n) with near words: their number, and count and wid of the most frequent one
    (ties: the smallest wid). wid grows with the word."""
    member = F.struct((-F.col("n")).alias("m"), "wid", "kind")
    parts = max(1, -(-words.count() // WORDS))
    groups = node_pairs(with_front(words, parts), parts).groupBy("p", "s").agg(F.sort_array(F.collect_list(member)).alias("all")).filter(F.size("all") > 1)
    # Members are sorted by falling count. Words without a letter are near each other; the cut word is near those of kind 2.
    groups = groups.select(
        F.filter("all", lambda x: x.kind > 0).alias("skip"), F.filter("all", lambda x: x.kind == 2).alias("end"), F.filter("all", lambda x: x.kind == 0).alias("cut"))
    whole = F.element_at("cut", 1)
    other = lambda x: F.when(x.wid == F.get("skip", F.lit(0)).wid, F.get("skip", F.lit(1))).otherwise(F.get("skip", F.lit(0)))
    entry = lambda wid, k, best: F.struct(wid.alias("wid"), k.cast("long").alias("k"), F.struct(best.m.alias("m"), best.wid.alias("wid")).alias("best"))
    same = F.transform("skip", lambda x: entry(x.wid, F.size("skip") - 1, other(x)))
    longer = F.transform("cut", lambda x: entry(x.wid, F.size("end"), F.get("end", F.lit(0))))
    shorter = F.when(F.size("cut") > 0, F.transform("end", lambda x: entry(x.wid, F.lit(1), whole))).otherwise(F.array().cast("array<struct<wid:bigint,k:bigint,best:struct<m:bigint,wid:bigint>>>"))
    found = groups.select(F.explode(F.concat(same, longer, shorter)).alias("e")).select("e.*").filter("k > 0")
    found = found.groupBy("wid").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return found.select("wid", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.wid").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(wid, root) of links(wid, near): where following the links ends. Each round doubles how far a link reaches; a link
    leads to at least RATIO times the count, so chains are short."""
    far = written(links.select("wid", F.col("near").alias("root")), "far")
    while True:
        up = far.select(F.col("wid").alias("root"), F.col("root").alias("up"))
        step = written(far.join(up, "root", "left").select("wid", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "far")
        if not step.filter("moved").limit(1).count():
            return step.select("wid", "root")
        far = step.select("wid", "root")


def numbered(words: DataFrame) -> DataFrame:
    """words(word, n) with `wid`, which grows with the word in code-point order; written, so that it stays as it is."""
    return written(words.select("word", "n").orderBy("word").withColumn("wid", F.monotonically_increasing_id()), "words")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), whose words are distinct."""
    words = numbered(words)
    near = written(neighbours(words), "near")
    has = words.join(near, "wid", "left").withColumn("has", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
    has = written(has.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("near")).alias("near")), "forms")
    name = words.select(F.col("wid").alias("near"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = roots(has.filter("near IS NOT NULL").select("wid", "near"))
    ends = last.join(words.select(F.col("wid").alias("root"), F.col("word").alias("end")), "root").select("wid", "end")
    return has.join(name, "near", "left").join(ends, "wid", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`variants` of the words of all texts."""
    return variants(written(word_counts(docs, id_col, text), "counts"))


# The same from all strings without one letter; crc32 by its byte table.
ORACLE = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM raw GROUP BY ALL),
hashed AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR || ':' || r, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM run, crc),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
gap AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM place),
near AS (SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT gap.word, w.word FROM gap JOIN w ON gap.rest = w.word UNION SELECT w.word, gap.word FROM gap JOIN w ON gap.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS top, arg_min(o.word, (-o.n, o.word)) AS other FROM near JOIN w o ON near.other = o.word GROUP BY near.word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk(word, stop) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.stop = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.stop AS root FROM walk JOIN formed ON walk.stop = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN ends USING (word)
"""


@query("op13_spelling", ORACLE)
def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))
