"""Language identification by multilingual mixture inference.

Learning counts hashed byte trigrams of words by language over all training documents. A word's likelihood under a
language is the product over its trigrams. A document is a mixture: expectation-maximisation estimates the share of its
words that each language wrote. The set of languages is chosen by penalised likelihood: starting from all of them, the
language with the smallest share goes for as long as the log-likelihood less half a log(words) per language does not
fall. The predicted language is the one with the largest share, which is the score.

Defined results: a null text, and one without a letter, gets `und` and score 0; so does every text if nothing could be
learned. Equal shares: the name that sorts first. Training rows with null text or null language teach nothing. Repeated
rows stay repeated; an empty table gives an empty result. Other columns are not read, and neither id nor language is an
input of a prediction.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from recset.llm.common import (
    Words, byte_table, float_sums, lengths_to_offsets, ragged_index, remainder, slices, split_words, table, texts)
from recset.llm.queries import query

UNDETERMINED = "und"
CELLS = 1 << 22  # numbers in a model, so that its size has a bound at any number of languages
BITS = (8, 16)  # of a hashed trigram: the most that CELLS allows, within these
SMOOTHING = 0.5
ROUNDS = 8  # of expectation-maximisation
KINDS = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lower=True)


def trigrams(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each word with a space on both sides, and offsets by word."""
    _, off, data = words.cast(pa.large_binary()).buffers()
    off = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    n = np.diff(off)
    line = np.full(len(data[off[0] : off[-1]]) + 2 * len(n) + 2, 0x20, np.uint32)
    at = lengths_to_offsets(n + 2)
    line[ragged_index(at[:-1] + 1, n)] = data[off[0] : off[-1]]
    x = line[:-2] << np.uint32(16) | line[1:-1] << np.uint32(8) | line[2:]
    x = x[ragged_index(at[:-1], n)]
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64), lengths_to_offsets(n)


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray  # (trigram, language): log-probability
    bits: int

    def words(self, words: pa.Array) -> np.ndarray:
        """Likelihood of each word under each language, the best one scaled to 1."""
        gram, off = trigrams(words, self.bits)
        ll = float_sums(self.logs[gram], off)
        return np.exp(ll - ll.max(axis=1, keepdims=True)) if len(ll) else ll


def bits_for(n_languages: int) -> int:
    return int(np.clip(int(CELLS // max(1, n_languages)).bit_length() - 1, *BITS))


def learn(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts by language over all rows of `training`."""
    rows = training.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    bits = bits_for(rows.select("lang").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            words = split_words(*texts(part.column("text")), KINDS)
            uniq, code = words.encoded()
            gram, off = trigrams(uniq, bits)
            d = part.column("lang").dictionary_encode()
            of = np.repeat(d.indices.to_numpy(zero_copy_only=False), np.diff(words.doc))
            for k, name in enumerate(d.dictionary.to_pylist()):
                n = np.bincount(code[of == k], minlength=len(uniq))
                own = np.bincount(gram, np.repeat(n, np.diff(off)), minlength=1 << bits).astype(np.int64)
                total[name] = total[name] + own if name in total else own
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # CELLS rows at most
    names = sorted(set(found.column("lang").to_pylist()))
    n = np.zeros((1 << bits, len(names)))
    place = {x: k for k, x in enumerate(names)}
    n[found.column("gram").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    logs = np.log(n + SMOOTHING) - np.log(n.sum(axis=0) + SMOOTHING * len(n))
    return Model(names, logs.astype(np.float32), bits)


def _em(like: np.ndarray, off: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds from `share` (a zero stays zero), and the log-likelihoods. like: (word, language)."""
    n = np.diff(off)
    tiny = np.finfo(np.float32).tiny
    for _ in range(ROUNDS):
        part = like * np.repeat(share, n, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), tiny)
        share = np.where(share > 0, float_sums(part, off) / n[:, None], 0).astype(np.float32)
    total = (like * np.repeat(share, n, axis=0)).sum(axis=1)
    return share, float_sums(np.log(np.maximum(total, tiny)), off)


def mixtures(like: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of each language in each text; texts without words get zeros. Languages outside the chosen set have 0."""
    n_lang = like.shape[1]
    out = np.zeros((len(off) - 1, n_lang), np.float32)
    todo = np.flatnonzero(np.diff(off) > 0)
    if not len(todo) or not n_lang:
        return out
    n = np.diff(off)[todo]
    like = like[ragged_index(off[:-1][todo], n)].astype(np.float32)
    own = lengths_to_offsets(n)
    share, ll = _em(like, own, np.full((len(todo), n_lang), 1 / n_lang, np.float32))
    penalty = 0.5 * np.log(n)
    while True:
        out[todo] = share
        many = (share > 0).sum(axis=1) > 1
        if not many.any():
            return out
        # Try each document that is left without its smallest share, and without shares below half a word.
        rows = np.flatnonzero(many)
        todo, n, penalty = todo[rows], n[rows], penalty[rows]
        like = like[ragged_index(own[:-1][rows], n)]
        own, share, ll = lengths_to_offsets(n), share[rows], ll[rows]
        held = np.where(share > 0, share, np.inf)
        drop = (held * n[:, None] < 0.5) & (share < share.max(axis=1, keepdims=True))
        drop[np.arange(len(rows)), n_lang - 1 - held[:, ::-1].argmin(axis=1)] = True
        less = np.where(drop, 0, share)
        less /= less.sum(axis=1, keepdims=True)
        share2, ll2 = _em(like, own, less.astype(np.float32))
        better = ll2 - penalty * (share2 > 0).sum(axis=1) >= ll - penalty * (share > 0).sum(axis=1)
        if not better.any():
            return out
        rows = np.flatnonzero(better)
        todo, n, penalty = todo[rows], n[rows], penalty[rows]
        like = like[ragged_index(own[:-1][rows], n)]
        own, share, ll = lengths_to_offsets(n), share2[rows], ll2[rows]


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", shares: str | None = None) -> DataFrame:
    """`docs` with the predicted language and its share, and a map of all shares if a name is given for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [F.lit(None).cast("map<string,double>").alias(shares)] if shares else []
    frame = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for part in slices(batches, text, max(1 << 18, (8 << 20) // max(4, len(m.names)))):
            column = part.column(text)
            words: Words = split_words(*texts(column), KINDS)
            uniq, code = words.encoded()
            if len(m.names):
                share = mixtures(m.words(uniq)[code], words.doc)
            else:
                share = np.zeros((len(column), 1), np.float32)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)) & (share.max(axis=1) > 0)
            best = share.argmax(axis=1)
            new = {
                lang: pa.array([m.names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())], pa.string()),
                score: pa.array(np.where(letters, np.minimum(share.max(axis=1).astype(np.float64), 1.0), 0.0)),
            }
            if shares:
                each = [[(m.names[k], float(row[k])) for k in np.flatnonzero(row)] if ok else [] for row, ok in zip(share, letters)]
                new[shares] = pa.array(each, pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], part.schema.names)

    return frame.mapInArrow(run, frame.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Documents that may teach: the crc32 of the id as text is not divisible by `folds`."""
    return docs.filter(remainder(id_col, folds) != 0)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = learn(training_rows(docs).select("text", "lang"))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text", held), model).drop("text")
