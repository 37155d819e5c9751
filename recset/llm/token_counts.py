"""Token counts by rank-synchronous merging.

The vocabulary's pieces never hold a space mark behind another character, so a text is cut at its spaces and the parts
are counted one by one; a part that was seen before is looked up. The others of a batch are held together as one ragged
array of symbols. In each round every part looks for its pair of lowest rank and merges it, all parts at the same time,
until no part has a pair that the vocabulary knows. The symbols that survive are the tokens; a character outside the
vocabulary survives as one token for each of its bytes.

Merging all places of a part's lowest pair at once equals merging them one after another if no pair with the new piece
ranks as low or lower. That is tested for every piece of the vocabulary; where it fails only the first place is merged.

Defined results: null and empty texts have no tokens. Texts of any length are counted whole. Repeated rows stay repeated;
an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from recset.llm.common import slices, table, texts
from recset.llm.queries import query

NAME = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"  # stands for a space in pieces
NONE = np.int32(2**30)  # rank of a pair that the vocabulary does not know
# Kinds of pieces in the model file (fixed values).
NORMAL, USER_DEFINED = 1, 4


class Merger:
    MOST = 400_000  # parts with known counts that a worker keeps, in two halves (this affects speed only)

    def __init__(self, path: str):
        model = model_pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not train.byte_fallback
                or train.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in model.pieces)):
            raise ValueError("this vocabulary needs a normaliser or own symbols, which the counter does not have")
        self.prefix = norm.add_dummy_prefix
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        names = list(scores)
        number = {p: i for i, p in enumerate(names)}
        rank = np.array([order[scores[p]] for p in names], np.int32)
        self.char = {p: i for p, i in number.items() if len(p) == 1}
        self.chars = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.chars[ord(c)] = i
        left, right, made = [], [], []
        for p in names:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    left.append(number[p[:k]])
                    right.append(number[p[k:]])
                    made.append(number[p])
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        self.n = len(names)
        self._table(left * self.n + right, made.astype(np.int32), rank[made] if len(made) else np.zeros(0, np.int32))
        worst = np.full(self.n, np.iinfo(np.int32).max)
        for side in (left, right):
            np.minimum.at(worst, side, rank[made])
        self.safe = worst > rank  # by piece: pairs with it all rank behind it
        self.marks_split = not any(MARK in p.lstrip(MARK) for p in names)
        self.lines_split = not any("\n" in p and len(p) > 1 for p in names)
        inside = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        self.bigrams = np.sort(np.array([self.char.get(b[0], 0) * self.n + self.char.get(b[1], 0) for b in inside], np.int64))
        self.kept: tuple[dict, dict] = {}, {}

    def _table(self, keys: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """Hash table of the pairs with linear probing, filled without a loop over pairs."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int64)
        self.slot_made, self.slot_rank = np.zeros(size, np.int32), np.full(size, NONE, np.int32)
        at, left = self._hash(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            who = left[np.flatnonzero(free)[first]]
            self.slots[place], self.slot_made[place], self.slot_rank[place] = keys[who], made[who], rank[who]
            waits = ~np.isin(left, who)
            left, at = left[waits], (at[waits] + 1) & (size - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece that each pair makes, and its rank (NONE if there is none)."""
        made, rank = np.zeros(len(a), np.int32), np.full(len(a), NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[left].astype(np.int64) * self.n + b[left]
        at = self._hash(keys)
        while len(left):
            slot = self.slots[at]
            hit = slot == keys
            made[left[hit]], rank[left[hit]] = self.slot_made[at[hit]], self.slot_rank[at[hit]]
            go = ~hit & (slot >= 0)
            left, keys, at = left[go], keys[go], (at[go] + 1) & (len(self.slots) - 1)
        return made, rank

    def merge(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence. seq: the sequence number of each symbol, 0.. in order."""
        n_seq = int(seq[-1]) + 1 if len(seq) else 0
        out = np.bincount(seq, minlength=n_seq)
        made, rank = self.pairs(sym[:-1], sym[1:])
        made, rank = np.append(made, 0).astype(np.int32), np.append(rank, NONE).astype(np.int32)
        rank[:-1][seq[:-1] != seq[1:]] = NONE
        while True:
            # Only sequences that still have a known pair go on.
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1])) if len(seq) else np.zeros(0, np.int64)
            if not len(start):
                return out
            low = np.minimum.reduceat(rank, start)
            n = np.diff(np.append(start, len(seq)))
            alive = low < NONE
            if not alive.all():
                keep = np.repeat(alive, n)
                sym, seq, made, rank = sym[keep], seq[keep], made[keep], rank[keep]
                low, n = low[alive], n[alive]
                if not len(seq):
                    return out
            at = np.flatnonzero(rank == np.repeat(low, n))
            # Of overlapping places the left ones count: every second of a run of neighbours.
            new_run = np.append(True, np.diff(at) > 1)
            run = np.cumsum(new_run) - 1
            at = at[(np.arange(len(at)) - np.flatnonzero(new_run)[run]) % 2 == 0]
            same = np.append(False, seq[at[1:]] == seq[at[:-1]])
            at = at[~same | self.safe[made[at]]] if not self.safe[made[at]].all() else at
            if not self.safe[made[at]].all():
                first = np.append(True, seq[at[1:]] != seq[at[:-1]])
                one = np.isin(seq[at], seq[at][~self.safe[made[at]]])
                at = at[first | ~one]
            sym[at] = made[at]
            out -= np.bincount(seq[at], minlength=n_seq)
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, made, rank = sym[keep], seq[keep], made[keep], rank[keep]
            at = place[at]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            touched = touched[touched < len(sym) - 1]
            m, r = self.pairs(sym[touched], sym[touched + 1])
            r[seq[touched] != seq[touched + 1]] = NONE
            made[touched], rank[touched] = m, r
            rank[-1] = NONE

    def count_parts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part, spaces in it already marked."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(parts)), n)
        sym = self.chars[points]
        total = np.zeros(len(parts), np.int64)
        other = sym < 0
        if other.any():
            p = points[other]
            np.add.at(total, owner[other], 1 + (p > 0x7F) + (p > 0x7FF).astype(np.int64) + (p > 0xFFFF))
        sym, owner, place = sym[~other], owner[~other], np.flatnonzero(~other)
        if not len(sym):
            return total
        # A sequence ends where no piece holds the two characters side by side.
        keys = sym[:-1].astype(np.int64) * self.n + sym[1:]
        hit = np.searchsorted(self.bigrams, keys)
        joined = np.zeros(len(keys), bool)
        ok = hit < len(self.bigrams)
        joined[ok] = self.bigrams[hit[ok]] == keys[ok]
        joined &= (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1)
        seq = np.append(0, np.cumsum(~joined))
        owner_of = owner[np.append(True, ~joined)]
        np.add.at(total, owner_of, self.merge(sym.copy(), seq))
        return total

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        # A line break is a part of its own kind: it never joins with what stands before it.
        column = pc.replace_substring(column, MARK, " ")
        if self.lines_split:
            column = pc.replace_substring(column, "\n", " \n")
        lists = pc.split_pattern(column, " ") if self.marks_split else None
        if lists is None:
            whole = [(MARK if self.prefix and t else "") + t.replace(" ", MARK) for t in column.to_pylist()]
            return self.count_parts(whole) if whole else np.zeros(0, np.int64)
        off = lists.offsets.to_numpy().astype(np.int64)
        d = lists.flatten().dictionary_encode()
        uniq, code = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self._known([u if u[:1] == "\n" and self.lines_split else MARK + u for u in uniq])
        n = known[code] if len(code) else np.zeros(0, np.int64)
        empty = np.array([u == "" for u in uniq], bool)[code] if len(code) else np.zeros(0, bool)
        first = off[:-1][off[:-1] < off[1:]]
        if not self.prefix:
            raise ValueError("a vocabulary without a space before the text is not expected here")
        if empty.any():
            # Spaces in a row, or at an end of the text: their marks belong to the part behind them.
            heads = np.zeros(len(code), bool)
            heads[first] = True
            run_first = empty & (heads | ~np.append(False, empty[:-1]))
            firsts = np.flatnonzero(run_first)
            stop = np.flatnonzero(~empty | heads)
            texts_, where = [], []
            ends = off[1:][np.searchsorted(off, firsts, "right") - 1]
            nxt = np.append(stop, len(code))[np.searchsorted(stop, firsts + 1)]
            for a, b, e in zip(firsts.tolist(), nxt.tolist(), ends.tolist()):
                b = min(b, e)
                tail = "" if b == e else uniq[code[b]]
                if tail[:1] == "\n" and self.lines_split:
                    tail, b = "", b  # the marks stand alone before a line break
                    texts_.append(MARK * (b - a))
                elif b == e:
                    texts_.append(MARK * (b - a))
                else:
                    texts_.append(MARK * (b - a + 1) + tail)
                    n[b] = 0
                n[a:b] = 0
                where.append(a)
            n = n.copy()
            n[where] = self._known(texts_)
        total = np.zeros(len(column), np.int64)
        some = off[:-1] < off[1:]
        total[some] = np.add.reduceat(n, off[:-1][some]) if some.any() else 0
        total[np.asarray(pc.equal(pc.binary_length(column), 0))] = 0
        return total

    def _known(self, parts: list[str]) -> np.ndarray:
        fresh, old = self.kept
        new = list({p for p in parts if p not in fresh and p not in old})
        found = dict(zip(new, self.count_parts(new).tolist())) if new else {}
        out = np.fromiter((fresh[p] if p in fresh else old[p] if p in old else found[p] for p in parts), np.int64, len(parts))
        fresh.update({p: c for p, c in found.items() if len(p) <= 64})
        if old:
            fresh.update({p: old[p] for p in parts if p in old})
        if len(fresh) >= self.MOST // 2:
            self.kept = {}, fresh
        return out


_KEPT: dict[str, Merger] = {}


def merger(path: str | None = None) -> Merger:
    path = path or public_tokenizers.path(NAME)
    if path not in _KEPT:
        _KEPT[path] = Merger(path)
    return _KEPT[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every document."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, off = texts(part.column("text"))
            n = merger(vocabulary).counts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
