"""Token ids of the word-level BPE vocabulary by the tokenizers library, with far fewer calls than one per text.

The vocabulary's pre-tokens never cross white space, so the ids of a text are the ids of its words one after another. Words of plain
letters, digits and punctuation are cut into the pre-tokens of the vocabulary's own pattern, all words of a slice of text at once and
lower-cased: runs of letters, single digits, runs of punctuation. Each worker keeps the ids of pre-tokens that it has seen; new
ones go through the library's BPE in one call, many to a line, and the word-end marks of the result separate them again. Every
other word (apostrophes, other letters and signs, special strings) is a unit of its own, which goes through the library's whole
pipeline.
"""
from __future__ import annotations

import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from recset.llm.common import SPACES, Words, byte_table, lengths_to_offsets, ragged_index, split_words

NAME = "word_bpe_49k.json"
KINDS = byte_table(lambda b: b not in SPACES, lower=False)
# Plain bytes by kind: letters (C3 begins a letter of U+00C0 to U+00FF), digits, and ASCII punctuation. The apostrophe is not plain,
# as the pattern has contractions, nor is <, with which special strings begin.
LETTER, DIGIT, SIGN = 1, 2, 3
PLAIN = np.zeros(256, np.int8)
PLAIN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
PLAIN[0x30:0x3A] = DIGIT
PLAIN[[b for b in range(0x21, 0x7F) if not PLAIN[b] and b not in b"'<"]] = SIGN
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LINE = 400  # pre-tokens in a line


def units(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """Pre-tokens of plain words, lower-cased, and other words as they are; and which units are such other words."""
    words = split_words(data, off, KINDS)
    kind = PLAIN[data]
    # C3 and the byte behind it: a letter, but for the signs U+00D7 and U+00F7; lower case is 32 above for U+00C0 to U+00DE.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    good = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
    kind[lead[good]] = kind[lead[good] + 1] = LETTER
    lower = LOWER[data]
    capital = lead[good & (tail < 0x9F)] + 1
    lower[capital] += 32
    odd = np.add.reduceat(kind == 0, words.start) if len(words) else np.zeros(0, np.int64)
    # White space behind a word has kind 0 as well.
    after = np.append(words.start[1:], len(data))[: len(words)]
    odd = odd - (after - words.end) > 0
    plain = np.zeros(len(data) + 1, np.int8)
    plain[words.start[~odd]] += 1
    plain[words.end[~odd]] -= 1  # may be the start of the next text's first word
    plain = np.cumsum(plain[:-1], dtype=np.int8).astype(bool)
    first = np.zeros(len(data), bool)
    first[1:] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    first[words.start] = True
    start = np.flatnonzero(first)
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data))[: len(start)], words.end[word]) if len(start) else start
    return Words(np.where(plain, lower, data), start, end, np.searchsorted(start, off)), odd[word]


class WordIds:
    MOST = 300_000  # kept units; when full, the older half goes (this affects speed only)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: tuple[dict, dict] = {}, {}

    @staticmethod
    def _turn(kept: tuple[dict, dict], most: int) -> tuple[dict, dict]:
        return kept if len(kept[0]) < most else ({}, kept[0])

    def _piece_ids(self, new: list[str]) -> list[bytes]:
        lines = [" ".join(new[i : i + LINE]) for i in range(0, len(new), LINE)]
        ids = np.concatenate([np.array(e.ids, "<i4") for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or cuts[-1] != len(ids):
            raise ValueError("the vocabulary has pre-tokens without a word end")
        raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _whole_ids(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.whole.encode_batch_fast(new, add_special_tokens=False)]

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and offsets; `end` is appended to each text if given."""
        found, odd = units(data, off)
        uniq, code = found.encoded()
        is_odd = np.zeros(len(uniq), bool)
        is_odd[code] = odd
        uniq = uniq.to_pylist()
        fresh, old = self.kept
        ids = [fresh.get(u) for u in uniq]
        new = [k for k, x in enumerate(ids) if x is None]
        if old:
            for k in new:
                x = old.get(uniq[k])
                if x is not None:
                    ids[k] = fresh[uniq[k]] = x
            new = [k for k in new if ids[k] is None]
        for find, some in ((self._piece_ids, [k for k in new if not is_odd[k]]), (self._whole_ids, [k for k in new if is_odd[k]])):
            if some:
                for k, x in zip(some, find([uniq[k].decode("utf-8", "replace") for k in some])):
                    ids[k] = fresh[uniq[k]] = x
        self.kept = self._turn(self.kept, self.MOST)
        doc = found.doc
        if end is not None:
            ids.append(np.array([end], "<i4").tobytes())
            code = np.insert(code, doc[1:], len(uniq))
            doc = doc + np.arange(len(doc))
        flat = np.frombuffer(b"".join(ids), "<i4")
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = lengths_to_offsets(n)
        out = flat[ragged_index(at[:-1][code], n[code])] if len(code) else flat[:0]
        return out, lengths_to_offsets(n[code])[doc]


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """One encoder per worker and vocabulary."""
    path = path or public_tokenizers.path(NAME)
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
