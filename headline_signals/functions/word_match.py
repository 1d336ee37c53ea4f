"""Which words of some lists a text holds, for a batch of texts at a time.

The texts of a batch are looked at as UTF-8 bytes, one after the other. A table over the first
bytes of the words picks the places where one may begin, and only there the words are compared,
by length. So a text is read once, however many words and lists there are. Comparisons are exact.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# runs in Python workers: shipped with the task, so that workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes looked at in one step.
STEP = 1 << 20
_PLAIN = re.compile(r"[a-z0-9]+( [a-z0-9]+)*")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def plain(words: Sequence[str]) -> bool:
    """Whether all ``words`` are ASCII letters and digits in lower case, or several such with one space between."""
    return all(_PLAIN.fullmatch(w) for w in words)


class WordMatcher:
    """Counts the distinct words of each list in a text; ``whole``: only where neither a letter a-z nor
    a digit stands next to them."""

    def __init__(self, lists: Sequence[Sequence[str]], whole: bool = False):
        self.whole, self.empty = whole, ["" in words for words in lists]
        self.words = sorted({w.encode() for words in lists for w in words if w})
        number = {w: i for i, w in enumerate(self.words)}
        self.member = np.zeros((len(self.words), len(lists)), bool)
        for j, words in enumerate(lists):
            self.member[[number[w.encode()] for w in words if w], j] = True
        self.longest = max(map(len, self.words), default=0)
        # bytes that pick the places: as many as the shortest word has, 1, 2 or 4
        least = min(map(len, self.words), default=1)
        self.first = 4 if least >= 4 else min(least, 2)
        starts = np.array([int.from_bytes(w[:self.first], "little") for w in self.words], np.uint32)
        self.table = np.zeros(1 << (8, 8, 16, 0, 20)[self.first], bool)
        self.table[self._slot(starts)] = True
        #: By length: the words' first eight bytes in ascending order, and their numbers.
        self.by_length = {}
        for length in sorted({len(w) for w in self.words}):
            same = [w for w in self.words if len(w) == length]
            keys = np.array([int.from_bytes(w[:8], "little") for w in same], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.by_length[length] = keys[order], np.array([number[w] for w in same])[order]
        self.long = {w: number[w] for w in self.words if len(w) > 8}

    def _slot(self, starts: np.ndarray) -> np.ndarray:
        return starts * np.uint32(2_654_435_761) >> np.uint32(12) if self.first == 4 else starts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """``[text, list]``: distinct words of the list in the text; null holds none."""
        out = np.zeros((len(texts), len(self.empty)), np.int32)
        for row, word in self._pairs(texts):
            for j in range(len(self.empty)):
                out[:, j] += np.bincount(row[self.member[word, j]], minlength=len(texts)).astype(np.int32)
        held = ~texts.is_null().to_numpy(zero_copy_only=False)
        return (out + np.array(self.empty, np.int32)) * held[:, None]

    def _pairs(self, texts: pa.Array):
        """The distinct (text, word) pairs that match, in one or no piece."""
        texts = texts.cast(pa.large_string())
        _, ends, content = texts.buffers()
        if not len(texts) or content is None or not self.words:
            return
        offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(content, np.uint8)[:offsets[-1]]
        found = [np.unique(self._step(data, offsets, a, min(a + STEP, len(data))))
                 for a in range(int(offsets[0]), len(data), STEP)]
        if found:
            yield np.divmod(np.unique(np.concatenate(found)), len(self.words))

    def _step(self, data: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Numbers (text times words plus word) of the matches that begin in ``[start, stop)``."""
        n = stop - start
        buf = np.zeros(n + 8, np.uint8)
        near = data[start:stop + 8]
        buf[:len(near)] = near
        code = buf
        if self.first > 1:
            code = buf[:-1] | buf[1:].astype(np.uint16) << np.uint16(8)
        if self.first > 2:
            code = code[:-2] | code[2:].astype(np.uint32) << np.uint32(16)
        begins = self.table[self._slot(code[:n])]
        if self.whole:
            free = np.ones(n, bool)
            free[1:] = ~_ALNUM[buf[:n - 1]]
            free[0] = start == 0 or not _ALNUM[data[start - 1]]
            firsts = offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, stop)] - start
            free[firsts] = True
            begins &= free
        at = np.flatnonzero(begins)
        keys = np.lib.stride_tricks.sliding_window_view(buf, 8)[at].view("<u8").ravel()
        at += start
        text = np.searchsorted(offsets, at, "right") - 1
        end = offsets[text + 1]
        out = [np.empty(0, np.int64)]
        for length, (wanted, numbers) in self.by_length.items():
            part = keys & np.uint64((1 << 8 * min(length, 8)) - 1)
            place = np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)
            hit = np.flatnonzero((wanted[place] == part) & (at + length <= end))
            if self.whole and len(hit):
                after = at[hit] + length
                hit = hit[(after == end[hit]) | ~_ALNUM[data[np.minimum(after, len(data) - 1)]]]
            word = numbers[place[hit]]
            if length > 8:  # the first eight bytes agree
                word = np.array([self.long.get(data[p:p + length].tobytes(), -1) for p in at[hit]], np.int64)
                hit, word = hit[word >= 0], word[word >= 0]
            out.append(text[hit] * len(self.words) + word)
        return np.concatenate(out)


def counter(lists: Sequence[Sequence[str]], whole: bool = False):
    """``WordMatcher.counts`` as a function from a batch of texts to one array of counts each."""
    matcher = WordMatcher(lists, whole)

    def count(texts: pa.Array) -> pa.Array:
        found = matcher.counts(texts)
        ends = pa.array(np.arange(0, found.size + 1, len(lists), dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.int32()))

    # types themselves, as annotations are texts in this module
    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return count
