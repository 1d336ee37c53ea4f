"""Induced suffix sorting of one shard, with queues that go to disk.

Suffixes are classified (S: smaller than the next suffix, L: larger). The leftmost S
suffixes are sorted through their substrings, which become names of a shorter string that
is sorted in its turn; all other suffixes follow by induction: taking suffixes from a
queue in order, each hands its predecessor to the queue of that one's first symbol. First
symbols only grow (L) or only fall (S) during a pass, so one FIFO per symbol is a priority
queue. Queues keep positions in memory up to a budget and in an unnamed file of the task
beyond it; the text itself may be a mapped file.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Symbols: text bytes are shifted by 2; 1 ends a piece, 0 the text.
SYMBOLS = 258
PIECE_END, TEXT_END = 1, 0
#: Positions that one set of queues keeps in memory, in bytes.
QUEUE_BYTES = 48 << 20


class SymbolQueues:
    """One FIFO of positions per symbol; beyond ``budget`` bytes they are written to a file that
    has no name and vanishes with the task."""

    def __init__(self, budget: int = QUEUE_BYTES):
        self.budget, self.held, self.file = budget, 0, None
        self.parts: list[list] = [[] for _ in range(SYMBOLS)]

    def put(self, symbol: int, positions: np.ndarray) -> None:
        if len(positions):
            self.parts[symbol].append(positions)
            self.held += positions.nbytes
            if self.held > self.budget:
                self._spill()

    def deal(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Puts every position into its symbol's queue, in order."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(symbols)]):
            self.put(int(symbols[a]), positions[a:b])

    def take(self, symbol: int) -> np.ndarray:
        """All positions of a symbol in order; its queue is empty afterwards."""
        parts, self.parts[symbol] = self.parts[symbol], []
        out = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                out.append(np.frombuffer(self.file.read(8 * part[1]), np.int64))
            else:
                self.held -= part.nbytes
                out.append(part)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if not isinstance(part, tuple):
                    parts[i] = (self.file.tell(), len(part))
                    self.file.write(np.ascontiguousarray(part).tobytes())
        self.held = 0


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last one (the end) is."""
    # a run of equal symbols has the type of its last symbol; the end differs from all others
    changes = np.flatnonzero(text[:-1] != text[1:])
    at = np.repeat(changes, np.diff(np.r_[-1, changes]))
    return np.r_[text[at] < text[at + 1], True]


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> SymbolQueues:
    """All suffixes by first symbol, each list in order, from the leftmost S suffixes in order."""
    by_symbol = SymbolQueues()
    by_symbol.deal(text[seeds], seeds)
    large = SymbolQueues()
    queue = SymbolQueues()
    for c in range(SYMBOLS):
        now = queue.take(c)
        while len(now):
            large.put(c, now)
            now = _hand_on(text, small, now, False, c, queue)
        _hand_on(text, small, by_symbol.take(c), False, c, queue)
    done, queue = SymbolQueues(), SymbolQueues()
    for c in range(SYMBOLS - 1, -1, -1):
        falling = []
        now = queue.take(c)
        while len(now):
            falling.append(now)
            now = _hand_on(text, small, now, True, c, queue)
        own = large.take(c)
        _hand_on(text, small, own[::-1], True, c, queue)
        done.put(c, own)
        if falling:
            done.put(c, np.concatenate(falling)[::-1])
    done.put(TEXT_END, np.array([len(text) - 1], np.int64))
    return done


def _hand_on(text: np.ndarray, small: np.ndarray, now: np.ndarray, type_: bool, c: int,
             queue: SymbolQueues) -> np.ndarray:
    """Predecessors of ``now`` of one type: those with symbol ``c`` are returned, others dealt."""
    before = now[now > 0] - 1
    before = before[small[before] == type_]
    symbols = text[before]
    same = symbols == c
    queue.deal(symbols[~same], before[~same])
    return before[same]


def _names(text: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost S substrings: equal if the substrings are, ascending as they are.
    ``first`` has their positions ascending, ``order`` sorted by substring."""
    ends = np.r_[first[1:] + 1, len(text)]
    number = np.empty(len(text), np.int32)
    number[first] = np.arange(len(first))
    length = (ends - first)[number[order]]
    starts, same = order, np.zeros(len(order), bool)
    same[1:] = length[1:] == length[:-1]
    # compare neighbours of equal length symbol by symbol, only those still equal
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        differ = text[starts[left] + step] != text[starts[left - 1] + step]
        same[left[differ]] = False
        left = left[~differ]
        step += 1
        left = left[length[left] > step]
    names = np.cumsum(~same) - 1
    out = np.empty(len(first), np.int64)
    out[number[order]] = names
    return out



def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, by pairs of ranks of doubled length, until
    all differ or the first ``depth`` names decide. Only suffixes that still tie are sorted
    again; a rank is the place of the first of those that tie."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    start = np.r_[True, names[order[1:]] != names[order[:-1]]]
    rank, span = np.empty(n, np.int64), 1
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    while span < min(depth, n):
        tied = np.flatnonzero(~(start & np.r_[start[1:], True]))
        if not len(tied):
            break
        ties = order[tied]
        after = ties + span
        key = rank[ties] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        order[tied], key = ties[by_key], key[by_key]
        start[tied] = np.r_[True, key[1:] != key[:-1]]
        new = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[order[tied]] = new[tied]
        span *= 2
    return order


def sorted_suffixes(text: np.ndarray, depth: int):
    """Positions of all suffixes of ``text`` (symbols, the last is 0), a list per first symbol, in
    an order that is right for the first ``depth`` symbols."""
    small = suffix_types(text)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(first) > 1:
        rough = induce(text, small, first)
        leftmost = np.zeros(len(text), bool)
        leftmost[first] = True
        order = np.concatenate([p[leftmost[p]] for p in (rough.take(c) for c in range(SYMBOLS))])
        names = _names(text, first, order)
        seeds = order if names.max() == len(first) - 1 else first[_sort_names(names, depth)]
    else:
        seeds = first
    done = induce(text, small, seeds)
    for c in range(SYMBOLS):
        positions = done.take(c)
        if len(positions):
            yield positions
