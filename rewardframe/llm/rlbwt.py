"""Run-length index of short texts, and matching statistics streamed from it.

The texts of a block are joined by separators.  The index holds their Burrows-Wheeler transform by
runs (symbol and length), for either end of every run a sample, and the row at which each text ends.
It stands for the texts: they are read from it backwards, and its size follows the runs, so copies
with few differences cost little.

Reading a text takes one step of the transform (LF) per byte.  The length of the match with the row
before, or after, in suffix order grows by one per step as long as that row is in the same run.  At
the end of a run it does not; there the sample says what it is after the step.  So the longest match of
every suffix with any other follows from samples alone, and all texts of a block are streamed side by side.
""" 

from __future__ import annotations

import numpy as np

from .bpe import pack, unpack

_U = np.uint64
_FIRST = 7  # symbols of 9 bits that fit one number


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes, compared up to ``depth`` symbols, by prefix doubling.

    A position's rank is the first place of its group; only groups of more than one are sorted again.
    """
    n = len(symbols)
    wide = np.zeros(n + _FIRST, np.uint64)
    wide[:n] = symbols
    key = np.zeros(n, np.uint64)
    for k in range(_FIRST):
        key |= wide[k : k + n] << _U(9 * (_FIRST - 1 - k))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.zeros(2 * n, np.int64)  # beyond the end: 0
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = _FIRST
    while len(slots) and h < depth:
        own = order[slots]
        own_rank = rank[own]
        key = (own_rank.astype(np.uint64) << _U(32)) | np.where(own + h < n, rank[np.minimum(own + h, n)] + 1, 0).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(own)))
        rank[own] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def _common(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b`` within their texts; ``left`` is what remains."""
    n = len(data)
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words[: max(n - k, 0)] |= data[k:].astype(np.uint64) << _U(8 * k)
    most = np.minimum(left[a], left[b])
    found = most.copy()
    live, at = np.flatnonzero(most > 0), 0
    while len(live):
        x = words[a[live] + at] ^ words[b[live] + at]
        off = x != 0
        if off.any():
            lowest = x[off] & (~x[off] + _U(1))
            same = (np.log2(lowest.astype(np.float64)) / 8).astype(np.int64)
            i = live[off]
            found[i] = np.minimum(most[i], at + same)
        at += 8
        live = live[~off]
        live = live[most[live] > at]
    return found


class RunIndex:
    """``heads`` and ``lengths`` of the runs; ``up`` and ``down``: the match with the row before the first row
    of a run, and with the row after its last, one step on; ``ends``: rows of the texts' ends."""

    def __init__(self, heads: np.ndarray, lengths: np.ndarray, up: np.ndarray, down: np.ndarray, ends: np.ndarray):
        self.heads, self.lengths, self.up, self.down, self.ends = heads, lengths, up, down, ends

    @classmethod
    def build(cls, texts: list[bytes]) -> RunIndex:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = len(data)
        symbols = data.astype(np.uint16) + 1
        symbols[ends] = 0
        left = np.repeat(ends, sizes + 1) - np.arange(n)
        # In full: a step from row to row is only right in the one true order.
        order = suffix_order(symbols, n)
        bwt = symbols[order - 1]
        first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        heads, lengths = bwt[first], np.diff(np.append(first, n))
        after = _steps(heads, lengths)
        top, bottom = after, after + lengths - 1
        up, down = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        some = np.flatnonzero(top > 0)
        up[some] = _common(data, left, order[top[some]], order[top[some] - 1])
        some = np.flatnonzero(bottom + 1 < n)
        down[some] = _common(data, left, order[bottom[some]], order[bottom[some] + 1])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        return cls(heads, lengths, up, down, row[ends])

    def pack(self) -> bytes:
        parts = [pack(x) for x in (self.heads, self.lengths, self.up, self.down, self.ends)]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> RunIndex:
        parts, at = [], 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpack(data[at + 8 : at + 8 + size]).astype(np.int64))
            at += 8 + size
        return cls(*parts)

    def statistics(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of the texts (of these sizes), and a 0 after each text, the longest match of what starts
        there with what starts elsewhere; and where each text begins in them."""
        begins = np.cumsum(sizes + 1) - sizes - 1
        found = np.zeros(int((sizes + 1).sum()), np.int64)
        start = np.cumsum(self.lengths) - self.lengths
        after, last = _steps(self.heads, self.lengths), self.lengths - 1
        # The longest texts first: those that still go on are then a prefix.
        by = np.argsort(-sizes, kind="stable")
        row, place = self.ends[by], (begins + sizes)[by]
        going = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, int(sizes.max(initial=0)) + 1))
        up, down = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k in going.tolist():
            row, place, up, down = row[:k], place[:k] - 1, up[:k], down[:k]
            run = np.searchsorted(start, row, "right") - 1
            offset = row - start[run]
            up = np.where(offset == 0, self.up[run], up + 1)
            down = np.where(offset == last[run], self.down[run], down + 1)
            row = after[run] + offset
            found[place] = np.maximum(up, down)
        return found, begins


def _steps(heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row that the first row of each run leads to, one symbol further left."""
    by = np.argsort(heads, kind="stable")
    after = np.empty(len(heads), np.int64)
    after[by] = np.cumsum(lengths[by]) - lengths[by]
    return after


def matching_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of texts against each other, and where each begins in them."""
    return RunIndex.build(texts).statistics(np.fromiter(map(len, texts), np.int64, len(texts)))


def repeated_spans(index: RunIndex, lengths: np.ndarray, counts: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text of an index (distinct, with its length and the number of its copies) the spans that are covered by
    strings of ``least`` bytes that also start elsewhere: an array of (start, stop)."""
    statistics, begins = index.statistics(lengths)
    hit = np.flatnonzero(statistics >= least)
    change = np.zeros(len(statistics) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + least, -1)
    twice = (counts > 1) & (lengths >= least)
    np.add.at(change, begins[twice], 1)
    np.add.at(change, (begins + lengths)[twice], -1)
    inside = np.cumsum(change) > 0
    steps = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    owner = np.searchsorted(begins, starts, "right") - 1
    spans = np.stack((starts - begins[owner], stops - begins[owner]), axis=1)
    return np.split(spans, np.searchsorted(owner, np.arange(1, len(lengths))))
