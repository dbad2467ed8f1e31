"""Hashed 5-word shingles of whole texts, in NumPy over the buffers of an Arrow column.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Hashes have 64 bits: two different shingles of
one pair of texts are taken for equal with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

N_WORDS = 5
CHUNK = 1 << 19  # bytes of text that are worked on at once; a longer text goes alone
_U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 1 << 63, N_WORDS + 1, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a chunk are kept."""
    if n <= CHUNK and CHUNK in _powers:
        return _powers[CHUNK]
    size = max(n, CHUNK)
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(size + 1, b, dtype=np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size == CHUNK:
        _powers[CHUNK] = tuple(made)
    return tuple(made)


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and document offsets of consecutive runs of texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of every document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    data = _LOWER[data]
    full = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | edge[1:n]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _PLACE[N_WORDS])
    return h, np.diff(np.searchsorted(s, offsets))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingle hashes, sorted; fewer than five words make one."""
    for data, offsets in _chunks(texts):
        h, counts = _word_hashes(data, offsets)
        full = np.zeros(max(len(h) - N_WORDS + 1, 0), np.uint64)
        for k in range(N_WORDS):
            full += h[k : k + len(full)] * _PLACE[k]
        full = mix(full)
        at = 0
        for m in counts.tolist():
            if m >= N_WORDS:
                x = np.sort(full[at : at + m - N_WORDS + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif m:
                x = (h[at : at + m] * _PLACE[:m]).sum(dtype=np.uint64) + _U(m)
                yield mix(np.array([x], np.uint64) ^ _PLACE[N_WORDS])
            else:
                yield np.zeros(0, np.uint64)
            at += m
