"""Texts cut into pre-tokens, whole batches at once.

The pattern is that of the public rank files (``PATTERN`` there): contractions, letters, numbers and
other characters with one space before them, white space.  Every boundary follows from the classes of
a few neighbouring characters, so the cut is a handful of array operations instead of a regular
expression run text by text.  Which characters are letters or numbers is asked of the tokenizer library
itself, once, on the driver.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = range(4)
STRETCH = 1 << 20  # bytes of text cut at once
LAST_TEXT = 0x40000  # no letter or number beyond
# Code points that are white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_kinds(pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first code point, kind) of all code points, as the tokenizer library classes them.

    Assigned code points have the class of their category.  For those that this Python does not know yet
    the library is asked: after an ``a`` a letter joins it, so the first byte of the letter is merged
    with it; the same for numbers after a ``1``.
    """
    import tiktoken

    leads = list(range(0xC2, 0xF5))
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([x, b]): 256 + i * len(leads) + j for i, x in enumerate(b"a1") for j, b in enumerate(leads)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kinds = np.zeros(0x110000, np.uint8)
    groups = [unicodedata.category(chr(p)) for p in range(0x110000)]
    kinds[[p for p, g in enumerate(groups) if g[0] == "L"]] = LETTER
    kinds[[p for p, g in enumerate(groups) if g[0] == "N"]] = NUMBER
    points = [p for p in range(0x80, LAST_TEXT) if groups[p] == "Cn"]
    for kind, before in ((LETTER, "a"), (NUMBER, "1")):
        own = 256 + (before == "1") * len(leads)
        ids = np.array(probe.encode_ordinary("".join(f"{before}{chr(p)}\n" for p in points)))
        marks = ids[(ids == ord(before)) | ((ids >= own) & (ids < own + len(leads)))]
        kinds[np.array(points)[marks >= 256]] = kind
    kinds[WHITE] = SPACE
    first = np.flatnonzero(np.diff(kinds, prepend=kinds[0] + 1))
    return first.astype(np.int32), kinds[first]


def kind_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, kinds = runs
    return np.repeat(kinds, np.diff(first, append=0x110000))


def token_starts(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token; ``first`` marks those that begin a text."""
    n = len(points)
    kind = kinds[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last space of several stands apart from them if something follows; a plain one joins that.
    space = kind == SPACE
    apart = np.zeros(n, bool)
    apart[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= apart
    start[1:] &= ~(apart[:-1] & (points[:-1] == 0x20))
    # Contractions: an apostrophe that begins a pre-token takes one or two letters with it.
    at = np.flatnonzero((points == ord("'")) & start)
    end = np.append(points, np.zeros(3, points.dtype))
    stop = np.append(first, np.ones(3, bool))
    one, two = end[at + 1], end[at + 2]
    inside = ~stop[at + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside & ~stop[at + 2] & np.isin(one.astype(np.int64) * 256 + np.minimum(two, 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    start[at[short | long] + 1] = False
    after = np.concatenate((at[short] + 2, at[long] + 3))
    start[after[after < n]] = True
    return start


def _stretches(data: bytes, ends: np.ndarray) -> list[int]:
    """Places that cut a batch into stretches: ends of texts, or in long texts a space after a
    visible ASCII character, where a pre-token begins whatever stands around."""
    cuts, at, size = [], 0, len(data)
    while at < size:
        if size - at <= STRETCH:
            cuts.append(size)
            break
        upto = at + STRETCH
        text_end = int(ends[np.searchsorted(ends, upto, "right") - 1]) if ends[0] <= upto else 0
        if text_end > at:
            at = text_end
        else:
            near = data.rfind(b" ", at + 1, upto)
            while near > at and not 0x21 <= data[near - 1] <= 0x7E:
                near = data.rfind(b" ", at + 1, near)
            # No such place: the rest of the text in one.
            at = near if near > at else int(ends[np.searchsorted(ends, at, "right")])
        cuts.append(at)
    return cuts


def cut(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts (no nulls), one after the other, and their number by text."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    base = int(np.frombuffer(texts.buffers()[1], np.int64, 1, texts.offset * 8)[0])
    data = texts.buffers()[2].slice(base, int(ends[-1]))
    raw = data.to_pybytes()
    begins = np.zeros(len(raw), bool) if len(texts) > 1 else None
    if begins is not None:
        begins[(ends - sizes)[sizes > 0]] = True
    found, lo = [], 0
    for hi in _stretches(raw, ends):
        points = np.frombuffer(raw[lo:hi].decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width, dtype=np.int64) - width + lo
        first = np.zeros(len(points), bool) if begins is None else begins[place]
        first[0] = True
        found.append(place[token_starts(points, first, kinds)])
        lo = hi
    starts = np.concatenate(found)
    offsets = pa.py_buffer(np.append(starts, ends[-1]))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, data])
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    return tokens, counts
