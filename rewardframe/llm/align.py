"""Alignment of the tokens of two tokenizers, and how often they stand for each other.

Tokens are byte intervals of " " + text.  All intervals of both tokenizers, of many texts laid end to
end, are put in order of their starts; the running maximum of their ends is kept.  A group ends where a
start reaches that maximum: there tokens of both end.  Inside a group each token of A is expanded to
the tokens of B that it overlaps; these are the links.

Both tokenizers surely begin a token at a space after a character that is not white space.  So the
texts of a block (some megabytes) fall into units, and each distinct unit of the block is tokenized
and aligned once; the figures of a text are those of its units put together by position.

The count of an id pair is the number of documents that hold it linked.  A block counts its own
documents first; rows (pair, block, documents) are summed by pair, and the counts of each block's pairs come
back as one row, so what is shuffled follows the distinct pairs of blocks, not links.

Defined cases: a null or empty text, and one whose tokens do not spell " " + text, has no tokens: all its figures are
0 and its groups are an empty string, unhashed; repeated rows are documents of their own; very long texts are a
block of their own; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered, pack, slices, unpack
from .common import settle, small_batches, sorted_side, tidy
from .workers import kept

BLOCK = 8 << 20  # bytes of text
TOGETHER = 1 << 15  # units that the tokenizers get at once
_SPACE = "▁"  # how B's pieces spell a space
_NEWER = "\u0250"  # first character after the Latin blocks
_BLOCK_ROW = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, uses binary, pairs array<bigint>, docs array<int>"
)
_ROW = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Characters that stand for bytes in the entries of byte-level tokenizers: visible ones of Latin-1
    for themselves, the others, in order, from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Ids and byte lengths of units by both tokenizers.

    Where all characters are of the oldest blocks, whose classes no version of Unicode changes, A's ids come
    from the faster of its two libraries, which merges by the same ranks.
    """

    def __init__(self, a: str, b: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in self.a.get_vocab(with_added_tokens=False).items()}
        with open(a, "rb") as file:
            merges = json.load(file)["model"]["merges"]
        ordered = [ranks["".join(m if isinstance(m, list) else m.split(" ")).translate(str.maketrans(letters)).encode("latin-1")] for m in merges]
        if any(x >= y for x, y in itertools.pairwise(ordered)):
            raise ValueError("the ids of A are not in the order of its merges")
        self.ranked = tiktoken.Encoding(a, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece goes on beyond a space")
        self.space = [self.b.piece_to_id(_SPACE)]
        if pieces[self.space[0]] != _SPACE:
            raise ValueError("no piece for a space")
        a_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.tables = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]

    def _ids(self, units: list[str]) -> list[list[int]]:
        found = [self.ranked.encode_ordinary(u) if u.isascii() or max(u) < _NEWER else None for u in units]
        open_ = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(open_, self.a.encode_batch_fast([units[k] for k in open_], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def encode(self, units: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: number of tokens by unit, all ids, all byte lengths, and which units they spell."""
        parts = [self._encode(units.slice(lo, TOGETHER)) for lo in range(0, len(units), TOGETHER)] or [self._encode(units)]
        return [tuple(map(np.concatenate, zip(*side, strict=True))) for side in zip(*parts, strict=True)]

    def _encode(self, units: pa.Array) -> list[tuple[np.ndarray, ...]]:
        texts = units.cast(pa.large_string()).to_pylist()
        # B adds the first space of a unit by itself, but not to an empty text.
        coders = (self._ids, lambda us: [x or self.space for x in self.b.encode([u[1:] for u in us], num_threads=1)])
        out = []
        for coder, table in zip(coders, self.tables, strict=True):
            ids = coder(texts)
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))
            tokens = table.take(pa.array(flat))
            sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))]
            spelled = pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(ends), tokens.buffers()[2] or pa.py_buffer(b"")])
            out.append((counts, flat, sizes, pc.equal(spelled, units).to_numpy(zero_copy_only=False)))
        return out


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and the group number of each in that order: a group ends where a
    start reaches the largest end so far."""
    order = np.lexsort((ends, starts))
    begin, upto = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = begin[1:] >= upto[:-1]
    return order, np.cumsum(new) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all overlapping pairs of two sequences of adjoining intervals."""
    first = np.searchsorted(b_end, a_start, "right")
    last = np.searchsorted(b_start, a_end, "left")
    return np.repeat(np.arange(len(a_start)), last - first), gathered(first, last - first)


def _spelled(numbers: np.ndarray, after: np.ndarray, marks: tuple[bytes, ...]) -> pa.Array:
    """Decimal numbers, each with one of the marks after it."""
    texts = pc.cast(pa.array(numbers), pa.string()).cast(pa.binary())
    return pc.binary_join_element_wise(texts, pa.array(list(marks), pa.binary()).take(pa.array(after)), pa.scalar(b"", pa.binary()))


class Units:
    """Aligned distinct units of a block."""

    def __init__(self, units: pa.Array, coders: Tokenizers):
        (self.n_a, a, a_size, right_a), (self.n_b, b, b_size, right_b) = coders.encode(units)
        self.right = right_a & right_b
        # Units that are not spelled have no tokens here; their texts are left out as a whole.
        keep_a, keep_b = np.repeat(self.right, self.n_a), np.repeat(self.right, self.n_b)
        a, a_size, b, b_size = a[keep_a], a_size[keep_a], b[keep_b], b_size[keep_b]
        self.n_a, self.n_b = self.n_a * self.right, self.n_b * self.right
        a_end, b_end = np.cumsum(a_size, dtype=np.int64), np.cumsum(b_size, dtype=np.int64)
        a_start, b_start = a_end - a_size, b_end - b_size
        order, group = coalesce(np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end)))
        own = np.empty(len(order), np.int64)
        own[order] = group
        unit = np.concatenate((np.repeat(np.arange(len(units)), self.n_a), np.repeat(np.arange(len(units)), self.n_b)))
        # Groups: A's ids, then B's, and so on from group to group.
        is_b = np.arange(len(order)) >= len(a)
        listed = np.lexsort((np.arange(len(order)), is_b, own))
        ids, side, of = np.concatenate((a, b))[listed], is_b[listed], own[listed]
        ends = np.ones(len(listed), bool)
        ends[:-1] = (side[1:] != side[:-1]) | (of[1:] != of[:-1])
        text = _spelled(ids, np.where(ends, np.where(side, 2, 1), 0), (b",", b"|", b";"))
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)))
        cuts = upto[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        body = text.buffers()[2] or pa.py_buffer(b"")
        self.text = pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(cuts), body])
        new = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        self.n_groups = np.bincount(unit[listed][new], minlength=len(units))
        at_a, at_b = overlaps(a_start, a_end, b_start, b_end)
        self.n_links = np.bincount(unit[: len(a)][at_a], minlength=len(units)) if len(a) else np.zeros(len(units), np.int64)
        self.pairs, self.links = np.unique((a[at_a].astype(np.int64) << 32) | b[at_b], return_inverse=True)
        self.link_start = np.cumsum(self.n_links) - self.n_links


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of " " + text, one text after the other, and their number by text.

    A unit begins at a space after a visible ASCII character, and at the start of a text.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
    ends = np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False), dtype=np.int64)
    data = spaced.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(ends[-1]) if len(ends) else 0)
    first = np.zeros(len(raw), bool)
    first[np.concatenate(([0], ends[:-1]))[: len(ends)]] = True
    first[1:] |= (raw[1:] == 0x20) & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)
    starts = np.flatnonzero(first)
    offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, data])
    return units, np.diff(np.searchsorted(starts, ends, "left"), prepend=0)


def _aligned(ids: pa.Array, texts: pa.Array, coders: Tokenizers, block: int) -> pa.RecordBatch:
    """One row for a block of texts."""
    full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    units, counts = units_of(texts.take(pa.array(full)))
    coded = units.dictionary_encode()
    of = Units(coded.dictionary, coders)
    places = coded.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(counts)))
    sums = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests, uses, docs = [""] * len(texts), [], np.zeros(len(of.pairs), np.int64)
    used = np.zeros(len(texts), np.int64)
    for k, d in enumerate(full.tolist()):
        own = places[ends[k] : ends[k + 1]]
        if not of.right[own].all():
            continue
        for c, out in sums.items():
            out[d] = getattr(of, c)[own].sum()
        spelled = of.text.take(pa.array(own))
        first, last = (int(x) for x in np.frombuffer(spelled.buffers()[1], np.int64)[[0, len(own)]])
        # The mark after the last group goes.
        digests[d] = hashlib.sha256(memoryview(spelled.buffers()[2])[first : last - 1]).hexdigest()
        pairs, times = np.unique(of.links[gathered(of.link_start[own], of.n_links[own])], return_counts=True)
        docs[pairs] += 1
        used[d] = len(pairs)
        uses.append(np.concatenate((pairs, times)))
    held = docs > 0
    flat = np.concatenate(uses) if uses else np.zeros(0, np.int64)
    named = {
        "block": [block], "doc_id": [ids], **{c: [pa.array(v)] for c, v in sums.items()}, "groups_sha256": [pa.array(digests)],
        "uses": [_joined(pack(used), pack(flat), pack(np.flatnonzero(held)))],
        "pairs": [pa.array(of.pairs[held])], "docs": [pa.array(docs[held].astype(np.int32))],
    }
    kinds = {"block": pa.int64(), "groups_sha256": pa.list_(pa.string()), "uses": pa.binary(), "docs": pa.list_(pa.int32())}
    return pa.record_batch([pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in named.items()], list(named))


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def _align(a: str, b: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = kept(("align", a, b, pattern), lambda: Tokenizers(a, b, pattern))
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            return _aligned(*map(pa.concat_arrays, zip(*held, strict=True)), coders, block)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(sizes, BLOCK):
                part = int(sizes[i:j].sum())
                if held and size + part > BLOCK:
                    yield done()
                    block, held, size = block + 1, [], 0
                held.append((batch.column("doc_id").slice(i, j - i), texts.slice(i, j - i)))
                size += part
        if held:
            yield done()

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of the texts of each block from the counts of its pairs, which name their places."""
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            used, flat, held = map(unpack, _parted(row.column("uses")[0].as_py()))
            told = row.column("told").flatten()
            known = int(held[-1]) + 1 if len(held) else 0
            count, best = np.zeros(known, np.int64), np.zeros(known, np.int64)
            at = told.field("place").to_numpy(zero_copy_only=False)
            count[held[at]] = told.field("n").to_numpy(zero_copy_only=False)
            best[held[at]] = told.field("best").to_numpy(zero_copy_only=False)
            n_best, total, lo = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64), 0
            for d, n in enumerate(used.tolist()):
                pairs, times = flat[lo : lo + n], flat[lo + n : lo + 2 * n].astype(np.int64)
                lo += 2 * n
                n_best[d], total[d] = (times * best[pairs]).sum(), (times * count[pairs]).sum()
            columns = {c: row.column(c).flatten() for c in own} | {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
            names = [f.split()[0] for f in _ROW.split(", ")]
            yield pa.record_batch([columns[c] for c in names], names)


def pair_counts(entries: DataFrame) -> DataFrame:
    """(pair, n, best) of rows (pair, docs): in how many documents, and 1 if no pair of the same A id is in more."""
    counts = settle(entries.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = settle(counts.groupBy("a").agg(F.max("n").alias("most")))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


@tidy
@small_batches
def align(docs: DataFrame, a: str, b: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is the file of a byte-level tokenizer, ``pattern`` the one that splits its texts, ``b`` the file of a
    piece tokenizer with byte fallback; all executors have them.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blocks = settle(rows.mapInArrow(_align(a, b, pattern), _BLOCK_ROW))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "e")).select("block", "place", "e.pairs", "e.docs").withColumnRenamed("pairs", "pair")
    counts = settle(pair_counts(entries.select("pair", "docs")))
    told = (
        entries.select("block", "place", "pair").join(counts, "pair")
        .groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    )
    wide = blocks.drop("pairs", "docs").join(sorted_side(told), "block", "left")
    return wide.withColumn("told", F.coalesce("told", F.array().cast("array<struct<place:int,n:bigint,best:bigint>>"))).mapInArrow(_scored, _ROW)
