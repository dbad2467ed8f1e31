"""Suffix-array dedup: removes what repeats ``LEAST`` bytes or more, by run-length indexes.

An index over everything would need one task, so the corpus is cut up by content first.  Of every
window of ``LEAST`` bytes the grams of ``GRAM`` bytes are hashed; the smallest hash is the window's
anchor.  Equal windows have equal anchors, so a window can only repeat in another that has its
anchor.

1. List the anchors of all texts, deal them by value, and mark those that occur twice or more.
2. Around each marked anchor lies its context: the windows that have it as their anchor.  Contexts are
   dealt by anchor, equal ones collapse, and each block of anchors gets a run-length index of its contexts: their
   run-compressed Burrows-Wheeler transform with sampled run ends.  The indexes are a table.  Then the contexts
   are streamed from their index for the matching statistics, and so the spans that repeat.
3. The spans of a text are put together and cut out.

An anchor with more than ``HOT`` occurrences has its contexts cut into pieces of ``PIECE`` windows at
fixed distances from the anchor and dealt by the bytes that all windows of a piece share; the places
of a piece stay out of the index and meet its spans in a join, batch by batch.

Defined cases: null texts are empty ones; texts under ``LEAST`` bytes stay; rows that repeat a text
repeat all of it; a span may cut a character, the digest is over the bytes that remain; an empty table
gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pack, unpack
from .common import digest, settle, small_batches, sorted_side
from .rlbwt import RunIndex, repeated_spans
from .shingles import _BYTE, _power, mix

LEAST = 200
GRAM = 64
HOT = 4096  # occurrences of an anchor whose contexts one task takes whole
PIECE = 16
CHUNK = 1 << 19  # bytes whose anchors are found at once
BUCKET = 4 << 20  # bytes of text for each indexing group
BLOCK = 1 << 18  # bytes of contexts in one index, about
_PLACE_BITS = 21
_U = np.uint64


# --- 1: anchors -----------------------------------------------------------------------------------


def _windows(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that ``offsets`` cut from ``data``: the first and last window of each, its
    place, its hash, and the text's number.  Windows are numbered by the byte they start at."""
    n = len(data)
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    low = _U((1 << _PLACE_BITS) - 1)
    wide = least - gram + 1
    # Smallest value of each run of `wide`: ties go to the first, as the place is the lower part.
    rows = -(-len(h) // wide)
    grid = np.full(rows * wide, ~_U(0))
    grid[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - least + 1
    place = (np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & low).astype(np.int64)
    lengths = np.diff(offsets)
    kept = np.repeat(np.arange(len(lengths)), lengths)
    start = np.flatnonzero(np.arange(count) + least <= offsets[1:][kept[:count]])
    text = kept[start]
    place = place[start]
    fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))[: len(start)]
    at = np.flatnonzero(fresh)
    last = start[np.append(at[1:] - 1, len(start) - 1)] if len(at) else at
    # Anchors are small hashes: mixed again, they spread evenly over the buckets.
    return start[at], last, place[at], mix(h[place[at]]), text[at]


def anchors(texts: pa.Array, least: int, gram: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: number of the first, their bytes, and per anchor the text's number, the
    first and last window, the place and the hash; positions are in the bytes of the run.

    A text longer than a chunk comes in pieces that overlap by a window less one byte: the anchor of
    a window depends on the window alone.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        cuts = offsets[i : j + 1] - offsets[i]
        if len(own) <= CHUNK:
            first, last, place, h, text = _windows(own, cuts, least, gram)
        else:
            parts = []
            for at in range(0, len(own) - least + 1, CHUNK - least + 1):
                piece = own[at : at + CHUNK]
                f, z, p, hh, t = _windows(piece, np.array([0, len(piece)]), least, gram)
                parts.append((f + at, z + at, p + at, hh, t))
            first, last, place, h, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield i, own, text, first, np.stack((last, place)), h
        i = j


def _list_anchors(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = [b""] * batch.num_rows
            for i, own, text, _, _, h in anchors(batch.column("text"), least, gram):
                edges = np.searchsorted(text, np.arange(text[-1] + 2 if len(text) else 0))
                for k in range(len(edges) - 1):
                    keys[i + k] = h[edges[k] : edges[k + 1]].tobytes()
                del own
            yield pa.record_batch([batch.column("doc_id"), batch.column("tkey"), pa.array(keys, pa.binary())], ["doc_id", "tkey", "keys"])

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            sizes = [len(x) for x in keys]
            rows = np.repeat(batch.column("row").to_numpy(), sizes)
            ordinals = np.concatenate([np.arange(s, dtype=np.uint32) for s in sizes]) if sizes else np.zeros(0, np.uint32)
            keys = np.concatenate(keys) if sizes else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            keys, rows, ordinals = keys[order], rows[order], ordinals[order]
            b = _bucket(keys, buckets)
            edges = np.searchsorted(b, np.arange(buckets + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(edges)).tolist()
            cut = lambda x: pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary())  # noqa: B023, E731
            yield pa.record_batch([pa.array(full, pa.int32()), cut(keys), cut(rows), cut(ordinals)], ["bucket", "keys", "rows", "ordinals"])

    return run


def _mark(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Anchors that occur twice or more: per row, their numbers, doubled, plus one for hot ones."""
    keys, rows, ordinals = (np.concatenate([np.frombuffer(x, k) for x in t[c].to_pylist()]) for c, k in (("keys", np.uint64), ("rows", np.int64), ("ordinals", np.uint32)))
    order = np.argsort(keys)
    keys = keys[order]
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)))
    many = np.repeat(sizes, sizes)
    order, many = order[many > 1], many[many > 1]
    rows, marks = rows[order], ordinals[order] * np.uint32(2) + (many > HOT)
    order = np.argsort(rows, kind="stable")
    rows, marks = rows[order], marks[order].astype(np.uint32)
    edges = np.append(np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else [], len(rows)).astype(np.int64)
    return pa.table({
        "row": pa.array(rows[edges[:-1]], pa.int64()),
        "marks": pa.array([marks[edges[i] : edges[i + 1]].tobytes() for i in range(len(edges) - 1)], pa.binary()),
        "hot": pa.array([bool((marks[edges[i] : edges[i + 1]] & 1).any()) for i in range(len(edges) - 1)], pa.bool_()),
    })


# --- 2: contexts and indexes ----------------------------------------------------------------------


def _marked(batch: pa.RecordBatch, least: int, gram: int, hot: bool):
    """Contexts of marked anchors: row number in the batch, its text's start in the bytes, the bytes,
    anchor hash, first window, last window, place."""
    wanted = [np.concatenate([np.frombuffer(x, np.uint32) for x in m]) for m in batch.column("marks").to_pylist()]
    # Texts are cut at the same bytes, so anchors have the numbers they had before.
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))))
    for i, own, text, first, (last, place), h in anchors(batch.column("text"), least, gram):
        edges = np.searchsorted(text, np.arange(text[-1] + 2 if len(text) else 0))
        raw = own.tobytes()
        for k in range(len(edges) - 1):
            marks = wanted[i + k]
            pick = np.sort((marks[(marks & 1) == hot] >> 1).astype(np.int64)) + edges[k]
            base = int(sizes[i + k] - sizes[i])
            for f, z, p, x in zip(first[pick].tolist(), last[pick].tolist(), place[pick].tolist(), h[pick].tolist(), strict=True):
                yield i + k, base, raw, x, f, z, p


_CONTEXTS = "bucket int, keys binary, lengths binary, counts binary, refs binary, rows binary, starts binary, data binary"


def _send(buckets: int, least: int, gram: int):
    """Contexts by bucket, some MB at a time; equal ones once, with the number of texts and where they stand."""

    def packed(found: dict[bytes, list]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for text, (key, n, refs) in found.items():
            by.setdefault(((key >> 32) * buckets) >> 32, []).append((key, text, n, refs))
        rows = []
        for b, items in by.items():
            refs = [r for x in items for r in x[3]]
            rows.append((
                b, np.array([x[0] for x in items], np.uint64).tobytes(), np.array([len(x[1]) for x in items], np.uint32).tobytes(),
                np.array([x[2] for x in items], np.int64).tobytes(), np.array([len(x[3]) for x in items], np.uint32).tobytes(),
                np.array([r[0] for r in refs], np.int64).tobytes(), np.array([r[1] for r in refs], np.int64).tobytes(),
                pa.compress(b"".join(x[1] for x in items), codec="zstd", asbytes=True),
            ))
        names = [x.split()[0] for x in _CONTEXTS.split(", ")]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            rows, copies = batch.column("row").to_pylist(), batch.column("copies").to_pylist()
            for i, base, raw, key, first, last, _ in _marked(batch, least, gram, False):
                text = raw[first : last + least]
                item = found.get(text)
                if item is None:
                    item = found[text] = [key, 0, []]
                    size += len(text)
                item[1] += copies[i]
                item[2].append((rows[i], first - base))
                if size > 8 << 20:
                    yield packed(found)
                    found, size = {}, 0
        yield packed(found)

    return run


_INDEX = "index binary, lengths binary, counts binary, refs binary, rows binary, starts binary"


def _build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Indexes of the contexts of a bucket, one for each block of anchors, with the places of the contexts."""
    found: dict[int, dict[bytes, list]] = {}
    for r in t.drop_columns("bucket").to_pylist():
        kinds = (("keys", np.uint64), ("lengths", np.uint32), ("counts", np.int64), ("refs", np.uint32), ("rows", np.int64), ("starts", np.int64))
        keys, lengths, counts, refs, rows, starts = (np.frombuffer(r[c], k).tolist() for c, k in kinds)
        data = pa.decompress(r["data"], decompressed_size=sum(lengths), codec="zstd", asbytes=True)
        at = ref = 0
        for k, n, c, m in zip(keys, lengths, counts, refs, strict=True):
            item = found.setdefault(k, {}).setdefault(data[at : at + n], [0, []])
            item[0] += c
            item[1].extend(zip(rows[ref : ref + m], starts[ref : ref + m], strict=True))
            at, ref = at + n, ref + m
    out = []

    def flush(block: list[tuple[bytes, list]]) -> None:
        refs = [r for x in block for r in x[1][1]]
        out.append((
            RunIndex.build([x[0] for x in block]).pack(), pack(np.array([len(x[0]) for x in block])), np.array([x[1][0] for x in block], np.int64).tobytes(),
            pack(np.array([len(x[1][1]) for x in block])), np.array([r[0] for r in refs], np.int64).tobytes(), np.array([r[1] for r in refs], np.int64).tobytes(),
        ))

    block, size = [], 0
    for k in sorted(found):
        block.extend(found[k].items())
        size += sum(map(len, found[k]))
        if size >= BLOCK:
            flush(block)
            block, size = [], 0
    if block:
        flush(block)
    cols = list(zip(*out, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, pa.binary()) for c in cols], [x.split()[0] for x in _INDEX.split(", ")])


def _stream(least: int):
    """Spans per row: the contexts of each index are streamed from it, for their matching statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, refs = unpack(r["lengths"]).astype(np.int64), unpack(r["refs"]).tolist()
                spans = repeated_spans(RunIndex.unpack(r["index"]), lengths, np.frombuffer(r["counts"], np.int64), least)
                rows, starts = (np.frombuffer(r[c], np.int64).tolist() for c in ("rows", "starts"))
                out: dict[int, list[np.ndarray]] = {}
                at = 0
                for own, m in zip(spans, refs, strict=True):
                    if len(own):
                        for row, start in zip(rows[at : at + m], starts[at : at + m], strict=True):
                            out.setdefault(row, []).append(own + start)
                    at += m
                yield _span_rows(out)

    return run


def _span_rows(out: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    spans = [np.concatenate(x).astype(np.int64).tobytes() for x in out.values()]
    return pa.record_batch([pa.array(list(out), pa.int64()), pa.array([0] * len(out), pa.int64()), pa.array(spans, pa.binary())], ["row", "start", "spans"])


_PIECES = "bucket int, core long, cid binary, copies long, rows binary, starts binary, piece binary"


def _send_hot(buckets: int, least: int, gram: int):
    """Pieces of hot anchors' contexts, some MB at a time; each once, with all the places where it stands."""

    def packed(found: dict[bytes, tuple]) -> pa.RecordBatch:
        rows = [
            (((core >> 32) * buckets) >> 32, core - (1 << 63), cid, sum(x[2] for x in refs),
             np.array([x[0] for x in refs], np.int64).tobytes(), np.array([x[1] for x in refs], np.int64).tobytes(), text)
            for cid, (core, text, refs) in found.items()
        ]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            rows, copies = batch.column("row").to_pylist(), batch.column("copies").to_pylist()
            for i, base, raw, key, first, last, place in _marked(batch, least, gram, True):
                for d in range((place - last) // PIECE, (place - first) // PIECE + 1):
                    # Windows that start d * PIECE to (d + 1) * PIECE - 1 bytes before the anchor.
                    lo, hi = max(first, place - (d + 1) * PIECE + 1), min(last, place - d * PIECE)
                    shared = raw[place - d * PIECE : place - (d + 1) * PIECE + 1 + least]
                    core = int.from_bytes(hashlib.blake2b(shared + d.to_bytes(4, "little") + key.to_bytes(8, "little"), digest_size=8).digest(), "little")
                    text = raw[lo : hi + least]
                    cid = hashlib.blake2b(text + core.to_bytes(8, "little"), digest_size=16).digest()
                    if cid not in found:
                        found[cid] = (core, text, [])
                        size += len(text)
                    found[cid][2].append((rows[i], lo - base, copies[i]))
                if size > 8 << 20:
                    yield packed(found)
                    found, size = {}, 0
        yield packed(found)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of pieces, put at all their places: one row for each text of a batch."""
    for batch in batches:
        out: dict[int, list[np.ndarray]] = {}
        for rows, starts, spans in zip(*[batch.column(c).to_pylist() for c in ("rows", "starts", "spans")], strict=True):
            own = np.frombuffer(spans, np.int64)
            for row, start in zip(np.frombuffer(rows, np.int64).tolist(), np.frombuffer(starts, np.int64).tolist(), strict=True):
                out.setdefault(row, []).append(own + start)
        yield _span_rows(out)


_HOT_INDEX = "index binary, lengths binary, counts binary, cids binary"


def _build_hot(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Indexes of the pieces of a bucket, one for each block of cores, with the pieces' names."""
    found: dict[int, dict[bytes, tuple[bytes, int]]] = {}
    for core, cid, piece, copies in zip(*[t[c].to_pylist() for c in ("core", "cid", "piece", "copies")], strict=True):
        found.setdefault(core, {})[cid] = (piece, copies)
    out = []

    def flush(block: list[tuple[bytes, tuple[bytes, int]]]) -> None:
        pieces = [x[1][0] for x in block]
        counts = np.array([x[1][1] for x in block], np.int64).tobytes()
        out.append((RunIndex.build(pieces).pack(), pack(np.array(list(map(len, pieces)))), counts, b"".join(x[0] for x in block)))

    block, size = [], 0
    for k in sorted(found):
        block.extend(found[k].items())
        size += sum(len(x[0]) for x in found[k].values())
        if size >= BLOCK:
            flush(block)
            block, size = [], 0
    if block:
        flush(block)
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, pa.binary()) for c in cols], [x.split()[0] for x in _HOT_INDEX.split(", ")])


def _stream_hot(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                spans = repeated_spans(RunIndex.unpack(r["index"]), unpack(r["lengths"]).astype(np.int64), np.frombuffer(r["counts"], np.int64), least)
                cids = [r["cids"][i : i + 16] for i in range(0, len(r["cids"]), 16)]
                some = [(c, own.astype(np.int64).tobytes()) for c, own in zip(cids, spans, strict=True) if len(own)]
                yield pa.record_batch([pa.array([x[i] for x in some], pa.binary()) for i in (0, 1)], ["cid", "spans"])

    return run


# --- 3: removal -----------------------------------------------------------------------------------


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, parts in zip(*[batch.column(c).to_pylist() for c in ("tkey", "text", "parts")], strict=True):
                raw = (text or "").encode()
                inside = np.zeros(len(raw) + 1, np.int64)
                for p in parts:
                    spans = np.frombuffer(p["spans"], np.int64).reshape(-1, 2) + p["start"]
                    np.add.at(inside, spans[:, 0], 1)
                    np.add.at(inside, spans[:, 1], -1)
                gone = np.cumsum(inside)[:-1] > 0
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                out.append((key, int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


@small_batches
def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, keep_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the remaining bytes if ``keep_text`` and something was removed, else null.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", digest(F.col("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    listed = rows.select("doc_id", "tkey", "text").mapInArrow(_list_anchors(least, gram), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tkey binary, keys binary")
    listed = settle(listed.filter(F.octet_length("keys") > 0).withColumn("row", F.monotonically_increasing_id()))
    dealt = listed.select("row", "keys").mapInArrow(_deal(buckets), "bucket int, keys binary, rows binary, ordinals binary")
    marks = settle(dealt.groupBy("bucket").applyInArrow(_mark, "row long, marks binary, hot boolean"))

    # One row stands for all that have its text.
    first = settle(listed.groupBy("tkey").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    marks = marks.join(first.select("row"), "row", "left_semi").groupBy("row").agg(F.collect_list("marks").alias("marks"), F.max("hot").alias("hot"))
    same = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("tkey"))))
    wanted = listed.select("row", same.alias("same")).join(first, "row").join(marks, "row")
    body = rows.select("text", same.alias("same"))
    texts = settle(body.join(sorted_side(settle(wanted)), "same").dropDuplicates(["same"]).select("row", "tkey", "copies", "marks", "hot", "text"))

    sent = texts.select("row", "copies", "marks", "text").mapInArrow(_send(buckets, least, gram), _CONTEXTS)
    # The indexes are rows of a table; a lost task streams its own again, and builds none.
    indexes = settle(sent.groupBy("bucket").applyInArrow(_build, _INDEX))
    spans = indexes.mapInArrow(_stream(least), "row long, start long, spans binary")
    pieces = settle(texts.filter("hot").select("row", "copies", "marks", "text").mapInArrow(_send_hot(buckets, least, gram), _PIECES))
    held = pieces.groupBy("cid").agg(F.sum("copies").alias("copies"), F.first("piece").alias("piece"), F.first("bucket").alias("bucket"), F.first("core").alias("core"))
    hot_indexes = settle(held.groupBy("bucket").applyInArrow(_build_hot, _HOT_INDEX))
    hot = settle(hot_indexes.mapInArrow(_stream_hot(least), "cid binary, spans binary"))
    placed = pieces.select("cid", "rows", "starts").join(hot, "cid").select("rows", "starts", "spans")
    spans = settle(spans.union(placed.mapInArrow(_spread, "row long, start long, spans binary")))

    parts = spans.groupBy("row").agg(F.collect_list(F.struct("start", "spans")).alias("parts"))
    cut = texts.select("row", "tkey", "text").join(sorted_side(parts), "row").select("tkey", "text", "parts").mapInArrow(
        _cut(keep_text), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    cut = settle(cut)
    all_rows = rows.select("doc_id", "tkey", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return all_rows.join(cut, all_rows["tkey"] == cut["key"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept",
    )
