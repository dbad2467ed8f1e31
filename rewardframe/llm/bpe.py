"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

1. Texts are cut into pre-tokens ("words").  Some megabytes of texts are a block: the places of all its
   words in its own list of distinct words go to a file in the shared folder, compressed; the distinct
   words go, dealt by hash into ``buckets``, to a table.
2. The table is shuffled by bucket.  Every word of the corpus is in one bucket, so it is encoded once there,
   however many blocks hold it; its ids are joined back to each block's list.
3. The lists are shuffled by block.  The file of the block is read and the ids of its texts are put together
   by position.

So words travel once per block that holds them, not once per occurrence, and no text is shuffled.  There
are as many buckets as the session has shuffle partitions, so a bucket is what any shuffle puts into one
task.  Decoding takes, for each id, its row of the token-byte table; the table goes to the tasks, its
size is that of the vocabulary.

Defined cases: a null or empty text has no ids; decoding nothing gives no bytes, decoding null gives null,
an id outside the table is an error; repeated rows are encoded each by itself; very long texts are a block of
their own; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import settle, work_folder
from .files import store, whole_file
from .workers import kept

BLOCK = 10 << 20  # bytes of text
OUT = 1 << 20  # ids put together at once
_PACKED = "block string, bucket int, words binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


# --- Packed columns: numbers as byte planes, so that a general compressor sees them apart ------------


def pack(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, compressed."""
    wide = np.ascontiguousarray(numbers, "<u4")
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(wide).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).reshape(-1).view("<u4")


def pack_words(words: pa.Array) -> bytes:
    """Byte strings, compressed: their lengths, then their bytes."""
    sizes = pack(pc.binary_length(words).to_numpy(zero_copy_only=False))
    body = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b"", pa.large_binary()))[0].as_py()
    return b"".join((len(sizes).to_bytes(8, "little"), sizes, len(body).to_bytes(8, "little"), pa.compress(body, codec="zstd", asbytes=True)))


def unpack_words(data: bytes) -> pa.Array:
    at = 8 + int.from_bytes(data[:8], "little")
    sizes = unpack(data[8:at])
    n = int.from_bytes(data[at : at + 8], "little")
    body = pa.decompress(data[at + 8 :], decompressed_size=n, codec="zstd")
    offsets = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), body])


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes sum to ``limit`` at most, or that are one row."""
    ends, i, before = np.cumsum(sizes, dtype=np.int64), 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield i, j
        i, before = j, int(ends[j - 1])


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the stretches (start, size), one after the other."""
    after = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)


# --- 1: blocks -----------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about ``BLOCK`` bytes."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(sizes, BLOCK):
            part = int(sizes[i:j].sum())
            if held and size + part > BLOCK:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
            held.append((batch.column("doc_id").slice(i, j - i), texts.slice(i, j - i)))
            size += part
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def _cut(folder: str, runs: tuple[np.ndarray, np.ndarray], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pretokens.kind_table(runs)
        for ids, texts in _blocks(batches):
            tokens, counts = pretokens.cut(texts, kinds)
            coded = tokens.dictionary_encode()
            places, words = coded.indices.to_numpy(), coded.dictionary
            often = np.bincount(places, minlength=len(words))
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = words.take(pa.array(order))
            dealt = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))
            # The name is new in every attempt: rows of a finished task name the files of that very attempt.
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            with whole_file(folder, name) as out, pa.ipc.new_file(out, pa.schema([("doc_id", pa.int64()), ("data", pa.large_binary())])) as to:
                to.write(pa.record_batch([ids, pa.nulls(len(ids), pa.large_binary())], ["doc_id", "data"]))
                data = [pack(counts), pack(rank[places]), pack(dealt)]
                to.write(pa.record_batch([pa.nulls(3, pa.int64()), pa.array(data, pa.large_binary())], ["doc_id", "data"]))
            by_bucket = np.argsort(dealt, kind="stable")
            ends = np.searchsorted(dealt[by_bucket], np.arange(buckets + 1))
            used = [b for b in range(buckets) if ends[b] < ends[b + 1]] or [0]  # texts without words: one empty row
            packed = [pack_words(words.take(pa.array(by_bucket[ends[b] : ends[b + 1]]))) for b in used]
            yield pa.record_batch([pa.array([name] * len(used)), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["block", "bucket", "words"])

    return run


# --- 2: every distinct word once -------------------------------------------------------------------


def _encode_bucket(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        encoding = kept(("tiktoken", path, pattern), lambda: _encoding(path, pattern))
        lists = [unpack_words(x) for x in table.column("words").to_pylist()]
        coded = pa.concat_arrays([pa.array([], pa.large_binary()), *lists]).dictionary_encode()
        found = [encoding.encode_ordinary(w.decode()) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        places, at, rows = coded.indices.to_numpy(), 0, []
        for part in lists:
            own = places[at : at + len(part)]
            at += len(part)
            counts, body = pack(sizes[own]), pack(ids[gathered(starts[own], sizes[own])])
            rows.append(len(counts).to_bytes(8, "little") + counts + body)
        return pa.table([table.column("block"), table.column("bucket"), pa.array(rows, pa.binary())], ["block", "bucket", "words"])

    return run


# --- 3: ids by position ------------------------------------------------------------------------------


def _put_together(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        files, base = store(folder)
        with files.open_input_file(f"{base}/{table.column('block')[0].as_py()}") as stream:
            read = pa.ipc.open_file(stream)
            docs = read.get_batch(0).column("doc_id")
            counts, places, dealt = (unpack(x) for x in read.get_batch(1).column("data").to_pylist())
        sizes, ids = np.zeros(len(dealt), np.int64), []
        order = np.argsort(dealt, kind="stable")
        lists = sorted(zip(table.column("bucket").to_pylist(), table.column("words").to_pylist(), strict=True))
        cuts = [8 + int.from_bytes(x[:8], "little") for _, x in lists]
        sizes[order] = np.concatenate([unpack(x[8:z]) for (_, x), z in zip(lists, cuts, strict=True)])
        ids = np.concatenate([unpack(x[z:]) for (_, x), z in zip(lists, cuts, strict=True)]).astype(np.int32)
        starts = np.empty(len(dealt), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for i, j in slices(counts, OUT):
            own = places[ends[i] : ends[j]]
            upto = np.concatenate(([0], np.cumsum(sizes[own], dtype=np.int64)))
            lists_ = pa.ListArray.from_arrays(pa.array(upto[ends[i : j + 1] - ends[i]].astype(np.int32)), pa.array(ids[gathered(starts[own], sizes[own])]))
            yield pa.record_batch([docs.slice(i, j - i), lists_], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every text, by the rank file ``ranks`` that all executors have, without special
    tokens.  ``pattern`` must be the one that ``pretokens`` cuts by; each of its matches is encoded apart.

    Whole texts and id lists pass through Python: run it under ``small_batches``."""
    spark = docs.sparkSession
    folder, buckets = work_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    words = settle(rows.mapInArrow(_cut(folder, pretokens.character_kinds(pattern), buckets), _PACKED))
    coded = words.groupBy("bucket").applyInArrow(_encode_bucket(ranks, pattern), _PACKED)
    return coded.groupBy("block").applyInArrow(_put_together(folder), "doc_id bigint, ids array<int>")


def _decode(table: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            for i, j in slices(sizes, OUT):
                part = ids.slice(i, j - i)
                own = table.take(part.flatten())
                ends = np.concatenate(([0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False), dtype=np.int64)))
                upto = ends[np.concatenate(([0], np.cumsum(sizes[i:j], dtype=np.int64)))]
                body = own.buffers()[2] or pa.py_buffer(b"")
                whole = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(upto), body])
                whole = pc.if_else(part.is_null(), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "ids"), whole],
                    [*(c for c in batch.schema.names if c != "ids"), "bytes"],
                )

    return run


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The rows with ``bytes``, the decoded ids, in place of ``ids``."""
    table = read_ranks(ranks)
    by_id = [None] * (max(table.values()) + 1)
    for token, i in table.items():
        by_id[i] = token
    kept_ = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_), "bytes binary"])
    return encoded.select(*[f.name for f in kept_], "ids").mapInArrow(_decode(pa.array(by_id, pa.large_binary())), schema)
