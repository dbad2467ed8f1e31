"""Token ids as length-delimited binary records, with an offset index.

A file is a sequence of frames.  Each frame is: length of the payload (8 bytes), masked checksum of
the length (4), payload, masked checksum of the payload (4), all little-endian.  A payload is: bytes
per id (1), 1 if an id of the document follows (1), that id (8), the token ids.  The checksum is
CRC-32, rotated and shifted by a constant as record files commonly do, so that checksums over data
that hold checksums stay sound.  The index has a row per record (file, offset, length, doc_id,
n_tokens), so shuffled readers can fetch any record by itself.

Files follow each other in ascending order of doc_id, and so do the records of a file.

Defined cases: a null or empty text is a record of the end id alone; null ids come first; repeated
rows give repeated records, rows of one id are ordered by the first ``TIE`` characters of their texts, then
by a hash of them; an empty table gives no records; further
columns are left alone.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import gathered
from .common import settle, shared_folder, small_batches
from .files import store, whole_file
from .workers import kept

END_ID = 2
SLICE = 8 << 20  # bytes of text encoded at once
CACHE = 600_000  # words, and pre-tokens, whose ids a Python worker remembers
TOGETHER = 64  # pre-tokens that the tokenizer gets at once
MARK = "\x01"
TIE = 16  # characters of a text that order the rows of one id
# How the tokenizer cuts words into pre-tokens, and the same for visible ASCII characters in lower case.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_MASK = 0xA282EAD8
_HEAD = "<QI"  # length and its checksum
_LEAD = "<BBq"  # bytes per id, whether a document id follows, the id


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    """``ids`` has the file's type, two or four bytes per id."""
    return struct.pack(_LEAD, ids.dtype.itemsize, doc_id is not None, doc_id or 0) + ids.tobytes()


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack_from(_LEAD, payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_LEAD))


def read_frames(stream) -> Iterator[bytes]:
    """Payloads of a stream of frames; a wrong checksum or a cut-off frame is an error."""
    while head := stream.read(struct.calcsize(_HEAD)):
        size, check = struct.unpack(_HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError("wrong checksum of a length")
        body = stream.read(size + 4)
        payload, check = bytes(body[:size]), struct.unpack("<I", body[size:])[0]
        if masked(payload) != check:
            raise ValueError("wrong checksum of a payload")
        yield payload


class WordEncoder:
    """Token ids of texts, by a tokenizer that drops white space and never joins words across it.

    Each distinct word is encoded by the tokenizer once and its ids are kept; texts are put together
    from them.  Beyond ``CACHE`` words the older half is forgotten.  An encoder belongs to a Python worker, so
    what one task has learned serves the next.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        largest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.bare, self.pieces = self._bare(), {}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words = pa.array(["", " "], pa.large_string())  # the second, no word, is the end of a text
        self.table, self.used = np.zeros(1 << 20, np.uint32), 1
        self.table[0] = self.end_id
        self.start, self.size = np.zeros(CACHE * 2, np.int64), np.zeros(CACHE * 2, np.int64)
        self.size[1] = 1

    def forget(self) -> None:
        """Drops the older half of the words."""
        at = np.concatenate(([0, 1], np.arange(2 + len(self.words) // 2, len(self.words))))
        sizes = self.size[at]
        ids = self.table[gathered(self.start[at], sizes)]
        self.words = self.words.take(pa.array(at))
        self.table[: len(ids)], self.used = ids, len(ids)
        self.start[: len(at)], self.size[: len(at)] = np.cumsum(sizes) - sizes, sizes

    def _bare(self):
        """The merges alone, for words of visible ASCII characters, whose pre-tokens a plain pattern finds; None if
        the tokenizer does something else with them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        told = json.loads(self.tokenizer.to_str())
        steps = [x.get("pattern", {}).get("Regex") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lowers = any(x["type"] == "Lowercase" for x in (told["normalizer"] or {}).get("normalizers", []))
        if not lowers or _PRE_TOKENS not in steps or told["model"].get("end_of_word_suffix") != "</w>":
            return None
        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        return bare

    def _learn_pieces(self, pieces: list[str]) -> None:
        texts = [" ".join(pieces[lo : lo + TOGETHER]) for lo in range(0, len(pieces), TOGETHER)]
        found = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("a pre-token does not end where its last token does")
        flat, starts = ids.tolist(), [0, *ends[:-1].tolist()]
        self.pieces.update(zip(pieces, [flat[a:z] for a, z in zip(starts, ends.tolist(), strict=True)], strict=True))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        plain = self.bare is not None
        cut = [_PLAIN.findall(w.lower()) if plain and w.isascii() and w.isprintable() and "<|" not in w else None for w in words]
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        known = self.pieces
        new = list({p for x in cut if x for p in x if p not in known})
        if new:
            self._learn_pieces(new)
        others = [w for w, x in zip(words, cut, strict=True) if x is None]
        told = iter(self._whole(others))
        found = [next(told) if x is None else known[x[0]] if len(x) == 1 else list(itertools.chain.from_iterable([known[p] for p in x])) for x in cut]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Ids of words by all steps of the tokenizer, many words at a time with a mark between them; words that hold the
        mark alone."""
        if self.mark is None or any(MARK in w for w in words):
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        texts = [f" {MARK} ".join([*words[lo : lo + TOGETHER], ""]) for lo in range(0, len(words), TOGETHER)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep the mark between words")
        starts = np.append(0, ends[:-1] + 1).tolist()
        flat = ids.tolist()
        return [flat[a:z] for a, z in zip(starts, ends.tolist(), strict=False)]

    def learn(self, words: pa.Array) -> None:
        for at in range(0, len(words), 10_000):
            part = words.slice(at, 10_000).to_pylist()
            sizes, ids = self._ids(part)
            n, k = len(part), len(self.words) + at
            while self.used + len(ids) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            while k + n > len(self.start):
                self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
            self.table[self.used : self.used + len(ids)] = ids
            self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
            self.size[k : k + n] = sizes
            self.used += len(ids)
        self.words = pa.concat_arrays([self.words, words])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text and the end id."""
        if len(self.words) > CACHE:
            self.forget()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        if found.null_count:
            self.learn(coded.dictionary.filter(found.is_null()))
            found = pc.index_in(coded.dictionary, value_set=self.words)
        places = found.to_numpy(zero_copy_only=False).astype(np.int64)
        words = places[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64)
        # One end mark after the words of each text.
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        words = np.insert(words, ends, 1)
        sizes = self.size[words]
        after = np.cumsum(sizes)
        ids = self.table[np.repeat(self.start[words] - after + sizes, sizes) + np.arange(after[-1])].astype(self.kind)
        stops = after[ends + np.arange(len(ends))]
        first = 0
        for stop in stops.tolist():
            yield ids[first:stop]
            first = stop


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i, before = 0, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield texts.slice(i, j - i)
        i, before = j, int(sizes[j - 1])


def _writer(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0
        name = f"part-{TaskContext.get().partitionId():06d}.rec"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder = kept(("words", path, end_id), lambda: WordEncoder(path, end_id))
        with whole_file(folder, name) as out:
            while first is not None:
                texts = first.column("text").cast(pa.large_string()).fill_null("")
                own, at = first.column("doc_id").to_pylist(), 0
                rows: list[tuple[int, int, int]] = []
                for part in _slices(texts):
                    written = []
                    for ids in encoder.encode(part):
                        data = frame(payload_of(own[at], ids))
                        rows.append((offset, len(data), len(ids)))
                        offset += len(data)
                        at += 1
                        written.append(data)
                    out.write(b"".join(written))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch([pa.array([name] * len(rows)), *cols, pa.array(own, pa.int64())], ["file", "offset", "length", "n_tokens", "doc_id"])
                first = next(batches, None)

    return run


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """Writes the record files and, as a table under ``folder``/index, their index; returns the index.

    ``tokenizer`` is the path of a tokenizer file on the executors.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Rows of one id, such as those without, are dealt too: by how their texts begin, by a hash, equal ones by their place.
    keys = [F.substring("text", 1, TIE), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({f"_tie{i}": k for i, k in enumerate(keys)})
    order = ["doc_id", *[f"_tie{i}" for i in range(len(keys))]]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = ordered.mapInArrow(_writer(tokenizer, end_id, folder), "file string, offset long, length long, n_tokens long, doc_id long")
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        names = ["file", "place", "doc_id", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, lean in zip(batch.column("file").to_pylist(), batch.column("lean").to_pylist(), strict=True):
                rows, size, place = [], 0, 0
                with files.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    for payload in read_frames(stream):
                        doc, ids = read_payload(payload)
                        wide = ids.astype("<u4").tobytes()
                        rows.append((name, place, doc, len(ids), zlib.crc32(wide), None if lean else wide))
                        place, size = place + 1, size + (0 if lean else len(wide))
                        if len(rows) >= 10_000 or size >= 16 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_records(spark: SparkSession, folder: str, lean: bool = False) -> DataFrame:
    """Records of a folder from its files: file, place, doc_id, n_tokens, ids_crc32, ids, start.

    ``start`` counts the ids of all records before; ``ids`` are 4-byte little-endian numbers, left out
    if ``lean``.  Only sums by file are put in one order.
    """
    index = spark.read.schema("file string, offset long, length long, n_tokens long, doc_id long").parquet(f"{folder}/index")
    files = index.select("file").distinct().withColumn("lean", F.lit(lean))
    rows = files.repartition("file").mapInArrow(_reader(folder), "file string, place long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    rows = settle(rows)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, rows["file"] == sums["of"]).withColumn("start", F.col("base") + F.col("inside")).drop("of", "base", "inside")


@small_batches
def export(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the documents to a new folder and reads them back, without the ids themselves."""
    folder = shared_folder(docs.sparkSession)
    write_records(docs, folder, tokenizer, doc_id, text, end_id)
    return read_records(docs.sparkSession, folder, lean=True).drop("ids")
