"""WARC archives with a merged capture index.

Pages are written as WARC records, one gzip member each.  Of equal payloads of ``REVISIT`` bytes or
more one is a response, the others are revisits that refer to it.  Each writing task also writes its
capture index as sorted runs: lines of URL key, timestamp, archive, offset and length, cut into
compressed blocks.  The runs are merged outside memory: the key space is cut into ranges, and for
each range a task streams the blocks of all runs through a loser tree, one block of each run at a
time, which yields the capture history of every URL in one global order.  Where there are more runs
than ``FAN_IN``, they are first merged in groups.  Archives are read back by the merged index.

Defined cases: a null html is an empty payload; a null URL has the key ``-``; a null page_id is kept as
null, and never is the largest id unless no other holds the payload; rows that repeat the largest id
are all responses; an empty table gives empty archives and index; further columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_folder, sorted_side
from .files import store, whole_file

REVISIT = 1000  # least payload bytes that are not written again
RUN = 100_000  # captures of a sorted run
BLOCK = 2_000  # captures of an index block
RANGE = 200_000  # captures that a merging task gets, about
FAN_IN = 256  # runs that a merging task reads at once
LEVEL = 1
_DAY0 = datetime(2024, 1, 1, tzinfo=UTC)


# --- records --------------------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort key of a URL: host parts from the top down, then path and query, lower-cased."""
    m = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return re.sub(r"\s", "%20", (url or "").lower()) or "-"
    host = m[1].lower().rpartition("@")[2]
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/"))


def captured(page_id: int | None) -> datetime:
    """Capture time of a page that comes without one: a minute for each id."""
    return _DAY0 + timedelta(minutes=(page_id or 0) % 500_000)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if it refers to another page; not yet compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = captured(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {when}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '-')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _number(urn: str) -> int | None:
    tail = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "none" else int(tail)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload bytes, payload digest, record type, refers_to and stored payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("wrong length of a record")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError("wrong digest of a payload")
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    to = fields.get("WARC-Refers-To")
    return _number(fields["WARC-Record-ID"]), size, stated, kind, _number(to) if to else None, payload


# --- index blocks ---------------------------------------------------------------------------------


class BlockWriter:
    """Writes sorted index lines as compressed blocks and notes what each block holds."""

    def __init__(self, out, name: str, run: str):
        self.out, self.name, self.run = out, name, run
        self.offset, self.lines, self.blocks = 0, [], []

    def add(self, line: bytes) -> None:
        self.lines.append(line)
        if len(self.lines) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            data = zlib.compress(b"\n".join(self.lines), LEVEL)
            self.out.write(data)
            self.blocks.append((self.run, self.name, self.offset, len(data), len(self.lines), self.lines[0], self.lines[-1]))
            self.offset += len(data)
            self.lines = []


_BLOCKS = "run string, file string, offset long, length long, n long, first binary, last binary"
_BLOCK_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_BLOCK_NAMES = ["run", "file", "offset", "length", "n", "first", "last"]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_BLOCK_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{TaskContext.get().partitionId():06d}"
        name, offset, lines, runs = f"pages-{task}.warc.gz", 0, [], 0

        def sorted_run() -> list[tuple]:
            nonlocal lines, runs
            own = f"run-{task}-{runs:04d}"
            with whole_file(folder, f"{own}.idx") as out:
                blocks = BlockWriter(out, f"{own}.idx", own)
                for line in sorted(lines):
                    blocks.add(line)
                blocks.flush()
            lines, runs = [], runs + 1
            return blocks.blocks

        with whole_file(folder, name) as out:
            for batch in batches:
                for page, url, html, digest, to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                    pack = zlib.compressobj(LEVEL, wbits=31)
                    data = pack.compress(record(page, url, (html or "").encode(), digest, to)) + pack.flush()
                    out.write(data)
                    lines.append(f"{url_key(url)} {captured(page):%Y%m%d%H%M%S} {name} {offset:012d} {len(data)}".encode())
                    offset += len(data)
                    if len(lines) >= RUN:
                        yield _blocks(sorted_run())
        if lines:
            yield _blocks(sorted_run())

    return run


# --- external merge -------------------------------------------------------------------------------


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, the winner moves on.

    Taking a line costs one comparison per level of the tree.
    """

    def __init__(self, runs: list[Iterator[bytes]]):
        self.runs, self.k = runs, len(runs)
        self.heads: list[bytes | None] = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Plays the matches on the way from leaf ``i`` to the top."""
        at, winner = (i + self.k) // 2, i
        while at > 0:
            other = self.losers[at]
            if other == -1:  # the first one here waits for its opponent
                self.losers[at] = winner
                return
            if self._before(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while self.k:
            top = self.losers[0]
            line = self.heads[top]
            if line is None:
                return
            yield line
            self.heads[top] = next(self.runs[top], None)
            at, winner = (top + self.k) // 2, top
            while at > 0:
                if self._before(self.losers[at], winner):
                    self.losers[at], winner = winner, self.losers[at]
                at //= 2
            self.losers[0] = winner


def _stream(files, base: str, blocks: list[tuple[str, int, int]], low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """Lines of a run's blocks, in order, from ``low`` to below ``high``; one block is held at a time."""
    for name, offset, length in blocks:
        with files.open_input_file(f"{base}/{name}") as f:
            f.seek(offset)
            data = zlib.decompress(f.read(length))
        for line in data.split(b"\n"):
            if (low is None or line >= low) and (high is None or line < high):
                yield line


def _merge(folder: str, level: int, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each (grp, part); rows are sorted by these, then run, then first."""
    files, base = store(folder)

    def merged(key: tuple, runs: dict[str, list], low: bytes | None, high: bytes | None) -> pa.RecordBatch:
        name = f"merge-{level}-{key[0]:06d}-{key[1]:06d}.idx"
        with whole_file(folder, name) as out:
            blocks = BlockWriter(out, name, f"merge-{level}-{key[0]:06d}")
            for line in LoserTree([_stream(files, base, b, low, high) for b in runs.values()]):
                blocks.add(line)
            blocks.flush()
        return _blocks(blocks.blocks)

    key, runs, bounds = None, {}, (None, None)
    for batch in rows:
        for grp, p, run, name, offset, length, low, high in zip(*[batch.column(c).to_pylist() for c in ("grp", "part", "run", "file", "offset", "length", "low", "high")], strict=True):
            if (grp, p) != key:
                if key is not None:
                    yield merged(key, runs, *bounds)
                key, runs, bounds = (grp, p), {}, (low, high)
            runs.setdefault(run, []).append((name, offset, length))
    if key is not None:
        yield merged(key, runs, *bounds)


def merge_runs(blocks: DataFrame, folder: str, fan_in: int = FAN_IN, per_range: int = RANGE) -> DataFrame:
    """Merges all runs into one: the blocks of the result, whose order by ``first`` is the global one.

    ``blocks`` tells what each block of each run holds.  Only the edges of the ranges and counts come
    to the driver.
    """
    spark, level = blocks.sparkSession, 0
    while True:
        runs, lines = blocks.agg(F.count_distinct("run"), F.sum("n")).first()
        if not runs or (runs == 1 and level):
            return blocks
        groups = -(-runs // fan_in)
        parts = max(1, min(4096, -(-lines // per_range)))
        edges: list[bytes] = []
        if parts > 1:
            spans = blocks.select("first").repartitionByRange(parts, "first").groupBy(F.spark_partition_id().alias("p"))
            edges = sorted(r["e"] for r in spans.agg(F.min("first").alias("e")).collect())[1:]  # 4,095 at most
        ranges = spark.createDataFrame(
            [(i, bytes(a) if a is not None else None, bytes(b) if b is not None else None) for i, (a, b) in enumerate(zip([None, *edges], [*edges, None], strict=True))],
            "part int, low binary, high binary",
        )
        group = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int") if groups > 1 else F.lit(0)
        meets = (F.col("low").isNull() | (F.col("last") >= F.col("low"))) & (F.col("high").isNull() | (F.col("first") < F.col("high")))
        rows = blocks.withColumn("grp", group).join(F.broadcast(ranges), meets)  # 4,096 ranges at most
        rows = rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "run", "first")
        level += 1
        blocks = settle(rows.mapInArrow(partial(_merge, folder, level), _BLOCKS))
        if groups == 1:
            return blocks


def _lines(folder: str):
    """Captures of index blocks: key, timestamp, archive, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            for name, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                rows = [x.decode().split(" ") for x in _stream(files, base, [(name, offset, length)], None, None)]
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([
                    pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]),
                    pa.array(list(map(int, cols[3])), pa.int64()), pa.array(list(map(int, cols[4])), pa.int64()),
                ], ["url_key", "timestamp", "archive", "offset", "length"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        name, f = None, None
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    name, f = archive, files.open_input_file(f"{base}/{archive}")
                f.seek(offset)
                rows.append((*parse(zlib.decompress(f.read(length), wbits=31))[:5], archive, offset))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        if f is not None:
            f.close()

    return run


# --- jobs -----------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives and sorted index runs to ``folder``; returns the runs' blocks."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.withColumn("digest", F.sha1(body))
    # The id of the response for each payload that is long enough and held twice.
    keep = rows.filter(F.octet_length(body) >= REVISIT).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("c"))
    keep = settle(keep.filter("c > 1").select("digest", "top"))
    rows = rows.join(sorted_side(keep), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    rows = rows.select("page_id", "url", "html", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    return settle(rows.mapInArrow(_write(folder), _BLOCKS))


def capture_index(blocks: DataFrame, folder: str, fan_in: int = FAN_IN, per_range: int = RANGE) -> DataFrame:
    """All captures in global order: block (its first line), url_key, timestamp, archive, offset, length."""
    merged = merge_runs(blocks, folder, fan_in, per_range)
    return merged.repartitionByRange("first").sortWithinPartitions("first").select("file", "offset", "length").mapInArrow(
        _lines(folder), "url_key string, timestamp string, archive string, offset long, length long"
    )


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index lists, from the archives; digests and lengths are checked."""
    rows = index.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(
        _read(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long",
    )


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to a new folder and reads them back through the merged index."""
    folder = shared_folder(pages.sparkSession)
    blocks = write_archives(pages, folder, page_id, url, html)
    return read_archives(capture_index(blocks, folder), folder)
