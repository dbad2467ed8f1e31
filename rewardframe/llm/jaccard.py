"""N-gram Jaccard join by token-combination prefixes.

Tokens are the hashed 5-word shingles of a text.  Two sets of similarity 0.8 or more differ in so few
tokens that a short prefix of each, in one global order, must meet: at most n // 5 tokens of a set of
n are missing from the other.  The order puts rare tokens first.  Rare tokens are indexed one by one.
Tokens held by more than ``RARE`` documents are frequent: a lone one would fetch too many documents,
so they are dealt into subclasses and indexed by pairs within a subclass; each subclass then covers
one missing token less, and the prefix is extended until rare tokens and pairs together cover one
missing token more than there can be.  Which tokens are frequent only affects the cost.

1. Count the tokens over all texts and pick the frequent ones (at most ``MAX_FREQUENT``: the limit
   of what is rare doubles until they fit).
2. Build each text's set, its content key, a parity bitmap and its index entries; equal sets are one
   node from here on.
3. Entries with two nodes or more make buckets.  In each bucket one hub is compared with all others.
   Buckets whose nodes are not yet in one component then compare what is outside the hub's component
   with the rest.  So linked groups cost as many comparisons as they have nodes, not pairs of nodes.
   A pair that meets in many buckets is passed on by the first of them, and by few others.
4. Lengths and bitmaps discard pairs that can't be similar (two sets differ in at least as many
   tokens as their parity bitmaps differ in bits): a small bitmap inside the bucket join, one that
   grows with the set after it.  The rest are verified on the whole texts.

Defined cases: null and empty texts, and texts of white space, have no shingles and are linked with
nothing; repeated rows and texts with equal sets are in one component; a null id never is the id of
a component that has others; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, digest, packed, settle, small_batches, sorted_side, tidy, unpacked
from .shingles import mix, shingle_sets
from .workers import forget

RARE = 64  # documents that may hold a rare token
MAX_FREQUENT = 1_000_000  # frequent tokens sent to the tasks, 8 bytes each
BUCKET = 4_000_000  # tokens that a counting or indexing task gets, about
BITS = 512
SEEN = 16  # buckets that a node remembers
FAN = 256  # partners of a node that one verifying group holds
_U = np.uint64
_PAIR = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


# --- 1: frequent tokens ---------------------------------------------------------------------------


def _ranges(sorted_values: np.ndarray, buckets: int) -> np.ndarray:
    """Edges of the buckets that cut the 64-bit numbers into equal ranges."""
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_values, cuts), [len(sorted_values)]))


def _count_tokens(buckets: int):
    """Per batch and bucket: the distinct tokens, 3 bytes each, and further counts of those met again.

    Within a bucket 24 bits tell tokens apart well enough: two that share them are counted together,
    and at worst called frequent together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what an earlier operator left in this worker
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            tokens = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(tokens)))
            tokens = tokens[first]
            edges = _ranges(tokens, buckets)
            rows: list[tuple[int, bytes, bytes]] = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part, more = tokens[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]
                many = more > 1
                rows.append((b, _three(part, b, buckets).view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), np.concatenate((part[many], (more[many] - 1).astype(np.uint64))).tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "tokens", "extra"])

    return run


def _shift(buckets: int) -> int:
    """Lower bits that are cut off, so that what is left of a bucket's tokens fits 32 bits."""
    return max(33 - buckets.bit_length(), 0)


def _short(tokens: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The 32 bits of a token that follow from its bucket's start."""
    start = _U((bucket << 64) // buckets)
    return ((tokens - start) >> _U(_shift(buckets))).astype(np.uint32)


def _three(tokens: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The upper 24 of the 32 bits that follow from a token's bucket."""
    return (_short(tokens, bucket, buckets) >> np.uint32(8)).astype("<u4")


def _from_three(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def _frequent_of(buckets: int, least: int):
    """Tokens of a bucket counted over all batches: those with more than ``least``."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = key[0].as_py()
        values = np.concatenate([_from_three(x) for x in t["tokens"].to_pylist()])
        values.sort()
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        counts = np.diff(np.append(first, len(values)))
        values = values[first]
        for x in t["extra"].to_pylist():  # of tokens that are among the values
            tokens, more = np.frombuffer(x, np.uint64).reshape(2, -1)
            np.add.at(counts, np.searchsorted(values, _three(tokens, b, buckets)), more.astype(np.int64))
        kept = counts > least
        start = _U((b << 64) // buckets)
        # The token's lower bits are cut off: a frequent token is one with these upper bits.
        tokens = (values[kept].astype(np.uint64) << _U(_shift(buckets) + 8)) + start
        return pa.table({"token": tokens.view(np.int64), "docs": counts[kept]})

    return run


def frequent_tokens(texts: DataFrame, buckets: int, rare: int) -> np.ndarray:
    """Sorted starts of the frequent tokens' ranges (each 2^shift wide), ``MAX_FREQUENT`` at most."""
    counted = texts.mapInArrow(_count_tokens(buckets), "bucket int, tokens binary, extra binary")
    many = settle(counted.groupBy("bucket").applyInArrow(_frequent_of(buckets, rare), "token long, docs long"))
    sizes = many.groupBy(F.floor(F.log2("docs")).alias("p")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    power, left = 0, sum(r["n"] for r in sizes)
    while left > MAX_FREQUENT:
        power += 1
        left = sum(r["n"] for r in sizes if r["p"] >= power)
    found = many.filter(F.col("docs") >= 2**power).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


# --- 2: sets and index entries --------------------------------------------------------------------


def _is_frequent(tokens: np.ndarray, frequent: np.ndarray, width: int) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(frequent, tokens, "right") - 1
    return (at >= 0) & (tokens - frequent[at] < _U(width))


def entries(tokens: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set: single rare tokens, and pairs of frequent ones.

    Prefixes hold small hashes; entries are mixed again, so that they spread evenly over the buckets.
    """
    n, none = len(tokens), np.zeros(0, np.uint64)
    if n < 4:  # a set of another size can't be similar
        return none, none
    need = n // 5 + 1
    rare = tokens[~often]
    if len(rare) >= need:
        return mix(rare[:need]), none
    many, need = tokens[often], need - len(rare)
    pairs = []
    # A pair of sets meets in the size class of the larger one.
    for c in sorted({n.bit_length(), (n * 5 // 4).bit_length()}):
        group = (mix(many) >> _U(32)) % _U(max(1, (1 << c) // 16))
        _, first = np.unique(group, return_index=True)
        again = np.ones(len(many), np.int64)
        again[first] = 0
        stop = int(np.searchsorted(np.cumsum(again), need)) + 1
        order = np.argsort(group[:stop], kind="stable")
        t, g = many[:stop][order], group[:stop][order]
        for gap in range(1, stop):
            same = g[gap:] == g[:-gap] if gap < len(g) else np.zeros(0, bool)
            if not same.any():
                break
            pairs.append(mix(t[:-gap][same] * _PAIR[0] + t[gap:][same] * _PAIR[1] + _PAIR[2:] * _U(c)))
    return mix(rare), np.concatenate(pairs) if pairs else none


def _parity(tokens: np.ndarray, bits: int) -> bytes:
    """For each remainder modulo ``bits``, whether an odd number of tokens has it."""
    return np.packbits(np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ; the larger one is folded to the size of the smaller."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = min(len(a), len(b)) * 8
    for k, n in ((0, len(a) * 8), (1, len(b) * 8)):
        v = (x, y)[k]
        while n > size:
            n //= 2
            v = (v >> n) ^ (v & ((1 << n) - 1))
        x, y = (v, y) if k == 0 else (x, v)
    return (x ^ y).bit_count()


def _six(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each token: enough to bring sets together, which are then verified."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _describe(frequent, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tokens in shingle_sets(batch.column("text")):
                single, pair = entries(tokens, _is_frequent(tokens, frequent.value, width))
                key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
                # The wide bitmap has two to four bits per token.
                bits, wide = _parity(tokens, BITS), _parity(tokens, max(16, 2 << (len(tokens) - 1).bit_length()))
                out.append((len(tokens), key, bits, wide, _six(single), pair.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.binary()] * 5), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("tkey"), *made], ["doc_id", "tkey", "n", "key", "bits", "wide", "single", "pair"])

    return run


def _deal(buckets: int):
    """Single entries of a batch, by bucket: 32 bits of each, and its row as a distance from a base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_from_six(x) for x in batch.column("single").to_pylist()]
            rows = np.repeat(batch.column("row").to_numpy(), [len(x) for x in values])
            values = np.concatenate(values) if values else np.zeros(0, np.uint64)
            # Rows of one file are near each other.
            for file in np.unique(rows >> 32):
                own = rows >> 32 == file
                order = np.argsort(values[own])
                v, base = values[own][order], int(rows[own].min())
                away = rows[own][order] - base
                away = away.astype(np.uint16 if away.max() < 1 << 16 else np.uint32)
                edges = _ranges(v, buckets)
                full = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.record_batch([
                    pa.array(full, pa.int32()),
                    pa.array([_short(v[edges[b] : edges[b + 1]], b, buckets).tobytes() for b in full], pa.binary()),
                    pa.array([base] * len(full), pa.int64()),
                    pa.array([away[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                ], ["bucket", "values", "base", "rows"])

    return run


def _meet(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Groups of rows that share an entry of the bucket, each group of rows once."""
    values = [np.frombuffer(x, np.uint32) for x in t["values"].to_pylist()]
    rows = np.concatenate([
        np.frombuffer(x, np.uint16 if len(x) == 2 * len(v) else np.uint32).astype(np.int64) + base
        for v, base, x in zip(values, t["base"].to_pylist(), t["rows"].to_pylist(), strict=True)
    ])
    values = np.concatenate(values)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), len(values))
    many = np.flatnonzero(np.diff(edges) > 1)
    groups = {np.sort(rows[edges[i] : edges[i + 1]]).tobytes() for i in many.tolist()}
    return pa.table({"rows": pa.array([np.frombuffer(g, np.int64) for g in groups], pa.list_(pa.int64()))})


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.frombuffer(x, np.int64) for x in batch.column("pair").to_pylist()]
        rows = np.repeat(batch.column("row").to_numpy(), [len(x) for x in values])
        yield pa.record_batch([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), pa.array(rows)], ["g", "node"])


# --- 3 and 4: pairs, links, components ------------------------------------------------------------


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (x, salt, y, text): a row with y = x brings the text that the next are compared with."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        found = []
        for x, y, tokens in zip(xs, ys, shingle_sets(batch.column("text")), strict=True):
            if x == y:
                hub, own = x, tokens
                continue
            if hub != x:
                raise ValueError(f"text of node {x} is missing")
            both = len(np.intersect1d(own, tokens, assume_unique=True))
            if 100 * both >= 80 * (len(own) + len(tokens) - both):
                found.append((x, y))
        yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys, nx, ny, wx, wy = (batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny", "wx", "wy"))
        kept = [9 * differing(a, b) <= m + n for a, b, m, n in zip(wx, wy, nx, ny, strict=True)]
        yield pa.record_batch([pa.array([v for v, k in zip(c, kept, strict=True) if k], pa.int64()) for c in (xs, ys)], ["x", "y"])


def near_pairs(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs (x, y) whose wide bitmaps (about: node, a.n, wide) don't rule them out."""
    side = lambda k: about.select(F.col("node").alias(k), F.col("a.n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
    both = pairs.join(sorted_side(side("x")), "x").join(sorted_side(side("y")), "y")
    return both.select("x", "y", "nx", "ny", "wx", "wy").mapInArrow(_near, "x long, y long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) of nodes whose texts (node, text) are similar.

    The text of x is sent once to each group of at most about ``FAN`` partners, so a node with very
    many partners is spread over many groups.
    """
    pairs = settle(pairs)
    fans = settle(pairs.groupBy("x").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans")))
    partners = pairs.join(fans, "x").select("x", F.pmod(F.xxhash64("y"), F.col("fans")).cast("int").alias("salt"), F.col("y").alias("node"))
    hubs = fans.select("x", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.col("x").alias("node"))
    rows = texts.join(sorted_side(partners.union(hubs)), "node").withColumn("late", (F.col("x") != F.col("node")).cast("int"))
    rows = rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "late").select("x", F.col("node").alias("y"), "text")
    return settle(rows.mapInArrow(_verify, "x long, y long"))


def components(links: DataFrame) -> DataFrame:
    """Component (smallest node) of every node of the links (x, y).

    Each round takes the smallest label among a node's neighbours and then the label of that label;
    labels are settled, so rounds do not build on each other's lineage.
    """
    ends = settle(links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = settle(ends.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")))
    while True:
        near = ends.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", "comp", F.least("comp", "near").alias("best"))
        over = labels.select(F.col("node").alias("best"), F.col("comp").alias("over"))
        after = settle(step.join(over, "best").select("node", F.least("best", "over").alias("next"), (F.least("best", "over") != F.col("comp")).alias("moved")))
        moved = after.filter("moved").limit(1).count()
        labels = after.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels


def _close(x: str, y: str):
    """Bounds that similar sets meet: lengths, and bits in which the small bitmaps differ."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(
        (F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0)
    )
    return (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (9 * apart <= nx + ny)


def with_seen(posted: DataFrame) -> DataFrame:
    """Adds ``seen``: the node's last ``SEEN`` buckets before this one, in the order of their keys.

    Two nodes whose lists share a bucket have met there, or before it: texts that share a passage share
    hundreds of buckets, and are to be compared in one or a few of them.  In the first bucket that they
    share, their lists have nothing in common.
    """
    before = Window.partitionBy("node").orderBy("g").rowsBetween(-SEEN, -1)
    return posted.withColumn("seen", F.collect_list("g").over(before))


def open_pairs(left: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes of different components that share a bucket of ``left`` (g, node, comp, bulk, a, seen)."""
    out = left.filter("comp <> bulk").select("g", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("a").alias("h"), F.col("seen").alias("sx"))
    inner = left.select(F.col("g").alias("g2"), F.col("node").alias("y"), F.col("comp").alias("cy"), "a", "bulk", F.col("seen").alias("sy"))
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("bulk")) | (F.col("x") < F.col("y")))
    pairs = out.join(inner, (F.col("g") == F.col("g2")) & apart & _close("h", "a") & ~F.arrays_overlap("sx", "sy"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _identity(doc_id: str, tkey: str):
    """Key of the rows with one id and one text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.hex(tkey))))


def links_of(described: DataFrame, docs: DataFrame, doc_id: str, text: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, low: smallest doc_id) and the components (node, comp) of the linked ones."""
    sets = described.filter("n > 0")
    nodes = settle(sets.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")))
    rows = sets.select("row", "key").join(nodes.select("key", "node"), "key").select("row", "node")
    rows = settle(rows)

    single = sets.filter(F.octet_length("single") > 0).select("row", "single").mapInArrow(_deal(buckets), "bucket int, values binary, base long, rows binary")
    groups = settle(single.groupBy("bucket").applyInArrow(_meet, "rows array<long>").distinct())
    from_single = groups.select(F.xxhash64("rows").alias("g"), F.explode("rows").alias("row")).join(rows, "row").select("g", "node")
    paired = sets.filter(F.octet_length("pair") > 0).select("row", "pair").join(rows.filter("row = node").select("row"), "row", "left_semi")
    from_pair = paired.mapInArrow(_unfold, "g long, node long")
    posted = settle(from_single.union(from_pair).distinct())
    live = posted.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    shape = F.array(*[F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(BITS // 64)])
    about = settle(sets.join(rows.filter("row = node").select("row"), "row", "left_semi").select(
        F.col("row").alias("node"), "wide", F.struct("n", shape.alias("bits"), F.xxhash64("row").alias("u"), F.col("row").alias("id")).alias("a")
    ))
    posted = settle(posted.join(live, "g").join(about.select("node", "a"), "node"))

    hubs = settle(posted.groupBy("g").agg(F.min(F.struct("a.u", "a.id"))["id"].alias("hub"), F.count("*").alias("c")).join(about.select(F.col("node").alias("hub"), F.col("a").alias("h")), "hub"))
    first = posted.join(hubs, "g").filter((F.col("hub") != F.col("node")) & _close("h", "a")).select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()

    used = posted.select("node").distinct()
    wanted = described.join(used, described["row"] == used["node"]).select("node", _identity("doc_id", "tkey").alias("same"))
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tkey", digest(F.col("text")))
    body = body.select("text", _identity("doc_id", "tkey").alias("same"))
    texts = settle(body.join(sorted_side(settle(wanted)), "same").dropDuplicates(["same"]).select("node", "text"))

    near = verified(near_pairs(first, about), texts)
    found = components(near)
    posted = settle(posted.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    open_ = posted.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("a.u", "comp"))["comp"].alias("bulk")).filter("lo <> hi").select("g", "bulk")
    rest = open_pairs(settle(with_seen(posted.join(settle(open_), "g"))))
    far = verified(near_pairs(rest.distinct(), about), texts)
    # Components so far stand for their nodes: new links join components.
    linked = found.select(F.col("node").alias("x"), F.col("comp").alias("y")).union(far)
    return nodes, components(linked)


@tidy
@small_batches
def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE) -> DataFrame:
    """One row per document: doc_id, tkey (content key of the text), n_shingles, component_id, keeps.

    ``component_id`` is the smallest doc_id reachable by links.  ``keeps`` marks one content of each
    component (the smallest id, then key); all documents without shingles keep.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (6 * BUCKET)))
    frequent = frequent_tokens(rows.select("text"), buckets, rare)
    sent = spark.sparkContext.broadcast(frequent)
    schema = ", ".join(f"{n} {t}" for n, t in (("doc_id", rows.schema["doc_id"].dataType.simpleString()), ("tkey", "binary"), ("n", "long"), ("key", "binary"), ("bits", "binary"), ("wide", "binary"), ("single", "binary"), ("pair", "binary")))
    described = rows.select("doc_id", digest(F.col("text")).alias("tkey"), "text").mapInArrow(_describe(sent, 1 << (_shift(buckets) + 8)), schema)
    described = settle(described.withColumn("row", F.monotonically_increasing_id()))
    nodes, comps = links_of(described, docs, doc_id, text, buckets)
    nodes = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = settle(nodes)
    lows = settle(nodes.groupBy("comp").agg(F.min("low").alias("component_id")))
    nodes = settle(nodes.join(lows, "comp").select("key", "comp", "component_id"))
    narrow = described.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "key")
    joined = settle(narrow.join(nodes, "key", "left"))
    best = settle(joined.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("best")))
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    return joined.join(best, "comp", "left").select(
        "doc_id", "tkey", "n_shingles",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("comp").isNull(), True).otherwise(chosen).alias("keeps"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component left, with their columns."""
    kept = join_similar(docs, doc_id, text).filter("keeps AND n_shingles > 0").select(_identity("doc_id", "tkey").alias("same"))
    kept = settle(kept.distinct())
    full = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    rows = docs.filter(full).select(packed(docs).alias("row"), F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("tkey"))
    # Of rows that repeat the kept id and text one stays: each task passes on one, before rows are dealt.
    rows = rows.select("row", _identity("doc_id", "tkey").alias("same")).dropDuplicates(["same"])
    # An inner join: a semi join would be moved below, where whole groups are dealt.
    rows = rows.join(sorted_side(kept), "same").select("row")
    # Rows without words have no shingles; all of them stay.
    return unpacked(rows.unionAll(docs.filter(~full).select(packed(docs).alias("row"))), docs)
