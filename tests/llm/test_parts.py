"""Helpers that run inside tasks, against naive versions."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import shingles, tokenizer

from rewardframe.llm import jaccard, records, repeats, rlbwt, urls, warc, workers
from rewardframe.llm.queries import tokenizer_path
from rewardframe.llm.shingles import shingle_sets

TEXTS = [None, "", " \t\n", "one", "one two three", "One two three four five", "a b c d e f g a b c d e", "x" * 3000, "é Ä ß " * 40,
         "a\x0bb\x0cc\rd\ne", "\x1f\x85   u v w x y z"]


def test_shingle_sets():
    got = list(shingle_sets(pa.array(TEXTS)))
    assert [len(x) for x in got] == [len(shingles(t)) for t in TEXTS]
    same = list(shingle_sets(pa.array(["A B c d e f", "a b\tC d\n e F", "a b c d e", "a b c d", "a b c d f"])))
    assert (same[0] == same[1]).all() and same[2][0] in same[0] and same[3][0] != same[4][0]
    assert all((np.diff(x.astype(object)) > 0).all() for x in got)


def test_shingles_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n)) for n in (5, 2000, 40, 0, 7000, 3)]
    whole = [x.tolist() for x in shingle_sets(pa.array(texts))]
    monkeypatch.setitem(shingle_sets.__globals__["_chunks"].__globals__, "CHUNK", 1000)
    monkeypatch.setitem(shingle_sets.__globals__, "_powers", {})
    assert [x.tolist() for x in shingle_sets(pa.array(texts))] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]


def test_entries_meet():
    """Similar sets share an entry, whatever is frequent."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(4, 120))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        lose = int(rng.integers(0, n // 5 + 1))
        other = np.concatenate((base[lose:], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)))
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        often = rng.random() * 1.1
        frequent = np.sort(a[rng.random(len(a)) < often])
        sig = []
        for s in (a, b):
            one, two = jaccard.entries(s, np.isin(s, frequent))
            sig.append((set(one.tolist()), set(two.tolist())))
        assert sig[0][0] & sig[1][0] or sig[0][1] & sig[1][1]


def test_pairs_of_many_buckets_are_passed_on_once(spark):
    """All pairs that share a bucket are found, and hundreds of shared buckets do not multiply them."""
    rng = random.Random(11)
    rows, pairs = [], set()
    for g in range(300):
        nodes = rng.sample(range(12), 9) if g < 280 else rng.sample(range(10, 40), 3)
        rows += [(g, n, n // 2, nodes[0] // 2, {"n": 10, "bits": [0] * (jaccard.BITS // 64)}) for n in nodes]
        pairs |= {(x, y) for x in nodes for y in nodes if x < y and x // 2 != y // 2}
    posted = spark.createDataFrame(rows, "g long, node long, comp long, bulk long, a struct<n:long,bits:array<long>>")
    got = [tuple(r) for r in jaccard.open_pairs(jaccard.with_seen(posted)).collect()]
    assert set(got) == pairs
    assert len(got) < 2 * len(pairs)


def test_frequent_tokens_of_a_bucket():
    sets = [[1 << 60, 2 << 60, 2 << 60, 3 << 60], [2 << 60, 3 << 60], [3 << 60]]
    batches = [pa.record_batch([pa.array([0]), pa.array([0])], ["doc_id", "x"]) for _ in sets]
    made = jaccard._count_tokens(1)
    given = iter([np.array(x, np.uint64) for x in sets])
    with pytest.MonkeyPatch.context() as m:
        m.setitem(made.__globals__, "shingle_sets", lambda column: [next(given)])
        rows = pa.Table.from_batches(list(made(iter(batches))))
    got = jaccard._frequent_of(1, 2)((pa.scalar(0),), rows).to_pylist()
    assert [(r["token"] >> 60, r["docs"]) for r in got] == [(2, 3), (3, 3)]


def test_workers_forget():
    made = []
    for _ in range(2):
        workers.kept("t", lambda: made.append(1))
    assert len(made) == 1
    workers.forget()
    workers.kept("t", lambda: made.append(1))
    assert len(made) == 2


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(50))
        texts = list({
            bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) + base[rng.randint(0, 25) : rng.randint(25, 50)]
            + bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))
        })
        got, begins = rlbwt.matching_statistics(texts)
        for i, t in enumerate(texts):
            for p in range(len(t)):
                best = 0
                for j, u in enumerate(texts):
                    for q in range(len(u)):
                        k = 0
                        while (i, p) != (j, q) and p + k < len(t) and q + k < len(u) and t[p + k] == u[q + k]:
                            k += 1
                        best = max(best, k)
                assert got[begins[i] + p] == best


def test_run_index_is_small_for_alike_texts():
    rng = random.Random(5)
    letters = b"abcdefghijklmnopqrstuvwxyz "
    base = bytes(rng.choice(letters) for _ in range(330))
    texts = []
    for i in range(400):
        own = bytearray(base[: rng.randint(250, 330)])
        own[rng.randrange(250)] = 65 + i % 26
        texts.append(bytes(own))
    texts = list(set(texts))
    index = rlbwt.RunIndex.build(texts)
    size = sum(map(len, texts))
    assert len(index.heads) < size / 8 and len(index.pack()) < size / 4
    back = rlbwt.RunIndex.unpack(index.pack())
    sizes = np.array(list(map(len, texts)))
    assert (back.statistics(sizes)[0] == index.statistics(sizes)[0]).all()
    # Where texts differ from all others, the index is no smaller than they are: runs are short.
    other = [bytes(rng.choice(letters) for _ in range(300)) for _ in range(50)]
    assert len(rlbwt.RunIndex.build(other).heads) > 0.8 * sum(map(len, other))


def test_anchors_depend_on_windows_alone(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcd") for _ in range(9000))

    def found(t):
        return sorted((t[a : z + 40], int(h)) for _, _, _, first, (last, _), hs in repeats.anchors(pa.array([t]), 40, 12)
                      for f, zz, h in zip(first, last, hs, strict=True) for a, z in [(w, w) for w in range(f, zz + 1)])

    whole = found(text)
    assert len(whole) == len(text) - 39
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert found(text) == whole


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(bytes([rng.randint(97, 101), rng.randint(97, 101)]) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc_record_round_trip():
    for page, url, payload, to in ((1, "http://a.b/c", b"x\r\n\r\ny", None), (None, None, b"", None), (7, "u\r\nv", b"z" * 2000, 9)):
        import hashlib

        digest = hashlib.sha1(payload).hexdigest()
        kind = "response" if to is None else "revisit"
        got = warc.parse(warc.record(page, url, payload, digest, to))
        assert got == (page, len(payload), digest, kind, to, payload if to is None else b"")
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "00" * 20, None))


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/A b?q=1#f") == "com:80,example,www)/a%20b?q=1"
    assert warc.url_key(None) == "-" and warc.url_key("no url") == "no%20url"


def test_frames():
    ids = [np.array(x, "<u2") for x in ([], [2], [1, 65535, 7])]
    data = b"".join(records.frame(records.payload_of(d, x)) for d, x in zip((None, 5, -3), ids, strict=True))
    got = [records.read_payload(p) for p in records.read_frames(io.BytesIO(data))]
    assert [(d, x.tolist()) for d, x in got] == [(None, []), (5, [2]), (-3, [1, 65535, 7])]
    for broken in (data[:5] + b"\x01" + data[6:], data[:-6] + b"\x01" + data[-5:]):
        with pytest.raises(ValueError):
            list(records.read_frames(io.BytesIO(broken)))


def test_word_encoder(monkeypatch):
    monkeypatch.setattr(records, "CACHE", 8)
    texts = ["", "  ", "Hello, wörld!\nHELLO", "a b  c", "<|endoftext|> x <|EndOfText|>", "ΑΣ ΑΣΑ Å é ́x", "1234 it's", "x" * 500]
    encoder = records.WordEncoder(tokenizer_path(), 2)
    for _ in range(2):
        got = [x.tolist() for x in encoder.encode(pa.array(texts, pa.large_string()))]
        assert got == [tokenizer().encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_pattern_tokens():
    assert urls.pattern_tokens("||ads.example.com^") == ["ads", "com", "example"]
    assert urls.pattern_tokens("*foo/bar*") == [] or urls.pattern_tokens("/foo/bar*") == ["foo"]
    assert urls.pattern_tokens("casino") == []


def test_differing_bits_bound_differing_tokens():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(4, 200)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, 4)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64))))
        maps = [jaccard._parity(x, max(16, 2 << (len(x) - 1).bit_length())) for x in (a, b)]
        apart = jaccard.differing(*maps)
        assert apart == jaccard.differing(*maps[::-1]) <= len(np.setxor1d(a, b))
        assert jaccard.differing(maps[0], maps[0]) == 0
