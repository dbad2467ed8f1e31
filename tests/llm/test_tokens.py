"""Byte-level BPE, spelling variants and token alignment: parts, and the cases of the docstrings."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from brute import alignment, byte_bpe, spelled_words, variants
from pyspark.sql import functions as F

from rewardframe.llm import align, bpe, pretokens, queries
from rewardframe.llm import variants as spelling
from rewardframe.llm.common import shared_folder

RANKS = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
FILES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = list("abst'rvelmLD \n\t    é中١٣½.,-'’😀́᠎​\x1c\x85ำ▁\u0000ァǅ") + ["'s", " 're", "<s>", "<|endoftext|>", "<0x0A>", "  \n  ", " x"]


def odd_texts(seed, n, longest=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def kinds():
    return pretokens.kind_table(pretokens.character_kinds(public_tokenizers.PATTERN))


@pytest.mark.parametrize("stretch", [5, 60, 1 << 20])
def test_cut(kinds, stretch, monkeypatch):
    monkeypatch.setattr(pretokens, "STRETCH", stretch)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for seed in range(60):
        texts = odd_texts(seed, seed % 7 + 1)
        got, counts = pretokens.cut(pa.array(texts), kinds)
        want = [pattern.findall(t) for t in texts]
        assert [x.decode() for x in got.to_pylist()] == [x for w in want for x in w]
        assert counts.tolist() == [len(w) for w in want]


def test_packing():
    for numbers in ([], [0], [7, 1 << 31, 65536, 255]):
        assert bpe.unpack(bpe.pack(np.array(numbers, np.int64))).tolist() == numbers
    for words in ([], [b""], [b"a", b"", "é\n".encode() * 300]):
        assert bpe.unpack_words(bpe.pack_words(pa.array(words, pa.large_binary()))).to_pylist() == words


def test_byte_bpe_cases(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    monkeypatch.setattr(bpe, "OUT", 500)
    texts = [None, "", " ", "x" * 20_000, "word " * 9000, *odd_texts(1, 60), *odd_texts(2, 4, 9000), *["the same text"] * 40]
    ids = [None, 3, 3, *range(len(texts) - 3)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, block int, ids int").repartition(5)
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    told = encoded.select("doc_id", F.size("ids").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("h"), "ids")
    got = rows(bpe.decode(told, RANKS).select("doc_id", "n", "h", F.sha2("bytes", 256).alias("b")), "doc_id", "n", "h", "b")
    assert got == sorted(((d, *w) for d, w in zip(ids, byte_bpe(texts, RANKS, public_tokenizers.PATTERN), strict=True)), key=repr)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    empty = bpe.encode(df.filter("text IS NULL"), RANKS, public_tokenizers.PATTERN)
    assert [tuple(r) for r in empty.collect()] == [(None, [])]


def test_decode_of_nothing(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [0, 1])], "k int, ids array<int>")
    got = {r["k"]: r["bytes"] for r in bpe.decode(df, RANKS).collect()}
    assert got[1] == b"" and got[2] is None and len(got[3]) == 2


def test_each_word_is_encoded_once(spark, monkeypatch):
    """A word that every document holds is one row of a bucket per block, and one entry of the encoder."""
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    df = spark.createDataFrame([(i, f"the same words again {i} ") for i in range(600)], "doc_id bigint, text string").repartition(3)
    cut = df.mapInArrow(bpe._cut(shared_folder(spark), pretokens.character_kinds(public_tokenizers.PATTERN), 4), bpe._PACKED).collect()
    per_block = {}
    for r in cut:
        own = [w for w in bpe.unpack_words(r["words"]).to_pylist() if w == b" words"]
        per_block.setdefault(r["block"], []).extend([r["bucket"]] * len(own))
    assert len(per_block) > 3 and len({tuple(x) for x in per_block.values()}) == 1 and len(next(iter(per_block.values()))) == 1


def crowd():
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÉÿàéö", "ÀÉÿàé", "éÉÿàéö"]
    words = [w[:k] + c + w[k + d :] for w in base for k in range(len(w)) for c in ("", "a", "b") for d in (0, 1) if rng.random() < 0.3] + base
    return [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(60)) + ("" if i % 4 else " chains chainsx chainsxy " * i)) for i in range(120)]


def test_variants_cases(spark):
    data = [(1, None), (2, ""), (None, None), (3, "short 123 ___"), *crowd(), *crowd()[:20]]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id bigint, text string, word int, key int").repartition(4)
    got = rows(spelling.group_variants(df), "word", "form", "root", "n", "n_near", "form_n")
    want = variants(spelled_words(data))
    assert got == sorted(want, key=repr) and max(w[4] for w in want) > 6
    assert spelling.group_variants(df.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdef": 10_000, "abcdeg": 1_500, "abcdhg": 200, "abcihg": 30, "abjihg": 5, "zzzzzz": 5}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    found = spelling.group_variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), typo=1 << 40)
    got = {r["word"]: (r["form"], r["root"]) for r in found.collect()}
    assert got["abjihg"] == ("abcihg", "abcdef") and got["abcdef"] == (None, "abcdef") and got["zzzzzz"] == (None, "zzzzzz")


def test_groups_are_bounded_by_the_alphabet(spark):
    words = [f"{a}{b}cdefgh" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    turned = spelling.rotations(df)
    assert turned.count() == sum(2 * len(w) + 1 for w in words)
    assert turned.groupBy("key").count().agg(F.max("count")).first()[0] <= 17
    assert {r["s"] for r in spelling.neighbours(df).groupBy("word").agg(F.sum("near").alias("s")).collect()} == {30}


def test_alignment_cases(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 2500)
    texts = [None, "", " ", "x" * 8000, "word " * 4000, "a▁b", *odd_texts(3, 50), *odd_texts(4, 3, 6000), *["the same text, e.g. naïve café"] * 30]
    ids = [None, 3, 3, *range(len(texts) - 3)]
    data = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id bigint, text string, pair int, block int").repartition(5)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = alignment(data, *FILES)
    assert rows(align.align(df, *FILES, public_tokenizers.PATTERN), *columns) == sorted(want, key=repr)
    assert any(w[3] < min(w[1:3]) for w in want) and sum(not w[1] for w in want) >= 3
    assert align.align(df.limit(0), *FILES, public_tokenizers.PATTERN).collect() == []


def test_coalesce():
    order, group = align.coalesce(np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9]))
    assert order.tolist() == [3, 0, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]
    a, b = align.overlaps(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 2, 5]), np.array([2, 5, 9]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]
