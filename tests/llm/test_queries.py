"""Registered queries against DuckDB or plain Python, on the smallest data."""

import duckdb
import pytest
from brute import alignment, byte_bpe, clean, components, mix, quality, records, repeats, secrets, spelled_words, variants

from rewardframe.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, duck):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(got, columns) == sorted(want, key=repr)


def test_jaccard(spark, docs):
    got = rows(queries.QUERIES["op1_jaccard_join"](spark, DATA), ["doc_id", "n_shingles", "component_id"])
    pairs = [(d, t) for d, t, _ in docs]
    assert got == sorted(((d, *c) for (d, _), c in zip(pairs, components(pairs), strict=True)), key=repr)


def test_repeats(spark, docs):
    got = rows(queries.QUERIES["op4_suffix_dedup"](spark, DATA), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    want = [(d, *r) for (d, _, _), r in zip(docs, repeats([t for _, t, _ in docs]), strict=True)]
    assert got == sorted(want, key=repr) and any(r[2] for r in want)


def test_records(spark, docs):
    got = rows(queries.QUERIES["op6_token_records"](spark, DATA), ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert got == sorted(records([(d, t) for d, t, _ in docs]), key=repr)


def test_secrets(spark, docs):
    got = rows(queries.QUERIES["op10_secret_scan"](spark, DATA), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    want = [(d, *secrets(t)) for d, t, _ in docs]
    assert got == sorted(want, key=repr) and any(w[5] for w in want)


def test_byte_bpe(spark, docs):
    import public_tokenizers

    got = rows(queries.QUERIES["op11_byte_bpe"](spark, DATA), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    want = byte_bpe([t for _, t, _ in docs], queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got == sorted(((d, *w) for (d, _, _), w in zip(docs, want, strict=True)), key=repr)


def test_variants(spark, docs):
    got = rows(queries.QUERIES["op12_spelling_variants"](spark, DATA), ["word", "form", "root", "n", "n_near", "form_n"])
    want = variants(spelled_words([(d, t) for d, t, _ in docs]))
    assert got == sorted(want, key=repr) and any(w[1] for w in want)


def test_alignment(spark, docs):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = rows(queries.QUERIES["op13_token_alignment"](spark, DATA), columns)
    want = alignment([(d, t) for d, t, _ in docs], queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert got == sorted(want, key=repr)


def test_pipeline(spark, duck, docs):
    import corpus_pipeline

    left = quality(docs)
    groups = components([(d, t) for d, t, _ in left])
    left = [r for r, (n, c) in zip(left, groups, strict=True) if not n or c == r[0]]
    left = clean(left, [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()])
    taken = [r for r, (*_, copies) in zip(left, mix(left), strict=True) for _ in range(copies)]
    got = rows(corpus_pipeline.run(spark, DATA), ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert got == sorted(records([(d, t) for d, t, _ in taken]), key=repr)


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
