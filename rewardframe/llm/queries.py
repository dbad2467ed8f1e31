"""Registered queries of the operators, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontam, jaccard, lines, mixing, quality, records, repeats, secrets, urls, variants, warc
from .common import settle, small_batches, table, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- SQL fragments -------------------------------------------------------------------------------

_SP = r"[\x20\x09-\x0D]+"
_W = r"[^\x20\x09-\x0D]+"


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SP}'), lambda w: w <> '')"


def _sql_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_line(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[1-9]', '0', 'g'), '{_SP}', ' ', 'g'))"


# --- 1: n-gram Jaccard join -----------------------------------------------------------------------


@query("op1_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join_similar(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


# --- 2: quality rules -----------------------------------------------------------------------------

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, {_sql_words('t')} AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS s(k) GROUP BY r),
stat AS (SELECT w.r, doc_id, source, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
        FROM w LEFT JOIN cover ON w.r = cover.r),
ln AS (SELECT r, doc_id, source, t, {_sql_line('l')} AS l, len(regexp_extract_all(l, '{_W}')) AS n
       FROM (SELECT r, doc_id, source, t, unnest(ls) AS l FROM w)),
txt AS (SELECT source, t, l, min(doc_id) AS id, max(n) AS n FROM
        (SELECT r, source, t, l, min(doc_id) AS doc_id, sum(n) AS n FROM ln GROUP BY ALL) GROUP BY source, t, l),
hot AS (SELECT source, l, min_by(t, id) AS holder FROM txt GROUP BY source, l HAVING count(*) > {quality.MAX_DOCS}),
lost AS (SELECT txt.source, txt.t, sum(n) AS n FROM txt JOIN hot ON txt.source IS NOT DISTINCT FROM hot.source
         AND txt.l = hot.l AND txt.t <> hot.holder GROUP BY txt.source, txt.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 100 * coalesce(lost.n, 0) <= {quality.MAX_LOST} * n_words AS kept,
  coalesce(lost.n, 0)::bigint AS lost_words
FROM stat LEFT JOIN lost ON stat.source IS NOT DISTINCT FROM lost.source AND stat.t = lost.t
"""


@query("op2_quality_rules", _QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lost_words",
    )


# --- 3: WARC --------------------------------------------------------------------------------------

_WARC = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT h, max(page_id) AS top, count(*) AS c FROM p WHERE n >= {warc.REVISIT} GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN t ON p.h = t.h
"""


@query("op3_warc_archive", _WARC)
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- 4: repeated substrings ------------------------------------------------------------------------


@query("op4_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# --- 5: benchmark decontamination -----------------------------------------------------------------


def _sql_shingles(name: str, id_: str, src: str) -> str:
    low = _sql_words(_sql_lower("text"))
    return f"""{name} AS (SELECT DISTINCT r, {id_}, g FROM (
  SELECT r, {id_}, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, {id_}, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM
    (SELECT row_number() OVER () AS r, {id_}, {low} AS ws FROM {src}) WHERE len(ws) > 0)))"""


_LEAKS = f"""
WITH {_sql_shingles('ds', 'doc_id', 'documents')},
{_sql_shingles('bs', 'item_id', 'benchmark')},
bn AS (SELECT r, item_id, count(*) AS n FROM bs GROUP BY r, item_id)
SELECT doc_id, item_id, n AS n_item, shared AS n_shared FROM
  (SELECT ds.r AS dr, doc_id, bs.r AS br, count(*) AS shared FROM ds JOIN bs ON ds.g = bs.g GROUP BY ds.r, doc_id, bs.r) s
  JOIN bn ON s.br = bn.r WHERE 100 * shared >= {decontam.PERCENT} * n
"""


@query("op5_decontamination", _LEAKS)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- 6: token-ID output ---------------------------------------------------------------------------


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_records")
def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.export(table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", "file")


# --- 7: mixing ------------------------------------------------------------------------------------

_MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 15))::bigint AS h FROM documents),
s AS (SELECT source, sum(size)::bigint AS n, (list_value{mixing.WEIGHTS})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS w
      FROM d GROUP BY source),
lv(k, level) AS (
  SELECT 0, 0.0::double UNION ALL
  SELECT k + 1, (SELECT (sum(s.n) * {mixing.BUDGET}::double / 100 - coalesce(sum(CASE WHEN {mixing.MAX_EPOCHS} * s.n <= level * s.w THEN {mixing.MAX_EPOCHS} * s.n END), 0))
    / sum(CASE WHEN {mixing.MAX_EPOCHS} * s.n > level * s.w THEN s.w END) FROM s)
  FROM lv WHERE k < 100 AND (SELECT count(*) FROM s WHERE {mixing.MAX_EPOCHS} * s.n > level * s.w) > 0),
top AS (SELECT max(level) AS level FROM lv),
t AS (SELECT source, n, least({mixing.MAX_EPOCHS} * n::double, level * w) AS target FROM s, top),
u AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::bigint ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, max(CASE WHEN mid <= target - whole * n THEN h END) AS cut FROM
  (SELECT source, h, sum(size) OVER (PARTITION BY source ORDER BY h) - size / 2 AS mid FROM g) g
  JOIN u ON g.source IS NOT DISTINCT FROM u.source GROUP BY g.source)
SELECT doc_id, d.size, u.n AS source_size, target, (d.size * (whole + CASE WHEN h <= coalesce(cut, -1) THEN 1 ELSE 0 END))::bigint AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


@query("op7_mix_sources", _MIX)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# --- 8: URL filters -------------------------------------------------------------------------------


def _sql_rules(rules) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rules)


_URLS = f"""
WITH p AS (SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN {_sql_lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
hr(rule, verdict) AS (VALUES {_sql_rules(urls.HOST_RULES)}),
pr(pattern, verdict, regex) AS (VALUES {_sql_rules([(p, v, urls.pattern_regex(p)) for p, v in urls.PATTERN_RULES])}),
hit AS (SELECT url, min(struct_pack(v := verdict, p := pattern)) AS b FROM (SELECT DISTINCT url FROM p WHERE url IS NOT NULL) u
    JOIN pr ON regexp_matches({_sql_lower('u.url')}, regex) GROUP BY url),
fit AS (SELECT host, path, max_by(struct_pack(r := rule, v := verdict), length(rule)) AS f FROM (SELECT DISTINCT host, path FROM p) q
    JOIN hr ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY host, path)
SELECT page_id, p.host, p.path, f.r AS rule, coalesce(f.v, b.v, 'allow') AS verdict, b.p AS pattern
FROM p LEFT JOIN hit ON p.url = hit.url LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path
"""


@query("op8_url_filters", _URLS)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


# --- 9: line dedup --------------------------------------------------------------------------------

_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, i, ls[i] AS raw, {_sql_line('ls[i]')} AS l, regexp_matches(ls[i], '{_W}') AS full_
      FROM (SELECT r, doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL)),
bad AS (SELECT l FROM l WHERE full_ GROUP BY l HAVING count(DISTINCT coalesce(source, '-')) >= {lines.MIN_SITES}),
k AS (SELECT r, sum(CASE WHEN full_ THEN 1 ELSE 0 END) AS n, sum(CASE WHEN full_ AND bad.l IS NOT NULL THEN 1 ELSE 0 END) AS gone,
      array_to_string(list(raw ORDER BY i) FILTER (bad.l IS NULL OR NOT full_), chr(10)) AS cleaned
      FROM l LEFT JOIN bad ON l.l = bad.l GROUP BY r)
SELECT doc_id, coalesce(n, 0)::bigint AS n_lines, coalesce(gone, 0)::bigint AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(cleaned, '')) END AS cleaned_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""


@query("op9_line_dedup", _LINES)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_site_lines(table(spark, sf_dir, "documents"))
    return done.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("cleaned", 256).alias("cleaned_sha256"))


# --- 10: secret scans -----------------------------------------------------------------------------


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *[n(k) for k in secrets.BASE], F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("found")).alias("spans"),
    )


# --- 11: byte-level BPE ---------------------------------------------------------------------------


@tidy
@small_batches
def _bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    told = bpe.encode(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids",
    )
    return settle(bpe.decode(told, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")))


@query("op11_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# --- 12: spelling variants ------------------------------------------------------------------------


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.group_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


# --- 13: cross-tokenizer alignment ----------------------------------------------------------------


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN,
    )
