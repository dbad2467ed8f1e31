"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content.  The ledger lists, for each blob
and rule version, what the scan found; a run scans only the pairs that the ledger does not hold, and
joins all findings back to every path (document) of a blob.

Defined cases: a null text is scanned as an empty one; repeated rows and copies share one scan and
each get its findings; the ledger may not exist yet; an empty table gives an empty result; further
columns are left alone.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, leftmost and without overlap, and the least length of a group."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Base kinds, in their order, then further kinds of well-known shape.  A run of one class that must
#: have n characters is written with {n,}: that finds the same runs as a later length check.
RULES = (
    Rule("assign", 1, _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", 1, "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
_BLOCK = 256
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start:bigint,place:int,kind:string,stop:bigint>>"


def _walk(sizes: Column) -> Column:
    """Start and stop of each match, from the lengths of what lies before it (b) and of itself (m).

    Walked in blocks, so that lists are only ever extended by a block.
    """
    pairs, zero = "array<struct<a:bigint,z:bigint>>", F.lit(0).cast("bigint")

    def one(s: Column, x: Column) -> Column:
        a = s["at"] + x["b"]
        return F.struct((a + x["m"]).alias("at"), F.concat(s["all"], F.array(F.struct(a.alias("a"), (a + x["m"]).alias("z")))).alias("all"))

    def block(s: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(s["at"].alias("at"), F.array().cast(pairs).alias("all")), one)
        put = lambda r: F.struct(r["at"].alias("at"), F.concat(s["all"], F.array(r["all"])).alias("all"))
        return F.get(F.transform(F.array(own), put), F.lit(0))

    count = F.ceil(F.size(sizes) / _BLOCK).cast("int")
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(sizes, i * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array())
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{pairs}>").alias("all"))
    return F.flatten(F.aggregate(parts, start, block)["all"])


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Matches of a rule as (start, place, kind, stop).

    The pieces between the matches and the matches themselves follow each other, so the starts are
    running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    walked = _walk(F.filter(sizes, lambda x: x["m"].isNotNull()))
    kept = F.zip_with(walked, group, lambda w, g: F.when(F.length(g) >= rule.least, F.struct(
        w["a"].alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), w["z"].alias("stop"),
    )))
    return F.when(text.rlike(rule.pattern), F.filter(kept, lambda x: x.isNotNull())).otherwise(F.array()).cast(_SPANS)


def read_ledger(spark, path: str) -> DataFrame:
    """Ledger rows (blob, kind, version, found); none where it does not exist yet."""
    schema = f"blob string, kind string, version int, found {_SPANS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_unseen(docs: DataFrame, text: str, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Scans the blobs of ``docs`` for the rule versions that the ledger lacks, and appends them."""
    spark = docs.sparkSession
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(asked, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
    todo = todo.filter(F.size("todo") > 0)
    per_rule = [F.when(
        F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r, i).alias("found")),
    ) for i, r in enumerate(rules)]
    rows = todo.select("blob", F.explode(F.array(*per_rule)).alias("r")).filter("r IS NOT NULL")
    rows.select("blob", "r.kind", "r.version", "r.found").write.mode("append").parquet(ledger)


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per document: doc_id, blob, found (spans by start, then by the order of the rules).

    ``ledger`` is a Parquet folder that lives from run to run; without it a new one is begun.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_folder(spark)
    scan_unseen(docs, text, ledger, rules)
    place = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        place = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), i).otherwise(place)
    wanted = read_ledger(spark, ledger).withColumn("place", place)
    # Places follow this run's rules, whatever the order was when a blob was scanned.
    moved = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.col("place").alias("place"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    found = wanted.filter("place IS NOT NULL AND size(found) > 0").select("blob", moved.alias("found"))
    found = settle(found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found")))
    paths = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    return paths.join(found, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(_SPANS)))


def spelled(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
