"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is text in which ``*`` stands for anything, a leading ``||`` for the start of a host
name, ``|`` for either end of the URL and ``^`` for a separator.  Each rule is filed under the one of
its literal tokens that the fewest URLs hold; the tokens of a URL fetch the rules filed under them,
and only those run their regular expression.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no host rule; a
null URL meets no pattern; repeated rows are judged alike, row by row; a rule without a whole token is
filed under four of its letters and digits, and without those under the empty token, which every URL holds;
of host rules of one length the last in code-point order wins; an allowing pattern wins over blocking ones; an
empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, digest, settle, sorted_side

#: Host and path rules of the standard run; the longest that fits wins.
HOST_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
#: Pattern rules of the standard run.
PATTERN_RULES = (
    ("casino", "block"), ("/poker/", "block"), ("||ads.", "block"), ("/banner/*/img^", "block"),
    ("/login", "block"), ("/cart/", "block"), ("?sessionid=", "block"), ("&sessionid=", "block"),
    ("?page=*&ref=", "block"), ("/wp-content/plugins/", "block"), ("||tracker.*/pixel", "block"),
    ("/tag/", "block"), ("||example.org/de/*.html|", "block"), ("||example.org/de/1*.html|", "allow"),
    ("||www.example.org^*/casino", "allow"),
)
_TOKEN = "[a-z0-9]+"
GRAM = 4  # letters and digits under which a rule without a whole token is filed
_GRAM_MARK = "~"


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def host_rule_table(spark, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Host rules as a table: domain, start (of the path), rule, verdict."""
    cut = [(*r.partition("/"), r, v) for r, v in rules]
    return spark.createDataFrame([(d, slash + start, r, v) for d, slash, start, r, v in cut], "domain string, start string, rule string, verdict string")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, own): for each distinct ``host`` with any, the rules of it and of the domains above it.

    Domains are found by joining the host's endings, so the number of rules does not matter; only those of
    one host's own domains are tried on its paths.
    """
    parts = F.split("host", "[.]", -1)
    ending = lambda i: F.array_join(F.slice(F.col("parts"), i, F.size("parts")), ".")
    ends = hosts.select("host").distinct().select("host", parts.alias("parts")).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), ending)).alias("domain"))
    by_domain = rules.groupBy("domain").agg(F.collect_list(F.struct("start", "rule", "verdict")).alias("own"))
    return ends.join(by_domain, "domain").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("own"))


def best_rule(own: Column, path: Column) -> Column:
    """The longest of the rules whose start leads the path, as (size, rule, verdict)."""
    fits = F.filter(own, lambda r: F.startswith(path, r["start"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def pattern_regex(pattern: str) -> str:
    """Regular expression of a pattern, over a URL with A-Z lower-cased."""
    body, head, tail = pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[^/?#]*://([^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    marks = {"*": ".*", "^": r"([^a-z0-9_.%\-]|$)"}
    return "(?s)" + head + "".join(marks.get(c) or re.escape(c) for c in body) + tail


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens that stand whole in every URL that fits: both neighbours end a token."""
    text = pattern.lower()
    text = "/" + text[2:] if text.startswith("||") else text  # a name part starts there
    found = []
    for m in re.finditer(_TOKEN, text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before not in ("", "*") and after not in ("", "*"):
            found.append(m[0])
    return sorted(set(found))


def pattern_gram(pattern: str) -> str | None:
    """For a pattern without a whole token: letters and digits that every URL that fits holds somewhere, marked."""
    runs = re.findall(_TOKEN, pattern.lower())
    longest = max(runs, key=len, default="")
    return _GRAM_MARK + longest[:GRAM] if len(longest) >= GRAM else None


def rule_table(spark, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rules as a table: pattern, verdict, regex, tokens."""
    tokens = lambda p: pattern_tokens(p) or [g for g in [pattern_gram(p)] if g]
    rows = [(p, v, pattern_regex(p), tokens(p)) for p, v in rules]
    return spark.createDataFrame(rows, "pattern string, verdict string, regex string, tokens array<string>")


def url_tokens(url: Column, grams: bool = False) -> Column:
    """Distinct tokens of a URL; with ``grams`` also the pieces of ``GRAM`` letters and digits, marked."""
    tokens = F.regexp_extract_all(url, F.lit(_TOKEN), F.lit(0))
    if not grams:
        return F.array_distinct(tokens)
    places = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t) - GRAM + 1, F.lit(0)))
    cut = lambda t: F.when(F.length(t) >= GRAM, F.transform(places(t), lambda i: F.concat(F.lit(_GRAM_MARK), F.substring(t, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, cut))))


def rule_index(held: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with the token they are filed under: the one that the fewest URLs hold, by the counts (token, urls).

    Rules without any are filed under the empty token.
    """
    options = rules.select("pattern", F.explode("tokens").alias("token"))
    ranked = options.join(held, "token", "left").select("pattern", F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token").alias("by"))
    best = ranked.groupBy("pattern").agg(F.min("by")["token"].alias("token"))
    return rules.join(best, "pattern", "left").select(F.coalesce("token", F.lit("")).alias("token"), "pattern", "verdict", "regex")


def pattern_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct ``url`` with a match: verdict (allow before block) and the deciding pattern."""
    rules = settle(rules)
    grams = rules.filter(F.exists("tokens", lambda t: t.startswith(_GRAM_MARK))).limit(1).count() > 0
    lower = settle(urls.select("url", ascii_lower(F.col("url")).alias("low")).filter("url IS NOT NULL").distinct())
    # Tokens are counted by a partial aggregate before they meet the rules: a token of every URL is one row per task.
    held = lower.select(F.explode(url_tokens(F.col("low"), grams)).alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    index = settle(rule_index(held, rules))
    everywhere = index.filter("token = ''").limit(1).count() > 0
    asked = url_tokens(F.col("low"), grams)
    asked = F.concat(F.array(F.lit("")), asked) if everywhere else asked
    # Only tokens that rules are filed under go on; the texts of the URLs follow those.
    wanted = lower.select("url", "low", F.explode(asked).alias("token"))
    hits = wanted.join(index, "token").filter(F.expr("low RLIKE regex"))
    return hits.groupBy("url").agg(F.min(F.struct("verdict", "pattern")).alias("hit")).select(
        "url", F.col("hit.verdict").alias("pattern_verdict"), F.col("hit.pattern").alias("pattern")
    )


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url",
    host_rules: tuple[tuple[str, str], ...] | DataFrame = HOST_RULES,
    pattern_rules: tuple[tuple[str, str], ...] | DataFrame = PATTERN_RULES, default: str = "allow",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    The host rule decides where one fits, else the patterns, else ``default``.  Rules are pairs (rule, verdict),
    or tables as ``host_rule_table`` and ``rule_table`` make them.
    """
    spark = pages.sparkSession
    if not isinstance(pattern_rules, DataFrame):
        pattern_rules = rule_table(spark, pattern_rules)
    if not isinstance(host_rules, DataFrame):
        host_rules = host_rule_table(spark, host_rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    hits = settle(pattern_verdicts(rows, pattern_rules).withColumn("k", digest(F.col("url"))).drop("url"))
    hosts = settle(rules_of_hosts(rows.select(host_of(F.col("url")).alias("host")), host_rules)).withColumnRenamed("host", "h")
    rows = rows.withColumn("k", digest(F.col("url"))).join(sorted_side(hits), "k", "left")
    rows = rows.select("page_id", "pattern_verdict", "pattern", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    rows = rows.join(sorted_side(hosts), "h", "left").withColumn("best", best_rule(F.col("own"), F.col("p")))
    return rows.select(
        "page_id", F.coalesce("h", F.lit("")).alias("host"), F.coalesce("p", F.lit("")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "pattern_verdict", F.lit(default)).alias("verdict"), "pattern",
    )
