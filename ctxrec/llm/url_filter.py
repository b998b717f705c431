"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host with an optional path prefix (``example.org/es/``) or a
pattern (``^casino^``) in which ``^`` stands for a separator or an end and
``*`` for any text. Each rule is filed under the one of its literal tokens
that fewest URLs of the table hold (counted over the whole table), a URL's
tokens fetch the rules filed under them, and only those run their regular
expression. The index is a hashed array inside the plan, so a URL is judged in
one pass without a shuffle and without Python. A list of more than PLAN_RULES
rules is a table instead, joined with the tokens of the distinct (host, path)
pairs; the results are the same. URLs of any length are judged whole.

Verdict: the longest fitting host rule decides (equal lengths: the rule string
that sorts last); else a fitting pattern (allow patterns before block
patterns); else ``allow``. Null URLs and URLs without ``://`` have an empty
host and path, fit no rule and are allowed. Repeated rows each get their row;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, query
from ctxrec.sources.tables import read_table


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    kind: str  # "host" or "pattern"


def host_rule(action: str, text: str) -> Rule:
    return Rule(action, text, "host")


def pattern_rule(action: str, text: str) -> Rule:
    return Rule(action, text, "pattern")


#: the rules of the contract (fixed values)
HOST_RULES = [
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
]
#: words that mark unwanted hosts and paths, each between separators
BLOCK_WORDS = ("casino bets betting poker gambling jackpot pills viagra cialis pharmacy adult porn xxx sex "
               "escort spam malware phishing warez torrent ads adserver track tracker tracking doubleclick").split()
DEFAULT_RULES = HOST_RULES + [pattern_rule("block", f"^{w}^") for w in BLOCK_WORDS] + [
    pattern_rule("allow", "^adult-education^"), pattern_rule("allow", "^spam-filter^")]

#: up to so many rules live in the plan, longer lists in a table
PLAN_RULES = 20_000
_TOKEN = re.compile(r"[a-z0-9]+")


def rule_regex(rule: Rule) -> str:
    """Regular expression over ``host + path``."""
    if rule.kind == "host":
        return r"^(?:[^/]*\.)?" + re.escape(rule.text)
    out = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9]|^|$)"}
    return "(?i)" + "".join(out.get(c) or re.escape(c) for c in rule.text)


def rule_tokens(rule: Rule) -> list[str]:
    """Literal tokens a URL must hold whole if the rule fits: those with a
    separator, or the start of the host, on both sides."""
    text, found = rule.text.lower(), []
    for m in _TOKEN.finditer(text):
        before = text[m.start() - 1] if m.start() else ("^" if rule.kind == "host" else "*")
        after = text[m.end()] if m.end() < len(text) else "*"
        if before != "*" and after != "*":
            found.append(m.group())
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) after the first ``://``; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(F.concat(host, path)), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, rules: list[Rule], url_col: str = "url", plan_rules: int = PLAN_RULES) -> dict[str, int]:
    """URLs that hold each token of the rules. The result has at most one row
    per token of the rule list, however many URLs there are."""
    wanted = sorted({t for r in rules for t in rule_tokens(r)})
    if not wanted:
        return {}
    host, path = url_parts(F.col(url_col))
    if len(rules) <= plan_rules:
        held = urls.select(F.explode(F.array_intersect(_tokens(host, path), F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        held = urls.select(F.explode(_tokens(host, path)).alias("token")).join(known, "token", "left_semi")
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Token -> rules filed under it ("" holds rules without a usable token)."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        key = min(rule_tokens(rule), key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(key, []).append(rule)
    return index


def _bucket(text: str, buckets: int) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big") % buckets


def _host_order(r) -> Column:
    """The host rule that decides is the largest of these."""
    return F.struct(F.length(r["text"]).alias("size"), r["text"].alias("text"), r["action"].alias("action"))


def _pattern_order(r) -> Column:
    """The pattern that decides is the smallest of these."""
    return F.struct(r["action"].alias("action"), (-F.length(r["text"])).alias("size"), r["text"].alias("text"))


def _fits_in_plan(base: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """Adds ``_rule`` and ``_pattern`` by the index as a hashed array of the plan."""
    buckets = 1
    while buckets < 2 * len(index):
        buckets *= 2
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for token, filed in index.items():
        for r in filed:
            table[_bucket(token, buckets)].append(
                {"token": token, "regex": rule_regex(r), "kind": r.kind, "action": r.action, "text": r.text})
    row = "struct<token:string,regex:string,kind:string,action:string,text:string>"
    filed = F.from_json(F.lit(json.dumps(table)), f"array<array<{row}>>")
    bucket = lambda t: (F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 8), 16, 10).cast("long")
                        % buckets).cast("int")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), _tokens(F.col("host"), F.col("path"))))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(filed, bucket(t)), lambda r: r["token"] == t)))
    fits = F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
    return base.withColumn("_fits", fits).select(
        *base.columns,
        F.array_max(F.transform(F.filter("_fits", lambda r: r["kind"] == "host"), _host_order)).alias("_rule"),
        F.array_min(F.transform(F.filter("_fits", lambda r: r["kind"] == "pattern"), _pattern_order)).alias("_pattern"))


def _fits_by_join(base: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The same by a table of rules, joined with the tokens of each distinct (host, path)."""
    table = base.sparkSession.createDataFrame(
        [(token, rule_regex(r), r.kind, r.action, r.text) for token, filed in index.items() for r in filed],
        "token string, regex string, kind string, action string, text string")
    places = base.select("host", "path").distinct()
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), _tokens(F.col("host"), F.col("path"))))
    fits = places.select("host", "path", F.explode(tokens).alias("token")).join(table, "token").where(
        F.rlike(F.concat("host", "path"), F.col("regex")))
    r = {c: F.col(c) for c in ("text", "action")}
    best = fits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(
        F.max(F.when(F.col("kind") == "host", _host_order(r))).alias("_rule"),
        F.min(F.when(F.col("kind") == "pattern", _pattern_order(r))).alias("_pattern"))
    return base.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(*base.columns, "_rule", "_pattern")


def judge_urls(urls: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id",
               url_col: str = "url", plan_rules: int = PLAN_RULES) -> DataFrame:
    """One row per URL: id, host, path, rule (the host rule that decided, else
    null), verdict, pattern (the pattern that decided, else null)."""
    rules = DEFAULT_RULES if rules is None else rules
    index = build_index(rules, token_counts(urls, rules, url_col, plan_rules))
    host, path = url_parts(F.col(url_col))
    base = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    best = _fits_in_plan(base, index) if len(rules) <= plan_rules else _fits_by_join(base, index)
    return best.select(
        id_col, "host", "path", F.col("_rule.text").alias("rule"),
        F.coalesce("_rule.action", "_pattern.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_pattern.text")).alias("pattern"))


_WORDS_RE = "|".join(BLOCK_WORDS)
_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r(text, h, p, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
w(word) AS (SELECT unnest(string_split('{" ".join(BLOCK_WORDS)}', ' '))),
j AS (SELECT u.*, (SELECT max({{'n': length(r.text), 't': r.text, 'a': r.action}}) FROM r
        WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS best,
      regexp_matches(host || path, '(^|[^a-z0-9])(adult-education|spam-filter)([^a-z0-9]|$)', 'i') AS good,
      (SELECT min({{'n': -length(w.word), 't': '^' || w.word || '^'}}) FROM w
        WHERE regexp_matches(u.host || u.path, '(^|[^a-z0-9])' || w.word || '([^a-z0-9]|$)', 'i')) AS bad
      FROM u)
SELECT page_id, host, path, best.t AS rule,
       coalesce(best.a, CASE WHEN good THEN 'allow' WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN best IS NOT NULL THEN NULL
            WHEN regexp_matches(host || path, '(^|[^a-z0-9])adult-education([^a-z0-9]|$)', 'i') THEN '^adult-education^'
            WHEN good THEN '^spam-filter^' ELSE bad.t END AS pattern
FROM j"""


@query("op1_url_filter", _SQL)
def op1_url_filter(spark, sf_dir):
    """Every url of ``pages`` judged by the contract's rules and the patterns."""
    return judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url"))
