"""URL rules indexed by their rarest literal token.

A rule is a regular expression over `host + path + rest` and the tokens that any URL it fits
must contain. Token counts over all URLs tell each rule's rarest token, under which it is filed. A URL's tokens
fetch its candidate rules and only those run their expressions, all within the URL's own row: nothing is
exploded or shuffled. The rules are a parameter, so index and counts are bounded by their number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name; action allow or block; pattern; tokens (lower case) that are in every URL it fits; exact: a host and path rule."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    exact: bool = False


def prefix_rule(action: str, text: str) -> Rule:
    """A host, all its subdomains, and the paths that start with the part from the first slash on."""
    host, slash, path = text.partition("/")
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^A-Za-z0-9])", (slash + path).lower())
    return Rule(text, action, rf"^(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}", tuple(whole), True)


#: Rules on hosts and paths, fixed values of the task.
PREFIX_RULES = [prefix_rule("block", "net/"), prefix_rule("allow", "example.net/en/"),
                prefix_rule("block", "example.com/de/"), prefix_rule("allow", "org/fr/")]
PATTERN_RULES = [
    Rule("spam-farm", "block", r"^(?:[^/?#]*[.])?spam-farm[.]", ("spam", "farm")),
    Rule("cheap-pills", "block", r"^(?:[^/?#]*[.])?cheap-pills[.]", ("cheap", "pills")),
    Rule("casino-host", "block", r"^(?:[^/?#]*[.-])?casino[.-]", ("casino",)),
    Rule("payday-loans", "block", r"payday[-_]?loans", ()),
    Rule("click-bait", "block", r"^(?:[^/?#]*[.])?click-bait[.]", ("click", "bait")),
    Rule("free-download", "block", r"[-_/]free[-_]download", ("free",)),
    Rule("session-id", "block", r"[?&]phpsessid=[0-9a-f]{16,}", ("phpsessid",)),
    Rule("print-view", "block", r"[?&]print=(?:1|true|yes)(?:&|#|$)", ("print",)),
    Rule("login-page", "block", r"/(?:user/)?login(?:[/?#.]|$)", ("login",)),
    Rule("cart-page", "block", r"/(?:shop/)?cart(?:[/?#.]|$)", ("cart",)),
    Rule("raw-address", "block", r"^[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?:[:/?#]|$)", ()),
    Rule("education", "allow", r"^(?:[^/?#]*[.])?edu(?:[.][a-z]{2})?(?:[:/?#]|$)", ("edu",)),
]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^?#]*([\s\S]*)", 1)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"))


def index(parsed: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without a token are under "" and fetched by every URL."""
    known = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        found = parsed.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, known)))).alias("t"))
        counts = {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a rule's token
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return filed


def _literal(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"),
                              F.lit(r.exact).alias("exact")) for r in rules])


def judged(pages: DataFrame, rules: list[Rule] | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, pattern_rules.

    rule: the longest host and path rule that fits, ties by name, else null. Without one, verdict is
    block if a pattern rule blocks and none allows, else allow. pattern_rules: the names of all pattern rules that fit, sorted.
    Null URLs, and those without "://", have empty host and path and are allowed unless a pattern fits the empty text.
    """
    rules = PREFIX_RULES + PATTERN_RULES if rules is None else rules
    url = F.col(url_column).cast("string")
    parsed = pages.select(F.col(id_column).alias("id"), host(url).alias("host"), path(url).alias("path"), _rest(url).alias("rest"))
    parsed = parsed.withColumn("whole", F.concat("host", "path", "rest"))
    parsed = parsed.withColumn("tokens", _tokens(F.col("whole")))
    filed = index(parsed, rules)
    everywhere = filed.pop("", [])
    fetched = [_literal(everywhere)] if everywhere else []
    if filed:
        lookup = F.create_map(*[x for t, rs in filed.items() for x in (F.lit(t), _literal(rs))])
        fetched.append(F.flatten(F.transform(
            F.filter("tokens", lambda t: F.map_contains_key(lookup, t)), lambda t: F.element_at(lookup, t))))
    fits = F.filter(F.concat(*fetched), lambda r: F.regexp_like("whole", r["pattern"])) if fetched else \
        F.filter(_literal([Rule("", "", "", ())]), lambda r: F.lit(False))
    found = parsed.withColumn("fits", fits)
    best = F.array_max(F.transform(F.filter("fits", lambda r: r["exact"]), lambda r: F.struct(
        F.length(r["name"]).alias("n"), r["name"].alias("name"), r["action"].alias("action"))))
    found = found.withColumn("best", best).withColumn("soft", F.filter("fits", lambda r: ~r["exact"]))
    by_pattern = F.exists("soft", lambda r: r["action"] == "block") & ~F.exists("soft", lambda r: r["action"] == "allow")
    return found.select(
        "id", "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.action", F.when(by_pattern, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join(F.array_sort(F.transform("soft", lambda r: r["name"])), ",").alias("pattern_rules"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2_SQL = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(.*)', 1) AS rest FROM pages),
r(name, action, pattern, hard) AS (VALUES {', '.join(
    f"({_quoted(r.name)}, {_quoted(r.action)}, {_quoted(r.pattern)}, {r.exact})" for r in PREFIX_RULES + PATTERN_RULES)}),
m AS (SELECT page_id, r.* FROM p JOIN r ON regexp_matches(host || path || rest, pattern)),
b AS (SELECT page_id, name AS rule, action FROM m WHERE hard QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC, name DESC) = 1),
s AS (SELECT page_id, string_agg(name, ',' ORDER BY name) AS names, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked
  FROM m WHERE NOT hard GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(names, '') AS pattern_rules FROM p LEFT JOIN b USING (page_id) LEFT JOIN s USING (page_id)
"""
