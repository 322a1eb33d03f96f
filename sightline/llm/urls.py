"""URL filters: rules are indexed by their rarest literal token, and a URL's tokens fetch the rules to try.

DataFrame functions only. Token counts over all URLs say which token of a rule is the rarest; a URL's distinct tokens
are joined to the index, and just the rules fetched run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: With more rules than this the index isn't broadcast but joined by token.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """name: what is returned; pattern: a regular expression on the host directly followed by the path (which starts with a slash or is empty, and no host holds one); tokens: literals that any match holds as whole tokens; rank: the larger wins."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(rule: str, action: str) -> UrlRule:
    """`net/es/`: host net or a subdomain, path from /es/ on. Longest wins."""
    host, path = rule.split("/", 1)
    whole = "/" + path.rsplit("/", 1)[0] if "/" in path else ""  # what is cut off at a slash is a whole token
    return UrlRule(rule, action, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(tokens(host + whole)), 1_000_000 + len(rule))


def tokens(text: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", text)))


#: The rules asked for.
RULES = [host_rule("com/", "allow"), host_rule("example.com/en/", "block"), host_rule("www.example.com/en/", "allow"), host_rule("net/es/", "block"), host_rule("net/fr/", "block")]
#: The method's own patterns, tried for URLs that no rule above fits: trackers, sessions and logins.
PATTERNS = [
    UrlRule("tracker host", "block", r"^(?:[^/]*\.)?(?:ads|track|tracker|doubleclick)\.", (), 1),
    UrlRule("session", "block", r"(?i)[;/?&](?:jsessionid|phpsessid|sid)=", (), 2),
    *(UrlRule(f"/{w}", "block", rf"(?i)/{w}(?:[/.]|\z)", (w,), 3) for w in ("login", "logout", "signup", "cart", "checkout")),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    first = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    host = F.translate(first, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, keep: list[str], rules: list[UrlRule] | None = None, others: list[UrlRule] | None = None, url_col: str = "url") -> DataFrame:
    """The columns `keep`, host, path, rule (the name of the first of `rules` that fits, by rank; else null), verdict, pattern.

    Without a fitting rule the verdict is that of the fitting pattern of `others` with the highest rank (named in
    `pattern`), else allow. Null URLs, and those without ://, have empty parts and fit no rule. Each row, repeated ones
    and those of null ids included, is judged by itself; an empty table gives no rows; columns not named are not read.
    """
    spark = pages.sparkSession
    rules, others = RULES if rules is None else rules, PATTERNS if others is None else others
    names = {c: f"_k{k}" for k, c in enumerate(keep)}
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(*(F.col(c).alias(n) for c, n in names.items()), host.alias("_host"), path.alias("_path"))
    # a row's tokens stay in its task, so the number of the row need only tell rows of one task apart
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    held = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(F.split(F.lower(F.concat_ws(" ", "_host", "_path")), "[^a-z0-9]+"), lambda t: t != "")))
    listed = [(k, r.name, r.action, r.pattern, r.rank, k < len(rules), list(r.tokens) or [""]) for k, r in enumerate([*rules, *others])]
    table = spark.createDataFrame(listed, "k int, name string, action string, pattern string, rank int, own boolean, tokens array<string>")
    asked = table.select("k", F.explode("tokens").alias("token"))
    seen = rows.select(F.explode(held).alias("token")).join(small(asked.select("token").distinct(), len(listed)), "token", "left_semi").groupBy("token").count()
    rarest = asked.join(seen, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(rarest, "k")
    tried = rows.withColumn("token", F.explode(held)).join(small(index, len(listed)), "token", "left")
    fits = F.rlike(F.concat("_host", "_path"), F.col("pattern"))
    won = F.when(fits, F.struct("own", "rank", (-F.col("k")).alias("k"), "name", "action"))
    best = tried.groupBy("_row").agg(*(F.first(c).alias(c) for c in [*names.values(), "_host", "_path"]), F.max(won).alias("_won"))
    own = F.coalesce(F.col("_won.own"), F.lit(False))
    return best.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(own, F.col("_won.name")).alias("rule"), F.coalesce("_won.action", F.lit("allow")).alias("verdict"), F.when(~own, F.col("_won.name")).alias("pattern"))


def small(df: DataFrame, rules: int) -> DataFrame:
    """df, of a few rows for each rule, broadcast if the rules are few enough."""
    return F.broadcast(df) if rules <= BROADCAST_RULES else df


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for each page; see judge."""
    return judge(pages, ["page_id"])
