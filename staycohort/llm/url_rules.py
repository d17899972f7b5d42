"""URL filters by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over `host + path` and the literal tokens every match
must hold. Tokens are counted over all URLs; a rule is filed under its token that
occurs least. A URL then fetches, with its distinct tokens, the rules filed under them,
and only those run their regular expressions. Rules without a token are filed under the
empty token, which every URL has. A list of rules up to `MOST_BROADCAST` is looked up as one
map in every task; a longer one is joined with the tokens of the distinct addresses, token by
token in parts, and only the best rule of each address comes back to its pages.

Nulls, ties and the rest: a null URL or one without `://` has an empty host and path and
matches only rules whose pattern matches the empty string; of the rules that match, the
greatest priority wins, then the smallest name; repeated rows are judged alike; input
columns are kept, and ones named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycohort.llm.common import join_spread, materialised

#: Rules up to which the index, under 1 KB a rule, is broadcast.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Rule:
    """`tokens`: runs of ASCII letters and digits that stand whole in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A rule written `host/path`: that host and its subdomains, paths that start with `/path`."""
    host, path = rule.split("/", 1)
    inner = re.findall(r"[0-9A-Za-z]+", path)
    if path and re.match(r"[0-9A-Za-z]", path[-1]):
        inner = inner[:-1]  # the last may go on in a URL
    pattern = rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    tokens = tuple(re.findall(r"[0-9A-Za-z]+", host) + inner)
    return Rule(rule, verdict, pattern, tokens, len(rule))


def _whole(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[0-9A-Za-z]+", text))


def host_word_rule(verdict: str, word: str, priority: int = -1) -> Rule:
    """Hosts with a label that is `word`, or has it between hyphens: `my-word.example.org`."""
    return Rule(f"host {word}", verdict, rf"^([^/]*[.-])?{re.escape(word)}([.-][^/]*)?(/|\z)", _whole(word), priority)


def path_part_rule(verdict: str, part: str, priority: int = -2) -> Rule:
    """Paths with the whole segment `part`, in its case."""
    return Rule(f"path {part}", verdict, rf"(?s)/(.*/)?{re.escape(part)}(/|\z)", _whole(part), priority)


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address: Column) -> Column:
    """The distinct runs of ASCII letters and digits, and the empty token."""
    found = F.regexp_extract_all(address, F.lit(r"[0-9A-Za-z]+"), 0)
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.priority) for r in rules],
        "name string, verdict string, pattern string, tokens array<string>, priority int",
    )


def rarest_tokens(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules, each with `filed`: its token that occurs in the fewest addresses."""
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    # Counted before the join, so that a token that many addresses share is summed in the map tasks.
    counts = (
        addresses.select(F.explode(tokens_of(F.col("address"))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    )
    return rules.join(rarest, "name", "left").select(
        "name", "verdict", "pattern", "priority", F.coalesce("least.token", F.lit("")).alias("filed")
    )


def _joined(located: DataFrame, index: DataFrame) -> DataFrame:
    """`located` with `__best`, by a join of its addresses' tokens with the filed rules."""
    addresses = materialised(located.select("__address").distinct())
    tokens = addresses.select("__address", F.explode(tokens_of(F.col("__address"))).alias("filed"))
    rules = index.groupBy("filed").agg(F.collect_list(F.struct("priority", "name", "verdict", "pattern")).alias("rules"))
    best = (
        join_spread(tokens, rules, "filed", ["__address"])
        .select("__address", F.inline("rules"))
        .where(F.expr("rlike(__address, pattern)"))
        .groupBy("__address")
        .agg(F.min(F.struct((-F.col("priority")).alias("p"), "name", "verdict")).alias("__best"))
    )
    of_address = addresses.join(best, "__address", "left")
    return join_spread(located, of_address, "__address", [c for c in located.columns if c != "__address"])


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """`pages` with host, path, the winning rule's name (or null) and the verdict."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    located = pages.select(
        *kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("__address", F.concat("host", "path"))
    rules_df = rule_table(pages.sparkSession, rules)
    index = rarest_tokens(located.select(F.col("__address").alias("address")), rules_df)
    judged = [
        *kept,
        "host",
        "path",
        F.col("__best.name").alias("rule"),
        F.coalesce("__best.verdict", F.lit(otherwise)).alias("verdict"),
    ]
    if len(rules) > most_broadcast:
        return _joined(located, index).select(*judged)
    filed = index.groupBy("filed").agg(
        F.collect_list(F.struct("priority", "name", "verdict", "pattern")).alias("rules")
    )
    # A map of at most `most_broadcast` rules, worked out once; a URL looks its tokens up in it.
    book = filed.agg(F.map_from_entries(F.collect_list(F.struct("filed", "rules"))).alias("__book"))
    fetched = F.flatten(
        F.filter(F.transform(tokens_of(F.col("__address")), lambda t: F.col("__book")[t]), F.isnotnull)
    )
    matching = F.filter("__rules", lambda r: F.rlike(F.col("__address"), r["pattern"]))
    best = F.element_at(
        F.array_sort(
            F.transform(
                matching,
                lambda r: F.struct((-r["priority"]).alias("p"), r["name"].alias("name"), r["verdict"].alias("verdict")),
            )
        ),
        1,
    )
    return (
        located.withColumn("__book", book.scalar())
        .withColumn("__rules", fetched)
        .withColumn("__best", F.when(F.size(matching) > 0, best))
        .select(*judged)
    )
