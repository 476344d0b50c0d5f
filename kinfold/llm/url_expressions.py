"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions under which a rule could be filed: each suffix of its host by labels with each
prefix of its path that ends at a slash. Expressions meet rules in an equi-join on a short prefix of their SHA-256; the full
digest and the rest of the rule's path then confirm a match, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import column, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join compares; the rest is compared after it.
SHORT_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = rest
    for end in "/?#":
        host = F.substring_index(host, end, 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    for end in "?#":
        path = F.substring_index(path, end, 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) filed under their host and their path up to its last slash.

    A null path is empty. Rules with an empty or null host or a null verdict fit nothing. Of rules that differ only in the
    verdict, the one that blocks stays.
    """
    return (
        rules.where((F.length("host") > 0) & F.col("verdict").isNotNull())
        .groupBy(
            F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule_folder", F.regexp_extract("rule_path", r"(?s)^.*/", 0))
        .withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_folder")))
        .withColumn("rule_short", F.substring("rule_digest", 1, SHORT_DIGITS))
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("slashes", F.size(F.split("rule_folder", "/")) - 1))


def expressions(urls: DataFrame, most_labels: Column, most_slashes: Column) -> DataFrame:
    """One row per (host, path) and expression of at most so many labels and slashes, with its digest."""
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), most_labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    folders = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, most_slashes)),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"), F.lit("/"))))
    return (
        urls.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
        .withColumn("short", F.substring("digest", 1, SHORT_DIGITS)))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winning rule, else null) and verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest rule wins, of equally long
    ones that with the longer host. Every row of ``pages`` stays, repeated rows too. Null and unparsable URLs have an empty
    host and path and get the default, as everything does when there are no rules. Columns with the name of a new one are
    replaced. URLs are expanded once per distinct host and path, and only as deep as the deepest rule.
    """
    host, path = host_and_path(column(url))
    kept = without(pages, "host", "path", "rule", "verdict")
    rows = pages.select(F.struct(*[column(c) for c in kept.columns]).alias("row"), host.alias("host"), path.alias("path"))
    index = rule_index(rules)
    # two numbers that bound the expansion; they come from the rules, not from the pages
    deepest = index.agg(F.max("labels"), F.max("slashes")).first()
    urls = rows.select("host", "path").where(F.length("host") > 0).distinct()
    matched = (
        expressions(urls, F.lit(deepest[0] or 0), F.lit(deepest[1] or 0)) if deepest[0]
        else urls.limit(0).selectExpr("*", "'' suffix", "'' folder", "'' digest", "'' short"))
    confirmed = (
        matched.join(index, matched["short"] == index["rule_short"])
        .where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path")))
    winners = (
        confirmed.groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict"))
    return (
        rows.join(winners, ["host", "path"], "left")
        .select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
