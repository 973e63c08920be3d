"""URL filters: each URL's host suffixes and path prefixes are joined with the rules on a short hash prefix.

Only expressions of a shape that some rule has (so many labels, such a path length) are made. Distinct (host, path) pairs are
judged once each, whatever number of pages has them. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(rest_of(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def hashed(rows: DataFrame, expression: Column) -> DataFrame:
    """Adds the digest of an expression, and its first four bytes."""
    return rows.withColumn("digest", F.sha2(expression, 256)).withColumn("prefix", F.substring("digest", 1, 8))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", broadcast_rules: int = 200_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict. rules: host, path, verdict ('allow' or 'block').

    A rule fits its host and all subdomains where the URL's path starts with its own. The longest rule (host and path
    together) wins; of equally long ones that with the longer host, then block before allow. No rule: rule null, verdict
    `otherwise`. Null URLs, and those without ://, have an empty host and path and fit no rule but one with an empty host.
    Rules with nulls are left out; repeated rules count once. Repeated pages come back repeated. An empty table gives no
    rows, and without rules each page gets `otherwise`. Rules are broadcast if they number at most broadcast_rules.
    """
    known = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    labels = lambda c: F.size(F.split(c, r"\.", -1))
    known = hashed(known, F.concat("r_host", "r_path")).withColumns({"labels": labels(F.col("r_host")), "length": F.length("r_path")})
    # All shapes, as one row: hosts have 127 labels at most and paths some thousand characters, so they are few.
    shapes = known.select("labels", "length").distinct().agg(F.collect_list(F.struct("labels", "length")).alias("shapes"))
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts, n, size = F.split("host", r"\.", -1), labels(F.col("host")), F.length("path")
    fitting = F.filter("shapes", lambda s: (s["labels"] <= n) & (s["length"] <= size))
    expression = F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(parts, n - s["labels"] + 1, s["labels"]), "."), F.substr(F.col("path"), F.lit(1), s["length"])))
    distinct = urls.select("host", "path").distinct().crossJoin(F.broadcast(shapes))
    expanded = hashed(distinct.select("host", "path", F.explode(expression).alias("expression")), F.col("expression"))
    side = known.select("prefix", F.col("digest").alias("r_digest"), "r_host", "r_path", "r_verdict")
    side = F.broadcast(side) if known.count() <= broadcast_rules else side
    fit = expanded.join(side, "prefix").where("digest = r_digest")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = fit.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
