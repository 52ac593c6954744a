"""URL filters: rules on host suffixes and path prefixes, found by hash prefixes.

Native: DataFrame expressions only. Each URL is expanded into host suffixes x path prefixes. Short prefixes of their digests
are joined with those of the rules; full digests then confirm, and the longest rule wins. Only expressions whose
short prefix is a rule's get past the join, so what is shuffled is a few rows for each URL that matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BROADCAST_ROWS = 200_000  # more rules than these are joined by a shuffle
LONGEST_PATH = 2048


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str = "url"):
    """Host (A-Z in lower case) and path; both empty for null and for texts without `://`."""
    at = F.instr(F.col(url), "://")
    tail = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    tail = F.split(F.coalesce(tail, F.lit("")), "[?#]", 2)[0]
    slash = F.instr(tail, "/")
    host = F.when(slash > 0, F.substring(tail, F.lit(1), slash - 1)).otherwise(tail)
    path = F.when(slash > 0, F.substring(tail, slash, F.length(tail))).otherwise("")
    return lowered(host), path


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to page_id.

    A rule fits its host and all subdomains if the path starts with its path; the longest (host and path) wins, of equal
    ones the first in order of text. Null and malformed URLs have an empty host and path, which no rule fits, and get the
    default. Repeated rows and null page_ids give their own rows; further columns are ignored; an empty table of pages or
    rules is allowed. Rule paths over 2048 characters are an error."""
    rules = rules.select(lowered(F.col("rule_host")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict").where("rule_host <> ''").dropDuplicates(["rule_host", "rule_path"])
    # host depths and path lengths that rules have: at most 127 labels and 2049 lengths
    limits = rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", "\\."))).alias("labels"), F.count("*").alias("n")).first()
    lengths, labels = sorted(limits["lengths"]), limits["labels"] or 1
    if lengths and lengths[-1] > LONGEST_PATH:
        raise ValueError("a rule's path is too long")
    digest = lambda h, p: F.sha2(F.concat(h, p), 256)  # noqa: E731  the host has no slash, the path begins with one
    host, path = url_parts()
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = pages.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    cut = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("path"))
    prefix = F.transform(cut, lambda k: F.substring(F.col("path"), F.lit(1), k))
    found = urls.select("host", "path", F.explode(suffix).alias("h")).select("host", "path", "h", F.explode(prefix).alias("p")).withColumn("digest", digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("digest", 1, 8))
    keyed = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, 8))
    if limits["n"] <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    hit = found.join(keyed, "short").where("digest = rule_digest")
    name = F.concat("rule_host", "rule_path")
    best = hit.groupBy("host", "path").agg(F.min(F.struct((-F.length(name)).alias("n"), name.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS tail FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(tail, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(tail, ''), length(regexp_extract(coalesce(tail, ''), '^[^/]*')) + 1) AS path FROM cut
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
