"""Filters, orders, pages, summaries and gates over findings, and the merged view of image layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence, risk

# fixed values: columns that a page may be sorted by (id where none is named), ranks of tiers
SORTABLE = ("risk_tier", "algorithm", "primitive", "language", "file", "line")
TIER_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def tier_counts(tier: str = "risk_tier") -> list[Column]:
    known = [F.count_if(F.col(tier) == t).alias(t) for t in risk.TIERS]
    other = F.count_if(F.coalesce(~F.col(tier).isin(*risk.TIERS), F.lit(True))).alias("UNSCORED")
    return [F.count("*").alias("total"), *known, other]


def risk_summary(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by tier; null and unknown tiers are UNSCORED, tiers without findings are 0."""
    return findings.groupBy(*by).agg(*tier_counts())


def scan_summary(findings: DataFrame, *by: str) -> DataFrame:
    """The same with counts by confidence band."""
    return findings.groupBy(*by).agg(*tier_counts(), *(F.count_if(F.col("confidence_band") == b).alias(b) for b in confidence.RANKS))


def select_findings(findings: DataFrame, *, tiers=(), primitives=(), languages=(), algorithms=(), min_band: str | None = None, search: str | None = None) -> DataFrame:
    """OR within each list, AND across; empty lists do not filter. A null band passes no min_band."""
    for tier in tiers:
        if tier.strip().upper() not in risk.TIERS:
            raise ValueError(f"no such tier: {tier}")
    for column, values, change in (("risk_tier", tiers, str.upper), ("primitive", primitives, str), ("language", languages, str), ("algorithm", algorithms, str)):
        if wanted := [change(v.strip()) for v in values if v.strip()]:
            findings = findings.where(F.col(column).isin(wanted))
    if min_band:
        least = confidence.RANKS.get(min_band.strip().upper())
        if least is None:
            raise ValueError(f"no such band: {min_band}")
        findings = findings.where(F.col("confidence_band").isin([b for b, r in confidence.RANKS.items() if r >= least]))
    if search:
        findings = findings.where(F.contains(F.lower(F.coalesce("file", F.lit(""))), F.lit(search.lower())) | F.contains(F.lower(F.coalesce("algorithm", F.lit(""))), F.lit(search.lower())))
    return findings


def page(findings: DataFrame, sort_by: str | None = None, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page. Ties are in order of id, nulls come last going up and first going down."""
    if sort_by not in (None, *SORTABLE) or not 1 <= limit <= 200 or offset < 0:
        raise ValueError("sort_by, limit or offset is out of range")
    name = sort_by or "id"
    key = F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()
    return findings.orderBy(key, F.col("id").asc()).offset(offset).limit(limit)


def severity_rank(tier: str = "risk_tier") -> Column:
    return reduce(lambda c, x: c.when(F.col(tier) == x[0], x[1]), TIER_RANK.items(), F).otherwise(4)


def gate(findings: DataFrame, fail_on: str, min_band: str = "UNVERIFIED", *by: str) -> DataFrame:
    """violated: whether a finding of the least band is of this tier or a worse one. UNSCORED never violates."""
    kept = F.coalesce("confidence_band", F.lit("UNVERIFIED"))
    bad = confidence.meets(kept, min_band) & (severity_rank() <= TIER_RANK[fail_on])
    return findings.groupBy(*by).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("violated"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def new_only(incoming: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Idempotent insert: the first row of each key that is not there yet."""
    return first_of(incoming, [key], order).join(known.select(key).distinct(), key, "left_anti")


def remediation(findings: DataFrame) -> DataFrame:
    fix = reduce(lambda c, x: c.when(F.col("algorithm") == x[0], x[1]), risk.FIXES.items(), F)
    return findings.withColumn("fix", fix.otherwise(risk.NO_FIX))


def merged_layers(entries: DataFrame) -> DataFrame:
    """The files of an image (image, layer_index, path, kind FILE, WHITEOUT or OPAQUE). The last layer of a path wins; a
    whiteout takes its path and all below it from lower layers, an opaque mark all below its directory."""
    files = entries.where("kind = 'FILE'").groupBy("image", "path").agg(F.max("layer_index").alias("layer_index"))
    marks = entries.where("kind <> 'FILE'").groupBy("image", F.col("path").alias("ancestor"), "kind").agg(F.max("layer_index").alias("mark_layer"))
    parts = F.split("path", "/")
    above = files.select("image", "path", "layer_index", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ancestor"))
    gone = above.join(marks, ["image", "ancestor"]).where("mark_layer > layer_index and (kind = 'WHITEOUT' or ancestor <> path)")
    return files.join(gone.select("image", "path").distinct(), ["image", "path"], "left_anti")
