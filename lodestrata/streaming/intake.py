"""Continuous intake of reports: each report once within a watermark, and counts by tier in windows of time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..operators.findings import tier_counts


def once(reports: DataFrame, key: str = "report_id", at: str = "created_at", late: str = "1 day") -> DataFrame:
    return reports.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def scored(reports: DataFrame) -> DataFrame:
    """The findings of reports (report_id, created_at, findings), scored here; the rules go to every task."""
    rows = reports.select("report_id", "created_at", F.posexplode("findings").alias("ordinal", "f")).select("report_id", "created_at", "ordinal", "f.*")
    return risk.score_findings(rows)


def tiers_by_window(findings: DataFrame, at: str = "created_at", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts by tier for each window, which is done when the watermark has passed it. `late` sets the watermark of findings that
    have none yet."""
    if late:
        findings = findings.withWatermark(at, late)
    counts = findings.groupBy(F.window(at, width)).agg(*tier_counts())
    return counts.select(F.col("window.start").alias("window_start"), *(c for c in counts.columns if c != "window"))
