"""The columns of a finding, and projections to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import confidence

CONFIDENCE_MODEL = "conf-1.0.0"
#: Columns and what a finding has where an engine says nothing.
COLUMNS = {
    "file": "string",
    "line": "int",
    "matched_call": "string",
    "library": "string",
    "algorithm": "string",
    "primitive": "string",
    "language": "string",
    "weak_by_default": "boolean",
    "confidence": "string",
    "key_size": "int",
    "detection_method": "string",
    "confidence_score": "decimal(3,2)",
    "confidence_band": "string",
    "confidence_signals": "array<string>",
    "confidence_model_version": "string",
    "artifact_type": "string",
    "artifact_ref": "string",
    "package_ecosystem": "string",
    "package_name": "string",
    "package_version": "string",
}


def as_findings(rows: DataFrame, *more: str, **given: Column | str) -> DataFrame:
    """rows as findings: columns that are given, that rows have, or nulls; scores from confidence_signals. `more` names columns
    that are carried along."""
    rows = rows.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()})
    if "confidence_signals" in rows.columns:
        rows = rows.withColumn("confidence_signals", confidence.distinct_signals(F.col("confidence_signals"))).withColumn("confidence_score", confidence.score(F.col("confidence_signals")))
        rows = rows.withColumn("confidence_band", confidence.band(F.col("confidence_score")))
        rows = rows.withColumn("confidence", confidence.legacy(F.col("confidence_band")))
    else:
        rows = rows.withColumns({"confidence_signals": F.array(), "confidence_score": F.lit(0), "confidence_band": F.lit("UNVERIFIED"), "confidence": F.lit("unverified")})
    rows = rows.withColumn("confidence_model_version", F.lit(CONFIDENCE_MODEL))
    return rows.select(*more, *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def fingerprint(repository: str = "repository", *columns: str) -> Column:
    """SHA-256 over the repository and what tells a finding from others, with a separator that no name has."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (repository, *(columns or ("file", "algorithm", "primitive", "matched_call")))]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)
