"""Functions for SQL, made of SQL expressions, so that Spark's optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import risk

FUNCTIONS = {
    "confidence_band(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 0.85 THEN 'VERIFIED' WHEN score >= 0.60 THEN 'PROBABLE' ELSE 'UNVERIFIED' END",
    "tier_rank(tier STRING) RETURNS INT": "CASE tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END",
    "file_criticality(file STRING) RETURNS STRING": f"CASE WHEN lower(file) RLIKE '{risk.CRITICAL_PATH}' THEN 'CRITICAL' WHEN lower(file) RLIKE '{risk.HIGH_PATH}' THEN 'HIGH' ELSE 'MEDIUM' END",
    "package_key(name STRING, ecosystem STRING) RETURNS STRING": "CASE WHEN ecosystem = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-') ELSE lower(name) END",
    "exact_version(spec STRING) RETURNS BOOLEAN": "coalesce(spec RLIKE '^[0-9][A-Za-z0-9.+_-]*$' AND NOT arrays_overlap(split(spec, '[.]'), array('x', 'X', '*')), false)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: confidence_band, tier_rank, file_criticality, package_key, exact_version."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
