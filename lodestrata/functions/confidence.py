"""Detection confidence from evidence signals, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of signals in hundredths, least scores of bands
WEIGHTS = {"import_resolved": 35, "alias_traced": 15, "call_site_matched": 20, "literal_algorithm_arg": 15, "key_size_extracted": 5, "rule_yaml_matched": 10, "expected_module_confirmed": 20, "dynamic_algorithm_arg": -20, "import_unresolved": -40, "path_looks_like_test": -10, "path_looks_like_vendor": -10}
BANDS = (("VERIFIED", 85), ("PROBABLE", 60), ("UNVERIFIED", None))
RANKS = {"VERIFIED": 2, "PROBABLE": 1, "UNVERIFIED": 0}


def distinct_signals(signals: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(signals, F.array().cast("array<string>"))))


def score(signals: Column) -> Column:
    """Sum of the distinct signals' weights (unknown ones weigh nothing), within 0 and 1."""
    has = lambda s: F.coalesce(F.array_contains(signals, s), F.lit(False))
    total = reduce(Column.__add__, (F.when(has(s), w).otherwise(0) for s, w in WEIGHTS.items()))
    return (F.least(F.greatest(total, F.lit(0)), F.lit(100)) / 100).cast("decimal(3,2)")


def band(value: Column) -> Column:
    return F.when(value >= 0.85, "VERIFIED").when(value >= 0.60, "PROBABLE").otherwise("UNVERIFIED")


def rank(value: Column) -> Column:
    """2, 1, 0 by band; unknown and null bands count as UNVERIFIED."""
    return F.when(value == "VERIFIED", 2).when(value == "PROBABLE", 1).otherwise(0)


def meets(value: Column, least: str) -> Column:
    return rank(value) >= RANKS.get(least, 0)


def legacy(value: Column) -> Column:
    return F.when(value == "VERIFIED", "high").otherwise("unverified")
