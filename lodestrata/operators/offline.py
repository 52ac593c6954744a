"""Bills of materials without the inventory: from scored findings and their summary as JSON, checked and reconciled first."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import bom
from .bom import TIERS, _get, _kind, _text

# fixed values: fields that a scored finding has to have, in the order in which the first missing one is named
REQUIRED = ("algorithm", "confidence", "file", "library", "line", "primitive", "risk_reason", "risk_tier")
COUNTS = ("total", *TIERS)
_TYPES = {"file": "string", "line": "int", "algorithm": "string", "key_size": "int", "confidence": "string", "confidence_band": "string", "confidence_score": "string", "risk_tier": "string", "criticality": "string", "risk_reason": "string", "source_context": "string", "detection_method": "string", "artifact_type": "string"}
_TYPES |= dict.fromkeys(("risk_model_version", "classical_broken", "quantum_vulnerable", "hndl_exposure", "recommended_replacement", "recommendation_type", "migration_effort_days", "data_shelf_life_years", "quantum_threat_horizon_years", "assumption_source"), "string")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """at, item of a file with one JSON array, or of files with an object in each line; what is no JSON is an item that is null."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("scan_id"), F.col("value").alias("text"))
    whole = texts.withColumn("v", F.try_parse_json("text"))
    arrays = whole.where(_kind(F.col("v")) == "ARRAY").select("scan_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "item"))
    lines = whole.where(F.coalesce(_kind(F.col("v")) != "ARRAY", F.lit(True))).select("scan_id", F.posexplode(F.split("text", "\\r?\\n")).alias("at", "line")).where("trim(line) <> ''")
    return arrays.unionByName(lines.select("scan_id", "at", F.try_parse_json("line").alias("item")))


def finding_problems(items: DataFrame) -> DataFrame:
    """at, problem: the first thing wrong with each item, in the order of items. Right ones have no row."""
    v = F.col("item")
    has = lambda name: _get(v, name).isNotNull()
    kind = lambda name: F.coalesce(_kind(_get(v, name)), F.lit("VOID"))
    problem = F.when(v.isNull() | (_kind(v) != "OBJECT"), "must be an object")
    for name in REQUIRED:
        problem = problem.when(~has(name), f"missing required field: {name}")
    for name in ("file", "algorithm"):
        problem = problem.when(kind(name) != "STRING", "invalid file or algorithm")
    line = F.coalesce(F.try_variant_get(_get(v, "line"), "$", "long"), F.lit(-1))
    problem = problem.when((kind("line") != "BIGINT") | (line < 0), "invalid line")
    tier_ok = (kind("risk_tier") == "VOID") | (kind("risk_tier") == "STRING") & F.coalesce(_text(_get(v, "risk_tier")).isin(*TIERS), F.lit(False))
    problem = problem.when(~tier_ok, "invalid risk_tier")
    return items.select("scan_id", "at", problem.alias("problem")).where("problem is not null").orderBy("scan_id", "at")


def findings_of(items: DataFrame) -> DataFrame:
    """Items that are right as scored findings; a finding without an id is numbered from 1 in their order."""
    v = F.col("item")
    field = lambda name, kind: F.try_variant_get(_get(v, name), "$", kind)
    own = {"id": F.coalesce(field("id", "string"), (F.col("at") + 1).cast("string"))} | {n: field(n, t) for n, t in _TYPES.items()}
    return items.select("at", *(c.alias(n) for n, c in own.items()))


def summary_problems(summary: Column, items: DataFrame) -> DataFrame:
    """problem: what is wrong with a summary (a variant) of these findings, one row for each: fields that are missing or no counts,
    and counts that the findings don't have."""
    tier = F.coalesce(_text(_get(F.col("item"), "risk_tier")), F.lit("UNSCORED"))
    counted = items.agg(F.count("*").alias("total"), *(F.count_if(tier == t).alias(t) for t in TIERS)).withColumn("s", summary)
    out = [F.when(F.coalesce(_kind(F.col("s")), F.lit("")) != "OBJECT", "summary must be an object")]
    for name in COUNTS:
        value = _get(F.col("s"), name)
        n = F.try_variant_get(value, "$", "long")
        counts = (F.coalesce(_kind(value), F.lit("")) == "BIGINT") & (F.coalesce(n, F.lit(-1)) >= 0)
        out.append(F.when(_kind(F.col("s")) == "OBJECT", F.when(value.isNull(), f"summary has no {name}").when(~counts, f"{name} is no count").when(n != F.col(name), f"{name} doesn't match the findings")))
    return counted.select(F.explode(F.array_compact(F.array(*out))).alias("problem"))


def document(spark: SparkSession, findings_path: str, summary_path: str, started_at: str, organization_id: str | None = None) -> str:
    """The bill of materials of one scan's files as JSON text. Wrong rows, a wrong summary and one that the rows don't bear out are
    errors that name the first problem."""
    items = stored(read_items(spark, findings_path), "items")
    wrong = finding_problems(items).limit(1).collect()
    if wrong:
        raise ValueError(f"finding at index {wrong[0].at}: {wrong[0].problem}")
    with_summary = spark.read.text(summary_path, wholetext=True).select(F.try_parse_json("value").alias("s"))
    text = with_summary.select(F.to_json("s").alias("j")).first()
    problems = summary_problems(F.try_parse_json(F.lit(text.j if text and text.j else "null")), items).collect()
    if problems:
        raise ValueError(problems[0].problem)
    found = findings_of(items).withColumn("scan_id", F.lit(1))
    scans = spark.createDataFrame([(1, started_at, "completed")], "scan_id int, started_at string, status string")
    built = bom.documents(found, scans).first().document
    if organization_id is None:
        return built
    doc = json.loads(built)
    doc["metadata"]["properties"] = [{"name": f"{bom.OWN}organization_id", "value": organization_id}]
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
