"""All registered queries and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import findings as ops
from ..operators import manifests
from . import derive, scans
from .tables_sql import BAND_SQL, FIX_SQL, RANK_SQL, SCORED_SQL, TIER_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


SCORED = f"{derive.FINDINGS_SQL}, {SCORED_SQL}"


def scored(spark, d: str) -> DataFrame:
    return risk.score_findings(derive.findings(spark, d))


@query(f"WITH {SCORED} SELECT scan_id, {TIER_SQL} FROM scored GROUP BY scan_id")
def risk_summary_by_scan(spark, d):
    return ops.risk_summary(scored(spark, d), "scan_id")


@query(f"WITH {SCORED} SELECT {TIER_SQL}, {BAND_SQL} FROM scored")
def scan_summary_total(spark, d):
    return ops.scan_summary(scored(spark, d))


@query(f"WITH {derive.FINDINGS_SQL} SELECT id, scan_id, line, confidence_score, confidence_band, CASE WHEN confidence_band = 'VERIFIED' THEN 'high' ELSE 'unverified' END AS confidence FROM findings")
def confidence_of_findings(spark, d):
    from ..functions.confidence import legacy

    return derive.findings(spark, d).select("id", "scan_id", "line", "confidence_score", "confidence_band", legacy(F.col("confidence_band")).alias("confidence"))


_SCORED_COLS = "id, canonical_algorithm, key_size, risk_tier, risk_reason, quantum_threat_horizon_years, risk_model_version, classical_broken, quantum_vulnerable, urgent, hndl_exposure, data_shelf_life_years, recommended_replacement, recommendation_type, migration_effort_days, criticality, source_context"


@query(f"WITH {SCORED} SELECT {_SCORED_COLS} FROM scored")
def scored_findings(spark, d):
    return scored(spark, d).select(*_SCORED_COLS.split(", "))


@query(f"WITH {SCORED} SELECT id, scan_id, algorithm, language, risk_tier FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH') AND language IN ('python', 'java') AND confidence_band IN ('VERIFIED', 'PROBABLE') AND (contains(lower(file), 'auth') OR contains(lower(algorithm), 'auth'))")
def filtered_findings(spark, d):
    return ops.select_findings(scored(spark, d), tiers=["critical ", "HIGH"], languages=["python", "java"], min_band="PROBABLE", search="AUTH").select("id", "scan_id", "algorithm", "language", "risk_tier")


@query(f"WITH {SCORED}, d AS (SELECT DISTINCT id, algorithm, risk_tier FROM scored) SELECT id, algorithm, risk_tier FROM d ORDER BY algorithm DESC, id LIMIT 50 OFFSET 100")
def findings_page(spark, d):
    return ops.page(scored(spark, d).select("id", "algorithm", "risk_tier").distinct(), "algorithm", True, 50, 100)


@query(f"WITH {SCORED} SELECT scan_id, coalesce(bool_or(confidence_band IN ('VERIFIED', 'PROBABLE') AND {RANK_SQL} <= 1), false) AS violated FROM scored GROUP BY scan_id")
def policy_gate(spark, d):
    return ops.gate(scored(spark, d), "HIGH", "PROBABLE", "scan_id")


@query(f"WITH {SCORED}, {derive.SCANS_SQL} SELECT s.scan_id, any_value(repo_id) AS repo_id, any_value(status) AS status, count(f.id) AS total, count(*) FILTER (risk_tier = 'CRITICAL') AS critical FROM scans s LEFT JOIN scored f ON f.scan_id = s.scan_id GROUP BY s.scan_id")
def trend_by_scan(spark, d):
    joined = derive.scans(spark, d).join(scored(spark, d).select("scan_id", "id", "risk_tier"), "scan_id", "left")
    return joined.groupBy("scan_id").agg(F.first("repo_id").alias("repo_id"), F.first("status").alias("status"), F.count("id").alias("total"), F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical"))


@query(f"WITH {derive.SCANS_SQL} SELECT repo_id, scan_id, status FROM scans QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, scan_id DESC) = 1")
def latest_scan_by_repository(spark, d):
    return derive.scans(spark, d).groupBy("repo_id").agg(F.max_by(F.struct("scan_id", "status"), F.struct("started_at", "scan_id")).alias("s")).select("repo_id", "s.*")


@query(f"WITH {derive.FINDINGS_SQL} SELECT DISTINCT algorithm, {FIX_SQL} AS fix FROM findings")
def remediation_by_algorithm(spark, d):
    return ops.remediation(derive.findings(spark, d).select("algorithm").distinct())


@query(f"WITH {derive.FINDINGS_SQL} SELECT file, algorithm, min(line) AS line, count(*) AS occurrences FROM findings GROUP BY file, algorithm")
def deduplicated_findings(spark, d):
    return derive.findings(spark, d).groupBy("file", "algorithm").agg(F.min("line").alias("line"), F.count("*").alias("occurrences"))


@query("SELECT o_orderkey AS report_id, o_custkey % 50 AS agent_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def idempotent_ingest(spark, d):
    reports = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 50).alias("agent_id"), "o_custkey")
    known = reports.where("o_custkey % 7 = 0")
    return ops.new_only(reports.unionByName(reports), known, "report_id", ["agent_id"]).select("report_id", "agent_id")


@query(f"""WITH {derive.LAYERS_SQL}, files AS (SELECT image, path, max(layer_index) AS layer_index FROM entries WHERE kind = 'FILE' GROUP BY image, path)
SELECT image, path, layer_index FROM files f WHERE NOT EXISTS (SELECT 1 FROM entries m WHERE m.image = f.image AND m.kind <> 'FILE' AND m.layer_index > f.layer_index
  AND (m.kind = 'WHITEOUT' AND m.path = f.path OR starts_with(f.path, m.path || '/')))""")
def merged_layer_view(spark, d):
    return ops.merged_layers(derive.layer_entries(spark, d))


@query("""WITH o AS (SELECT o_orderkey AS path, o_orderkey % 4 AS shape, o_custkey AS v FROM orders)
SELECT path, 2 AS lineno, 'ssl_protocols' AS directive, 'TLSv1.' || (v % 4) || ' TLSv1.3' AS value FROM o WHERE shape IN (0, 1)
UNION ALL SELECT path, 4, 'ssl_ciphers', 'RC4:DES' || v FROM o WHERE shape = 0
UNION ALL SELECT path, 5, 'ssl_ciphers', 'HIGH:!MD5 # ' || v FROM o WHERE shape = 1
UNION ALL SELECT path, 1, 'server', '{' FROM o WHERE shape = 2
UNION ALL SELECT path, 2, 'listen', (v % 1000) || ' ssl' FROM o WHERE shape = 2
UNION ALL SELECT path, 4, '}', '# end' FROM o WHERE shape = 2
UNION ALL SELECT path, 3, 'ssl_verify_client', 'off' FROM o WHERE shape = 3 AND v % 2 = 1""")
def nginx_directives(spark, d):
    o = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 4).alias("shape"), F.col("o_custkey").cast("string").alias("v"), "o_custkey")
    text = (
        F.when(F.col("shape") == 0, F.concat(F.lit("# tls\n  SSL_protocols   TLSv1."), F.col("o_custkey") % 4, F.lit(" TLSv1.3;\n\nssl_ciphers RC4:DES"), "v", F.lit(";\n}\nlonely;\n")))
        .when(F.col("shape") == 1, F.concat(F.lit("{\n\tssl_protocols\tTLSv1."), F.col("o_custkey") % 4, F.lit(" TLSv1.3 ;\n\t#ssl_ciphers x;\n\n\t ssl_ciphers  HIGH:!MD5 # "), "v"))
        .when(F.col("shape") == 2, F.concat(F.lit("server {\r\n\tlisten "), F.col("o_custkey") % 1000, F.lit(" ssl;\r\n  }\r\n} # end\r\n")))
        .otherwise(F.concat(F.lit("\n \t \n"), F.when(F.col("o_custkey") % 2 == 1, "ssl_verify_client off;").otherwise("#ssl_verify_client off;")))
    )
    return manifests.nginx_directives(o.select("path", text.alias("text")))


@query("""WITH p AS (SELECT p_partkey AS path, p_partkey % 3 AS shape, p_size AS v FROM part)
SELECT path, 3 AS line, 'Py_Crypto.x' AS name, CASE WHEN path % 2 = 0 THEN '2.' || v END AS version FROM p WHERE shape = 0
UNION ALL SELECT path, 5, 'cryptography', NULL FROM p WHERE shape = 0
UNION ALL SELECT path, 1, 'requests', '2.' || v FROM p WHERE shape = 1
UNION ALL SELECT path, 4, 'flask', '1.0' FROM p WHERE shape = 1
UNION ALL SELECT path, 6, 'own', NULL FROM p WHERE shape = 1
UNION ALL SELECT path, 2, 'a.b', '1!2.' || v || '+x' FROM p WHERE shape = 2
UNION ALL SELECT path, 3, 'c', NULL FROM p WHERE shape = 2""")
def requirement_lines(spark, d):
    p = derive.table(spark, d, "part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 3).alias("shape"), F.col("p_size").cast("string").alias("v"))
    p = derive.dealt(p, "path")
    spec = F.concat(F.when(F.col("path") % 2 == 0, "==").otherwise(">="), F.lit("2."), "v")
    text = (
        F.when(F.col("shape") == 0, F.concat(F.lit("# pins\n-r base.txt\nPy_Crypto.x[extra]"), spec, F.lit(" ; python_version > '3' \\\n  --hash=sha256:00 # why\ncryptography ==41.* # loose\ngit+https://host/x.git\n")))
        .when(F.col("shape") == 1, F.concat(F.lit("req\\\n  uests==2."), "v", F.lit("\t# tab\n#flask\n\tflask == 1.0\n./local\nown @ https://host/own.whl\n")))
        .otherwise(F.concat(F.lit("\r\na.b === 1!2."), "v", F.lit("+x\r\nc[one,two] ~= 2 ; extra == 'q'\r\n--index-url https://host\r\n")))
    )
    return manifests.requirements(p.select("path", text.alias("text"))).drop("declared")


@query(f"""WITH {SCORED} SELECT count(*) FILTER (classical_broken) AS broken, count(*) FILTER (quantum_vulnerable) AS quantum, count(DISTINCT file) AS files, count(DISTINCT recommended_replacement) AS replacements, {BAND_SQL} FROM scored""")
def compliance_report(spark, d):
    return scored(spark, d).agg(F.count_if("classical_broken").alias("broken"), F.count_if("quantum_vulnerable").alias("quantum"), F.countDistinct("file").alias("files"), F.countDistinct("recommended_replacement").alias("replacements"), *(F.count_if(F.col("confidence_band") == b).alias(b) for b in ("VERIFIED", "PROBABLE", "UNVERIFIED")))


@query(f"WITH {SCORED} SELECT CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {RANK_SQL}, id) AS INT) AS place, scan_id, id, risk_tier FROM (SELECT DISTINCT scan_id, id, risk_tier FROM scored)")
def severity_order(spark, d):
    rows = scored(spark, d).select("scan_id", "id", "risk_tier").distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("scan_id").orderBy(ops.severity_rank(), "id")))


from . import artefact_queries, inventory_queries, order_queries  # noqa: E402  they take queries of this module

QUERIES |= scans.QUERIES | inventory_queries.QUERIES | order_queries.QUERIES | artefact_queries.QUERIES
ORACLES |= scans.ORACLES | inventory_queries.ORACLES | order_queries.ORACLES | artefact_queries.ORACLES
