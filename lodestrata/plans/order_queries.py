"""Queries in an order of all rows (numbers, chains, decisions as of a time), and over bundles, packages, trends and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk
from ..operators import bundles, inventory, scan
from ..operators.numbering import previous
from . import derive
from .inventory_queries import SCORED, _scored

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {derive.FINDINGS_SQL}, f AS (SELECT DISTINCT scan_id % 2 AS engine, file, line, algorithm, 'p' || (scan_id % 5) AS package_name, id AS matched_call FROM findings)
SELECT *, row_number() OVER (ORDER BY engine, file, line, algorithm, package_name, matched_call) - 1 AS finding_id FROM f""")
def findings_in_order(spark, d):
    f = derive.findings(spark, d)
    rows = f.select((F.col("scan_id") % 2).alias("engine"), "file", "line", "algorithm", F.concat(F.lit("p"), F.col("scan_id") % 5).alias("package_name"), F.col("id").alias("matched_call")).distinct()
    return scan.in_order(rows, "finding_id")


_CHAIN = """WITH e AS (SELECT CASE WHEN user_id % 3 < 2 THEN 'main' ELSE event_type END AS organization_id, event_id AS id, sha256('h' || event_id || event_type) AS entry_hash FROM events),
c AS (SELECT *, lag(entry_hash) OVER (PARTITION BY organization_id ORDER BY id) AS before FROM e),
t AS (SELECT *, CASE WHEN id % 97 = 5 THEN 'changed' ELSE before END AS prev_hash FROM c)"""


@query(f"""{_CHAIN}, b AS (SELECT *, prev_hash IS DISTINCT FROM before AS bad FROM t)
SELECT organization_id, NOT bool_or(bad) AS ok, count(*) AS checked, min(id) FILTER (bad) AS first_bad_id, count(*) FILTER (bad) AS bad FROM b GROUP BY organization_id""")
def audit_chain_links(spark, d):
    e = derive.table(spark, d, "events")
    main = F.when(F.col("user_id") % 3 < 2, "main").otherwise(F.col("event_type"))
    entries = e.select(main.alias("organization_id"), F.col("event_id").alias("id"), F.sha2(F.concat(F.lit("h"), "event_id", "event_type"), 256).alias("entry_hash"))
    chained = previous(entries, ["organization_id"], ["id"], "entry_hash", "before")
    chained = chained.withColumn("prev_hash", F.when(F.col("id") % 97 == 5, "changed").otherwise(F.col("before"))).drop("before")
    return inventory.verify_chain(chained, recompute=False)


@query("""WITH t AS (SELECT o_custkey % 97 AS f, o_orderdate AS at, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL),
l AS (SELECT l_orderkey AS scan_id, l_suppkey % 120 AS fingerprint, l_shipdate AS started_at, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l.scan_id, l.fingerprint, l.started_at, l.n, t.status AS triage_status, t.at AS triaged_at FROM l ASOF LEFT JOIN t ON l.fingerprint = t.f AND l.started_at >= t.at""")
def triage_as_of_scan(spark, d):
    found = derive.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id"), (F.col("l_suppkey") % 120).alias("fingerprint"), F.col("l_shipdate").alias("started_at")).agg(F.count("*").alias("n"))
    triage = derive.table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("fingerprint"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("triage_id"), F.col("o_orderstatus").alias("status"))
    return inventory.triage_as_of(found, triage)


_BODY = """'{"agent_id":"a' || (o_custkey % 7) || '","created_at":"2026-01-02T03:04:05+00:00","findings":[{"algorithm":"RSA","file":"é' || o_orderkey || '.py","key_size":' || (1024 + o_custkey % 3) || ',"line":1}],"organization_id":"o","report_id":"r' || o_orderkey || '","repository_id":"p","summary":{"CRITICAL":' || (o_orderkey % 3) || ',"total":1}}'"""


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_orderkey % 6 AS shape, 'sha256:' || sha256({_BODY}) AS digest FROM orders)
SELECT 's' || id AS source, CASE WHEN shape < 5 THEN 'r' || id END AS report_id, CASE WHEN shape < 5 THEN digest END AS digest,
  CASE shape WHEN 1 THEN 'digest' WHEN 2 THEN 'algorithm' WHEN 3 THEN 'no digest or signature' WHEN 5 THEN 'no JSON object' END AS reason FROM b""")
def bundle_digests(spark, d):
    """Bundles as agents might write them: fields in another order and with spaces."""
    o = derive.table(spark, d, "orders")
    n, shape = F.col("o_orderkey"), F.col("o_orderkey") % 6
    agent, size, critical = (F.col("o_custkey") % 7).cast("string"), (F.col("o_custkey") % 3 + 1024).cast("string"), (n % 3).cast("string")
    finding = lambda a, b, c: F.concat(F.lit(a), n.cast("string"), F.lit(b), size, F.lit(c))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key = n.cast("string")
    canonical = text('{"agent_id":"a', agent, '","created_at":"2026-01-02T03:04:05+00:00","findings":[', finding('{"algorithm":"RSA","file":"é', '.py","key_size":', ',"line":1}'), '],"organization_id":"o","report_id":"r', key, '","repository_id":"p","summary":{"CRITICAL":', critical, ',"total":1}}')
    claimed = F.when(shape == 1, "sha256:00").otherwise(F.concat(F.lit("sha256:"), F.sha2(canonical, 256)))
    algorithm, signature = F.when(shape == 2, "RSA").otherwise("Ed25519"), F.when(shape == 3, "null").otherwise('"c2ln"')
    sent = text('{ "summary": {"total": 1, "CRITICAL": ', critical, '},\n "signature": ', signature, ', "bundle_digest": "', claimed, '", "signature_algorithm": "', algorithm, '", "report_id": "r', key, '", "repository_id": "p", "organization_id": "o", "created_at": "2026-01-02T03:04:05+00:00", "agent_id": "a', agent, '",\n "findings": [', finding('{"file": "\\u00e9', '.py", "line": 1, "algorithm": "RSA", "key_size": ', "}"), "]}")
    sent = F.when(shape == 5, F.concat(F.lit("["), sent)).otherwise(sent).cast("binary")
    files = o.select(F.concat(F.lit("s"), n).alias("source"), F.length(sent).alias("length"), sent.alias("content"))
    return bundles.checked(files).select("source", "report_id", "digest", "reason")


@query(f"""WITH {SCORED}, p AS (SELECT *, ['pypi', 'npm', 'deb'][scan_id % 3 + 1] AS package_ecosystem, CASE WHEN scan_id % 4 > 0 THEN 'lib' || (scan_id % 50) END AS package_name, CASE WHEN line % 3 > 0 THEN '1.' || line END AS package_version,
  ['DEPENDENCY_MANIFEST', 'CONTAINER_LAYER', 'BINARY'][line % 3 + 1] AS artifact_type FROM scored)
SELECT package_ecosystem, package_name, package_version, algorithm, array_to_string(list_sort(list_distinct(list(artifact_type))), ',') AS found_as, count(*) AS findings,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNSCORED'][min(CASE risk_tier WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END)] AS risk_tier FROM p WHERE package_name IS NOT NULL GROUP BY 1, 2, 3, 4""")
def same_library_across_engines(spark, d):
    n, line = F.col("scan_id"), F.col("line")
    one = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % 3).cast("int") + 1)
    found = _scored(spark, d).withColumns({
        "package_ecosystem": one(("pypi", "npm", "deb"), n), "package_name": F.when(n % 4 > 0, F.concat(F.lit("lib"), n % 50)), "package_version": F.when(line % 3 > 0, F.concat(F.lit("1."), line)),
        "artifact_type": one(("DEPENDENCY_MANIFEST", "CONTAINER_LAYER", "BINARY"), line),
    })
    return inventory.same_library(found).withColumn("found_as", F.array_join("found_as", ","))


_TIERS = ", ".join(f"count(*) FILTER (risk_tier = '{t}') AS \"{t}\"" for t in risk.TIERS)


@query(f"""WITH {SCORED}, {derive.SCANS_SQL}, n AS (SELECT scan_id, count(*) AS total, {_TIERS} FROM scored GROUP BY scan_id)
SELECT s.scan_id, s.repo_id, c_name AS repository, s.started_at, coalesce(total, 0) AS total, {", ".join(f'coalesce("{t}", 0) AS "{t}"' for t in risk.TIERS)} FROM scans s JOIN customer ON c_custkey = repo_id LEFT JOIN n ON n.scan_id = s.scan_id""")
def trend_of_repositories(spark, d):
    repositories = derive.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"))
    return inventory.trend(derive.scans(spark, d), repositories, _scored(spark, d))


_BANDS = ", ".join(f"count(*) FILTER (confidence_band = '{b}') AS \"{b}\"" for b in ("VERIFIED", "PROBABLE", "UNVERIFIED"))


@query(f"""WITH {SCORED} SELECT language, count(*) AS total, {_TIERS}, count(*) FILTER (risk_tier = 'UNSCORED') AS "UNSCORED", {_BANDS}, count(*) FILTER (classical_broken) AS broken, count(*) FILTER (quantum_vulnerable) AS quantum,
  count(DISTINCT file) AS files, array_to_string(list_sort(list_distinct(list(recommended_replacement))), '; ') AS replacements FROM scored GROUP BY language""")
def compliance_by_language(spark, d):
    out = inventory.compliance(_scored(spark, d), "language")
    return out.withColumn("replacements", F.array_join("replacements", "; ")).drop("models")


@query(f"""WITH {SCORED}, {derive.SCANS_SQL}, c AS (SELECT risk_tier AS tier, count(*) AS n FROM scored GROUP BY risk_tier), t AS (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNSCORED']) AS tier),
a AS (SELECT tier, coalesce(n, 0) AS n FROM t LEFT JOIN c USING (tier))
SELECT (SELECT count(*) FROM scans WHERE status = 'running') AS active_scans, (SELECT count(*) FROM scored WHERE risk_tier = 'CRITICAL') AS critical, (SELECT count(*) FROM scored WHERE quantum_vulnerable) AS quantum, (SELECT count(*) FROM scored) AS total,
  tier, n, n / (SELECT max(n) FROM a) AS of_greatest, n / (SELECT sum(n) FROM a) AS of_all FROM a""")
def dashboard_counts(spark, d):
    return inventory.dashboard(derive.scans(spark, d), _scored(spark, d)).select("active_scans", "critical", "quantum", "total", F.inline("tiers"))
