"""Two-axis risk of findings: rules by algorithm, key sizes, data lifetime, criticality of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON_YEARS, MODEL = 12.0, "2026.1"
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# fixed values: algorithm, tier, broken classically, broken by quantum computers, replacement, its kind, days of migration, years of shelf life
RULES = [
    ("MD5", "CRITICAL", True, False, "SHA-256 or BLAKE2", "classical", 1, 0.0),
    ("SHA-1", "CRITICAL", True, False, "SHA-256", "classical", 1, 0.0),
    ("SHA-224", "LOW", False, False, None, None, 0, None),
    ("SHA-256", "LOW", False, False, None, None, 0, None),
    ("SHA-384", "LOW", False, False, None, None, 0, None),
    ("SHA-512", "LOW", False, False, None, None, 0, None),
    ("DES", "CRITICAL", True, False, "AES-256-GCM", "classical", 3, 0.0),
    ("3DES", "HIGH", False, False, "AES-256-GCM", "classical", 5, 0.0),
    ("RC4", "CRITICAL", True, False, "AES-256-GCM", "classical", 3, 0.0),
    ("AES", "LOW", False, False, None, None, 0, None),
    ("AES-256", "LOW", False, False, None, None, 0, None),
    ("RSA", "HIGH", False, True, "ML-KEM-768 + ML-DSA-65 (hybrid with RSA-3072+)", "hybrid", 30, 10.0),
    ("ECC", "HIGH", False, True, "ML-KEM-768 + ML-DSA-65", "post-quantum", 30, 10.0),
    ("DSA", "HIGH", False, True, "ML-DSA-65", "post-quantum", 21, 10.0),
    ("HMAC", "LOW", False, False, None, None, 0, None),
    ("TLS", "MEDIUM", False, False, "TLS-1.3 with hybrid PQC key exchange (draft)", "hybrid", 7, 5.0),
    ("TLS-1.0", "CRITICAL", True, False, "TLS-1.3", "classical", 7, 0.0),
    ("TLS-1.1", "HIGH", True, False, "TLS-1.3", "classical", 7, 0.0),
    ("TLS-1.2", "MEDIUM", False, False, "TLS-1.3 with hybrid PQC (draft)", "hybrid", 14, 5.0),
    ("TLS-1.3", "LOW", False, False, None, None, 0, None),
]
# fixed values: a name in lower case and its canonical name; other names are put in upper case
ALIASES = [
    ("md5", "MD5"),
    ("sha1", "SHA-1"),
    ("sha-1", "SHA-1"),
    ("sha224", "SHA-224"),
    ("sha-224", "SHA-224"),
    ("sha256", "SHA-256"),
    ("sha-256", "SHA-256"),
    ("sha384", "SHA-384"),
    ("sha-384", "SHA-384"),
    ("sha512", "SHA-512"),
    ("sha-512", "SHA-512"),
    ("des", "DES"),
    ("3des", "3DES"),
    ("triple-des", "3DES"),
    ("triple_des", "3DES"),
    ("rc4", "RC4"),
    ("arc4", "RC4"),
    ("aes", "AES"),
    ("aes-128-cbc", "AES"),
    ("aes-256-gcm", "AES-256"),
    ("aes-256-cbc", "AES-256"),
    ("aes256", "AES-256"),
    ("aes-256", "AES-256"),
    ("rsa", "RSA"),
    ("ecc", "ECC"),
    ("ec", "ECC"),
    ("dsa", "DSA"),
    ("hmac", "HMAC"),
    ("tls", "TLS"),
    ("tls1.0", "TLS-1.0"),
    ("tls-1.0", "TLS-1.0"),
    ("tls1.1", "TLS-1.1"),
    ("tls-1.1", "TLS-1.1"),
    ("tls1.2", "TLS-1.2"),
    ("tls-1.2", "TLS-1.2"),
    ("tls1.3", "TLS-1.3"),
    ("tls-1.3", "TLS-1.3"),
]
# fixed values: reasons by algorithm; those of RSA keys by size, where {} is the size
REASONS = {
    "MD5": "MD5 is classically broken — collision attacks are well-documented and computationally trivial. Immediate replacement with SHA-256 required.",
    "SHA-1": "SHA-1 is classically broken — the SHAttered chosen-prefix collision was demonstrated at ~$45k cloud cost. Replace with SHA-256 immediately.",
    "DES": "DES uses a 56-bit key that has been feasibly brute-forced since 1999. Replace with AES-256-GCM for authenticated encryption.",
    "3DES": "3DES is deprecated by NIST — Sweet32 birthday attack demonstrates 64-bit block cipher weakness. Migrate to AES-256-GCM.",
    "RC4": "RC4 has known statistical biases and is prohibited in TLS by RFC 7465. Replace immediately with AES-256-GCM.",
    "RSA": "RSA is quantum-vulnerable — Shor's algorithm breaks it regardless of key size. Confirm the data shelf life and migration effort before setting a Mosca urgency. Plan a compatible hybrid migration to ML-KEM-768 for key establishment.",
    "ECC": "ECC is quantum-vulnerable — Shor's algorithm breaks all elliptic curve groups. Migrate to NIST-standardized ML-KEM (key exchange) or ML-DSA (signatures).",
    "DSA": "DSA is quantum-vulnerable via Shor's algorithm. Migrate digital signatures to ML-DSA-65 (NIST FIPS 204).",
    "TLS": "TLS usage detected; assess version. TLS 1.0/1.1 are critically broken; TLS 1.2 is acceptable but lacks PQC key exchange; TLS 1.3 is recommended.",
    "TLS-1.0": "TLS 1.0 is classically broken (POODLE, BEAST) and deprecated by RFC 8996. Upgrade to TLS 1.3 immediately.",
    "TLS-1.1": "TLS 1.1 is deprecated by RFC 8996 and lacks modern cipher suites. Upgrade to TLS 1.3.",
    "TLS-1.2": "TLS 1.2 is currently acceptable but lacks post-quantum key exchange. Plan migration to TLS 1.3 with hybrid PQC extensions.",
}
SMALL_RSA = "RSA-{} is both classically factorable and quantum-vulnerable via Shor's algorithm. Immediate migration to RSA-3072+ or ML-KEM-768."
EQUAL_RSA = "RSA-2048 is classically acceptable but quantum-vulnerable via Shor's algorithm. Plan migration to ML-KEM-768 within the threat horizon."
URGENT = " Mosca urgency: data shelf-life + migration effort exceeds quantum threat horizon."
STATIC = "Static crypto inventory finding."
OBSERVED = (" Observed in ", "; verify deployed-path reachability before treating this as production exposure.")
# fixed values: what a path contains, by criticality; parts of a path, by context (the last one of tests counts for configuration only)
CRITICAL_PATH, HIGH_PATH = "auth|login|payment|billing|session", "api|service|core|db|database"
TEST_PARTS, DEMO_PARTS = ("test", "tests", "__tests__", "fixtures", "fixture", "spec"), ("demo", "demos", "example", "examples", "sample", "samples")
CONFIG_TEST_PARTS = (*TEST_PARTS, "e2e")
# fixed values: fixes by exact name
FIXES = {"MD5": "SHA-256 or BLAKE2", "DES": "AES-256-GCM", "SHA1": "SHA-256", "RSA_LT_2048_SIGNATURE": "RSA-3072+/Ed25519 now; ML-DSA (Dilithium-class) for PQC track", "RSA_LT_2048_KEYEXCHANGE": "ML-KEM (Kyber-class)"}
NO_FIX = "Manual review needed"


def rule_table(spark: SparkSession) -> DataFrame:
    """A row for each name of each rule's algorithm: 37 rows, small enough to go to every task."""
    by_name = {r[0]: r for r in RULES}
    rows = [(known, *by_name[name], REASONS.get(name)) for known, name in ALIASES]
    return spark.createDataFrame(rows, "known_name string, rule_algorithm string, rule_tier string, rule_broken boolean, rule_quantum boolean, rule_replacement string, rule_kind string, rule_days int, rule_shelf double, rule_reason string")


def criticality(file: Column) -> Column:
    low = F.lower(F.coalesce(file, F.lit("")))
    return F.when(low.rlike(CRITICAL_PATH), "CRITICAL").when(low.rlike(HIGH_PATH), "HIGH").otherwise("MEDIUM")


def context(file: Column, test_parts: tuple = TEST_PARTS) -> Column:
    parts = F.split(F.lower(file), "[/\\\\]")
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, test_parts))), "TEST_ONLY").when(F.arrays_overlap(parts, F.array(*map(F.lit, DEMO_PARTS))), "DEMO_ONLY").otherwise("SOURCE")


def score_findings(findings: DataFrame, assumption: str | None = None) -> DataFrame:
    """Adds risk_tier (UNSCORED if no rule fits), risk_reason, classical_broken, quantum_vulnerable, hndl_exposure, urgent,
    criticality and what to do. supplied_shelf_life is the years that the finding itself states (`assumption` names where they
    come from); data_shelf_life_years those that count. A source_context that the finding has stays."""
    rules = F.broadcast(rule_table(findings.sparkSession))
    out = findings.join(rules, F.lower(F.trim("algorithm")) == F.col("known_name"), "left")
    canonical = F.coalesce("rule_algorithm", F.upper(F.trim("algorithm")))
    rsa = F.coalesce(F.col("rule_algorithm") == "RSA", F.lit(False))
    small, equal = F.coalesce(rsa & (F.col("key_size") < 2048), F.lit(False)), F.coalesce(rsa & (F.col("key_size") == 2048), F.lit(False))
    stated = F.col("supplied_shelf_life")
    shelf = F.when(stated >= 0, stated).otherwise(F.col("rule_shelf"))
    quantum = F.coalesce("rule_quantum", F.lit(False))
    late = F.coalesce(shelf + F.col("rule_days") / 365 > HORIZON_YEARS, F.lit(False))
    urgent = quantum & ~small & ~equal & (F.col("rule_tier") == "HIGH") & stated.isNotNull() & late
    given = F.upper("source_context") if "source_context" in findings.columns else F.lit(None).cast("string")
    where = F.coalesce(given, context(F.col("file")))
    reason = F.when(small, F.concat(*(F.lit(SMALL_RSA.split("{}")[0]), F.col("key_size").cast("string"), F.lit(SMALL_RSA.split("{}")[1])))).when(equal, EQUAL_RSA).when(urgent, F.concat("rule_reason", F.lit(URGENT))).otherwise(F.col("rule_reason"))
    note = F.concat(F.lit(OBSERVED[0]), F.translate(F.lower(where), "_", " "), F.lit(OBSERVED[1]))
    return out.select(
        *(F.col(x) for x in findings.columns if x != "source_context"),
        canonical.alias("canonical_algorithm"),
        F.when(small, "CRITICAL").when(equal, "MEDIUM").otherwise(F.coalesce("rule_tier", F.lit("UNSCORED"))).alias("risk_tier"),
        F.when(where.isin("TEST_ONLY", "DEMO_ONLY"), F.concat(F.coalesce(reason, F.lit(STATIC)), note)).otherwise(reason).alias("risk_reason"),
        (small | F.coalesce("rule_broken", F.lit(False))).alias("classical_broken"),
        quantum.alias("quantum_vulnerable"),
        F.coalesce(urgent, F.lit(False)).alias("urgent"),
        F.when(~quantum, "NOT_APPLICABLE").when(stated.isNull(), "UNKNOWN").when(urgent, "HIGH").otherwise("ASSESSMENT_REQUIRED").alias("hndl_exposure"),
        shelf.alias("data_shelf_life_years"),
        F.lit(HORIZON_YEARS).alias("quantum_threat_horizon_years"),
        F.when(stated.isNotNull(), F.lit(assumption).cast("string")).alias("assumption_source"),
        F.lit(MODEL).alias("risk_model_version"),
        F.col("rule_replacement").alias("recommended_replacement"),
        F.col("rule_kind").alias("recommendation_type"),
        F.col("rule_days").alias("migration_effort_days"),
        criticality(F.col("file")).alias("criticality"),
        where.alias("source_context"),
    )
