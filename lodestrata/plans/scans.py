"""Queries that read manifests, configuration and sources, made of the test tables' rows, and the SQL that states what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import config, dependencies
from . import derive

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _files(rows: DataFrame, shapes: list[tuple]) -> DataFrame:
    """Files path, name, ext, content: for each row the one whose place is its shape."""
    rows = derive.dealt(rows, "id")
    name = content = F
    for k, (file, *parts) in enumerate(shapes):
        name, content = name.when(F.col("shape") == k, F.lit(file)), content.when(F.col("shape") == k, F.concat(*(F.lit(p) if isinstance(p, str) else p() if callable(p) else p for p in parts)))
    out = rows.withColumns({"name": name, "content": content.cast("binary")})
    path = F.concat(F.lit("r"), "id", F.lit("/"), F.when(F.col("name").contains("ci"), F.lit(".github/")).otherwise(F.lit("")), "name")
    return out.select(path.alias("path"), "name", F.concat(F.lit("."), F.substring_index("name", ".", -1)).alias("ext"), "content")


def V():
    return F.col("v")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 7 AS shape, CAST(p_size AS VARCHAR) AS v FROM part), f(file, line, package_ecosystem, package_name, package_version, algorithm, weak_by_default, language, matched_call) AS (
SELECT 'r' || id || '/package.json', 0, 'npm', 'md5', '2.' || v || '.0', 'MD5', true, 'javascript', 'dependencies: md5@2.' || v || '.0' FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/package.json', 0, 'npm', 'crypto-js', NULL, 'UNKNOWN', false, 'javascript', 'devDependencies: Crypto-JS@^' || v FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/package-lock.json', 0, 'npm', 'sha1', v || '.0.0', 'SHA-1', true, 'javascript', 'package-lock.json: sha1@' || v || '.0.0' FROM p WHERE shape = 1
UNION ALL SELECT 'r' || id || '/pyproject.toml', 0, 'pypi', 'pycryptodome', v || '.1', 'UNKNOWN', false, 'python', 'project.dependencies: PyCryptodome==' || v || '.1' FROM p WHERE shape = 2
UNION ALL SELECT 'r' || id || '/pyproject.toml', 0, 'pypi', 'cryptography', NULL, 'UNKNOWN', false, 'python', 'tool.poetry.group.dev.dependencies: cryptography==' || v || '.*' FROM p WHERE shape = 2
UNION ALL SELECT 'r' || id || '/Pipfile.lock', 0, 'pypi', 'pycrypto', '2.' || v, 'UNKNOWN', true, 'python', 'develop: pycrypto==2.' || v FROM p WHERE shape = 3
UNION ALL SELECT 'r' || id || '/poetry.lock', 0, 'pypi', 'pyopenssl', v, 'UNKNOWN', false, 'python', 'poetry.lock: pyOpenSSL==' || v FROM p WHERE shape = 4
UNION ALL SELECT 'r' || id || '/pom.xml', 0, 'maven', 'org.bouncycastle:bcprov-jdk18on', CASE WHEN id % 2 = 0 THEN '1.' || v END, 'UNKNOWN', false, 'java', 'pom.xml: org.bouncycastle:bcprov-jdk18on:' || CASE WHEN id % 2 = 0 THEN '1.' || v ELSE '${bc}' END FROM p WHERE shape = 5
UNION ALL SELECT 'r' || id || '/requirements-dev.txt', 2, 'pypi', 'pycryptodomex', '2.' || v, 'UNKNOWN', false, 'python', 'requirements-dev: PyCryptodomeX==2.' || v FROM p WHERE shape = 6
) SELECT * FROM f""")
def dependency_findings(spark, d):
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("shape"), F.col("p_size").cast("string").alias("v"))
    files = _files(rows, [
        ("package.json", '{"dependencies": {"md5": "2.', V, '.0", "left-pad": "1.0.0"}, "devDependencies": {"Crypto-JS": "^', V, '"}, "peerDependencies": "none"}'),
        ("package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"name": "own"}, "node_modules/a/node_modules/sha1": {"version": "', V, '.0.0"}, "node_modules/md5": {"link": true, "version": "1.0.0"}}}'),
        ("pyproject.toml", '[project]\ndependencies = ["PyCryptodome[x] == ', V, '.1 ; python_version > \'3\'", "requests"]\n[tool.poetry.group.dev.dependencies]\npython = "^3"\ncryptography = "', V, '.*"\n'),
        ("Pipfile.lock", '{"default": {"requests": {"version": "==1"}}, "develop": {"pycrypto": {"version": "==2.', V, '"}}}'),
        ("poetry.lock", '[[package]]\nname = "pyOpenSSL"\nversion = "', V, '"\n[[package]]\nname = "six"\nversion = "1"\n'),
        ("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencyManagement><dependencies><dependency><groupId>org.BouncyCastle</groupId><artifactId>bcprov-jdk18on</artifactId><version>', F.when(F.col("id") % 2 == 0, F.concat(F.lit("1."), V())).otherwise("${bc}"), "</version></dependency></dependencies></dependencyManagement></project>"),
        ("requirements-dev.txt", "# own\nPyCryptodomeX == 2.", V, "  # pinned\nPYCRYPTODOMEX==2.", V, "\n"),
    ])
    return dependencies.dependency_findings(files).select("file", "line", "package_ecosystem", "package_name", "package_version", "algorithm", "weak_by_default", "language", "matched_call")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS shape, o_custkey % 4 AS t, o_custkey % 3 AS u FROM orders), f(file, line, algorithm, key_size, matched_call, library, weak_by_default, confidence_band, confidence_score) AS (
SELECT 'r' || id || '/deploy.yaml', 0, 'TLSv1.' || t, NULL, 'spec.min_protocol: TLSv1.' || t, 'kubernetes', t < 3, 'VERIFIED', 0.90 FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/deploy.yaml', 0, 'RC4', NULL, 'spec.cipher_suites: HIGH:RC4-SHA', 'kubernetes', true, 'VERIFIED', 0.90 FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/deploy.yaml', 0, 'TLS', NULL, 'verify: False', 'kubernetes', true, 'VERIFIED', 0.90 FROM o WHERE shape = 0 AND u = 0
UNION ALL SELECT 'r' || id || '/deploy.yaml', 0, 'RSA', 1024, 'list.key_size: ${BITS}', 'kubernetes', true, 'UNVERIFIED', 0.00 FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/.github/ci.yml', 0, 'TLSv1.0', NULL, 'env.ssl_policy: ELBSecurityPolicy-2015-05', 'github_actions', true, 'VERIFIED', 0.90 FROM o WHERE shape = 1
UNION ALL SELECT 'r' || id || '/.github/ci.yml', 0, 'TLS', NULL, 'env.ssl_verify: ${{ inputs.verify }}', 'github_actions', true, 'UNVERIFIED', 0.00 FROM o WHERE shape = 1
UNION ALL SELECT 'r' || id || '/app.json', 0, 'RSA', CASE u WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 4096 END, 'a.b.rsa_bits: ' || CASE u WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 4096 END, 'tls_literal', u = 0, 'VERIFIED', 0.90 FROM o WHERE shape = 2
UNION ALL SELECT 'r' || id || '/main.tf', 0, 'RSA', 1024, 'resource.tls_private_key.own.rsa_bits = 1024', 'terraform', true, 'VERIFIED', 0.90 FROM o WHERE shape = 3
UNION ALL SELECT 'r' || id || '/main.tf', 0, 'TLSv1.' || CASE u WHEN 0 THEN 0 ELSE 2 END, NULL, 'resource.lb.main.min_tls_version = ' || CASE u WHEN 0 THEN '1.0' ELSE '1.2' END, 'terraform', true, 'VERIFIED', 0.90 FROM o WHERE shape = 3
UNION ALL SELECT 'r' || id || '/main.tf', 0, 'TLS', NULL, 'provider.aws.skip_credentials_validation = True', 'terraform', true, 'VERIFIED', 0.90 FROM o WHERE shape = 3
UNION ALL SELECT 'r' || id || '/nginx.conf', 2, 'TLSv1.' || CASE WHEN t < 2 THEN 1 ELSE t END, NULL, 'ssl_protocols TLSv1.' || CASE WHEN t < 2 THEN 1 ELSE t END || ' TLSv1.3;', 'nginx', CASE WHEN t = 3 THEN false ELSE true END, 'VERIFIED', 0.90 FROM o WHERE shape = 4
UNION ALL SELECT 'r' || id || '/nginx.conf', 2, 'TLSv1.3', NULL, 'ssl_protocols TLSv1.' || CASE WHEN t < 2 THEN 1 ELSE t END || ' TLSv1.3;', 'nginx', false, 'VERIFIED', 0.90 FROM o WHERE shape = 4 AND t <> 3
UNION ALL SELECT 'r' || id || '/nginx.conf', 3, 'DES', NULL, 'ssl_ciphers DES-CBC3-SHA:!MD5;', 'nginx', true, 'VERIFIED', 0.90 FROM o WHERE shape = 4
UNION ALL SELECT 'r' || id || '/nginx.conf', 3, 'MD5', NULL, 'ssl_ciphers DES-CBC3-SHA:!MD5;', 'nginx', true, 'VERIFIED', 0.90 FROM o WHERE shape = 4
) SELECT file, line, algorithm, key_size, matched_call, library, weak_by_default, confidence_band, CAST(confidence_score AS DECIMAL(3, 2)) AS confidence_score FROM f""")
def config_findings(spark, d):
    rows = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("shape"), (F.col("o_custkey") % 4).alias("t"), (F.col("o_custkey") % 3).alias("u"))
    t, u = F.col("t").cast("string"), F.col("u")
    bits = F.when(u == 0, "1024").when(u == 1, "2048").otherwise("4096")
    files = _files(rows, [
        ("deploy.yaml", "# tls_version: TLSv1.0\nspec:\n  min_protocol: TLSv1.", t, "\n  cipher_suites: HIGH:RC4-SHA\n  description: MD5 and RC4\n---\nverify: ", F.when(u == 0, "false").otherwise("yes"), "\nlist:\n  - key_size: ${BITS}\n  - rsa_size: 512\n"),
        ("ci.yml", "env:\n  ssl_policy: &p ELBSecurityPolicy-2015-05\n  SSL_VERIFY: ${{ inputs.verify }}\n".replace("SSL_VERIFY", "ssl_verify")),
        ("app.json", '{"a": [{"b": {"rsa_bits": ', bits, '}}], "note": "insecure"}'),
        ("main.tf", '# rsa_bits = 512\nresource "tls_private_key" "own" {\n  algorithm = "RSA"\n  rsa_bits  = 1024\n}\nresource "lb" "main" {\n  min_tls_version = "', F.when(u == 0, "1.0").otherwise("1.2"), '"\n  tls_version = var.tls\n}\nprovider "aws" {\n  skip_credentials_validation = true\n}\n'),
        ("nginx.conf", "server {\n\tssl_protocols TLSv1.", F.when(F.col("t") < 2, "1").otherwise(t), " TLSv1.3;\n\tssl_ciphers DES-CBC3-SHA:!MD5;\n}\n"),
    ])
    return config.config_findings(files).select("file", "line", "algorithm", "key_size", "matched_call", "library", "weak_by_default", "confidence_band", "confidence_score")
