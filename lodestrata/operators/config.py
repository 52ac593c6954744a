"""Cryptographic settings in configuration: pairs of keys and values joined with a table of detectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..functions.rules import rule_table
from ..sources import parsers
from . import manifests

# fixed values: rule, algorithm, primitive, key size, weak by default
RULES = [
    ("tls_v1_0", "TLSv1.0", "protocol_version", None, True),
    ("tls_v1_1", "TLSv1.1", "protocol_version", None, True),
    ("tls_v1_2", "TLSv1.2", "protocol_version", None, True),
    ("tls_v1_3", "TLSv1.3", "protocol_version", None, False),
    ("weak_cipher_rc4", "RC4", "encryption", None, True),
    ("weak_cipher_des", "DES", "encryption", None, True),
    ("weak_cipher_md5", "MD5", "hashing", None, True),
    ("weak_cipher_export", "EXPORT", "encryption", None, True),
    ("rsa_1024", "RSA", "key_exchange", 1024, True),
    ("rsa_2048", "RSA", "key_exchange", 2048, False),
    ("rsa_4096", "RSA", "key_exchange", 4096, False),
    ("ssl_verify_false", "TLS", "protocol_version", None, True),
]
# fixed values: rule, kind of file, whether a key equals or contains one of the names, names, values
DETECTORS = [
    ("tls_v1_0", "yaml", "equals", ["tls_version", "tlsversion", "ssl_protocol", "ssl_protocols", "min_protocol", "minimum_version", "minimum_tls_version", "tls_min_version", "protocol_version", "sslprotocol", "tlsminversion"], ["TLSv1.0", "TLSv1", "1.0", "SSLv3", "SSLv2"]),
    ("tls_v1_0", "yaml", "equals", ["ssl_policy"], ["ELBSecurityPolicy-TLS-1-0", "ELBSecurityPolicy-2015-05"]),
    ("tls_v1_0", "hcl2", "equals", ["ssl_policy"], ["ELBSecurityPolicy-TLS-1-0", "ELBSecurityPolicy-2015-05"]),
    ("tls_v1_0", "hcl2", "equals", ["min_tls_version"], ["1.0", "TLSv1"]),
    ("tls_v1_0", "hcl2", "equals", ["tls_version"], ["TLSv1.0", "TLSv1", "1.0"]),
    ("tls_v1_0", "nginx", "equals", ["ssl_protocols"], ["TLSv1 ", "TLSv1;", "TLSv1\t", " TLSv1.0", "TLSv1.0 ", "TLSv1.0;"]),
    ("tls_v1_1", "yaml", "equals", ["tls_version", "tlsversion", "ssl_protocol", "ssl_protocols", "min_protocol", "minimum_version", "minimum_tls_version", "tls_min_version", "protocol_version"], ["TLSv1.1", "1.1"]),
    ("tls_v1_1", "hcl2", "equals", ["ssl_policy"], ["ELBSecurityPolicy-TLS-1-1"]),
    ("tls_v1_1", "hcl2", "equals", ["tls_version"], ["TLSv1.1", "1.1"]),
    ("tls_v1_1", "nginx", "equals", ["ssl_protocols"], ["TLSv1.1 ", "TLSv1.1;", "TLSv1.1\t"]),
    ("tls_v1_2", "yaml", "equals", ["tls_version", "tlsversion", "ssl_protocol", "min_protocol", "minimum_version", "minimum_tls_version", "tls_min_version", "protocol_version", "max_version", "maximum_version"], ["TLSv1.2", "1.2"]),
    ("tls_v1_2", "hcl2", "equals", ["tls_version"], ["TLSv1.2", "1.2"]),
    ("tls_v1_2", "hcl2", "equals", ["min_tls_version"], ["TLSv1.2", "1.2"]),
    ("tls_v1_2", "nginx", "equals", ["ssl_protocols"], ["TLSv1.2"]),
    ("tls_v1_3", "yaml", "equals", ["tls_version", "tlsversion", "ssl_protocol", "min_protocol", "minimum_version", "minimum_tls_version", "tls_min_version", "protocol_version", "max_version", "maximum_version", "maximum_tls_version", "tls_max_version"], ["TLSv1.3", "1.3"]),
    ("tls_v1_3", "hcl2", "equals", ["tls_version"], ["TLSv1.3", "1.3"]),
    ("tls_v1_3", "nginx", "equals", ["ssl_protocols"], ["TLSv1.3"]),
    ("weak_cipher_rc4", "yaml", "equals", ["cipher_suites", "ciphersuites", "ssl_ciphers", "allowed_ciphers", "tls_cipher"], ["RC4", "RC4-SHA", "RC4-MD5", "EXP-RC4"]),
    ("weak_cipher_rc4", "nginx", "equals", ["ssl_ciphers"], ["RC4"]),
    ("weak_cipher_rc4", "hcl2", "equals", ["cipher_suite"], ["RC4"]),
    ("weak_cipher_des", "yaml", "equals", ["cipher_suites", "ciphersuites", "ssl_ciphers", "allowed_ciphers"], ["DES", "3DES", "DES-CBC3", "DES3", "EDH-RSA-DES-CBC3", "ECDH-RSA-DES-CBC3", "DES-CBC3-SHA"]),
    ("weak_cipher_des", "nginx", "equals", ["ssl_ciphers"], ["DES", "3DES"]),
    ("weak_cipher_md5", "yaml", "equals", ["cipher_suites", "ciphersuites", "ssl_ciphers"], ["MD5", "RC4-MD5", "EXP-RC4-MD5"]),
    ("weak_cipher_md5", "nginx", "equals", ["ssl_ciphers"], ["MD5"]),
    ("weak_cipher_export", "nginx", "equals", ["ssl_ciphers"], ["EXP", "EXPORT"]),
    ("weak_cipher_export", "yaml", "equals", ["cipher_suites", "ssl_ciphers"], ["EXP", "EXPORT"]),
    ("rsa_1024", "yaml", "equals", ["rsa_bits", "rsa_key_size", "key_size", "key_bits", "rsa_size"], ["1024"]),
    ("rsa_1024", "hcl2", "equals", ["rsa_bits"], ["1024"]),
    ("rsa_1024", "hcl2", "equals", ["key_size"], ["1024"]),
    ("rsa_2048", "yaml", "equals", ["rsa_bits", "rsa_key_size", "key_size", "key_bits"], ["2048"]),
    ("rsa_2048", "hcl2", "equals", ["rsa_bits"], ["2048"]),
    ("rsa_4096", "yaml", "equals", ["rsa_bits", "rsa_key_size", "key_size", "key_bits"], ["4096"]),
    ("ssl_verify_false", "yaml", "equals", ["verify", "ssl_verify", "tls_verify", "ssl_check_cert", "verify_ssl", "verify_tls", "verify_certificates"], ["false", "False", "no", "off", "disabled", "0"]),
    ("ssl_verify_false", "yaml", "equals", ["insecure", "insecure_skip_verify", "skip_ssl_verification", "skip_verify", "allow_insecure"], ["true", "True", "yes", "1"]),
    ("ssl_verify_false", "hcl2", "contains", ["insecure", "skip_credentials_validation", "skip_requesting_account_id", "skip_cert_verification", "insecure_skip_verify", "allow_insecure"], ["true"]),
    ("ssl_verify_false", "nginx", "equals", ["ssl_verify_client"], ["off"]),
]
# fixed values: library by format, marks of values that are filled in later, longest evidence
LIBRARIES = {"yaml_k8s": "kubernetes", "yaml_compose": "docker_compose", "yaml_github": "github_actions", "yaml_gitlab": "gitlab_ci", "hcl2": "terraform", "nginx": "nginx", "json": "tls_literal"}
INTERPOLATION = ("${", "#{", "{{")
EVIDENCE = 500
LITERAL_SIGNALS = ("import_resolved", "call_site_matched", "expected_module_confirmed", "literal_algorithm_arg")
_PAIR = "path string, fmt string, kind string, ordinal int, line int, key_path array<string>, value string"


def file_format(path: Column, name: Column, ext: Column) -> Column:
    """Format of a configuration file; null for other files."""
    name, yaml = F.lower(name), F.lower(ext).isin(".yaml", ".yml")
    github = F.array_contains(F.split(F.lower(path), "/"), ".github")
    return (
        F.when(name.isin(".gitlab-ci.yml", ".gitlab-ci.yaml"), "yaml_gitlab")
        .when(github & (yaml | F.lower(ext).isin(".tf", ".conf", ".json")), "yaml_github")
        .when(name.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "yaml_compose")
        .when(yaml, "yaml_k8s")
        .when(F.lower(ext) == ".tf", "hcl2")
        .when((name == "nginx.conf") | (F.lower(ext) == ".conf"), "nginx")
        .when(F.lower(ext) == ".json", "json")
    )


def _kinds(files: DataFrame) -> DataFrame:
    files = files.select("path", file_format(F.col("path"), F.col("name"), F.col("ext")).alias("fmt"), "content").where("fmt is not null and content is not null")
    return files.withColumn("kind", F.when(F.col("fmt").startswith("yaml"), "yaml").otherwise(F.col("fmt")))


def _parsed(files: DataFrame) -> DataFrame:
    """Pairs of files that are parsed one by one; a file that can't be is one row without ordinal, with the reason as value."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, fmt, kind, content in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                found, problem = parsers.pairs(kind, content.as_py())
                rows += [(path, fmt, kind, k, 0, *own) for k, own in enumerate(found)]
                rows += [(path, fmt, kind, None, 0, None, problem)] if problem else []
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in _PAIR.split(", ")])

    return _kinds(files).where("kind <> 'nginx'").select("path", "fmt", "kind", "content").mapInArrow(parse, _PAIR)


def _nginx(files: DataFrame) -> DataFrame:
    return _kinds(files).where("kind = 'nginx'").select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def config_pairs(files: DataFrame) -> DataFrame:
    """path, fmt, kind, ordinal, line, key_path, value of configuration files (path, name, ext, content), in order in each file.

    nginx directives are read by expressions, the others file by file; files that are no UTF-8 or can't be parsed have none
    (config_problems() says which)."""
    texts = _nginx(files).where("text is not null")
    lines = manifests.nginx_directives(texts).select("path", F.lit("nginx").alias("fmt"), F.lit("nginx").alias("kind"), F.col("lineno").cast("int").alias("ordinal"), F.col("lineno").cast("int").alias("line"), F.array("directive").alias("key_path"), "value")
    return _parsed(files).where("ordinal is not null").unionByName(lines)


def config_problems(files: DataFrame) -> DataFrame:
    """path, problem of configuration files that can't be read."""
    no_text = _nginx(files).where("text is null").select("path", F.lit("UnicodeDecodeError: no UTF-8").alias("problem"))
    return _parsed(files).where("ordinal is null").select("path", F.col("value").alias("problem")).unionByName(no_text)


def interpolated(value: Column) -> Column:
    out = F.lit(False)
    for mark in INTERPOLATION:
        out = out | value.contains(mark)
    return out


def _matches(kind: Column, value: Column, patterns: Column) -> Column:
    """Whether the value is one of the patterns, by the rules of the kind of file."""
    quotes = "^[\"']+|[\"']+$"
    clean = F.regexp_replace(value, quotes, "")
    tokens = F.transform(F.split(clean, "[:,\\s;]+"), lambda t: F.regexp_replace(t, quotes, ""))
    same = lambda x, p: F.lower(x) == F.lower(p)
    in_text = F.exists(patterns, lambda p: same(clean, p) | F.exists(tokens, lambda t: same(t, p) | t.startswith(F.concat(p, F.lit("-"))) | t.startswith(F.concat(p, F.lit("_")))))
    in_line = F.exists(patterns, lambda p: F.contains(F.concat(value, F.lit(" ")), p) | value.endswith(F.rtrim(F.replace(p, F.lit("\t"), F.lit(" ")))))
    return F.when(kind == "nginx", in_line).when(kind == "hcl2", F.exists(patterns, lambda p: same(clean, p))).otherwise(in_text)


def config_findings(files: DataFrame, rules: list[tuple] = RULES, detectors: list[tuple] = DETECTORS) -> DataFrame:
    """Settings that detectors know; of equal ones (file, algorithm, evidence) the first in the order of pairs, rules and detectors.

    A value that is filled in later matches any YAML or JSON detector of its key, unverified. The table of detectors has some
    hundred rows, one for each key, and goes to every task."""
    spark = files.sparkSession
    rules = {r[0]: (k, *r) for k, r in enumerate(rules)}
    rows = [(k, how, key, kind, *rules[rule], values) for k, (rule, kind, how, keys, values) in enumerate(detectors) for key in keys]
    table = rule_table(spark, rows, "detector int, how string, wanted_key string, wanted_kind string, rule_order int, rule string, algorithm string, primitive string, key_size int, weak_by_default boolean, patterns array<string>")
    pairs = config_pairs(files).withColumn("leaf", F.coalesce(F.lower(F.try_element_at("key_path", F.lit(-1))), F.lit(""))).withColumn("wanted_kind", F.when(F.col("kind") == "json", "yaml").otherwise(F.col("kind")))
    # each pair looks its whole key up, and those of its kind that a part of a key is enough for; files are parsed once for both
    table = table.withColumn("at", F.when(F.col("how") == "equals", F.col("wanted_key")).otherwise(""))
    parts = sorted({kind for _, kind, how, _, _ in detectors if how == "contains"})
    looked = F.array(F.struct(F.lit("equals").alias("how"), F.col("leaf").alias("at")), F.struct(F.lit("contains").alias("how"), F.lit("").alias("at")))
    looked = F.when(F.col("wanted_kind").isin(parts), looked).otherwise(F.slice(looked, 1, 1))
    spots = pairs.select("*", F.inline(looked))
    hits = spots.join(table, ["wanted_kind", "how", "at"]).where(F.contains("leaf", "wanted_key")).drop("how", "at")
    open_ = interpolated(F.col("value"))
    found = hits.where(_matches(F.col("kind"), F.col("value"), F.col("patterns")) | open_ & (F.col("wanted_kind") == "yaml"))
    path = F.array_join("key_path", ".")
    evidence = F.when(F.col("kind") == "nginx", F.concat(path, F.lit(" "), "value", F.lit(";"))).when(F.col("kind") == "hcl2", F.concat(path, F.lit(" = "), "value")).otherwise(F.concat(path, F.lit(": "), "value"))
    signals = F.when(open_, F.array(F.lit("import_unresolved"))).otherwise(F.array(*map(F.lit, LITERAL_SIGNALS)))
    found = found.withColumns({"matched_call": F.left(evidence, F.lit(EVIDENCE)), "signals": signals})
    first = found.groupBy("path", "algorithm", "matched_call").agg(F.min_by(F.struct("line", "fmt", "primitive", "key_size", "weak_by_default", F.col("signals").alias("confidence_signals")), F.struct("ordinal", "rule_order", "detector")).alias("r"))
    library = F.expr("CASE fmt " + " ".join(f"WHEN '{f}' THEN '{x}'" for f, x in LIBRARIES.items()) + " ELSE 'tls_literal' END")
    first = first.select(F.col("path").alias("file"), "algorithm", "matched_call", "r.*").withColumn("library", library)
    return as_findings(first, language="config", detection_method="config_analysis", artifact_type="CONFIG_FILE", artifact_ref=F.col("file"))
