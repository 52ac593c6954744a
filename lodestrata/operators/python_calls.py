"""Cryptographic calls in Python sources: calls are extracted file by file, rules applied as a join."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings

# fixed values: call, algorithm, primitive, library
CALLS = [
    ("hashlib.md5", "MD5", "hash", "hashlib"),
    ("hashlib.sha1", "SHA-1", "hash", "hashlib"),
    ("hashlib.sha256", "SHA-256", "hash", "hashlib"),
    ("hashlib.sha384", "SHA-384", "hash", "hashlib"),
    ("hashlib.sha512", "SHA-512", "hash", "hashlib"),
    ("MD5.new", "MD5", "hash", "PyCryptodome"),
    ("SHA1.new", "SHA-1", "hash", "PyCryptodome"),
    ("SHA224.new", "SHA-224", "hash", "PyCryptodome"),
    ("SHA256.new", "SHA-256", "hash", "PyCryptodome"),
    ("SHA384.new", "SHA-384", "hash", "PyCryptodome"),
    ("SHA512.new", "SHA-512", "hash", "PyCryptodome"),
    ("DES.new", "DES", "encrypt", "PyCryptodome"),
    ("DES3.new", "3DES", "encrypt", "PyCryptodome"),
    ("ARC4.new", "RC4", "encrypt", "PyCryptodome"),
    ("AES.new", "AES", "encrypt", "PyCryptodome"),
    ("HMAC.new", "HMAC", "mac", "PyCryptodome"),
    ("RSA.generate", "RSA", "asymmetric-keygen", "PyCryptodome"),
    ("rsa.generate_private_key", "RSA", "asymmetric-keygen", "cryptography"),
    ("ec.generate_private_key", "ECC", "asymmetric-keygen", "cryptography"),
    ("dsa.generate_private_key", "DSA", "asymmetric-keygen", "cryptography"),
    ("hashes.MD5", "MD5", "hash", "cryptography"),
    ("hashes.SHA1", "SHA-1", "hash", "cryptography"),
    ("hashes.SHA256", "SHA-256", "hash", "cryptography"),
    ("hashes.SHA384", "SHA-384", "hash", "cryptography"),
    ("hashes.SHA512", "SHA-512", "hash", "cryptography"),
    ("algorithms.ARC4", "RC4", "encrypt", "cryptography"),
    ("algorithms.TripleDES", "3DES", "encrypt", "cryptography"),
    ("algorithms.AES", "AES", "encrypt", "cryptography"),
    ("ssl.SSLContext", "TLS", "protocol", "ssl"),
    ("ssl.create_default_context", "TLS", "protocol", "ssl"),
    ("ssl.wrap_socket", "TLS", "protocol", "ssl"),
]
# fixed values: names of digests, weak algorithms
DIGESTS = {"md5": "MD5", "sha1": "SHA-1", "sha224": "SHA-224", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512"}
WEAK = ("MD5", "SHA-1", "DES", "3DES", "RC4")
_SITES = "file string, line int, ordinal int, candidates array<string>, digest string, key_size int, alias_traced boolean, snippet string"


def call_sites(source: str) -> list[tuple]:
    """Calls whose root is an import: line, names to try (whole, last three, last two), digest argument, key size, whether the import's target
    differs from its local name, text."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    names: dict[str, str] = {}
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Import):
            names.update((a.asname or a.name.split(".")[0], a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            names.update((a.asname or a.name, f"{node.module or ''}.{a.name}") for a in node.names)
    out = []
    for node in (n for n in nodes if isinstance(n, ast.Call)):
        parts, at = [], node.func
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        if not isinstance(at, ast.Name) or at.id not in names:
            continue
        dotted = [*names[at.id].split("."), *reversed(parts)]
        tries = list(dict.fromkeys(".".join(dotted[-k:]) for k in (len(dotted), 3, 2) if k <= len(dotted)))
        literal = lambda kind: next((a.value for a in node.args if isinstance(a, ast.Constant) and type(a.value) is kind), None)
        named = {k.arg: k.value.value for k in node.keywords if isinstance(k.value, ast.Constant)}
        third = node.args[2] if len(node.args) > 2 else None
        mac = third.value if isinstance(third, ast.Constant) and isinstance(third.value, str) else named.get("digestmod")
        digest = mac if "hmac.new" in tries else literal(str)
        size = next((named[k] for k in ("key_size", "bits") if type(named.get(k)) is int), literal(int))
        out.append((node.lineno, tries, digest if isinstance(digest, str) else None, size, names[at.id] != at.id, ast.unparse(node)[:500]))
    return out


def python_problems(files: DataFrame) -> DataFrame:
    """path, problem of the .py files that can't be parsed."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["rel_path"], b["content"]):
                try:
                    ast.parse(bytes(content).decode("utf-8", "replace"))
                except (SyntaxError, ValueError) as e:
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "problem"])

    return files.where("ext = '.py' and content is not null").select("rel_path", "content").mapInPandas(parse, "path string, problem string")


def python_findings(files: DataFrame, calls_known: list[tuple] = CALLS) -> DataFrame:
    """Findings of the .py files of a tree (file, content): the first of a call's names that a rule has; else, for hashlib.new
    and hmac.new, the digest named by a literal."""

    def sites(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, line, k, *rest) for f, c in zip(b["rel_path"], b["content"]) for k, (line, *rest) in enumerate(call_sites(bytes(c).decode("utf-8", "replace")))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _SITES.split(", ")])
            yield out.astype({"key_size": "Int32"})

    calls = files.where("ext = '.py' and content is not null").select("rel_path", "content").mapInPandas(sites, _SITES)
    rules = F.broadcast(files.sparkSession.createDataFrame(calls_known, "name string, algorithm string, primitive string, library string"))
    # the names of a call are tried side by side, and its row goes on with the first that a rule has; files are read once
    tried = calls.select("*", F.posexplode("candidates").alias("pos", "name")).join(rules, "name", "left")
    own = F.struct("algorithm", "primitive", "library")
    best = tried.groupBy("file", "line", "ordinal").agg(F.min_by(own, F.when(F.col("algorithm").isNotNull(), F.col("pos"))).alias("rule"), *(F.any_value(c).alias(c) for c in ("candidates", "digest", "key_size", "alias_traced", "snippet")))
    named = reduce(lambda c, x: c.when(F.lower("digest") == x[0], x[1]), DIGESTS.items(), F)
    of = lambda name: F.array_contains("candidates", name)
    out = best.withColumn("algorithm", F.coalesce("rule.algorithm", F.when(of("hashlib.new") | of("hmac.new"), named))).where("algorithm is not null")
    mac = F.col("rule").isNull() & of("hmac.new")
    sized = F.when(F.col("algorithm").isin("RSA", "ECC", "DSA"), F.col("key_size"))
    signals = F.array_compact(F.array(*map(F.lit, ("import_resolved", "call_site_matched", "expected_module_confirmed", "literal_algorithm_arg")), F.when(F.col("alias_traced"), "alias_traced"), F.when(sized.isNotNull(), "key_size_extracted")))
    out = out.select("file", "line", F.col("snippet").alias("matched_call"), F.when(mac, "hmac").otherwise(F.coalesce("rule.library", F.lit("hashlib"))).alias("library"), "algorithm", F.when(mac, "mac").otherwise(F.coalesce("rule.primitive", F.lit("hash"))).alias("primitive"), F.lit("python").alias("language"), F.col("algorithm").isin(*WEAK).alias("weak_by_default"), sized.alias("key_size"), signals.alias("confidence_signals"))
    return as_findings(out, detection_method="ast_static_analysis", artifact_type="SOURCE_FILE")
