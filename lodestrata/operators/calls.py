"""Cryptographic calls in Java, JavaScript and TypeScript: calls and what they are bound to are read file by file and matched by joins."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..functions.rules import rule_table
from ..sources import code

# fixed values: language by extension (TypeScript has the rules of JavaScript), and below the name of the method of detection
EXTENSIONS = {".java": "java", ".js": "javascript", ".cjs": "javascript", ".mjs": "javascript", ".ts": "typescript", ".cts": "typescript", ".mts": "typescript", ".jsx": "javascript", ".tsx": "typescript"}
PLAIN = (".ts", ".cts", ".mts")  # without elements: `<T>x` is a cast there
WEB = "webcrypto-global"
# fixed values: rules, object, method, text of the first argument, algorithm, primitive, weak by default, modules
RULES = [
    ("java", "MessageDigest", "getInstance", "MD5", "MD5", "hash", True, ["java.security.MessageDigest"]),
    ("java", "MessageDigest", "getInstance", "SHA-1", "SHA-1", "hash", True, ["java.security.MessageDigest"]),
    ("java", "MessageDigest", "getInstance", "SHA-256", "SHA-256", "hash", False, ["java.security.MessageDigest"]),
    ("java", "Cipher", "getInstance", "DESede", "3DES", "block-cipher", True, ["javax.crypto.Cipher"]),
    ("java", "Cipher", "getInstance", "DES", "DES", "block-cipher", True, ["javax.crypto.Cipher"]),
    ("java", "Cipher", "getInstance", "AES", "AES", "block-cipher", False, ["javax.crypto.Cipher"]),
    ("java", "Cipher", "getInstance", "RC4", "RC4", "stream-cipher", True, ["javax.crypto.Cipher"]),
    ("java", "Cipher", "getInstance", "RSA", "RSA", "pke", False, ["javax.crypto.Cipher"]),
    ("java", "Signature", "getInstance", "DSA", "DSA", "signature", False, ["java.security.Signature"]),
    ("java", "KeyPairGenerator", "getInstance", "RSA", "RSA", "pke", False, ["java.security.KeyPairGenerator"]),
    ("java", "KeyPairGenerator", "getInstance", "EC", "ECC", "signature", False, ["java.security.KeyPairGenerator"]),
    ("javascript", "crypto", "createHash", "md5", "MD5", "hash", True, ["crypto"]),
    ("javascript", "crypto", "createHash", "sha1", "SHA-1", "hash", True, ["crypto"]),
    ("javascript", "crypto", "createHash", "sha224", "SHA-224", "hash", False, ["crypto"]),
    ("javascript", "crypto", "createHash", "sha256", "SHA-256", "hash", False, ["crypto"]),
    ("javascript", "crypto", "createHash", "sha384", "SHA-384", "hash", False, ["crypto"]),
    ("javascript", "crypto", "createHash", "sha512", "SHA-512", "hash", False, ["crypto"]),
    ("javascript", "crypto", "createHmac", "md5", "MD5", "mac", True, ["crypto"]),
    ("javascript", "crypto", "createHmac", "sha1", "SHA-1", "mac", True, ["crypto"]),
    ("javascript", "crypto", "createHmac", "sha256", "SHA-256", "mac", False, ["crypto"]),
    ("javascript", "crypto", "createCipher", "des-ede3", "3DES", "block-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipheriv", "des-ede3", "3DES", "block-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipher", "des", "DES", "block-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipheriv", "des", "DES", "block-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipher", "rc4", "RC4", "stream-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipheriv", "rc4", "RC4", "stream-cipher", True, ["crypto"]),
    ("javascript", "crypto", "createCipher", "aes", "AES", "block-cipher", False, ["crypto"]),
    ("javascript", "crypto", "createCipheriv", "aes", "AES", "block-cipher", False, ["crypto"]),
    ("javascript", "crypto", "generateKeyPairSync", "rsa", "RSA", "asymmetric-keygen", False, ["crypto"]),
    ("javascript", "crypto", "generateKeyPairSync", "ec", "ECC", "asymmetric-keygen", False, ["crypto"]),
    ("javascript", "crypto", "generateKeyPairSync", "dsa", "DSA", "asymmetric-keygen", False, ["crypto"]),
    ("javascript", "crypto", "createSign", "rsa", "RSA", "signature", False, ["crypto"]),
    ("javascript", "crypto", "createSign", "ec", "ECC", "signature", False, ["crypto"]),
    ("javascript", "crypto", "createSign", "dsa", "DSA", "signature", False, ["crypto"]),
    ("javascript", "crypto", "digest", "sha1", "SHA-1", "hash", True, ["crypto", WEB]),
    ("javascript", "crypto", "digest", "sha256", "SHA-256", "hash", False, ["crypto", WEB]),
    ("javascript", "crypto", "generateKey", "aes", "AES", "symmetric-keygen", False, ["crypto", WEB]),
    ("javascript", "crypto", "generateKey", "rsa", "RSA", "asymmetric-keygen", False, ["crypto", WEB]),
    ("javascript", "crypto", "generateKey", "ec", "ECC", "asymmetric-keygen", False, ["crypto", WEB]),
]
SIGNALS = ("import_resolved", "call_site_matched", "expected_module_confirmed", "rule_yaml_matched", "literal_algorithm_arg")
_ROW = "file string, language string, module string, member string, line int, object string, method string, text string, size int, chained int, inline string, snippet string"
_COLUMNS = [x.split() for x in _ROW.split(", ")]
_SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in _COLUMNS])


def _parsed(content: bytes, language: str, markup: bool, names: set[str]) -> list[tuple]:
    """Language and columns behind it of the calls that a rule may match: of a method of these names, or what a member of such a
    name is imported as."""
    source = code.Source(content.decode("utf-8", "replace"), language, markup)
    imports = (code.java_imports if language == "java" else code.js_imports)(source)
    found = code.calls(source, names | {local for local, _, member in imports if member in names})
    return [(language, *to, *own) for to, own in zip(code.bound(imports, found), found)]


def read_calls(batches: Iterator[pa.RecordBatch], names: dict[str, set[str]]) -> Iterator[pa.RecordBatch]:
    """Calls of files (rel_path, ext, content) by methods of the names that their languages' rules have. Of copies of a file in a
    batch one is parsed, and its calls are those of all."""
    for b in batches:
        found, spans, files, calls = [], {}, [], []
        for k, (ext, content) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
            content, language, markup = content.as_py(), EXTENSIONS[ext], ext not in PLAIN
            key = language, markup, sha256(content).digest()
            if (span := spans.get(key)) is None:
                own = _parsed(content, language, markup, names["java" if language == "java" else "javascript"])
                span = spans[key] = range(len(found), len(found) + len(own))
                found += own
            files += [k] * len(span)
            calls += span
        own = [pa.array([r[k] for r in found], kind).take(pa.array(calls, pa.int32())) for k, kind in enumerate(_SCHEMA.types[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(files, pa.int32())).cast(pa.string()), *own], schema=_SCHEMA)


def java_js_findings(files: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Findings of the sources of a tree (rel_path, ext, content): the first rule that a call matches whose module is the one
    that its object or method is bound to. Files that are no UTF-8 are read with replacements.

    Each file is read once, and of its imports only those go on that a call is bound to. Rules that share a language and a method
    are one row in their order, so that a call meets them in one place and stays one row."""
    names: dict[str, set[str]] = {"java": set(), "javascript": set()}
    shared: dict[tuple, list] = {}
    for k, (language, library, called, *more) in enumerate(rules):
        names.setdefault(language, set()).add(called)
        shared.setdefault((language, called), []).append((k, library, *more))
    out = files.where(F.col("ext").isin(*EXTENSIONS) & F.col("content").isNotNull()).select("rel_path", "ext", "content").mapInArrow(lambda batches: read_calls(batches, names), _ROW)
    web = F.col("object").startswith("window.crypto.") | F.col("object").startswith("globalThis.crypto.")
    module = F.coalesce("module", "inline", F.when(web & (F.col("language") != "java"), WEB))
    method = F.when(F.col("object") == "", F.coalesce("member", "method")).otherwise(F.col("method"))
    plain = lambda x: F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]", "")
    out = out.withColumns({"module": module, "called": method, "rules_of": F.when(F.col("language") == "java", "java").otherwise("javascript"), "said": plain(F.col("text"))})
    named = F.when((F.col("object") == "") & (F.col("language") == "java"), F.substring_index("module", ".", -1)).otherwise(F.col("object"))
    table = rule_table(files.sparkSession, [(*key, of) for key, of in shared.items()], "rules_of string, called string, rules array<struct<rule: int, library: string, wanted: string, algorithm: string, primitive: string, weak_by_default: boolean, modules: array<string>>>", len(rules))
    table = table.withColumn("rules", F.transform("rules", lambda r: r.withField("wanted", plain(r["wanted"]))))

    def matches(r: Column) -> Column:
        own_path = (F.col("language") == "java") & F.array_contains(r["modules"], F.col("object"))
        return (F.array_contains(r["modules"], F.col("module")) | own_path) & F.contains(F.col("said"), r["wanted"])

    traced = F.col("module").isNotNull() & (F.col("module") != named)
    size = F.coalesce("size", F.when(F.col("language") == "java", F.col("chained")))
    signals = F.array_compact(F.array(*map(F.lit, SIGNALS), F.when(size.isNotNull(), "key_size_extracted"), F.when(traced, "alias_traced")))
    hits = out.join(table, ["rules_of", "called"]).select("file", "line", F.col("snippet").alias("matched_call"), "language", size.alias("key_size"), signals.alias("confidence_signals"), F.inline_outer(F.slice(F.filter("rules", matches), 1, 1)))
    return as_findings(hits.where("rule is not null"), detection_method="tree_sitter_query", artifact_type="SOURCE_FILE")
