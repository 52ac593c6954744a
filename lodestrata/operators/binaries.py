"""Cryptographic symbols and constants of executables: read file by file, matched with rules by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..functions.rules import rule_table
from ..sources import executables
from ..sources.patterns import Patterns

# fixed values: part of a symbol, algorithm, primitive, library, weak by default
SYMBOLS = [
    ("MD5_Init", "MD5", "hash", "OpenSSL/libcrypto", True),
    ("MD5_Update", "MD5", "hash", "OpenSSL/libcrypto", True),
    ("EVP_md5", "MD5", "hash", "OpenSSL/libcrypto", True),
    ("SHA1_Init", "SHA-1", "hash", "OpenSSL/libcrypto", True),
    ("EVP_sha1", "SHA-1", "hash", "OpenSSL/libcrypto", True),
    ("SHA256_Init", "SHA-256", "hash", "OpenSSL/libcrypto", False),
    ("EVP_sha256", "SHA-256", "hash", "OpenSSL/libcrypto", False),
    ("AES_encrypt", "AES", "encrypt", "OpenSSL/libcrypto", False),
    ("AES_set_encrypt_key", "AES", "encrypt", "OpenSSL/libcrypto", False),
    ("EVP_aes_256_gcm", "AES", "encrypt", "OpenSSL/libcrypto", False),
    ("DES_set_key", "DES", "encrypt", "OpenSSL/libcrypto", True),
    ("DES_ecb_encrypt", "DES", "encrypt", "OpenSSL/libcrypto", True),
    ("RC4", "RC4", "encrypt", "OpenSSL/libcrypto", True),
    ("RC4_set_key", "RC4", "encrypt", "OpenSSL/libcrypto", True),
    ("RSA_public_encrypt", "RSA", "key_exchange", "OpenSSL/libcrypto", False),
    ("RSA_generate_key_ex", "RSA", "key_exchange", "OpenSSL/libcrypto", False),
    ("libcrypto", "UNKNOWN", "library_link", "OpenSSL/libcrypto", False),
    ("libssl", "TLS", "protocol_version", "OpenSSL/libssl", False),
]
# fixed values: constant in hexadecimal, algorithm, primitive, weak by default
CONSTANTS = [
    ("637c777bf26b6fc53001672bfed7ab76", "AES", "encrypt", False),
    ("0123456789abcdeffedcba9876543210", "MD5", "hash", True),
    ("67452301efcdab8998badcfe10325476", "MD5", "hash", True),
    ("67452301efcdab8998badcfe10325476c3d2e1f0", "SHA-1", "hash", True),
    ("0e040d01020f0b08030a060c05090007", "DES", "encrypt", True),
]
SYMBOL_SIGNALS = ("import_resolved", "call_site_matched", "expected_module_confirmed", "rule_yaml_matched")
CONSTANT_SIGNALS = ("rule_yaml_matched", "import_unresolved")
SHORT = 4  # shorter parts of symbols have to be the whole symbol
_ROW = "file string, language string, ordinal int, symbol string, place string, constant int, rules array<int>"


def binary_findings(files: DataFrame, symbols: list[tuple] = SYMBOLS, constants: list[tuple] = CONSTANTS) -> DataFrame:
    """Findings of executables among files (rel_path, content): each symbol once for an algorithm, each place of a constant."""
    places = Patterns([bytes.fromhex(x) for x, *_ in constants])
    # short parts of symbols have to be the whole symbol
    parts = Patterns([x.encode() if len(x) >= SHORT else b"" for x, *_ in symbols])
    whole: dict[str, list[int]] = {}
    for k, (x, *_) in enumerate(symbols):
        whole.setdefault(x, []).append(k)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["rel_path"], b["content"]):
                if found := executables.read(bytes(content), places):
                    kind, names, hits = found
                    for k, (name, table) in enumerate(names):
                        if known := sorted({*whole.get(name, ()), *parts.within(name.encode("utf-8", "ignore"))}):
                            rows.append((file, kind, k, name, table, None, known))
                    rows += [(file, kind, None, None, f"{section}+0x{at:x}", k, None) for section, at, k in hits]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ROW.split(", ")]).astype({"ordinal": "Int32", "constant": "Int32"})

    # an executable begins with one of these; others aren't sent to Python
    start = F.hex(F.substring("content", 1, 4))
    executable = start.startswith("4D5A") | start.isin("7F454C46", *(x.hex().upper() for x in executables._MACHO))
    rows = files.where(executable).select("rel_path", "content").mapInPandas(read, _ROW)
    spark = files.sparkSession
    rules = rule_table(spark, [(k, *r) for k, r in enumerate(symbols)], "rule int, wanted string, algorithm string, primitive string, library string, weak_by_default boolean")
    # Mach-O files are named otherwise by the rules' formats and match none
    found = rows.where("symbol is not null and language <> 'macho'")
    hits = found.withColumn("rule", F.explode("rules")).join(rules, "rule")
    first = hits.groupBy("file", "algorithm", "symbol").agg(F.min_by(F.struct("language", "place", "primitive", "library", "weak_by_default"), F.struct("ordinal", "rule")).alias("r")).select("file", "algorithm", "symbol", "r.*")
    call = F.concat_ws(":", F.when(F.col("place") == ".dynamic:NEEDED", ".dynamic").otherwise(F.col("place")), "symbol")
    by_symbol = as_findings(first.withColumn("line", F.lit(0)), matched_call=call, confidence_signals=F.array(*map(F.lit, SYMBOL_SIGNALS)), detection_method="binary_symbol_table").withColumn("confidence", F.lit("high"))
    table = rule_table(spark, [(k, *r[1:]) for k, r in enumerate(constants)], "constant int, algorithm string, primitive string, weak_by_default boolean")
    placed = rows.where("constant is not null").join(table, "constant").withColumn("line", F.lit(0))
    by_constant = as_findings(placed, matched_call=F.col("place"), library="unknown", confidence_signals=F.array(*map(F.lit, CONSTANT_SIGNALS)), detection_method="binary_constant_scan")
    return by_symbol.unionByName(by_constant)
