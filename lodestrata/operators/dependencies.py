"""Dependencies of manifests, and the packages among them that rules know."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..functions.rules import rule_table
from ..sources import parsers
from . import manifests

# fixed values: ecosystem, package, library, algorithm, primitive, weak by default
PACKAGES = [
    ("maven", "org.bouncycastle:bcprov-jdk15on", "bouncycastle", "UNKNOWN", "library", False),
    ("maven", "org.bouncycastle:bcprov-jdk18on", "bouncycastle", "UNKNOWN", "library", False),
    ("npm", "md5", "md5", "MD5", "hash", True),
    ("npm", "sha1", "sha1", "SHA-1", "hash", True),
    ("npm", "crypto-js", "crypto-js", "UNKNOWN", "library", False),
    ("npm", "node-forge", "node-forge", "UNKNOWN", "library", False),
    ("pypi", "pycrypto", "pycrypto", "UNKNOWN", "library", True),
    ("pypi", "pycryptodome", "pycryptodome", "UNKNOWN", "library", False),
    ("pypi", "pycryptodomex", "pycryptodomex", "UNKNOWN", "library", False),
    ("pypi", "cryptography", "cryptography", "UNKNOWN", "library", False),
    ("pypi", "pyopenssl", "pyopenssl", "UNKNOWN", "library", False),
]
# fixed values: language by ecosystem, longest evidence
LANGUAGES = {"pypi": "python", "npm": "javascript", "maven": "java"}
EVIDENCE = 255
_RECORD = "path string, ordinal int, line int, ecosystem string, name string, version string, scope string, declared string"


def _parsed(files: DataFrame) -> DataFrame:
    """Records of manifests that are parsed file by file; a file that can't be is one row without ordinal, with the reason as declared."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, name, content in zip(b["path"], b["name"], b["content"]):
                found, problem = parsers.dependencies(name, bytes(content))
                rows += [(path, k, 0, *own) for k, own in enumerate(found)]
                rows += [(path, None, 0, None, None, None, None, problem)] if problem else []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RECORD.split(", ")]).astype({"ordinal": "Int32"})

    return files.where(F.col("name").isin(*parsers.MANIFESTS) & F.col("content").isNotNull()).select("path", "name", "content").mapInPandas(parse, _RECORD)


def _requirements(files: DataFrame) -> DataFrame:
    return files.where("name like 'requirements%.txt' and content is not null").select("path", F.regexp_replace("name", "\\.txt$", "").alias("scope"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def dependency_records(files: DataFrame) -> DataFrame:
    """path, ordinal, line, ecosystem, name, version, scope, declared of all manifests among files (path, name, content).

    Requirement files are read by expressions, the others file by file. Files that are no UTF-8 or can't be parsed have no
    records (dependency_problems() says which); an exact version only, else null."""
    texts = _requirements(files)
    lines = manifests.requirements(texts.where("text is not null").withColumn("path", F.struct("path", "scope")))
    lines = lines.select("path.path", F.col("line").alias("ordinal"), "line", F.lit("pypi").alias("ecosystem"), "name", "version", "path.scope", "declared")
    return _parsed(files).where("ordinal is not null").unionByName(lines)


def dependency_problems(files: DataFrame) -> DataFrame:
    """path, problem of manifests that can't be read."""
    no_text = _requirements(files).where("text is null").select("path", F.lit("UnicodeDecodeError: no UTF-8").alias("problem"))
    return _parsed(files).where("ordinal is null").select("path", F.col("declared").alias("problem")).unionByName(no_text)


def dependency_findings(files: DataFrame, packages: list[tuple] = PACKAGES) -> DataFrame:
    """Packages that rules know, the first of each package and version in a file."""
    rules = rule_table(files.sparkSession, packages, "ecosystem string, package_name string, library string, algorithm string, primitive string, weak_by_default boolean")
    records = dependency_records(files).withColumn("package_name", manifests.package_name(F.col("name"), F.col("ecosystem")))
    hits = records.join(rules, ["ecosystem", "package_name"])
    first = hits.groupBy("path", "ecosystem", "package_name", "version", "algorithm").agg(F.min_by(F.struct("line", "scope", "declared", "library", "primitive", "weak_by_default"), "ordinal").alias("r"))
    language = F.expr("CASE ecosystem " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in LANGUAGES.items()) + " END")
    first = first.select(F.col("path").alias("file"), "algorithm", "r.*", F.left(F.concat_ws(": ", "r.scope", "r.declared"), F.lit(EVIDENCE)).alias("matched_call"), language.alias("language"), F.col("ecosystem").alias("package_ecosystem"), "package_name", F.col("version").alias("package_version"))
    return as_findings(first, detection_method="dependency_manifest", artifact_type="DEPENDENCY_MANIFEST", artifact_ref=F.col("file"))
