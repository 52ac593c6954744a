"""Packages of operating systems in image layers: databases read by expressions, joined with rules by name or prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..functions.rules import rule_table

# fixed values: ecosystem, package, library; all stand for RSA in public key encryption and are not weak by default
PACKAGES = [
    ("deb", "libssl3", "openssl"),
    ("deb", "libssl1.1", "openssl"),
    ("deb", "openssl", "openssl"),
    ("deb", "libgcrypt20", "libgcrypt"),
    ("deb", "libnss3", "nss"),
    ("deb", "libwolfssl", "wolfssl"),
    ("apk", "libcrypto3", "openssl"),
    ("apk", "libssl3", "openssl"),
    ("apk", "openssl", "openssl"),
    ("apk", "libgcrypt", "libgcrypt"),
    ("apk", "mbedtls", "mbedtls"),
    ("rpm", "openssl-libs", "openssl"),
    ("rpm", "openssl", "openssl"),
    ("rpm", "libgcrypt", "libgcrypt"),
    ("pypi", "cryptography", "cryptography"),
    ("pypi", "pycryptodome", "pycryptodome"),
    ("npm", "node-forge", "node-forge"),
    ("maven", "bcprov-jdk15on", "bouncycastle"),
    ("maven", "bcprov-jdk18on", "bouncycastle"),
]
# fixed values: folders of layers that are left out, at the beginning of a path or below; packages that RPM databases are searched for
LAYER_SKIP = ("proc", "sys", "dev", "run", "usr/share/doc", "usr/share/man", "usr/share/locale", "var/cache", "var/log")
RPM_NAMES = "openssl|libgcrypt|nss|gnutls"


def kept_path(path: str = "path"):
    p = F.col(path)
    out = F.lit(True)
    for folder in LAYER_SKIP:
        out = out & ~p.startswith(folder) & ~F.concat(F.lit("/"), p, F.lit("/")).contains(f"/{folder}/")
    return out


def _trimmed(x):
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def installed(databases: DataFrame) -> DataFrame:
    """layer, ecosystem, ordinal, package, version of package databases (layer, ecosystem deb, apk or rpm, content binary).

    deb: blocks with a Package whose Status is empty or has `installed` in it. apk: the last P: and V: of a block. rpm: names and
    versions that stand in the file's bytes. A package without a version has `unknown`."""
    text = F.decode("content", "ISO-8859-1")
    own = databases.select("layer", "ecosystem", F.when(F.col("ecosystem") == "rpm", text).otherwise(F.decode("content", "UTF-8")).alias("text"))
    blocks = own.where("ecosystem in ('deb', 'apk')").select("layer", "ecosystem", F.posexplode(F.split("text", "\n\n")).alias("ordinal", "block"))
    field = lambda name: _trimmed(F.regexp_extract("block", f"(?im)^{name}:([^\\n]*)$", 1))
    last = lambda mark: _trimmed(F.regexp_extract("block", f"(?s).*(?:^|\\n)[^\\S\\n]*{mark}:([^\\n]*)", 1))
    deb = F.col("ecosystem") == "deb"
    rows = blocks.select("layer", "ecosystem", "ordinal", F.when(deb, field("Package")).otherwise(last("P")).alias("package"), F.when(deb, field("Version")).otherwise(last("V")).alias("version"), F.when(deb, field("Status")).otherwise("").alias("status"))
    rows = rows.where("package <> '' and (status = '' or status like '%installed%')").drop("status")
    found = own.where("ecosystem = 'rpm'").select("layer", "ecosystem", F.posexplode(F.regexp_extract_all("text", F.lit("([a-zA-Z0-9_+-]{2,64})-([0-9][a-zA-Z0-9_.+-]{1,32})"), F.lit(0))).alias("ordinal", "hit"))
    part = lambda k: F.regexp_extract("hit", "^([a-zA-Z0-9_+-]{2,64})-([0-9][a-zA-Z0-9_.+-]{1,32})$", k)
    rpm = found.select("layer", "ecosystem", "ordinal", part(1).alias("package"), part(2).alias("version")).where(F.col("package").rlike(f"^({RPM_NAMES})"))
    return rows.unionByName(rpm).withColumn("version", F.when(F.col("version") == "", "unknown").otherwise(F.col("version")))


def package_findings(databases: DataFrame, packages: list[tuple] = PACKAGES) -> DataFrame:
    """Packages that a rule names, wholly or before a dash or underscore; of a package the first row and the first rule, in each
    layer's database. Rules are tried by the names' own beginnings, so that the join is one by equality."""
    rules = [(k, *r) for k, r in enumerate(packages)]
    rules = rule_table(databases.sparkSession, rules, "rule int, rule_ecosystem string, rule_package string, library string")
    name, wanted = F.col("package"), F.col("rule_package")
    # a rule's name is the whole name, or what stands before one of its dashes or underscores
    tries = F.filter(F.transform(F.sequence(F.lit(1), F.length("package")), lambda k: F.when((k == F.length("package")) | F.substring(name, k + 1, F.lit(1)).isin("-", "_"), F.substring(name, F.lit(1), k))), lambda x: x.isNotNull())
    tried = installed(databases).withColumn("tried", F.explode(tries))
    hits = tried.join(rules, (F.col("ecosystem") == F.col("rule_ecosystem")) & (F.col("tried") == wanted))
    first = hits.groupBy("layer", "ecosystem", "package").agg(F.min_by(F.struct("version", "library"), F.struct("ordinal", "rule")).alias("r"))
    where = F.concat_ws(":", "layer", "package")
    first = first.select(where.alias("file"), F.lit(0).alias("line"), F.concat(F.col("ecosystem"), F.lit(":"), "package", F.lit("=="), "r.version").alias("matched_call"), "r.library", F.col("ecosystem").alias("package_ecosystem"), F.col("package").alias("package_name"), F.col("r.version").alias("package_version"))
    signals = F.array(F.lit("import_resolved"), F.lit("expected_module_confirmed"), F.lit("rule_yaml_matched"))
    return as_findings(first, algorithm="RSA", primitive="publicKeyEncryption", language="n/a", weak_by_default=F.lit(False), confidence_signals=signals, detection_method="container_package_inventory", artifact_type="CONTAINER_LAYER", artifact_ref=F.col("file")).withColumn("confidence", F.lit("high"))
