"""Bills of cryptographic materials: components of scored findings, documents by scan, and the checks of documents.

Components are rows; a document is put together only where it is written. The checks work on rows too, so that a document of
any size is never one value in a task, except for the JSON text that comes in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import risk
from ..sources.stored import stored

OWN = "lodestrata:"  # before the names of properties that the format doesn't have
TIERS = (*risk.TIERS, "UNSCORED")
SUMMARY, PROVENANCE = "x-risk-summary", "x-report-provenance"
REPORT = ("report_id", "agent_id", "organization_id", "bundle_digest", "signature_algorithm", "classification")
# fixed values: algorithm, its primitive and functions in a bill of materials
ASSETS = [
    ("MD5", "hash", ["digest"]),
    ("SHA-1", "hash", ["digest"]),
    ("SHA-256", "hash", ["digest"]),
    ("SHA-384", "hash", ["digest"]),
    ("SHA-512", "hash", ["digest"]),
    ("HMAC", "mac", ["mac"]),
    ("DES", "blockCipher", ["encrypt", "decrypt"]),
    ("3DES", "blockCipher", ["encrypt", "decrypt"]),
    ("RC4", "streamCipher", ["encrypt", "decrypt"]),
    ("AES", "blockCipher", ["encrypt", "decrypt"]),
    ("AES-256", "blockCipher", ["encrypt", "decrypt"]),
    ("RSA", "publicKeyEncryption", ["encapsulate", "decapsulate", "sign", "verify"]),
    ("ECC", "other", ["keyGenerate", "keyDerive"]),
    ("DSA", "signature", ["sign", "verify"]),
    ("TLS", "other", ["auth"]),
    ("TLS-1.0", "other", ["auth"]),
    ("TLS-1.1", "other", ["auth"]),
    ("TLS-1.2", "other", ["auth"]),
    ("TLS-1.3", "other", ["auth"]),
]
#: Properties of a component in their order: name, and how null and boolean values are written.
_PROPERTIES = [("risk_tier", "UNSCORED"), ("criticality", "MEDIUM"), ("risk_reason", None), ("source_context", "SOURCE"), ("confidence_band", None), ("confidence_score", None), ("detection_method", None), ("artifact_type", None)]
_PROPERTIES += [(x, None) for x in ("risk_model_version", "classical_broken", "quantum_vulnerable", "hndl_exposure", "recommended_replacement", "recommendation_type", "migration_effort_days", "data_shelf_life_years", "quantum_threat_horizon_years", "assumption_source")]


def components(findings: DataFrame, scan: str = "scan_id", ref: str = "id") -> DataFrame:
    """scan, ref, component (a struct as it is written), tier and reason for each scored finding. Algorithms are taken as they are
    named; a key size of 0 is none; properties without a value are left out."""
    table = F.broadcast(findings.sparkSession.createDataFrame(ASSETS, "asset string, asset_primitive string, asset_functions array<string>"))
    rows = findings.withColumn("asset_name", F.when(F.coalesce("algorithm", F.lit("")) == "", "UNKNOWN").otherwise(F.col("algorithm"))).join(table, F.col("asset_name") == F.col("asset"), "left")
    size = F.nullif(F.col("key_size"), F.lit(0)) if "key_size" in findings.columns else F.lit(None).cast("int")
    value = lambda x, default: F.coalesce(F.col(x).cast("string"), F.lit(default)) if x in findings.columns else F.lit(default).cast("string")
    properties = F.filter(F.array(*(F.struct(F.lit(OWN + x).alias("name"), value(x, default).alias("value")) for x, default in _PROPERTIES)), lambda p: p["value"].isNotNull())
    algorithm = F.struct(F.coalesce("asset_primitive", F.lit("other")).alias("primitive"), F.lit("softwarePlainRam").alias("implementationLevel"), F.coalesce("asset_functions", F.array().cast("array<string>")).alias("cryptoFunctions"), size.cast("string").alias("parameterSetIdentifier"), size.alias("keySize"))
    where = F.coalesce("file", F.lit("unknown"))
    confidence = F.coalesce("confidence", F.lit("unverified")) if "confidence" in findings.columns else F.lit("unverified")
    component = F.struct(
        F.lit("cryptographic-asset").alias("type"),
        F.concat(F.lit("finding-"), F.col(ref)).alias("bom-ref"),
        F.col("asset_name").alias("name"),
        F.concat_ws("-", "asset_name", size.cast("string")).alias("version"),
        F.concat(F.col("asset_name"), F.lit(" detected at "), where, F.lit(":"), F.coalesce("line", F.lit(0)), F.lit(" (confidence="), confidence, F.lit(")")).alias("description"),
        F.struct(F.lit("algorithm").alias("assetType"), algorithm.alias("algorithmProperties")).alias("cryptoProperties"),
        F.struct(F.array(F.struct(where.alias("location"), F.col("line").alias("line"))).alias("occurrences")).alias("evidence"),
        properties.alias("properties"),
    )
    return rows.select(F.col(scan).alias("scan"), F.col(ref).cast("string").alias("ref"), component.alias("component"), value("risk_tier", "UNSCORED").alias("tier"), value("risk_reason", None).alias("reason"))


def provenance(scans: DataFrame, reports: DataFrame | None) -> Column:
    """Where a scan comes from, with the columns of its report joined: a bundle that an agent sent, or this system's own scan."""
    local = F.struct(F.lit("local-api").alias("origin"), F.lit("not-signed-bundle").alias("integrity"), *(F.lit(None).cast("string").alias(x) for x in REPORT))
    if reports is None:
        return local
    sent = F.struct(F.lit("offline-agent-signed-bundle").alias("origin"), F.lit(None).cast("string").alias("integrity"), *(F.col(f"report.{x}").cast("string").alias(x) if x in reports.columns else F.lit(None).cast("string").alias(x) for x in REPORT))
    return F.when(F.col("report").isNotNull(), sent).otherwise(local)


def documents(findings: DataFrame, scans: DataFrame, scan: str = "scan_id", ref: str = "id", reports: DataFrame | None = None) -> DataFrame:
    """scan, document (JSON text) for each completed scan (scan_id, started_at, status): its components in the order of refs, the
    counts by tier, and where it comes from: the one of the reports that its report_id names, or this system. Serial numbers are
    derived from the scan and the content, so that a repeated run gives the same text.

    A document is one row by its nature; its size is that of one scan's findings."""
    known = reports is not None and "report_id" in scans.columns
    scans = scans.where("status = 'completed'").select(F.col(scan).alias("scan"), F.col("started_at"), *(["report_id"] if known else []))
    if known:
        held = reports.groupBy("report_id").agg(F.min(F.struct(*(x for x in REPORT if x in reports.columns))).alias("report"))
        scans = scans.join(held, "report_id", "left")
    own = components(findings, scan, ref)
    counted = own.groupBy("scan").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref", "component"))), lambda x: x["component"]).alias("components"), F.count("*").alias("total"), *(F.count_if(F.col("tier") == t).alias(t) for t in TIERS))
    out = scans.join(counted, "scan", "left")
    number = F.md5(F.concat_ws("|", F.col("scan").cast("string"), F.to_json("components")))
    serial = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(number, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    tool = F.struct(F.lit("lodestrata").alias("name"), F.lit("1.0.0").alias("version"))
    document = F.struct(
        F.lit("CycloneDX").alias("bomFormat"),
        F.lit("1.6").alias("specVersion"),
        serial.alias("serialNumber"),
        F.lit(1).alias("version"),
        F.struct(F.date_format(F.col("started_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.array(tool).alias("tools"), F.struct(F.lit("application").alias("type"), F.concat(F.lit("scan-"), F.col("scan")).alias("name"), F.lit("1").alias("version")).alias("component")).alias("metadata"),
        F.coalesce("components", F.array().cast(counted.schema["components"].dataType)).alias("components"),
        F.array().cast("array<string>").alias("externalReferences"),
        F.struct(*(F.coalesce(t, F.lit(0).cast("long")).alias(t) for t in ("total", *TIERS))).alias(SUMMARY),
        provenance(scans, reports if known else None).alias(PROVENANCE),
    )
    return out.select("scan", F.to_json(document).alias("document"))


def _issue(code: str, path: Column | str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), (path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(message).alias("message"))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


_NONE = "cast(null as struct<code:string,path:string,message:string>)"
_INT, _TEXT = ("BIGINT",), ("STRING",)


def _get(value: Column, *keys: str) -> Column:
    return F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in keys), "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _check(value: Column, path: Column | str, kinds: tuple[str, ...], ok: Column | None = None, required: bool = True, literal: bool = False) -> Column:
    """What is wrong with a field, or null. A literal of another type has a wrong value, not a wrong type."""
    none = F.expr(_NONE)
    out = F.when(value.isNull(), _issue("FIELD_MISSING", path, "Field required.") if required else none)
    if not required:
        out = out.when(_kind(value) == "VOID", none)
    if not literal:
        out = out.when(~_kind(value).isin(*kinds), _issue("FIELD_WRONG_TYPE", path, f"Must be {' or '.join(kinds)}."))
    if ok is not None:
        out = out.when(~F.coalesce(ok, F.lit(False)), _issue("FIELD_INVALID_VALUE", path, "Value is not allowed."))
    return out.otherwise(none)


def _among(value: Column, *allowed: str) -> Column:
    return (_kind(value) == "STRING") & _text(value).isin(*allowed)


def _filled(value: Column) -> Column:
    return F.length(_text(value)) > 0


def _within(value: Column, least: int) -> Column:
    return F.try_variant_get(value, "$", "long") >= least


def issues(texts: DataFrame, key: str = "doc") -> DataFrame:
    """key, code, path, message: what is wrong with documents (key, text), in the order of key, path, code and message. Valid ones
    have no row.

    Where the structure is wrong nothing else is checked, as in the format's own rules. Of a bom-ref that is there more than
    once the second place is named."""
    # written once, so that the texts are parsed once for all checks
    parsed = stored(texts.select(key, F.try_parse_json("text").alias("v")), "documents")
    bad = F.when(F.col("v").isNull(), _issue("NOT_JSON_SERIALIZABLE", "", "Document is not JSON.")).when(_kind(F.col("v")) != "OBJECT", _issue("DOCUMENT_NOT_OBJECT", "", "Document must be a JSON object."))
    parsed = parsed.withColumn("bad", bad)
    docs = parsed.where("bad is null")
    v = F.col("v")
    meta, summary = _get(v, "metadata"), _get(v, SUMMARY)
    serial, time = _get(v, "serialNumber"), _get(v, "metadata", "timestamp")
    own = [
        _check(_get(v, "bomFormat"), "/bomFormat", _TEXT, _among(_get(v, "bomFormat"), "CycloneDX"), literal=True),
        _check(_get(v, "specVersion"), "/specVersion", _TEXT, _among(_get(v, "specVersion"), "1.6"), literal=True),
        _check(serial, "/serialNumber", _TEXT, _text(serial).rlike("^urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        _check(_get(v, "version"), "/version", _INT, _within(_get(v, "version"), 1)),
        _check(meta, "/metadata", ("OBJECT",)),
        _check(_get(v, "components"), "/components", ("ARRAY",)),
        _check(_get(v, "externalReferences"), "/externalReferences", ("ARRAY",), required=False),
        _check(summary, f"/{SUMMARY}", ("OBJECT",), required=False),
    ]
    below = lambda holder, check: F.when(_kind(holder) == "OBJECT", check)
    own += [below(meta, _check(time, "/metadata/timestamp", _TEXT, F.try_to_timestamp(F.replace(_text(time), F.lit("T"), F.lit(" "))).isNotNull())), below(meta, _check(_get(meta, "tools"), "/metadata/tools", ("ARRAY", "OBJECT")))]
    part = _get(meta, "component")
    own += [below(meta, _check(part, "/metadata/component", ("OBJECT",), required=False)), *(below(part, _check(_get(part, x), f"/metadata/component/{x}", _TEXT, _filled(_get(part, x)))) for x in ("type", "name"))]
    own += [below(summary, _check(_get(summary, t), f"/{SUMMARY}/{t}", _INT, _within(_get(summary, t), 0))) for t in ("total", *TIERS)]
    found = docs.select(key, F.explode(F.array_compact(F.array(*own))).alias("i"))

    listed = docs.where(_kind(_get(v, "components")) == "ARRAY").select(key, F.posexplode(F.try_variant_get(v, "$.components", "array<variant>")).alias("at", "part"))
    listed = stored(listed, "components")
    p, at = F.col("part"), F.concat(F.lit("/components/"), F.col("at"))
    crypto, evidence = _get(p, "cryptoProperties"), _get(p, "evidence")
    asset = _get(crypto, "assetType")
    to = lambda tail: F.concat(at, F.lit(tail))
    own = [
        F.when(_kind(p) != "OBJECT", _issue("FIELD_WRONG_TYPE", at, "Must be OBJECT.")),
        *(below(p, x) for x in (
            _check(_get(p, "type"), to("/type"), _TEXT, _among(_get(p, "type"), "cryptographic-asset"), literal=True),
            _check(_get(p, "bom-ref"), to("/bom-ref"), _TEXT, _filled(_get(p, "bom-ref"))),
            _check(_get(p, "name"), to("/name"), _TEXT, _filled(_get(p, "name"))),
            _check(crypto, to("/cryptoProperties"), ("OBJECT",)),
            _check(evidence, to("/evidence"), ("OBJECT",)),
            _check(_get(p, "properties"), to("/properties"), ("ARRAY",)),
        )),
        below(crypto, _check(asset, to("/cryptoProperties/assetType"), _TEXT, _among(asset, "algorithm", "certificate", "protocol", "related-crypto-material"), literal=True)),
        below(crypto, _check(_get(crypto, "algorithmProperties"), to("/cryptoProperties/algorithmProperties"), ("OBJECT",), required=False)),
        below(crypto, F.when(_among(asset, "algorithm") & F.coalesce(_kind(_get(crypto, "algorithmProperties")), F.lit("VOID")).isin("VOID", ""), _issue("FIELD_INVALID_VALUE", to("/cryptoProperties"), "An algorithm needs algorithmProperties."))),
        below(evidence, _check(_get(evidence, "occurrences"), to("/evidence/occurrences"), ("ARRAY",), F.size(F.try_variant_get(evidence, "$.occurrences", "array<variant>")) > 0)),
    ]
    found = found.unionByName(listed.select(key, F.explode(F.array_compact(F.array(*own))).alias("i")))
    inner = lambda path, name: listed.select(key, "at", F.posexplode(F.try_variant_get(p, path, "array<variant>")).alias("k", "x")).withColumn("to", F.concat(at, F.lit(name), F.col("k")))
    places, properties = inner("$.evidence.occurrences", "/evidence/occurrences/"), inner("$.properties", "/properties/")
    x = F.col("x")
    field = lambda name, kinds, ok, required=True: _check(_get(x, name), F.concat("to", F.lit("/" + name)), kinds, ok, required)
    deep = lambda rows, *checks: rows.select(key, F.explode(F.array_compact(F.array(F.when(_kind(x) != "OBJECT", _issue("FIELD_WRONG_TYPE", F.col("to"), "Must be OBJECT.")), *(below(x, y) for y in checks)))).alias("i"))
    found = found.unionByName(deep(places, field("location", _TEXT, _filled(_get(x, "location"))), field("line", _INT, _within(_get(x, "line"), 0), False)))
    found = found.unionByName(deep(properties, field("name", _TEXT, _filled(_get(x, "name"))), field("value", _TEXT, None)))

    # taken of all documents; where the structure is wrong they are left out below
    refs = listed.select(key, "at", _text(_get(p, "bom-ref")).alias("ref")).withColumn("n", F.row_number().over(W.partitionBy(key, "ref").orderBy("at")))
    more = [refs.where("n = 2").select(key, _issue("BOM_REF_DUPLICATE", F.concat(F.lit("/components/"), "at", F.lit("/bom-ref")), "bom-ref must be unique.").alias("i"))]
    values = lambda name: F.transform(F.filter(F.try_variant_get(p, "$.properties", "array<struct<name:string,value:string>>"), lambda y: y["name"] == OWN + name), lambda y: y["value"])
    tiers = listed.select(key, to("/properties").alias("to"), values("risk_tier").alias("tier"), values("criticality").alias("critical"))
    tier_ok = (F.size("tier") == 1) & F.get("tier", F.lit(0)).isin(*TIERS)
    wrong = F.array(
        F.when(F.size("tier") != 1, _issue("RISK_TIER_PROPERTY_MISSING", F.col("to"), "A component has exactly one tier.")).when(~tier_ok, _issue("RISK_TIER_PROPERTY_INVALID", F.col("to"), "No such tier.")),
        F.when(F.exists("critical", lambda y: ~y.isin("CRITICAL", "HIGH", "MEDIUM", "LOW")), _issue("CRITICALITY_PROPERTY_INVALID", F.col("to"), "No such criticality.")),
    )
    more.append(tiers.select(key, F.explode(F.array_compact(wrong)).alias("i")))
    counts = tiers.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(tier_ok & (F.get("tier", F.lit(0)) == t)).alias(t) for t in TIERS))
    stated = docs.where(_kind(summary) == "OBJECT").select(key, *(F.try_variant_get(summary, f"$.{t}", "long").alias(f"said_{t}") for t in ("total", *TIERS)))
    both = stated.join(counts, key, "left")
    off = [F.when(F.coalesce(t, F.lit(0)) != F.col(f"said_{t}"), _issue("SUMMARY_TOTAL_MISMATCH" if t == "total" else "SUMMARY_TIER_MISMATCH", f"/{SUMMARY}/{t}", "The summary does not match the components.")) for t in ("total", *TIERS)]
    more.append(both.select(key, F.explode(F.array_compact(F.array(*off))).alias("i")))
    structure = reduce(DataFrame.unionByName, [parsed.where("bad is not null").select(key, F.col("bad").alias("i")), found]).withColumn("level", F.lit(1))
    out = structure.unionByName(reduce(DataFrame.unionByName, more).withColumn("level", F.lit(2)))
    out = out.withColumn("least", F.min("level").over(W.partitionBy(key))).where("level = least")
    return out.select(key, "i.*").orderBy(key, "path", "code", "message")
