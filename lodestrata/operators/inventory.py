"""The inventory of repositories, scans, findings, reports and agents: intake, coercion, queries over them, chains and gates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence, risk
from ..functions.rules import BROADCAST
from ..sources.stored import stored
from . import findings as ops
from .commits import Committed
from .numbering import carried, numbered, previous

# fixed values: states of scans, criticalities, kinds of artefacts, ecosystems
SCAN_STATES = ("pending", "running", "completed", "failed")
CRITICALITIES = ("MEDIUM", "HIGH", "CRITICAL")
ARTIFACTS = ("SOURCE_FILE", "DEPENDENCY_MANIFEST", "CONFIG_FILE", "BINARY", "CONTAINER_LAYER")
ECOSYSTEMS = ("pypi", "npm", "maven", "deb", "apk", "rpm")
# fixed values: names that a finding's fields may have, in lower case without spaces, and the field
FIELD_NAMES = [
    ("file", "file"), ("filepath", "file"), ("file_path", "file"), ("path", "file"), ("line", "line"), ("line_number", "line"), ("lineno", "line"), ("algorithm", "algorithm"), ("algo", "algorithm"),
    ("key_size", "key_size"), ("keysize", "key_size"), ("keylength", "key_size"), ("key_length", "key_size"), ("confidence", "confidence"), ("matched_call", "matched_call"), ("library", "library"),
    ("primitive", "primitive"), ("language", "language"), ("weak_by_default", "weak_by_default"), ("detection_method", "detection_method"), ("source_context", "source_context"),
    ("risk_tier", "risk_tier"), ("risktier", "risk_tier"), ("severity", "risk_tier"), ("tier", "risk_tier"), ("risk_reason", "risk_reason"), ("riskreason", "risk_reason"), ("reason", "risk_reason"),
    ("criticality", "criticality"), ("confidence_score", "confidence_score"), ("confidencescore", "confidence_score"), ("confidence_band", "confidence_band"), ("confidenceband", "confidence_band"),
    ("confidence_signals", "confidence_signals"), ("confidencesignals", "confidence_signals"), ("artifact_type", "artifact_type"), ("artifacttype", "artifact_type"), ("artifact_ref", "artifact_ref"), ("artifactref", "artifact_ref"),
    ("package_ecosystem", "package_ecosystem"), ("packageecosystem", "package_ecosystem"), ("package_name", "package_name"), ("packagename", "package_name"), ("package_version", "package_version"), ("packageversion", "package_version"),
    ("image_digest", "image_digest"), ("imagedigest", "image_digest"), ("layer_digest", "layer_digest"), ("layerdigest", "layer_digest"),
]
# fixed values: resource, action, roles that may
PERMISSIONS = [
    ("scans", "create", ["DEVELOPER", "SECURITY_ADMIN"]),
    ("scans", "read", ["AUDITOR", "DEVELOPER", "SECURITY_ADMIN"]),
    ("scans", "delete", ["SECURITY_ADMIN"]),
    ("findings", "read", ["AUDITOR", "DEVELOPER", "SECURITY_ADMIN"]),
    ("findings", "triage", ["DEVELOPER", "SECURITY_ADMIN"]),
    ("cbom", "export", ["AUDITOR", "DEVELOPER", "SECURITY_ADMIN"]),
    ("remediation", "generate", ["DEVELOPER", "SECURITY_ADMIN"]),
    ("remediation", "read", ["AUDITOR", "DEVELOPER", "SECURITY_ADMIN"]),
    ("agents", "read", ["AUDITOR", "SECURITY_ADMIN"]),
    ("agents", "manage", ["SECURITY_ADMIN"]),
    ("audit", "read", ["AUDITOR", "SECURITY_ADMIN"]),
    ("trends", "read", ["AUDITOR", "DEVELOPER", "SECURITY_ADMIN"]),
    ("users", "manage", ["SECURITY_ADMIN"]),
]


def permissions(spark) -> DataFrame:
    return spark.createDataFrame(PERMISSIONS, "resource string, action string, roles array<string>")


def allowed(requests: DataFrame) -> DataFrame:
    """Adds allowed to requests (role, resource, action); what no rule names is not."""
    table = F.broadcast(permissions(requests.sparkSession))
    return requests.join(table, ["resource", "action"], "left").withColumn("allowed", F.coalesce(F.array_contains("roles", F.col("role")), F.lit(False))).drop("roles")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def scanner_output(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (scan_id, ordinal, item) and errors (scan_id, bad_lines) of scanners' output (scan_id, text): one JSON array, or an
    object in each line. What is no object is left out; lines that are no JSON are counted."""
    text = F.regexp_replace("text", "^\\s+|\\s+$", "")
    texts = texts.select("scan_id", text.alias("text")).withColumn("v", F.when(F.col("text").startswith("["), F.try_parse_json("text")))
    whole = _kind(F.col("v")) == "ARRAY"
    listed = texts.where(whole).select("scan_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ordinal", "item"))
    lines = texts.where(~F.coalesce(whole, F.lit(False))).select("scan_id", F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("ordinal", "line"))
    lines = lines.where("trim(line) <> ''").withColumn("item", F.try_parse_json("line"))
    items = listed.unionByName(lines.where("item is not null").drop("line")).where(_kind(F.col("item")) == "OBJECT")
    return items, lines.where("item is null").groupBy("scan_id").agg(F.count("*").alias("bad_lines"))


def normalize(items: DataFrame) -> DataFrame:
    """Items (scan_id, ordinal, item) as findings: fields under any of their names (the first with a value), coerced, with
    defaults for what may not be null.

    All is done in an item's own row: its fields as an array in order, from which each column takes its best one."""
    known = F.create_map(*(F.lit(x) for pair in FIELD_NAMES for x in pair))
    entry = F.map_entries(F.try_variant_get("item", "$", "map<string,variant>"))
    named = F.transform(entry, lambda e, k: F.struct(F.element_at(known, F.replace(F.lower(e["key"]), F.lit(" "), F.lit(""))).alias("field"), (_text(e["value"]) == "").alias("empty"), k.alias("pos"), _kind(e["value"]).alias("kind"), F.coalesce(_text(e["value"]), F.to_json(e["value"])).alias("text"), F.to_json(e["value"]).alias("json")))
    given = F.filter(named, lambda e: e["field"].isNotNull() & (e["kind"] != "VOID"))
    # the least of each field's entries: those with a value come first
    best = F.aggregate(F.array_sort(given), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,text:string,json:string>>")), lambda m, e: F.when(F.map_contains_key(m, e["field"]), m).otherwise(F.map_concat(m, F.create_map(e["field"], F.struct(e["kind"].alias("kind"), e["text"].alias("text"), e["json"].alias("json"))))))
    rows = items.select("scan_id", "ordinal", best.alias("m"))
    kind = lambda f: F.try_element_at("m", F.lit(f))["kind"]
    text = lambda f: F.try_element_at("m", F.lit(f))["text"]
    trimmed = lambda f: F.nullif(F.regexp_replace(text(f), "^\\s+|\\s+$", ""), F.lit(""))
    whole = lambda f: F.when((kind(f) != "STRING") | trimmed(f).rlike("^[+-]?[0-9]+$"), F.floor(F.abs(trimmed(f).try_cast("double"))) * F.signum(trimmed(f).try_cast("double"))).try_cast("int")
    band = F.upper(trimmed("confidence_band"))
    band = F.when(band.isin(*confidence.RANKS), band)
    among = lambda value, known, default=None: F.when(value.isin(*known), value).otherwise(F.lit(default))
    signals = F.try_element_at("m", F.lit("confidence_signals"))
    listed = F.when(signals["kind"] == "ARRAY", signals["json"]).when(signals["kind"] == "STRING", signals["text"])
    return rows.select(
        "scan_id",
        "ordinal",
        F.coalesce(trimmed("file"), F.lit("UNKNOWN")).alias("file"),
        F.coalesce(whole("line"), F.lit(0)).alias("line"),
        F.coalesce(trimmed("algorithm"), F.lit("UNKNOWN")).alias("algorithm"),
        whole("key_size").alias("key_size"),
        *(text(x).alias(x) for x in ("library", "primitive", "language", "matched_call")),
        F.when(band.isNotNull(), confidence.legacy(band)).otherwise(F.lower(F.coalesce(trimmed("confidence"), F.lit("high")))).alias("confidence"),
        band.alias("confidence_band"),
        F.round(trimmed("confidence_score").try_cast("double"), 2).alias("confidence_score"),
        F.from_json(listed, "array<string>").alias("confidence_signals"),
        among(F.upper(trimmed("risk_tier")), risk.TIERS).alias("risk_tier"),
        among(F.upper(trimmed("criticality")), CRITICALITIES, "MEDIUM").alias("criticality"),
        among(F.upper(trimmed("artifact_type")), ARTIFACTS, "SOURCE_FILE").alias("artifact_type"),
        among(F.lower(trimmed("package_ecosystem")), ECOSYSTEMS).alias("package_ecosystem"),
    )


def band_gate(findings: DataFrame, min_band: str | None = None) -> DataFrame:
    """Findings of at least a band (PROBABLE where none or an unknown one is named); without a band of its own, a finding of high
    confidence counts as VERIFIED, any other as UNVERIFIED."""
    least = min_band if min_band in confidence.RANKS else "PROBABLE"
    band = F.coalesce(F.nullif("confidence_band", F.lit("")), F.when(F.col("confidence") == "high", "VERIFIED").otherwise("UNVERIFIED"))
    return findings.where(confidence.meets(band, least))


def scan_state(state: Column, default: str = "running") -> Column:
    return F.when(state.isin(*SCAN_STATES), state).otherwise(default)


def current_scans(events: DataFrame) -> DataFrame:
    """scan_id, status, at: the latest event of each scan (scan_id, at, ordinal, status); a state that is none is running."""
    return events.groupBy("scan_id").agg(F.max_by(F.struct(scan_state(F.col("status")).alias("status"), "at"), F.struct("at", "ordinal")).alias("s")).select("scan_id", "s.*")


def list_scans(scans: DataFrame, repo_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first; a repository's scans are chosen before the limit."""
    if repo_id is not None:
        scans = scans.where(F.col("repo_id") == repo_id)
    return scans.orderBy(F.col("started_at").desc_nulls_last(), F.col("scan_id").desc()).limit(limit)


def scan_detail(findings: DataFrame, scan_id) -> tuple[DataFrame, DataFrame]:
    """A scan's findings, and their counts by tier."""
    own = findings.where(F.col("scan_id") == scan_id)
    return own, ops.risk_summary(own)


def find_in_scan(findings: DataFrame, scan_id, finding_id) -> DataFrame:
    return findings.where((F.col("scan_id") == scan_id) & (F.col("id") == finding_id))


def with_assessments(findings: DataFrame, assessments: DataFrame) -> DataFrame:
    """Each finding with its assessment as one column, null where there is none."""
    nested = assessments.select(F.col("finding_id"), F.struct(*(x for x in assessments.columns if x != "finding_id")).alias("risk_assessment"))
    return findings.join(nested, findings.id == nested.finding_id, "left").drop("finding_id")


def resolve_repositories(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (name, url, organization_id, external_id) with repo_id, null where a new repository is needed, and match_key.

    The key is the organization with its own id, else the address, else the name of repositories without an address."""
    key = (
        F.when((F.coalesce("organization_id", F.lit("")) != "") & (F.coalesce("external_id", F.lit("")) != ""), F.struct(F.lit(1).alias("by"), F.col("organization_id").alias("a"), F.col("external_id").alias("b")))
        .when(F.coalesce("url", F.lit("")) != "", F.struct(F.lit(2).alias("by"), F.col("url").alias("a"), F.lit("").alias("b")))
        .otherwise(F.struct(F.lit(3).alias("by"), F.col("name").alias("a"), F.lit("").alias("b")))
    )
    ways = F.array(
        F.when(F.col("organization_id").isNotNull() & F.col("external_id").isNotNull(), F.struct(F.lit(1).alias("by"), F.col("organization_id").alias("a"), F.col("external_id").alias("b"))),
        F.when(F.col("url").isNotNull(), F.struct(F.lit(2).alias("by"), F.col("url").alias("a"), F.lit("").alias("b"))),
        F.when(F.col("url").isNull(), F.struct(F.lit(3).alias("by"), F.col("name").alias("a"), F.lit("").alias("b"))),
    )
    first = known.select("repo_id", F.explode(F.array_compact(ways)).alias("match_key")).groupBy("match_key").agg(F.min("repo_id").alias("repo_id"))
    return incoming.withColumn("match_key", key).join(first, "match_key", "left")


def ingest(bundles: DataFrame, known_reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports that are new (the first bundle of each report_id), and their findings scored here: tiers that clients send are not
    taken. bundles: report_id, created_at, findings (an array of structs with algorithm, key_size, file, line and more)."""
    new = ops.new_only(bundles, known_reports, "report_id", ["created_at"])
    rows = new.select("report_id", F.posexplode("findings").alias("ordinal", "f")).select("report_id", "ordinal", "f.*")
    return new.drop("findings"), risk.score_findings(rows.drop(*(x for x in rows.columns if x in ("risk_tier", "risk_reason", "criticality"))))


def carried_triage(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with the latest decision (fingerprint, updated_at, triage_id, status) on their fingerprint, null without one.

    Up to BROADCAST decisions go to every task, so that findings stay where they are and those of one fingerprint aren't brought
    together; more are joined as Spark sees fit."""
    last = triage.groupBy("fingerprint").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "triage_id")).alias("triage"))
    if triage.select("fingerprint").distinct().limit(BROADCAST + 1).count() <= BROADCAST:
        last = F.broadcast(last)
    return findings.join(last, "fingerprint", "left").select(findings["*"], F.col("triage.status").alias("triage_status"), F.col("triage.updated_at").alias("triaged_at"))


def triage_as_of(findings: DataFrame, triage: DataFrame, at: str = "started_at") -> DataFrame:
    """Findings with the latest decision (fingerprint, updated_at, triage_id, status) on their fingerprint that was made by the
    time `at` of their scan; later ones don't reach back. Null without one, without a time or without a fingerprint.

    Both sides are one table in the order of fingerprint and time, and decisions are carried along it by ranges, so that a
    fingerprint of very many findings is split over tasks."""
    spots = findings.select(F.col("fingerprint"), F.col(at).alias("time"), F.lit(1).alias("side"), F.lit(None).cast(triage.schema["triage_id"].dataType).alias("triage_id"), F.lit(None).cast("string").alias("status"), F.struct(*(f"`{c}`" for c in findings.columns)).alias("finding"))
    made = triage.select("fingerprint", F.col("updated_at").alias("time"), F.lit(0).alias("side"), "triage_id", F.col("status").cast("string").alias("status"), F.lit(None).cast(spots.schema["finding"].dataType).alias("finding"))
    known = F.col("side") == 0
    both = spots.unionByName(made.where("time is not null and fingerprint is not null"))
    out = carried(both, ["fingerprint"], ["time", "side", "triage_id"], F.when(known, F.struct("status", "time")), "decision").where("side = 1")
    valid = F.col("time").isNotNull() & F.col("fingerprint").isNotNull()
    return out.select("finding.*", F.when(valid, F.col("decision.status")).alias("triage_status"), F.when(valid, F.col("decision.time")).alias("triaged_at"))


def delivery_status(last: Column, now: Column, stale_after_hours: int) -> Column:
    return F.when(last.isNull(), "never_reported").when(last >= now - F.expr(f"INTERVAL {int(stale_after_hours)} HOURS"), "recent").otherwise("stale")


def agent_status(agents: DataFrame, reports: DataFrame, now: Column, stale_after_hours: int = 24) -> DataFrame:
    """Agents with the number of their reports, the last one and whether that is recent."""
    own = reports.groupBy("agent_id").agg(F.count("*").alias("report_count"), F.max("created_at").alias("last_report_at"), F.max_by("report_id", F.struct("created_at", "report_id")).alias("last_report_id"))
    out = agents.join(own, "agent_id", "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))
    return out.withColumn("delivery_status", delivery_status(F.col("last_report_at"), now, stale_after_hours))


AUDIT_KEYS = ("action", "actor_ref", "actor_type", "client_ip", "detail", "object_id", "object_type", "occurred_at", "organization_id", "outcome", "prev_hash")


def entry_hash(entry: dict) -> str:
    """SHA-256 of an entry's eleven fields as JSON with sorted keys and no spaces; detail is JSON text."""
    own = {k: entry.get(k) for k in AUDIT_KEYS}
    own["detail"] = json.loads(own["detail"]) if own["detail"] else None
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_entry_hash(entries: DataFrame) -> DataFrame:
    """Adds computed_hash; occurred_at is text with microseconds."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b[list(AUDIT_KEYS)].astype(object).where(b[list(AUDIT_KEYS)].notna(), None).to_dict("records")
            yield b.assign(computed_hash=[entry_hash(r) for r in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInPandas(compute, f"{schema}, computed_hash string")


def verify_chain(entries: DataFrame, by: str = "organization_id", recompute: bool = True) -> DataFrame:
    """ok, checked, first_bad_id, bad for each organization's chain: an entry is bad if its hash isn't that of its fields (where
    that is asked for), or its prev_hash isn't the hash of the entry before it.

    A chain is split over tasks by ranges of ids, and the last hash of a range is handed over to the next."""
    out = previous(with_entry_hash(entries) if recompute else entries, [by], ["id"], "entry_hash", "hash_before")
    bad = ~F.col("prev_hash").eqNullSafe(F.col("hash_before"))
    if recompute:
        bad = bad | ~F.col("entry_hash").eqNullSafe(F.col("computed_hash"))
    return out.groupBy(by).agg((F.count_if(bad) == 0).alias("ok"), F.count("*").alias("checked"), F.min(F.when(bad, F.col("id"))).alias("first_bad_id"), F.count_if(bad).alias("bad"))


def audit_events(events: DataFrame, *, since=None, until=None, after_id=None, **equal) -> DataFrame:
    """Events in order of id, filtered: equal names columns and their values; since is within, until is not."""
    for column, value in equal.items():
        if value is not None:
            events = events.where(F.col(column) == value)
    for value, test in ((since, lambda v: F.col("occurred_at") >= v), (until, lambda v: F.col("occurred_at") < v), (after_id, lambda v: F.col("id") > v)):
        if value is not None:
            events = events.where(test(value))
    return events.orderBy("id")


def risk_distribution(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by tier of the findings that have one; the total leaves out those without."""
    known = F.col("risk_tier").isNotNull()
    return findings.groupBy(*by).agg(F.count_if(known).alias("total"), *(F.count_if(F.col("risk_tier") == t).alias(t) for t in (*risk.TIERS, "UNSCORED")))


def trend(scans: DataFrame, repositories: DataFrame, findings: DataFrame) -> DataFrame:
    """scan_id, repo_id, repository, started_at and counts of each scan of a known repository: all findings, those without a tier
    too, and those of each tier. Findings are counted by scan before they meet the scans."""
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("risk_tier") == t).alias(t) for t in risk.TIERS))
    known = scans.join(repositories.select("repo_id", F.col("name").alias("repository")), "repo_id").join(counts, "scan_id", "left")
    return known.select("scan_id", "repo_id", "repository", "started_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *risk.TIERS)))


def compliance(scored: DataFrame, *by: str) -> DataFrame:
    """Counts by tier and band, of broken and quantum vulnerable findings and of files; the replacements that are due and the
    models that judged, which are as few as the rules."""
    return scored.groupBy(*by).agg(
        *ops.tier_counts(),
        *(F.count_if(F.col("confidence_band") == b).alias(b) for b in confidence.RANKS),
        F.count_if("classical_broken").alias("broken"),
        F.count_if("quantum_vulnerable").alias("quantum"),
        F.countDistinct("file").alias("files"),
        F.array_sort(F.collect_set("recommended_replacement")).alias("replacements"),
        F.array_sort(F.collect_set("risk_model_version")).alias("models"),
    )


def dashboard(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: scans that run, critical and quantum vulnerable findings, and for each tier its count, its part of the greatest
    count and its part of all."""
    active = scans.agg(F.count_if(F.col("status") == "running").alias("active_scans"))
    counts = findings.agg(F.count_if("quantum_vulnerable").alias("quantum"), *ops.tier_counts())
    tiers = (*risk.TIERS, "UNSCORED")
    most, part = F.greatest(*tiers), lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    bars = F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("n"), part(F.col(t), most).alias("of_greatest"), part(F.col(t), F.col("total")).alias("of_all")) for t in tiers))
    return active.join(F.broadcast(counts.select(F.col("CRITICAL").alias("critical"), "quantum", "total", bars.alias("tiers"))))  # one row each


def report_lines(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """place, line: a short report in words, of the counts in dashboard()."""
    one = dashboard(scans, findings)
    tier = lambda k: F.format_string("%s: %d findings, %.1f%% of all", F.col("tiers")[k]["tier"], F.col("tiers")[k]["n"], 100 * F.col("tiers")[k]["of_all"])
    lines = F.array(
        F.format_string("%d findings in all, %d scans are running.", "total", "active_scans"),
        F.format_string("%d are critical; %d rest on algorithms that quantum computers break.", "critical", "quantum"),
        *(tier(k) for k in range(5)),
    )
    return one.select(F.posexplode(lines).alias("place", "line"))


def of_organization(rows: DataFrame, repositories: DataFrame, organization_id: str) -> DataFrame:
    """Rows (with repo_id) of the repositories of one organization."""
    return rows.join(repositories.where(F.col("organization_id") == organization_id).select("repo_id"), "repo_id", "left_semi")


def first_and_latest(trend: DataFrame, key: str = "repo_id", at: str = "started_at", values: tuple[str, ...] = ("total", "critical")) -> DataFrame:
    """For each key the values of its first and latest scan, and the change between them."""
    order = F.struct(at, "scan_id")
    ends = trend.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("first"), F.max_by(F.struct(*values), order).alias("latest"))
    return ends.select(key, *(F.col(f"{end}.{v}").alias(f"{end}_{v}") for end in ("first", "latest") for v in values), *((F.col(f"latest.{v}") - F.col(f"first.{v}")).alias(f"{v}_change") for v in values))


def same_library(findings: DataFrame) -> DataFrame:
    """Findings of packages across engines: ways they were found and the worst tier, by ecosystem, name, version and algorithm;
    a package without a version is one of its own."""
    worst = F.min(ops.severity_rank())
    tier = reduce(lambda col, t: col.when(F.col("rank") == ops.TIER_RANK[t], t), risk.TIERS, F).otherwise("UNSCORED")
    out = findings.where("package_name is not null").groupBy("package_ecosystem", "package_name", "package_version", "algorithm").agg(F.sort_array(F.collect_set("artifact_type")).alias("found_as"), F.count("*").alias("findings"), worst.alias("rank"))
    return out.withColumn("risk_tier", tier).drop("rank")


def without_repositories(gone: DataFrame, repositories: DataFrame, scans: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of repositories, their scans and these scans' findings."""
    ids = gone.select("repo_id").distinct()
    left = scans.join(ids, "repo_id", "left_anti")
    return repositories.join(ids, "repo_id", "left_anti"), left, findings.join(left.select("scan_id"), "scan_id", "left_semi")


def positions(findings: DataFrame, *order: str) -> DataFrame:
    """finding_id and id: each finding's place from 0 in the order of file, line and what else is named."""
    return numbered(findings.drop("id"), "file", "line", *order, position="finding_id").withColumn("id", F.col("finding_id"))


def export_rows(findings: DataFrame) -> DataFrame:
    """The columns of the CSV export."""
    return findings.select(F.col("id").alias("ID"), F.col("file").alias("File"), F.col("algorithm").alias("Algorithm"), F.col("line").alias("Line"), F.col("risk_tier").alias("Risk Tier"), F.when(F.col("quantum_vulnerable"), "Yes").otherwise("No").alias("Quantum"), F.date_format("found_at", "yyyy-MM-dd").alias("Date"))


def write_findings(findings: DataFrame, path: str, kind: str = "json") -> None:
    """Findings as JSON lines or as quoted CSV with a header, in as many files as there are partitions."""
    if kind == "csv":
        export_rows(findings).write.option("header", True).option("quoteAll", True).csv(path)
    else:
        findings.write.json(path)


ASSESSED = ("classical_broken", "quantum_vulnerable", "hndl_exposure", "recommended_replacement", "recommendation_type", "migration_effort_days", "data_shelf_life_years", "quantum_threat_horizon_years", "assumption_source", "risk_model_version")


def persist(findings: DataFrame, at: Committed, key: str) -> bool:
    """Stores scored findings and their assessments under a key, both or neither, from one table that is written first; False
    where the key is stored already."""
    if at.done(key):
        return False
    found = stored(findings, "findings")
    return at.write(key, {"findings": found.drop(*ASSESSED), "assessments": found.select(F.col("id").alias("finding_id"), "scan_id", *ASSESSED)})


def remediation_text(findings: DataFrame) -> DataFrame:
    """Adds prompt: a question about the fix that the table has."""
    words = "In '%s', line %d uses %s. Our table names this fix: %s. Say in one or two sentences why the use is a risk and how the fix answers it, in the tone of a code review, and name no other fix."
    return ops.remediation(findings).withColumn("prompt", F.format_string(words, "file", "line", "algorithm", "fix"))
