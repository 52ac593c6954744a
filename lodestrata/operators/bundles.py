"""Report bundles: canonical JSON, digests, checks in a fixed order, files of bundles as a table or a stream. Bundles carry a
signature that whoever holds the keys checks; here it only has to be there."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: version and algorithm that bundles name, most bytes of one, fields that the digest leaves out
VERSION, ALGORITHM = "1.0", "Ed25519"
MOST = 1 << 20
OUTSIDE = ("signature", "signature_algorithm", "bundle_digest")
REASONS = ("too large", "no JSON object", "algorithm", "no digest or signature", "digest", "no report id")
_FILES = "path string, modificationTime timestamp, length long, content binary"
_CHECKED = "source string, report_id string, organization_id string, repository_id string, agent_id string, created_at string, digest string, reason string, body string"


def canonical(value) -> bytes:
    """JSON with sorted keys, no spaces and plain UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def digest(value: dict) -> str:
    return f"sha256:{hashlib.sha256(canonical({k: v for k, v in value.items() if k not in OUTSIDE})).hexdigest()}"


def build(organization_id: str, repository_id: str, agent_id: str, findings: list[dict], summary: dict, scan_context: dict, report_id: str | None = None) -> dict:
    """A bundle with its digest, ready to be signed."""
    ids = {"organization_id": organization_id.strip(), "repository_id": repository_id.strip(), "agent_id": agent_id.strip()}
    if not all(ids.values()):
        raise ValueError("a bundle needs an organization, a repository and an agent")
    own = {"bundle_version": VERSION, "report_id": report_id or str(uuid.uuid4()), "created_at": dt.datetime.now(dt.UTC).isoformat(), **ids, "scan_context": scan_context, "findings": findings, "summary": summary}
    return own | {"bundle_digest": digest(own)}


def _check(raw: bytes | None, length: int, most: int) -> tuple[str | None, str | None, dict]:
    """Digest, the first reason against a bundle, and what could be read."""
    if length > most or raw is None:
        return None, "too large", {}
    try:
        value = json.loads(raw)
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, "no JSON object", {}
    own = digest(value)
    if value.get("signature_algorithm") != ALGORITHM:
        return own, "algorithm", value
    if not isinstance(value.get("signature"), str) or not isinstance(value.get("bundle_digest"), str):
        return own, "no digest or signature", value
    if value["bundle_digest"] != own:
        return own, "digest", value
    if not isinstance(value.get("report_id"), str) or not value["report_id"]:
        return own, "no report id", value
    return own, None, value


def checked(bundles: DataFrame, most: int = MOST) -> DataFrame:
    """source, report_id, organization_id, repository_id, agent_id, created_at, digest, reason, body of bundles (source, length,
    content). The reason is the first of REASONS that holds, null for a good one; body is its canonical JSON."""
    names = [x.split()[0] for x in _CHECKED.split(", ")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, length, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own, reason, value = _check(content.as_py(), length, most)
                given = [value.get(k) if isinstance(value.get(k), str) else None for k in names[1:6]]
                rows.append((source, *given, own, reason, None if reason else canonical(value).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)] if rows else [pa.array([], pa.string())] * len(names), names=names)

    content = F.when(F.col("length") <= most, F.col("content"))
    return bundles.select(F.col("source").cast("string"), F.col("length").cast("long"), content.alias("content")).mapInArrow(check, _CHECKED)


def read(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """Checked bundles of a folder of files."""
    return checked(_bounded(spark.read.format("binaryFile").load(path)), most)


def read_stream(spark: SparkSession, folder: str, most: int = MOST) -> DataFrame:
    """The same as files arrive."""
    return checked(_bounded(spark.readStream.format("binaryFile").schema(_FILES).load(folder)), most)


def _bounded(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("source"), "length", "content")


FINDING = "file string, line int, matched_call string, library string, algorithm string, primitive string, language string, weak_by_default boolean, key_size int, detection_method string, confidence_band string, artifact_type string, artifact_ref string, package_name string, package_version string, data_shelf_life_years double"


def reports(good: DataFrame) -> DataFrame:
    """report_id, created_at, organization_id, repository_id, agent_id, digest, scan_context, findings of checked bundles without a
    reason, as inventory.ingest() takes them: each report once, the first by digest where there are several."""
    body = F.from_json("body", f"scan_context map<string,string>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")
    one = F.struct("digest", "created_at", "organization_id", "repository_id", "agent_id", "body")
    first = good.where("reason is null").groupBy("report_id").agg(F.min_by(one, F.struct("digest", "source")).alias("r")).select("report_id", "r.*").withColumn("parsed", body)
    findings = F.transform("parsed.findings", lambda f: f.withField("supplied_shelf_life", f["data_shelf_life_years"]).dropFields("data_shelf_life_years"))
    return first.select("report_id", F.to_timestamp("created_at").alias("created_at"), "organization_id", "repository_id", "agent_id", "digest", "parsed.scan_context", findings.alias("findings"))
