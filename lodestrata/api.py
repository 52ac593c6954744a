"""The inventory in a folder of tables: scans, pages of findings, bills of materials, intake of reports."""

from __future__ import annotations

import datetime as dt
import secrets
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bom, bundles, inventory, scan
from .operators import findings as ops
from .operators.commits import Committed

REPOSITORIES = "repo_id long, name string, url string, organization_id string, external_id string"
REPORTS = "report_id string, created_at timestamp, organization_id string, repository_id string, agent_id string, bundle_digest string, scan_id long, repo_id long"
SCANS = "scan_id long, repo_id long, started_at timestamp, at timestamp, ordinal int, status string"


class Inventory:
    """Tables `repositories`, `scans` (events of their states), `findings`, `assessments`, `reports` and `report_findings` below a
    folder. What a scan finds, and what an intake brings (its repositories and scans too), is written all or nothing.

    Ids of scans are made of the time and chance, so that several processes may scan at once; those of repositories are the
    largest so far and one, so one process at a time may add repositories."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.committed = Committed(spark, self.folder)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        if name in ("findings", "assessments", "reports", "report_findings"):
            return self.committed.read(name, schema)
        try:
            own = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            if schema is None:
                raise LookupError(f"no {name} yet") from None
            own = self.spark.createDataFrame([], schema)
        return own.unionByName(self.committed.read(f"sent_{name}", schema)) if name in ("repositories", "scans") else own

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def _next(self, name: str, column: str, schema: str) -> int:
        return (self.table(name, schema).agg(F.max(column)).first()[0] or 0) + 1

    def repository(self, name: str, url: str | None = None, organization_id: str | None = None, external_id: str | None = None) -> int:
        """The id of the repository with this organization's id, address or name; a new one where there is none."""
        wanted = self.spark.createDataFrame([(name, url, organization_id, external_id)], REPOSITORIES.split(", ", 1)[1])
        found = inventory.resolve_repositories(wanted, self.table("repositories", REPOSITORIES)).first().repo_id
        if found is None:
            found = self._next("repositories", "repo_id", REPOSITORIES)
            self._append("repositories", self.spark.createDataFrame([(found, name, url, organization_id, external_id)], REPOSITORIES))
        return found

    def _state(self, scan_id: int, repo_id: int, started: dt.datetime, ordinal: int, status: str) -> None:
        self._append("scans", self.spark.createDataFrame([(scan_id, repo_id, started, dt.datetime.now(), ordinal, status)], SCANS))

    def run_scan(self, root: str, repo_id: int, types=("source",), min_band: str = "PROBABLE", **options) -> int:
        """Scans a tree and stores what passes the band; the scan's id. A scan that fails is marked so, and its error is raised."""
        scan_id, started = time.time_ns() // 1_000_000 << 20 | secrets.randbits(20), dt.datetime.now()
        self._state(scan_id, repo_id, started, 0, "running")
        try:
            raw = inventory.band_gate(scan.tree_findings(self.spark, root, types), min_band)
            found = scan.in_order(scan.prepare(raw, root, **options), "finding_id").drop("engine").withColumn("scan_id", F.lit(scan_id).cast("long"))
            inventory.persist(found.withColumn("id", F.concat_ws("-", "scan_id", "finding_id")), self.committed, f"scan-{scan_id}")
        except Exception:
            self._state(scan_id, repo_id, started, 1, "failed")
            raise
        self._state(scan_id, repo_id, started, 1, "completed")
        return scan_id

    def scans(self) -> DataFrame:
        events = self.table("scans", SCANS)
        return events.select("scan_id", "repo_id", "started_at").distinct().join(inventory.current_scans(events).drop("at"), "scan_id")

    def list_scans(self, repo_id: int | None = None, limit: int = 50) -> DataFrame:
        return inventory.list_scans(self.scans(), repo_id, limit)

    def scan_detail(self, scan_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The scan, its findings with their assessments, its counts by tier."""
        own, summary = inventory.scan_detail(self.table("findings"), scan_id)
        return self.scans().where(F.col("scan_id") == scan_id), inventory.with_assessments(own, self.table("assessments").drop("scan_id")), summary

    def query_findings(self, scan_id: int, sort_by: str | None = None, descending: bool = False, limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame, DataFrame]:
        """A page, one row with total_filtered, and the counts by tier of the scan, which the filters don't change."""
        own, summary = inventory.scan_detail(self.table("findings"), scan_id)
        chosen = ops.select_findings(own, **filters)
        return ops.page(chosen, sort_by, descending, limit, offset), chosen.agg(F.count("*").alias("total_filtered")), summary

    def get_finding(self, scan_id: int, finding_id: str):
        row = inventory.find_in_scan(self.table("findings"), scan_id, finding_id).first()
        if row is None:
            raise LookupError(f"no finding {finding_id} in scan {scan_id}")
        return row

    def remediate(self, scan_id: int, finding_id: str):
        self.get_finding(scan_id, finding_id)
        return inventory.remediation_text(inventory.find_in_scan(self.table("findings"), scan_id, finding_id)).first()

    def export_bom(self, scan_id: int) -> str:
        """The scan's bill of materials as JSON text. A scan that is not completed, or a document with issues, is an error."""
        own = self.scans().where(F.col("scan_id") == scan_id)
        state = own.first()
        if state is None:
            raise LookupError(f"no scan {scan_id}")
        if state.status != "completed":
            raise ValueError(f"scan {scan_id} is {state.status}")
        found = self.table("findings").where(F.col("scan_id") == scan_id)
        assessed = self.table("assessments").where(F.col("scan_id") == scan_id).drop("scan_id").withColumnRenamed("finding_id", "assessed_id")
        sent = self.table("reports", REPORTS)
        own = own.join(sent.select("scan_id", "report_id"), "scan_id", "left")
        documents = bom.documents(found.join(assessed, found.id == assessed.assessed_id, "left"), own, reports=sent)
        text = documents.first().document
        wrong = bom.issues(self.spark.createDataFrame([(scan_id, text)], "doc long, text string")).collect()
        if wrong:
            raise ValueError(f"the document has issues: {[(r.code, r.path) for r in wrong]}")
        return text

    def ingest_bundles(self, reports: DataFrame, key: str | None = None) -> int:
        """Stores reports that are new, each as a completed scan of its repository, and their findings, scored here; all or
        nothing. The number of new reports. A key that has been stored is not stored again.

        A repository is known by its organization and the id that it has there; ids of new repositories and of scans are derived
        from these and from the report, so that no order of writes matters."""
        if key is not None and self.committed.done(key):
            return 0
        for name in ("organization_id", "repository_id", "agent_id", "digest"):
            if name not in reports.columns:
                reports = reports.withColumn(name, F.lit(None).cast("string"))
        new, scored = inventory.ingest(reports, self.table("reports", REPORTS))
        derived = lambda *of: F.shiftrightunsigned(F.xxhash64(*of), 2)
        new = new.select("report_id", "created_at", "organization_id", "repository_id", "agent_id", F.col("digest").alias("bundle_digest"), derived(F.lit("report"), "report_id").alias("scan_id"))
        new = inventory.stored(new, "new")
        found = new.count()
        if not found:
            return 0
        asked = new.select(F.coalesce("repository_id", F.lit("unknown")).alias("name"), F.lit(None).cast("string").alias("url"), "organization_id", F.col("repository_id").alias("external_id")).distinct()
        resolved = inventory.stored(inventory.resolve_repositories(asked, self.table("repositories", REPOSITORIES)).withColumn("known", F.col("repo_id").isNotNull()).withColumn("repo_id", F.coalesce("repo_id", derived(F.lit("repository"), "organization_id", "name"))), "resolved")
        own = new.join(resolved.select("repo_id", F.col("organization_id").alias("of"), F.col("name").alias("called")), F.col("organization_id").eqNullSafe(F.col("of")) & (F.coalesce("repository_id", F.lit("unknown")) == F.col("called"))).drop("of", "called")
        own = inventory.stored(own, "own")
        scored = inventory.stored(scored.join(own.select("report_id", "scan_id"), "report_id"), "scored")
        findings = scored.withColumns({"finding_id": F.col("ordinal").cast("long"), "id": F.concat_ws("-", "scan_id", "ordinal")})
        self.committed.write(key or f"intake-{secrets.token_hex(8)}", {
            "sent_repositories": resolved.where("not known").select(*(x.split()[0] for x in REPOSITORIES.split(", "))),
            "sent_scans": own.select("scan_id", "repo_id", F.col("created_at").alias("started_at"), F.col("created_at").alias("at"), F.lit(1).alias("ordinal"), F.lit("completed").alias("status")),
            "findings": findings.drop("report_id", "ordinal", *inventory.ASSESSED),
            "assessments": findings.select(F.col("id").alias("finding_id"), "scan_id", *inventory.ASSESSED),
            "report_findings": scored.drop("scan_id"),
            "reports": own,
        })
        return found

    def ingest_folder(self, folder: str) -> DataFrame:
        """Takes in all bundles of a folder of files; source, report_id and reason of those that are refused."""
        found = inventory.stored(bundles.read(self.spark, folder), "checked")
        self.ingest_bundles(bundles.reports(found))
        return found.where("reason is not null").select("source", "report_id", "reason")

    def ingest_stream(self, folder: str, checkpoint: str):
        """A query that takes in bundles as their files arrive. A batch that is repeated after a failure is stored once."""

        def batch(checked: DataFrame, number: int) -> None:
            self.ingest_bundles(bundles.reports(checked), f"stream-{checkpoint.rsplit('/', 1)[-1]}-{number}")

        return bundles.read_stream(self.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
