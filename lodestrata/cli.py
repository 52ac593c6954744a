"""The command line: scans a tree or an image and ends with 0, with 2 where a finding violates the policy, or with 1 on an error.

python -m lodestrata.cli TARGET --scan-type source --scan-type config --fail-on HIGH --json-out findings.json"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import confidence, risk
from .operators import bundles, scan
from .operators import findings as ops
from .sources.stored import stored

VIOLATED, FAILED = 2, 1
PRINTED = 100_000  # findings printed at most; more have to go to a folder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description="Finds cryptographic assets in sources, manifests, settings, executables and container images.")
    p.add_argument("target", help="file, tree or container image, mounted on every machine")
    p.add_argument("--scan-type", action="append", choices=scan.TYPES, help="repeatable; source where none is given")
    p.add_argument("--min-confidence", choices=list(confidence.RANKS), help="leaves out findings of lower bands before anything else")
    p.add_argument("--fail-on", choices=list(ops.TIER_RANK), help="ends with 2 where a finding has this tier or a worse one")
    p.add_argument("--json-out", metavar="PATH", help="writes the findings as one JSON array")
    p.add_argument("--out", metavar="FOLDER", help="writes the findings as JSON lines, in parallel, and prints none of them")
    p.add_argument("--summary-only", action="store_true", help="prints counts only")
    p.add_argument("--problems", action="store_true", help="reports files that can't be read on the error stream")
    p.add_argument("--redact-paths", action="store_true")
    p.add_argument("--source-context", choices=("SOURCE", "TEST_ONLY", "DEMO_ONLY"))
    p.add_argument("--data-shelf-life-years", type=float)
    p.add_argument("--max-bytes", type=int, default=1 << 31, help="of a file or image")
    for name in ("--report-bundle", "--organization-id", "--repository-id", "--agent-id"):
        p.add_argument(name, metavar="PATH" if name == "--report-bundle" else None)
    return p


def _as_json(findings: DataFrame) -> list[dict]:
    rows = findings.orderBy("finding_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(PRINTED + 1).collect()
    if len(rows) > PRINTED:
        raise ValueError(f"more than {PRINTED} findings; name a folder with --out")
    return [json.loads(r.j) for r in rows]


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout, err=sys.stderr) -> int:
    target, types = os.path.realpath(args.target), args.scan_type or ["source"]
    if not os.path.exists(target):
        print(f"error: target does not exist: {target}", file=err)
        return FAILED
    if args.data_shelf_life_years is not None and args.data_shelf_life_years < 0:
        print("error: --data-shelf-life-years must be non-negative", file=err)
        return FAILED
    if args.report_bundle and not (args.organization_id and args.repository_id and args.agent_id):
        print("error: --report-bundle requires --organization-id, --repository-id and --agent-id", file=err)
        return FAILED
    try:
        found, _ = scan.run_scan(spark, target, types, args.min_confidence, redact=args.redact_paths, most=args.max_bytes, shelf_life=args.data_shelf_life_years, source_context=args.source_context)
        found = scan.in_order(found, "finding_id").drop("engine").withColumn("id", F.col("finding_id"))
        found = stored(found, "scan")  # counted, judged and written from one table
        summary = ops.scan_summary(found).first().asDict()
        violated = bool(args.fail_on) and ops.gate(found, args.fail_on).first().violated
        if args.problems:
            for r in scan.tree_problems(spark, target, types, args.max_bytes).orderBy("scan", "path").limit(PRINTED).collect():
                print(f"[warn] {r.scan}: {r.path}: {r.problem}", file=err)
        if args.out:
            found.write.json(args.out)
        listed = _as_json(found) if args.json_out or args.report_bundle or not (args.summary_only or args.out) else []
        result = {"summary": summary, "findings": listed}
        if args.report_bundle:
            context = {"source_root": os.path.basename(target), "path_redaction": args.redact_paths, "data_shelf_life_years": args.data_shelf_life_years, "source_context": args.source_context, "scanner_mode": "offline_local"}
            bundle = bundles.build(args.organization_id, args.repository_id, args.agent_id, listed, summary, context)
            with open(args.report_bundle, "w", encoding="utf-8") as f:
                json.dump(bundle, f, indent=2)
            result["report_bundle"] = {"path": args.report_bundle, "digest": bundle["bundle_digest"]}
        if args.summary_only or args.out:
            print(json.dumps({"summary": summary, "policy": args.fail_on}, indent=2), file=out)
        else:
            print(json.dumps(result if args.report_bundle else listed, indent=2), file=out)
        if args.json_out:
            with open(args.json_out, "w", encoding="utf-8") as f:
                json.dump(listed, f, indent=2)
    except Exception as e:  # noqa: BLE001  the exit code says that the scan failed
        print(f"error: {type(e).__name__}: {str(e).splitlines()[0]}", file=err)
        return FAILED
    return VIOLATED if violated else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
