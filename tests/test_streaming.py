"""Intake of reports as a stream."""

import datetime as dt

from lodestrata.streaming import intake

FINDINGS = "array<struct<file:string,line:int,algorithm:string,key_size:int,supplied_shelf_life:double>>"
SCHEMA = f"report_id string, created_at timestamp, findings {FINDINGS}"


def test_reports_once_and_counts_by_window(spark, tmp_path):
    at = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    md5, rsa = ("a.py", 1, "MD5", None, None), ("b.py", 2, "RSA", 1024, None)
    batches = [[("r1", at(1, 5), [md5, rsa]), ("r2", at(1, 40), [md5])], [("r1", at(1, 5), [md5, rsa]), ("r3", at(2, 10), [("c.py", 1, "odd", None, None)])], [("r4", at(9, 0), [])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in/")
    counted = intake.tiers_by_window(intake.scored(intake.once(stream, late="2 hours")))
    query = counted.writeStream.format("memory").queryName("tiers").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.window_start, r.total, r.CRITICAL, r.UNSCORED) for r in spark.table("tiers").collect()}
    assert got == {(at(1, 0), 3, 3, 0), (at(2, 0), 1, 0, 1)}
    query = intake.scored(intake.once(stream, late="2 hours")).writeStream.format("memory").queryName("all_found").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = [(r.report_id, r.ordinal, r.risk_tier) for r in spark.table("all_found").collect()]
    assert sorted(rows) == [("r1", 0, "CRITICAL"), ("r1", 1, "CRITICAL"), ("r2", 0, "CRITICAL"), ("r3", 0, "UNSCORED")]
