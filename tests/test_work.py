"""What queries do once: files are read a single time, and by many tasks."""

import pyarrow as pa
import pytest

from lodestrata.operators import calls
from lodestrata.plans import artefact_queries, derive, inventory_queries, registry, scans

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [artefact_queries.template_and_element_calls, inventory_queries.java_js_calls])
def test_sources_are_read_once(spark, query):
    assert plan(query(spark, DIR)).count("MapInArrow") == 1


def test_a_call_stays_where_its_file_is_read(spark):
    """The first of the rules that a call matches is found without a shuffle of all calls."""
    assert "Aggregate" not in plan(inventory_queries.java_js_calls(spark, DIR))


def test_copies_of_a_file_are_parsed_once(monkeypatch):
    """Those in a batch, if they are of one language; each has its calls, in the order of files."""
    one, other, none = b"import c from 'crypto'\nc.createHash('md5'); f(g(1))", b"import { createHmac as m } from 'crypto'\nm('sha1')", b"f(1)"
    read, own = [], calls.code.Source
    monkeypatch.setattr(calls.code, "Source", lambda text, *more: read.append((text, *more)) or own(text, *more))
    files = [("a", ".js", one), ("b", ".js", none), ("c", ".js", other), ("d", ".mjs", one), ("e", ".ts", one), ("f", ".js", other)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary()))], names=["rel_path", "ext", "content"])
    got = [(r["file"], r["language"], r["module"], r["method"], r["text"]) for out in calls.read_calls([batch], {"java": set(), "javascript": {"createHash", "createHmac"}}) for r in out.to_pylist()]
    assert len(read) == 4
    md5, sha1 = ("crypto", "createHash", "md5"), ("crypto", "m", "sha1")
    assert got == [("a", "javascript", *md5), ("c", "javascript", *sha1), ("d", "javascript", *md5), ("e", "typescript", *md5), ("f", "javascript", *sha1)] * 50


def test_files_are_made_by_many_tasks(spark):
    rows = derive.table(spark, DIR, "part").selectExpr("p_partkey AS id", "0 AS shape").coalesce(1)
    files = scans._files(rows, [("a.txt", "x")])
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert files.count() == rows.count()


@pytest.mark.parametrize("query", [artefact_queries.nested_module_settings, scans.config_findings])
def test_settings_are_parsed_once(spark, query):
    assert plan(query(spark, DIR)).count("MapInArrow") == 1


def test_python_sources_are_read_once(spark):
    assert plan(inventory_queries.python_call_findings(spark, DIR)).count("MapInPandas") == 1


def test_requirement_files_are_read_by_many_tasks(spark):
    assert registry.requirement_lines(spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_documents_are_checked_by_many_tasks(spark, monkeypatch):
    given = []
    monkeypatch.setattr(inventory_queries.bom, "issues", lambda texts: given.append(texts) or texts.selectExpr("doc", "'' AS code", "'' AS path"))
    inventory_queries.bom_issues(spark, DIR)
    assert given[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_findings_of_one_fingerprint_stay_apart(spark, monkeypatch):
    """Decisions come to the findings; what a task holds is bounded by the rows that it is dealt."""
    monkeypatch.setattr(derive, "DEALT", 200)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = inventory_queries.triage_carried_forward(spark, DIR)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "hashpartitioning(fingerprint" not in text.split("BroadcastExchange")[0]
        rows = derive.table(spark, DIR, "lineitem").count()
        assert out.rdd.getNumPartitions() == max(4 * spark.sparkContext.defaultParallelism, -(-rows // 200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
