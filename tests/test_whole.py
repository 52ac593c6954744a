"""Queries against plain statements over whole tables."""

from collections import Counter

import duckdb

from lodestrata.plans import registry

DIR = "/root/testdata/sf0.001"


def test_remediation_has_the_whole_table(spark):
    fixes = {"MD5": "SHA-256 or BLAKE2", "SHA1": "SHA-256", "DES": "AES-256-GCM", "RSA_LT_2048_SIGNATURE": "RSA-3072+/Ed25519 now; ML-DSA (Dilithium-class) for PQC track", "RSA_LT_2048_KEYEXCHANGE": "ML-KEM (Kyber-class)"}
    got = {r.algorithm: r.fix for r in registry.QUERIES["remediation_by_algorithm"](spark, DIR).collect()}
    assert got == {a: fixes.get(a, "Manual review needed") for a in got} and got["MD5"] == "SHA-256 or BLAKE2"


def test_merged_layers_have_all_images(spark):
    con = duckdb.connect()
    want = con.sql(f"""WITH e AS (
      SELECT l_orderkey % 100 AS image, l_linenumber AS layer, CASE WHEN l_returnflag <> 'R' THEN 'FILE' WHEN l_partkey % 2 = 0 THEN 'WHITEOUT' ELSE 'OPAQUE' END AS kind,
        'd' || (l_partkey % 3) || CASE WHEN (l_returnflag = 'R' AND l_partkey % 2 = 1) OR l_partkey % 4 = 0 THEN '' ELSE '/f' || (l_partkey % 4) END AS path FROM '{DIR}/lineitem.parquet'
    ), f AS (SELECT image, path, max(layer) AS layer FROM e WHERE kind = 'FILE' GROUP BY ALL)
    SELECT image, path, layer FROM f WHERE NOT EXISTS (FROM e WHERE e.image = f.image AND e.kind <> 'FILE' AND e.layer > f.layer AND (e.kind = 'WHITEOUT' AND e.path = f.path OR starts_with(f.path, e.path || '/')))""").fetchall()
    got = registry.QUERIES["merged_layer_view"](spark, DIR).select("image", "path", "layer_index").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.image % 5 for r in got} == set(range(5))
