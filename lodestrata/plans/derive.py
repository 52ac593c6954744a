"""Finding-shaped relations from the test tables, by arithmetic on their integer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence
from .tables_sql import SCORE_SQL

NAMES = ["MD5", "sha1", "SHA-256", "DES", "3des", "RC4", "aes-256-gcm", "RSA", "ec", "DSA", "TLSv1.0", "tls1.2"]
SIZES = [None, 1024, 2048, 3072, None]
FOLDERS = ["src/auth", "src/api", "tests", "examples/demo", "lib/core", "app"]
LANGUAGES = ["python", "java", "javascript"]
SIGNALS = ["import_resolved", "call_site_matched", "expected_module_confirmed", "literal_algorithm_arg", "rule_yaml_matched", "key_size_extracted", "import_unresolved"]
BITS = [1, 2, 3, 5, 7, 11, 13]  # a signal is there where its number does not divide the key


DEALT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of which much is made, some to each of many tasks by their keys: a few MB of a table would be one task, and its files
    GBs. A task gets some DEALT rows however many there are, so that what it holds doesn't grow with the table."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DEALT))
    return rows.repartition(tasks, *keys)


def pick(values: list, key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int") + 1)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scan_id, line, algorithm, key_size, file, language, signals, supplied_shelf_life, confidence_score, confidence_band."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") + F.col("l_linenumber")
    signals = F.array_compact(F.array(*(F.when(key % b != 0 if b > 1 else F.lit(True), s) for s, b in zip(SIGNALS, BITS))))
    out = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"),
        F.col("l_orderkey").alias("scan_id"),
        F.col("l_linenumber").cast("int").alias("line"),
        pick(NAMES, "l_partkey").alias("algorithm"),
        pick(SIZES, "l_suppkey").cast("int").alias("key_size"),
        F.concat(pick(FOLDERS, "l_suppkey"), F.lit("/f"), F.col("l_partkey") % 7, F.lit(".py")).alias("file"),
        pick(LANGUAGES, "l_partkey").alias("language"),
        signals.alias("signals"),
        F.when(F.col("l_quantity").cast("int") % 3 > 0, (F.col("l_quantity").cast("int") % 25).cast("double")).alias("supplied_shelf_life"),
    )
    return out.withColumn("confidence_score", confidence.score(F.col("signals"))).withColumn("confidence_band", confidence.band(F.col("confidence_score")))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


def layer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind for each image, path and layer."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_partkey") % 2 == 0, "WHITEOUT").otherwise("OPAQUE")).otherwise("FILE")
    path = F.when(kind == "OPAQUE", F.concat(F.lit("d"), F.col("l_partkey") % 3)).when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("d"), F.col("l_partkey") % 3)).otherwise(F.concat(F.lit("d"), F.col("l_partkey") % 3, F.lit("/f"), F.col("l_partkey") % 4))
    return li.select((F.col("l_orderkey") % 100).alias("image"), F.col("l_linenumber").cast("int").alias("layer_index"), path.alias("path"), kind.alias("kind"))


FINDINGS_SQL = f"""raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id, l_orderkey AS scan_id, CAST(l_linenumber AS INT) AS line, l_partkey + l_linenumber AS k,
    ['MD5', 'sha1', 'SHA-256', 'DES', '3des', 'RC4', 'aes-256-gcm', 'RSA', 'ec', 'DSA', 'TLSv1.0', 'tls1.2'][l_partkey % 12 + 1] AS algorithm, CAST([NULL, 1024, 2048, 3072, NULL][l_suppkey % 5 + 1] AS INT) AS key_size,
    ['src/auth', 'src/api', 'tests', 'examples/demo', 'lib/core', 'app'][l_suppkey % 6 + 1] || '/f' || (l_partkey % 7) || '.py' AS file, ['python', 'java', 'javascript'][l_partkey % 3 + 1] AS language,
    CASE WHEN CAST(l_quantity AS INT) % 3 > 0 THEN CAST(CAST(l_quantity AS INT) % 25 AS DOUBLE) END AS supplied_shelf_life FROM lineitem
), weighed AS (SELECT *, greatest(0, least(100, {SCORE_SQL})) AS hundredths FROM raw
), findings AS (
  SELECT * EXCLUDE (hundredths, k), CAST(hundredths / 100.0 AS DECIMAL(3, 2)) AS confidence_score,
    CASE WHEN hundredths >= 85 THEN 'VERIFIED' WHEN hundredths >= 60 THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS confidence_band FROM weighed
)"""
LAYERS_SQL = """kinds AS (
  SELECT l_orderkey % 100 AS image, CAST(l_linenumber AS INT) AS layer_index, l_partkey AS p,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 2 = 0 THEN 'WHITEOUT' ELSE 'OPAQUE' END ELSE 'FILE' END AS kind FROM lineitem
), entries AS (
  SELECT image, layer_index, kind, CASE WHEN kind = 'OPAQUE' OR p % 4 = 0 THEN 'd' || (p % 3) ELSE 'd' || (p % 3) || '/f' || (p % 4) END AS path FROM kinds
)"""
SCANS_SQL = "scans AS (SELECT o_orderkey AS scan_id, o_custkey AS repo_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status FROM orders)"
