"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common as c
from lodestrata.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from lodestrata.llm.common import shared_dir


KEY_SEEDS = 20


def _key(seed: int, name: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(name).isNull(), name, "text")


def row_key(rows: DataFrame, name: str) -> Column:
    """64 bits that tell rows apart by their id, which may be null, and their text.

    Among 10**10 rows a few pairs of different ones have the same 64 bits. An aggregate finds these by a digest of 128 bits, and
    they get other keys."""
    digest = F.md5(F.concat(F.coalesce(F.col(name).cast("string"), F.lit("none")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("none"))))
    key = _key(0, name)
    for seed in range(1, KEY_SEEDS):
        ends = rows.select(key.alias("key"), digest.alias("digest")).groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        clashing = [r["key"] for r in ends.where("low <> high").select("key").collect()]  # n * n / 2**65 rows on average
        if not clashing:
            return key
        key = F.when(key.isin(clashing), _key(seed, name)).otherwise(key)
    raise RuntimeError("keys of rows clash")


def wrapped(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its key, so that no name of docs clashes with another one."""
    return docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"), row_key(docs, "doc_id").alias("row_key"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("doc")[x].alias(x) for x in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null texts have no words and go; repeated rows are judged each; null languages
    and sources are groups of their own; columns stay, whatever their names; an empty table stays empty."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones (five-word shingles, similarity 0.8).

    Rows are compared one by one, those without a doc_id too, and so are different texts of one doc_id; the first is the one
    of the least doc_id, those without one last. Of rows with equal doc_id and text the one stays whose columns come first as
    JSON. Null and empty texts link with nothing and stay; long texts are compared whole; columns stay, whatever their names;
    an empty table stays empty."""
    rows = wrapped(docs)
    groups = jaccard_join.similar_groups(rows.select(F.col("row_key").alias("doc_id"), F.col("doc.text").alias("text")), n=5, percent=80)
    linked = groups.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    several = linked.where("row_key <> component_id").select("component_id").distinct()
    members = c.materialize(linked.join(several, "component_id").join(rows.select("row_key", "doc.doc_id").distinct(), "row_key"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key"))
    gone = members.select("row_key").join(first.select("row_key"), "row_key", "left_anti")
    left = rows.join(gone, "row_key", "left_anti")
    others = [F.col("doc")[x].alias(x) for x in docs.columns if x not in ("doc_id", "text")]
    one = left.groupBy("row_key").agg(F.min_by("doc", F.to_json(F.struct(*others), {"ignoreNullFields": "false"})).alias("doc")) if others else left.dropDuplicates(["row_key"])
    return unwrapped(one, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows are judged one by one by their whole texts, repeated ones and those without a doc_id too. Null and empty texts hold no
    passage and stay; items without an id count, those without text don't; columns stay, whatever their names; an empty table
    stays empty, and an empty benchmark takes nothing away."""
    rows = wrapped(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    items = benchmark.select(row_key(benchmark, "item_id").alias("item_id"), "text")
    found = decontaminate.matches(rows.select(F.col("row_key").alias("doc_id"), F.col("doc.text").alias("text")), items)
    return unwrapped(rows.join(found.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for each secret that looks live.

    Null and empty texts stay as they are, long ones are searched whole; each of repeated rows stays; null sources and languages
    are owners of their own; columns stay, whatever their names; an empty table stays empty."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null and empty texts are one piece of one token; long ones are cut into pieces, none is lost; repeated rows are packed
    each; null doc_ids stay null; further columns are ignored; an empty table gives no piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", sequences)]

ORACLE_SQL = None  # quantile sketches, SimHash and a tokenizer are beyond SQL; tests/llm has plain versions of the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
