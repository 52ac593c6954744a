"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Pieces, by_bytes


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than `limit` tokens) to the doc_id of every row.

    Texts are whole, null texts are empty. Each task takes texts in batches of about equal bytes and cuts long ones at
    safe boundaries, so that its memory does not depend on how texts are spread. A .model file of sentencepiece has no such
    boundaries: its texts are encoded whole. There is no shuffle. Repeated rows and null
    ids give their own rows; further columns are ignored; an empty table gives an empty result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            ids = b.column(0)
            for start, texts in by_bytes(b.column(1)):
                n = pieces.counts(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
