"""Tables that several writes share, all or nothing.

An attempt writes its rows to each table under a name of its own; one record in the table of commits, written last, makes them
count. Rows of attempts that broke off have no record and are never read. Writing a key again that is committed does nothing,
so that a batch of a stream can be repeated."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "key string, attempt string, at timestamp"


class Committed:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            if schema is None:
                raise LookupError(f"no {name} yet") from None
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """The attempt that counts of each key: the earliest, where two at once have been committed."""
        return self._read("commits", _RECORD).groupBy("key").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))

    def done(self, key: str) -> bool:
        return not self._read("commits", _RECORD).where(F.col("key") == key).isEmpty()

    def write(self, key: str, tables: dict[str, DataFrame]) -> bool:
        """Writes all tables and commits them; False, and nothing written, where the key is committed already."""
        if self.done(key):
            return False
        attempt = f"{key}/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.folder}/{name}")
        record = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
        record.write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """Rows of committed attempts. A table that no attempt has been committed to isn't there yet."""
        rows = self._read(name, f"{schema}, attempt string" if schema else None)
        return rows.join(self.commits().select("attempt"), "attempt", "left_semi").drop("attempt")
