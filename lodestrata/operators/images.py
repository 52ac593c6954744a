"""Findings of container images: packages and keys in the files that the layers leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.finding import as_findings
from ..sources import der
from ..sources.images import ImageSource
from .findings import merged_layers
from .packages import kept_path, package_findings

# fixed values: most bytes of a file that may be a key, headers, suffixes, primitives by name of the key
MOST = 2 << 20
HEADERS = ("-----BEGIN CERTIFICATE-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----")
SUFFIXES = (".der", ".crt", ".cer")
SIGNALS = ("import_resolved", "call_site_matched", "expected_module_confirmed", "literal_algorithm_arg")
_KEY = "file string, matched_call string, algorithm string, key_size int, weak_by_default boolean"


def key_findings(files: DataFrame) -> DataFrame:
    """Certificates and private keys among files (file, path, content) of 2 MiB at most. Only what looks like one is read."""
    content = F.col("content")
    pem = F.lit(False)
    for header in HEADERS:
        pem = pem | F.contains(content, F.lit(header.encode()))
    der_file = content.startswith(F.lit(b"\x30")) & (F.length(content) >= 4) & F.regexp_extract("path", "(\\.[^./]*)$", 1).isin(*SUFFIXES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(file, *own) for file, raw in zip(b["file"], b["content"]) for own in der.keys_of(bytes(raw))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _KEY.split(", ")]).astype({"key_size": "Int32"})

    found = files.where((F.length(content) <= MOST) & (pem | der_file)).select("file", "content").mapInPandas(read, _KEY)
    primitive = F.when(F.col("algorithm") == "RSA", "publicKeyEncryption").when(F.col("algorithm").isin("DSA", "ECDSA", "Ed25519"), "digitalSignature").when(F.col("matched_call").contains("x509"), "publicKeyEncryption").otherwise("key_exchange")
    signals = F.array_compact(F.array(*map(F.lit, SIGNALS), F.when(F.col("key_size").isNotNull(), "key_size_extracted")))
    out = found.withColumns({"primitive": primitive, "confidence_signals": signals, "line": F.lit(0)})
    return as_findings(out, library="openssl", language="n/a", detection_method="certificate_parse", artifact_type="CONTAINER_LAYER", artifact_ref=F.col("file")).withColumn("confidence", F.lit("high"))


def certificate_findings(files: DataFrame) -> DataFrame:
    """Keys in certificate and key files that stand alone (rel_path, content)."""
    found = key_findings(files.select(F.col("rel_path").alias("file"), F.col("rel_path").alias("path"), "content"))
    return found.withColumn("artifact_type", F.lit("SOURCE_FILE"))


def read_images(spark: SparkSession, root: str, most: int = 1 << 31) -> DataFrame:
    """Entries of all images at or below root; what can't be read is a row of kind PROBLEM."""
    spark.dataSource.register(ImageSource)
    return spark.read.format("image_layers").options(maxBytes=most, problems="rows").load(root)


def within_limit(entries: DataFrame, most: int = 1 << 31) -> tuple[DataFrame, DataFrame]:
    """Entries of the images whose layers unpack to `most` bytes in all, and problems (source, path, image, layer_index, problem) of
    the others, with the layer where a running sum over the layers goes beyond the limit, and of what couldn't be read."""
    sizes = entries.where("kind = 'FILE'").groupBy("source", "image", "layer_index").agg(F.sum("size").alias("size"))
    # a row for each layer of an image
    running = sizes.withColumn("total", F.sum("size").over(W.partitionBy("source", "image").orderBy("layer_index")))
    over = running.where(F.col("total") > most).groupBy("source", "image").agg(F.min("layer_index").alias("layer_index"))
    over = over.withColumn("problem", F.lit(f"more than {most} bytes"))
    read = entries.where("kind = 'PROBLEM'").select("source", "image", "layer_index", "problem")
    problems = over.unionByName(read).withColumn("path", F.col("source"))
    return entries.join(problems.select("source").distinct(), "source", "left_anti"), problems


def image_findings(entries: DataFrame) -> DataFrame:
    """image and findings of layer entries (image, layer, layer_index, path, kind, content): of files that later layers leave,
    each in the layer that it is from."""
    entries = entries.where("kind <> 'PROBLEM'")
    left = merged_layers(entries.select("image", "path", "layer_index", "kind"))
    files = entries.where("kind = 'FILE'").join(left, ["image", "path", "layer_index"])
    database = F.when(F.col("path") == "var/lib/dpkg/status", "deb").when(F.col("path") == "lib/apk/db/installed", "apk").when(F.col("path").rlike("^var/lib/rpm/Packages[^/]*$"), "rpm")
    # the image goes along in front of the layer's digest, and is cut off again
    mark = F.concat_ws("\u001f", "image", "layer")
    packages = package_findings(files.select(mark.alias("layer"), database.alias("ecosystem"), "content").where("ecosystem is not null and content is not null"))
    keys = key_findings(files.where(kept_path() & F.col("content").isNotNull()).select(F.concat_ws(":", mark, "path").alias("file"), "path", "content"))
    both = packages.unionByName(keys)
    part = lambda k: F.split("file", "\u001f")[k]
    return both.select(part(0).alias("image"), part(1).alias("file"), *(x for x in both.columns if x not in ("file", "artifact_ref"))).withColumn("artifact_ref", F.col("file"))
